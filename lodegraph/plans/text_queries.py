"""Registered queries: retrieval over documents, nodes and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import text, vectors
from lodegraph.plans.register import query
from lodegraph.sources.tables import GRAPH_SQL, star_graph, table
from lodegraph.storage import kept

G = "WITH RECURSIVE " + GRAPH_SQL
#: Documents as nodes.
D = "d AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS name, lang AS kind, source || '/' || doc_id AS file_path, text AS description FROM documents)"
TOK = "list_filter(regexp_split_to_array(lower(name || ' ' || kind || ' ' || file_path || ' ' || description), '[^a-z0-9]+'), lambda t: len(t) BETWEEN 2 AND 40)"
FTS = "list_filter(regexp_split_to_array(lower(name || ' ' || description || ' ' || file_path), '[^\\p{L}\\p{N}]+'), lambda t: len(t) > 0)"
WORDS = "The than licensed under the license"


def documents(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.col("lang").alias("kind"), F.concat_ws("/", "source", "doc_id").alias("file_path"), F.col("text").alias("description"), F.lit(False).alias("is_external"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: len(t) BETWEEN 2 AND 40), ' ') AS tokens FROM documents")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query(G + " SELECT id, name FROM g_nodes WHERE name ILIKE '%bolt%' OR description ILIKE '%bolt%' OR file_path ILIKE '%bolt%' ORDER BY id LIMIT 100")
def search_like(spark, sf):
    return text.search_like(star_graph(spark, sf).nodes, "bolt").select("id", "name")


@query(f"WITH {D}, p AS (SELECT id, unnest({FTS}) AS t FROM d) SELECT id FROM p GROUP BY id HAVING bool_or(t = 'license') AND bool_or(starts_with(t, 'vers'))")
def fts_prefix(spark, sf):
    return text.fts_prefix(documents(spark, sf), "license vers", None).select("id")


@query(f"""WITH {D}, p AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest({FTS}) AS t FROM d) GROUP BY 1, 2), l AS (SELECT id, sum(tf) AS len FROM p GROUP BY 1),
s AS (SELECT id, 0 AS slot, tf FROM p WHERE t = 'license' UNION ALL SELECT id, 1, sum(tf) FROM p WHERE starts_with(t, 'vers') GROUP BY id),
n AS (SELECT slot, count(*) AS n FROM s GROUP BY 1), c AS (SELECT (SELECT count(*) FROM d) AS nn, (SELECT sum(len) FROM l) AS total),
x AS (SELECT s.id, sum((CASE WHEN ln((nn - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((nn - n + 0.5) / (n + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / nn)))) AS score, count(*) AS k
FROM s JOIN n USING (slot) JOIN l ON l.id = s.id, c GROUP BY s.id) SELECT id, floor(score * 1000000 + 0.5) / 1000000.0 AS score FROM x WHERE k = 2""")
def bm25(spark, sf):
    return text.bm25(documents(spark, sf), "license vers", None).select("id", text.round_half_up(F.col("score"), 6).alias("score"))


_TFIDF = f"""WITH {D}, p AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest({TOK}) AS t FROM d) GROUP BY 1, 2), l AS (SELECT id, sum(tf) AS len FROM p GROUP BY 1),
f AS (SELECT t, ln(((SELECT count(*) FROM d) + 1) / (count(*) + 1)) + 1 AS idf FROM p GROUP BY t), w AS (SELECT p.id, p.t, p.tf / l.len * f.idf AS w FROM p JOIN l ON l.id = p.id JOIN f ON f.t = p.t),
nd AS (SELECT id, sqrt(sum(w * w)) AS nd FROM w GROUP BY id)"""
_QUERY = f""", qt AS (SELECT t, count(*) AS c FROM (SELECT unnest(regexp_split_to_array(lower('{WORDS}'), '[^a-z0-9]+')) AS t) GROUP BY t), q AS (
SELECT qt.t, qt.c / (SELECT sum(c) FROM qt) * coalesce(idf, 1) AS q FROM qt LEFT JOIN f ON f.t = qt.t)"""
_COS = """, s AS (SELECT w.id, sum(w.w * q.q) / ((SELECT sqrt(sum(q * q)) FROM q) * any_value(nd.nd)) AS raw FROM w JOIN q ON q.t = w.t JOIN nd ON nd.id = w.id GROUP BY w.id)
SELECT id, floor(raw * 1000 + 0.5) / 1000.0 AS score FROM s WHERE raw > 0 {where} ORDER BY floor(raw * 1000000000 + 0.5) DESC, id LIMIT {n}"""


def index(spark, sf):
    """The documents' index, built once a session."""
    made = {}

    def build(name):
        if not made:
            made.update(zip(("tfidf_docs", "tfidf_idf"), text.tfidf_index(documents(spark, sf))))
        return made[name]

    return text.Index(*(kept(spark, f"{name} {sf}", lambda name=name: build(name)) for name in ("tfidf_docs", "tfidf_idf")))


@query(_TFIDF + _QUERY + _COS.format(where="", n=20))
def tfidf_search(spark, sf):
    return text.tfidf_search(documents(spark, sf), WORDS, index=index(spark, sf))


@query(_TFIDF + ", q AS (SELECT t, w AS q FROM w WHERE id = '7')" + _COS.format(where="AND id <> '7'", n=10))
def tfidf_similar(spark, sf):
    return text.tfidf_similar(documents(spark, sf), "7", index=index(spark, sf))


@query(f"""WITH {D}, a AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM d WHERE description ILIKE '%license%' QUALIFY r < 50),
b AS (SELECT id, row_number() OVER (ORDER BY len(description) DESC, id) - 1 AS r FROM d QUALIFY r < 50)
SELECT id, floor(sum(1.0 / (60 + r + 1)) * 1000000 + 0.5) / 1000000.0 AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def rrf_merge(spark, sf):
    d = documents(spark, sf)
    a = text.ranked(d.where(F.col("description").ilike("%license%")).select("id"), 50, [F.col("id")])
    b = text.ranked(d.select("id", F.length("description").alias("n")), 50, [F.desc("n"), F.col("id")])
    return text.rrf([a, b]).select("id", text.round_half_up(F.col("score"), 6).alias("score"))


_EMB = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS y FROM v WHERE vec_id = 3)"


@query(f"WITH {_EMB}, s AS (SELECT vec_id AS node_id, list_cosine_similarity(x, y) AS c FROM v, q) SELECT node_id, floor(c * 1000000 + 0.5) / 1000000.0 AS score FROM s WHERE c > 0 ORDER BY floor(c * 1000000000 + 0.5) DESC, node_id LIMIT 50")
def dense_cosine(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    return vectors.cosine_to(v, v.where("node_id = 3"), 50).select("node_id", text.round_half_up(F.col("score"), 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), e AS (SELECT vec_id, label, unnest(x) AS x, unnest(generate_series(1, len(x))) AS i FROM v),
m AS (SELECT i, avg(x) AS m FROM e WHERE label = 2 GROUP BY i), c AS (SELECT vec_id AS node_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS c FROM e JOIN m USING (i) GROUP BY vec_id)
SELECT node_id, floor(c * 1000000 + 0.5) / 1000000.0 AS score FROM c WHERE c > 0 ORDER BY floor(c * 1000000000 + 0.5) DESC, node_id LIMIT 50""")
def centroid_search(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), "label")
    return vectors.cosine_to(v, vectors.centroid(v.where("label = 2")), 50).select("node_id", text.round_half_up(F.col("score"), 6).alias("score"))


_HYBRID = f"""WITH {D}, like_leg AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM (SELECT id FROM d WHERE name ILIKE '%license%' OR description ILIKE '%license%' OR file_path ILIKE '%license%' ORDER BY id LIMIT 100) QUALIFY r < 50),
p AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest({FTS}) AS t FROM d) GROUP BY 1, 2), l AS (SELECT id, sum(tf) AS len FROM p GROUP BY 1),
s AS (SELECT id, sum(tf) AS tf FROM p WHERE starts_with(t, 'license') GROUP BY id), c AS (SELECT (SELECT count(*) FROM d) AS nn, (SELECT sum(len) FROM l) AS total, (SELECT count(*) FROM s) AS n),
b AS (SELECT s.id, (CASE WHEN ln((nn - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((nn - n + 0.5) / (n + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / nn))) AS score FROM s JOIN l ON l.id = s.id, c),
bm_leg AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM b QUALIFY r < 50),
v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS y FROM v WHERE id = '3'),
cs AS (SELECT id, list_cosine_similarity(x, y) AS c FROM v, q), dn AS (SELECT id, c FROM cs WHERE c > 0 ORDER BY c DESC, id LIMIT 50),
vec_leg AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) - 1 AS r FROM dn),
f AS (SELECT id, sum(1.0 / (60 + r + 1)) AS score FROM (SELECT * FROM like_leg UNION ALL SELECT * FROM bm_leg UNION ALL SELECT * FROM vec_leg) GROUP BY id)
SELECT f.id, floor(score * (CASE WHEN name = 'src1' THEN 1.0 ELSE 1.0 END) * 10000 + 0.5) / 10000.0 AS score, name, kind, file_path FROM f JOIN d ON d.id = f.id ORDER BY 2 DESC, f.id LIMIT 20"""


@query(_HYBRID)
def hybrid_search(spark, sf):
    v = table(spark, sf, "embeddings")
    v = v.select(F.col("vec_id").cast("string").alias("node_id"), F.col("embedding").alias("vector"))
    target = v.where("node_id = '3'").first().vector
    return text.hybrid_search(documents(spark, sf), "license", v, target)


@query(f"WITH {D} SELECT name AS repo, id FROM d WHERE description ILIKE '%license%' OR file_path ILIKE '%license%' OR name ILIKE '%license%' QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) <= 10")
def registry_search(spark, sf):
    from lodegraph.sources.registry import search_repos

    return search_repos(documents(spark, sf).withColumn("repo", F.col("name")), "license", 10).select("repo", "id")


@query("SELECT CAST(doc_id AS VARCHAR) AS node_id, sha256(source || ' ' || lang || ' ' || source || '/' || doc_id || ' ' || text) AS text_hash FROM documents WHERE doc_id % 4 = 1 OR lang = 'de'")
def embed_incremental(spark, sf):
    d = documents(spark, sf)
    full = F.concat_ws(" ", "name", "kind", "file_path", "description")
    stored = d.where((F.col("id").cast("bigint") % 4 != 1)).select(F.col("id").alias("node_id"), vectors.text_hash(F.when(F.col("kind") == "de", F.lit("old")).otherwise(full)).alias("text_hash"), F.lit("hashing-64").alias("provider"))
    return vectors.embed(d, stored).select("node_id", "text_hash")


@query("SELECT conv_id, count(*) AS turns, CAST(sum(ceil(len(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_estimate(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))
