"""Registered queries: change risk, version-control text, communities and architecture."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions.text import round_half_up
from lodegraph.operators import community as com, graph as ops, risk
from lodegraph.plans.register import query
from lodegraph.sources import gitdiff
from lodegraph.sources.tables import EVENT_SQL, GRAPH_SQL, event_graph, star_graph, table

G = "WITH RECURSIVE " + GRAPH_SQL

# --- risk
_HITS = " + ".join(f"(CASE WHEN contains(t, '{k}') THEN {risk.WEIGHTS.get(k, 1)} ELSE 0 END)" for k in risk.KEYWORDS)
_EXT = " ".join("WHEN ext IN ({}) THEN {}".format(", ".join(f"'.{x}'" for x in names.split()), points) for points, names in risk.EXTENSIONS.items())
#: f(file_path, blast, lines, has_tests, content) -> all factors.
_SCORE = f""", f2 AS (SELECT *, lower(string_split(file_path, '/')[-1]) AS base, regexp_extract(lower(string_split(file_path, '/')[-1]), '^.+(\\.[^.]*)$', 1) AS ext, lower(coalesce(content, '') || ' ' || file_path) AS t FROM f),
f3 AS (SELECT *, CAST(least(30, floor(blast / 50.0 * 30 + 0.5)) AS INTEGER) AS blast_score, CAST(least(25, 5 * ({_HITS})) AS INTEGER) AS keyword_score,
CAST(CASE WHEN regexp_matches(base, '{risk.NAMES}') THEN least(15, (CASE {_EXT} ELSE 2 END) + 7) ELSE CASE {_EXT} ELSE 2 END END AS INTEGER) AS type_score,
CAST(least(15, floor(lines / 500.0 * 15 + 0.5)) AS INTEGER) AS size_score, CASE WHEN has_tests THEN 0 ELSE 15 END AS test_score, regexp_matches(base, '{risk.NAMES}') AS risky FROM f2),
f4 AS (SELECT *, least(100, blast_score + keyword_score + type_score + size_score + test_score) AS score, keyword_score >= 10 OR risky AS security_relevant FROM f3),
f5 AS (SELECT *, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS band FROM f4)"""
_FACTORS = "file_path, blast_score, keyword_score, type_score, size_score, test_score, score, security_relevant, band"
_DOCS = "WITH f AS (SELECT source || '/' || doc_id || (CASE doc_id % 5 WHEN 0 THEN '/auth.ts' WHEN 1 THEN '/.env' WHEN 2 THEN '/x.env' WHEN 3 THEN '/data.json' ELSE '/readme.md' END) AS file_path, doc_id % 120 AS blast, n_chars % 900 AS lines, doc_id % 3 = 0 AS has_tests, text AS content FROM documents)"


@query(_DOCS + _SCORE + f" SELECT {_FACTORS} FROM f5")
def risk_score(spark, sf):
    d = table(spark, sf, "documents")
    m = F.col("doc_id") % 5
    name = F.when(m == 0, "/auth.ts").when(m == 1, "/.env").when(m == 2, "/x.env").when(m == 3, "/data.json").otherwise("/readme.md")
    files = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), name).alias("file_path"), (F.col("doc_id") % 120).alias("blast"), (F.col("n_chars") % 900).alias("lines"), (F.col("doc_id") % 3 == 0).alias("has_tests"), F.col("text").alias("content"))
    return risk.score_files(files)


#: Changes: the files of catalogue, geography and some customers, with lines out of the keys.
_CHANGES = """, ch AS (SELECT file_path, CASE CAST(substr(md5(file_path), 1, 1) IN ('0', '1', '2', '3') AS INTEGER) WHEN 1 THEN 'deleted' ELSE CASE WHEN file_path LIKE '%geo%' THEN 'added' ELSE 'modified' END END AS status,
length(file_path) * 7 AS lines_added, length(file_path) AS lines_removed FROM (SELECT DISTINCT file_path FROM g_nodes WHERE kind IN ('module', 'type', 'function')))"""


def _changes(g):
    p = g.nodes.where(F.col("kind").isin("module", "type", "function")).select("file_path").distinct()
    status = F.when(F.substring(F.md5("file_path"), 1, 1).isin("0", "1", "2", "3"), "deleted").when(F.col("file_path").like("%geo%"), "added").otherwise("modified")
    return p.select("file_path", status.alias("status"), F.lit(None).cast("string").alias("old_path"), (F.length("file_path") * 7).alias("lines_added"), F.length("file_path").alias("lines_removed"))


_ANALYSIS = """, w AS (SELECT n.file_path AS changed, n.id AS seed, n.id, 0 AS depth FROM g_nodes n JOIN ch USING (file_path) UNION
SELECT w.changed, w.seed, e.from_id, w.depth + 1 FROM w JOIN g_edges e ON e.to_id = w.id AND e.kind IN ('imports', 'exports') WHERE w.depth < 10),
bl AS (SELECT changed AS file_path, count(DISTINCT n.file_path) AS blast FROM w JOIN g_nodes n ON n.id = w.id WHERE n.file_path <> changed AND w.id <> seed GROUP BY changed),
nn AS (SELECT file_path, count(*) AS nodes_affected FROM g_nodes GROUP BY 1),
f AS (SELECT ch.file_path, status, lines_added + lines_removed AS lines, coalesce(nodes_affected, 0) AS nodes_affected, coalesce(blast, 0) AS blast, false AS has_tests, CAST(NULL AS VARCHAR) AS content FROM ch LEFT JOIN bl USING (file_path) LEFT JOIN nn USING (file_path))"""


@query(G + _CHANGES + _ANALYSIS + _SCORE + " SELECT file_path, status, lines, nodes_affected, blast, has_tests, blast_score, keyword_score, type_score, size_score, test_score, score, security_relevant, band FROM f5")
def analyze_changes(spark, sf):
    g = star_graph(spark, sf)
    return risk.analyze_changes(g, _changes(g))


@query(G + _CHANGES + " SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'renamed') AS renamed, CAST(sum(lines_added + lines_removed) AS BIGINT) AS total_lines FROM ch")
def risk_summary(spark, sf):
    return risk.summary(_changes(star_graph(spark, sf)))


@query(G + _CHANGES + " SELECT DISTINCT a.file_path FROM g_edges e JOIN g_nodes b ON b.id = e.to_id JOIN g_nodes a ON a.id = e.from_id WHERE b.file_path IN (SELECT file_path FROM ch) AND a.file_path NOT IN (SELECT file_path FROM ch)")
def blast_files(spark, sf):
    g = star_graph(spark, sf)
    return risk.blast_files(g, _changes(g))


_TESTED = ", t_nodes AS (SELECT id, CASE WHEN kind = 'class' THEN replace(file_path, '/src/', '/tests/') ELSE file_path END AS file_path FROM g_nodes)"


def _tested(g):
    from lodegraph.schema import Graph

    return Graph(g.nodes.withColumn("file_path", F.when(F.col("kind") == "class", F.replace("file_path", F.lit("/src/"), F.lit("/tests/"))).otherwise(F.col("file_path"))), g.edges)


@query(G + _CHANGES + _TESTED + " SELECT DISTINCT a.file_path FROM g_edges e JOIN t_nodes b ON b.id = e.to_id JOIN t_nodes a ON a.id = e.from_id WHERE b.file_path IN (SELECT file_path FROM ch) AND a.file_path NOT IN (SELECT file_path FROM ch) AND a.file_path LIKE '%/tests/%'")
def review_tests(spark, sf):
    g = _tested(star_graph(spark, sf))
    return risk.review_tests(g, _changes(g))


@query(G + _CHANGES + _ANALYSIS + _SCORE + " SELECT file_path, score FROM f5 WHERE score >= 25 ORDER BY score DESC, file_path LIMIT 5")
def focus_areas(spark, sf):
    g = star_graph(spark, sf)
    return risk.focus_areas(risk.analyze_changes(g, _changes(g)))


@query(G + _CHANGES + _ANALYSIS + _SCORE + " SELECT coalesce(CASE WHEN max(score) >= 75 THEN 'critical' WHEN max(score) >= 50 THEN 'high' WHEN max(score) >= 25 THEN 'medium' END, 'low') AS overall FROM f5")
def overall_risk(spark, sf):
    g = star_graph(spark, sf)
    return risk.overall(risk.analyze_changes(g, _changes(g)))


_NUM = ["10\t2\tsrc/a.ts", "-\t-\timg.png", "3\t1\tsrc/{x => y}.ts", "4\t0\told.ts => new.ts", "7\t7\tsrc/new.ts"]
_STATUS = ["A\tsrc/new.ts", "M\tsrc/a.ts", "D\tsrc/old.ts", "R100\tsrc/x.ts\tsrc/y.ts", "T\tsrc/t.ts"]


def _lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


@query("SELECT * FROM (VALUES ('src/a.ts', 10, 2), ('img.png', 0, 0), ('src/y.ts', 3, 1), ('new.ts', 4, 0), ('src/new.ts', 7, 7)) AS t(file_path, lines_added, lines_removed)")
def numstat_parse(spark, sf):
    return gitdiff.parse_numstat(_lines(spark, _NUM))


@query("SELECT * FROM (VALUES ('src/new.ts', 'added', NULL), ('src/a.ts', 'modified', NULL), ('src/old.ts', 'deleted', NULL), ('src/y.ts', 'renamed', 'src/x.ts'), ('src/t.ts', 'modified', NULL)) AS t(file_path, status, old_path)")
def name_status_parse(spark, sf):
    return gitdiff.parse_name_status(_lines(spark, _STATUS))


@query("SELECT * FROM (VALUES ('src/new.ts', 'added', 7, 7), ('src/a.ts', 'modified', 10, 2), ('src/old.ts', 'deleted', 0, 0), ('src/y.ts', 'renamed', 3, 1), ('src/t.ts', 'modified', 0, 0), ('s.ts', 'added', 0, 0)) AS t(file_path, status, lines_added, lines_removed)")
def git_changes(spark, sf):
    none = _lines(spark, _STATUS).where("false")
    staged = gitdiff.changes(gitdiff.parse_name_status(_lines(spark, ["A\ts.ts", "D\tsrc/a.ts"])), gitdiff.parse_numstat(none))
    return gitdiff.changes(gitdiff.parse_name_status(_lines(spark, _STATUS)), gitdiff.parse_numstat(_lines(spark, _NUM)), staged).drop("old_path")


# --- communities
#: A fixed partition: the third segment of the path.
_PART = ", m AS (SELECT id, string_split(file_path, '/')[3] AS community FROM g_nodes WHERE NOT is_external)"


def _members(g):
    return g.nodes.where("not is_external").select("id", F.get(F.split("file_path", "/"), 2).alias("community"))


@query(G + _PART + """, x AS (SELECT m.community, (m2.community IS NOT DISTINCT FROM m.community) AS same FROM (SELECT from_id AS id, to_id AS o FROM g_edges UNION ALL SELECT to_id, from_id FROM g_edges) e JOIN m ON m.id = e.id LEFT JOIN m m2 ON m2.id = e.o),
s AS (SELECT community, CAST(floor(count(*) FILTER (same) / 2) AS BIGINT) AS internal, count(*) FILTER (NOT same) AS external FROM x GROUP BY 1), z AS (SELECT community, count(*) AS size FROM m GROUP BY 1)
SELECT community, size, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, floor((CASE WHEN size < 2 OR coalesce(internal + external, 0) = 0 THEN 1.0 ELSE internal / (internal + external) END) * 1000000 + 0.5) / 1000000.0 AS cohesion FROM z LEFT JOIN s USING (community)""")
def cohesion(spark, sf):
    g = star_graph(spark, sf)
    return com.cohesion(g, _members(g)).withColumn("cohesion", round_half_up(F.col("cohesion"), 6))


@query(G + _PART + " SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, count(*) AS edges FROM g_edges e JOIN m a ON a.id = e.from_id JOIN m b ON b.id = e.to_id WHERE a.community <> b.community GROUP BY 1, 2")
def coupling(spark, sf):
    g = star_graph(spark, sf)
    return com.coupling(g, _members(g))


@query(G + _PART + """, d AS (SELECT to_id AS id, count(*) AS fan_in FROM g_edges WHERE kind IN ('calls', 'imports') GROUP BY 1)
SELECT community, n.id, name, fan_in FROM g_nodes n JOIN m ON m.id = n.id JOIN d ON d.id = n.id WHERE kind IN ('file', 'class', 'function', 'method') QUALIFY row_number() OVER (PARTITION BY community ORDER BY fan_in DESC, n.id) <= 5""")
def hubs(spark, sf):
    g = star_graph(spark, sf)
    return com.hubs(g, _members(g))


@query(G + _PART + ", c AS (SELECT community, language, count(*) AS n FROM g_nodes JOIN m USING (id) WHERE language IS NOT NULL GROUP BY 1, 2) SELECT community, language FROM c QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, language) = 1")
def dominant_language(spark, sf):
    g = star_graph(spark, sf)
    return com.dominant_language(g, _members(g))


_ROLE = " ".join(f"WHEN bool_or(regexp_matches(p, '{rx}')) THEN '{r}'" for r, rx in com.ROLES)


_TAIL = "CASE page_id % 40 % 9 WHEN 0 THEN 'util/x' WHEN 1 THEN 'a.test.ts' WHEN 2 THEN 'api/x' WHEN 3 THEN 'ui/x' ELSE 'x' END"


@query(f"WITH p AS (SELECT page_id % 40 AS c, lower(url || '/' || ({_TAIL})) AS p FROM pages) SELECT CAST(c AS VARCHAR) AS community, count(*) AS pages, CASE {_ROLE} ELSE 'unknown' END AS role FROM p GROUP BY c")
def infer_role(spark, sf):
    """Roles of forty communities of all pages, with paths that differ by community."""
    from lodegraph.schema import Graph

    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), (F.col("page_id") % 40).cast("string").alias("community"), F.concat("url", F.lit("/"), F.expr(_TAIL)).alias("file_path"))
    nodes = p.select("id", "file_path")
    return com.roles(Graph(nodes, nodes), p.select("id", "community")).join(p.groupBy("community").agg(F.count("*").alias("pages")), "community")


_NAMES = """, mm AS (SELECT m.id, m.community, kind, name, string_split(file_path, '/') AS s FROM m JOIN g_nodes USING (id)), sz AS (SELECT community, count(*) AS n, avg(CAST(kind IN ('class', 'interface') AS INTEGER)) AS share, min_by(name, id) FILTER (kind IN ('class', 'interface')) AS fc FROM mm GROUP BY 1),
q AS (SELECT community, unnest(s[1:-2]) AS part, unnest(generate_series(1, len(s) - 1)) AS i FROM mm), a AS (SELECT community, i, count(DISTINCT part) AS k, count(*) AS c, min(part) AS part FROM q GROUP BY 1, 2),
b AS (SELECT a.*, k = 1 AND c = n AS same FROM a JOIN sz USING (community)), st AS (SELECT community, min(i) FILTER (NOT same) AS stop FROM b GROUP BY 1), tl AS (SELECT community, max_by(part, i) AS tail FROM b JOIN st USING (community) WHERE same AND (stop IS NULL OR i < stop) AND part <> '' GROUP BY 1),
ws AS (SELECT community, w, count(*) AS c FROM (SELECT community, unnest(regexp_extract_all(name, '[A-Z]?[a-z]+')) AS w FROM mm) WHERE length(w) >= 3 GROUP BY 1, 2 HAVING count(*) >= 2), tw AS (SELECT community, w AS word FROM ws QUALIFY row_number() OVER (PARTITION BY community ORDER BY c DESC, w) = 1)
SELECT community, coalesce(CASE WHEN length(tail) > 2 THEN tail END, CASE WHEN share > 0.4 THEN fc END, word, 'cluster-' || n) AS label FROM sz LEFT JOIN tl USING (community) LEFT JOIN tw USING (community)"""


@query(G + ", m AS (SELECT id, CASE kind WHEN 'class' THEN 'a' WHEN 'interface' THEN 'b' WHEN 'module' THEN 'b' WHEN 'method' THEN 'c' WHEN 'file' THEN 'd' ELSE file_path END AS community FROM g_nodes WHERE NOT is_external)" + _NAMES)
def derive_name(spark, sf):
    g = star_graph(spark, sf)
    k = F.col("kind")
    c = F.when(k == "class", "a").when(k.isin("interface", "module"), "b").when(k == "method", "c").when(k == "file", "d").otherwise(F.col("file_path"))
    return com.names(g, g.nodes.where("not is_external").select("id", c.alias("community")))


@query(None)
def communities(spark, sf):
    return com.detect(star_graph(spark, sf))


@query(None)
def communities_persisted(spark, sf):
    g = event_graph(spark, sf)
    return com.persist(g, com.detect(g))[0]


@query("SELECT size, count(*) AS n FROM (SELECT 1 + count(o_orderkey) AS size FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) GROUP BY size")
def file_component_count(spark, sf):
    """Customers and their orders as files joined by imports: sizes of components and how many there are of each."""
    from lodegraph.schema import Graph

    g = star_graph(spark, sf)
    nodes = g.nodes.where("kind in ('class', 'file')").withColumns({"kind": F.lit("file"), "file_path": F.col("id")})
    size = com.file_components(Graph(nodes, g.edges)).groupBy("component").agg(F.count("*").alias("size"))
    return size.groupBy("size").agg(F.count("*").alias("n"))


_LABELS = """WITH f AS (SELECT page_id % 17 AS c, url AS p FROM pages), s AS (SELECT c, regexp_split_to_array(p, '[/\\\\]') AS s FROM f), z AS (SELECT c, count(*) AS n, min(s) AS one FROM s GROUP BY 1),
q AS (SELECT c, unnest(s) AS part, unnest(generate_series(0, len(s) - 1)) AS i FROM s), a AS (SELECT c, i, count(DISTINCT part) AS k, count(*) AS cc, min(part) AS part FROM q GROUP BY 1, 2), b AS (SELECT a.*, k = 1 AND cc = n AS same FROM a JOIN z USING (c)),
st AS (SELECT c, coalesce(min(i) FILTER (NOT same), max(i) + 1) AS stop FROM b GROUP BY 1), l AS (SELECT b.c, part AS last FROM b JOIN st ON st.c = b.c AND b.i = stop - 1 AND stop >= 2)
SELECT CAST(z.c AS VARCHAR) AS component, CASE WHEN n = 1 THEN one[-1] ELSE coalesce(last, 'cluster-' || n || '-files') END AS label FROM z LEFT JOIN l ON l.c = z.c"""


@query(_LABELS)
def file_labels(spark, sf):
    return com.file_labels(table(spark, sf, "pages").select((F.col("page_id") % 17).cast("string").alias("component"), F.col("url").alias("file_path")))


@query("WITH RECURSIVE " + EVENT_SQL + """, c AS (SELECT from_id, to_id FROM v_edges UNION SELECT c.from_id, e.to_id FROM c JOIN v_edges e ON e.from_id = c.to_id),
k AS (SELECT count(DISTINCT lo) AS n FROM (SELECT a.from_id AS id, min(b.from_id) AS lo FROM c a JOIN c b ON a.from_id = b.to_id AND a.to_id = b.from_id GROUP BY 1)), f AS (SELECT count(DISTINCT event_type) AS n FROM events),
p AS (SELECT count(*) AS n FROM (SELECT least(length(from_id) % 2, length(to_id) % 2) AS a, greatest(length(from_id) % 2, length(to_id) % 2) AS b FROM v_edges WHERE length(from_id) % 2 <> length(to_id) % 2) HAVING count(*) > 10),
o AS (SELECT count(*) AS n FROM (SELECT DISTINCT event_type FROM events) WHERE event_type NOT IN (SELECT from_id FROM v_edges UNION ALL SELECT to_id FROM v_edges)), g AS (SELECT max(n) AS n FROM (SELECT length(event_type) % 2 AS q, count(DISTINCT event_type) AS n FROM events GROUP BY 1))
SELECT CAST(greatest(0, 100 - 10 * least(k.n, 5) - 2 * least(o.n, 10) - 5 * (SELECT count(*) FROM p) - (CASE WHEN g.n > f.n * 0.7 THEN 15 ELSE 0 END)) AS BIGINT) AS score FROM k, f, o, g""")
def health_score(spark, sf):
    g = event_graph(spark, sf)
    got = com.overview(g, g.nodes.select("id", (F.length("id") % 2).cast("string").alias("community")))
    return spark.createDataFrame([(got["score"],)], "score bigint")
