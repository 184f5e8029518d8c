"""Registered queries: extraction, streaming batches, bundles, wiki and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions.text import round_half_up
from lodegraph.plans import reports
from lodegraph.plans.graph_queries import _LAYER
from lodegraph.plans.register import query
from lodegraph.sources import parsers
from lodegraph.sources.tables import GRAPH_SQL, star_graph, table
from lodegraph.streaming import watch

G = "WITH RECURSIVE " + GRAPH_SQL


@query("""SELECT 'file:' || url AS from_id, 'external_dep:' || t AS to_id, count(*) AS n FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t FROM pages) GROUP BY ALL""")
def extract_imports(spark, sf):
    p = table(spark, sf, "pages")
    links = reports.html_links(p).join(p.select("page_id", "url"), "page_id")
    return links.groupBy(F.concat(F.lit("file:"), "url").alias("from_id"), F.concat(F.lit("external_dep:"), "target").alias("to_id")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE regexp_extract(lower(url || e), '\\.[^./]+$') WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.hh' THEN 'cpp' WHEN '.kt' THEN 'kotlin' END AS language FROM (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN '/a.TS' WHEN 1 THEN '/b.py' WHEN 2 THEN '/c.hh' WHEN 3 THEN '/d.kt' WHEN 4 THEN '/e.tsx' ELSE '/f.xyz' END AS e FROM pages)")
def detect_language(spark, sf):
    m = F.col("page_id") % 6
    e = F.when(m == 0, "/a.TS").when(m == 1, "/b.py").when(m == 2, "/c.hh").when(m == 3, "/d.kt").when(m == 4, "/e.tsx").otherwise("/f.xyz")
    return table(spark, sf, "pages").select("page_id", parsers.language(F.concat("url", e)).alias("language"))


@query("""WITH d AS (SELECT doc_id, source, lang, '/docs/' || doc_id || '.py' AS f FROM documents)
SELECT 'file:' || f AS from_id, 'external_dep:' || source AS to_id, 'imports' AS kind, 'imports ' || source AS reason FROM d
UNION ALL SELECT 'file:' || f, 'class:' || f || '#Doc' || doc_id, 'exports', 'exports class Doc' || doc_id FROM d
UNION ALL SELECT 'file:' || f, 'function:' || f || '#read_' || lang, 'exports', 'exports function read_' || lang FROM d
UNION ALL SELECT 'class:' || f || '#Doc' || doc_id, 'class:' || f || '#Base', 'inherits', 'Doc' || doc_id || ' inherits Base' FROM d""")
def parse_sources(spark, sf):
    """Every document as a Python file: its whole text as comments, an import of its source, a function of its language."""
    d = table(spark, sf, "documents")
    code = F.concat(F.lit("# "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n# ")), F.lit("\nimport "), "source", F.lit("\n\nclass Doc"), F.col("doc_id").cast("string"), F.lit("(Base):\n    def read_"), "lang", F.lit("(self):\n        return 1\n"))
    g, _ = parsers.parse_graph(d.select(F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), code.alias("content")))
    return g.edges.select("from_id", "to_id", "kind", "reason")


@query("""WITH e AS (SELECT user_id, ts, event_type, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE AS gap FROM events), g AS (
SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n_events, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS files FROM g GROUP BY user_id, k""")
def watch_batches(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("file_path"))
    return watch.debounce(e, ["user_id"], "30 minutes").select("user_id", F.unix_micros("started").alias("started_us"), "n_events", F.array_join("files", ",").alias("files"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN doc_id % 7 = 0 THEN 'unlink' WHEN doc_id % 7 = 1 THEN 'add' ELSE 'change' END AS event FROM documents WHERE doc_id % 7 IN (0, 1) OR lang = 'es'")
def snapshot_events(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    after = d.where("doc_id % 7 != 0").withColumn("content_hash", F.when(F.col("lang") == "es", F.lit("new")).otherwise(F.col("content_hash")))
    return watch.snapshot_events(d.where("doc_id % 7 != 1"), after)


_FILE = "/src/geo/region1.ts"


@query(G + _LAYER + f""", own AS (SELECT * FROM g_nodes WHERE file_path = '{_FILE}'), cls AS (SELECT id, name FROM own WHERE kind IN ('class', 'interface')),
lines AS (SELECT 1 AS section_no, 'File' AS title, 'Bundle for `{_FILE}`' AS line
UNION ALL SELECT 2, 'Layers', '- ' || layer || ': ' || n || ' files' FROM (SELECT layer, count(*) AS n FROM lay GROUP BY layer ORDER BY n DESC, layer LIMIT 12)
UNION ALL SELECT 3, 'Symbols', '- ' || kind || ' `' || name || '`' FROM own WHERE kind <> 'file'
UNION ALL SELECT 7, 'Hierarchy', '- `' || c.name || '` ' || CASE e.kind WHEN 'inherits' THEN 'extends' ELSE 'implements' END || ' `' || coalesce(n.name, e.to_id) || '`' FROM g_edges e JOIN cls c ON c.id = e.from_id LEFT JOIN g_nodes n ON n.id = e.to_id WHERE e.kind IN ('inherits', 'implements')
UNION ALL SELECT 7, 'Hierarchy', '- `' || c.name || '` extended by `' || coalesce(n.name, e.from_id) || '`' FROM g_edges e JOIN cls c ON c.id = e.to_id LEFT JOIN g_nodes n ON n.id = e.from_id WHERE e.kind IN ('inherits', 'implements'))
SELECT section_no, title, count(*) AS n_lines, CAST(ceil((sum(length(line)) + count(*) - 1) / 4.0) AS BIGINT) AS tokens FROM lines GROUP BY 1, 2""")
def bundle_sections(spark, sf):
    return reports.bundle_sections(reports.bundle_lines(star_graph(spark, sf), _FILE))


@query(G + f""" SELECT '- ' || kind || ' `' || name || '`' AS line FROM g_nodes WHERE file_path = '{_FILE}' AND kind <> 'file'""")
def bundle_symbols(spark, sf):
    return reports.bundle_lines(star_graph(spark, sf), _FILE).where("section_no = 3").select("line")


@query(G + ", m AS (SELECT id, string_split(file_path, '/')[3] AS community FROM g_nodes WHERE NOT is_external) SELECT community, count(*) AS n_nodes, count(DISTINCT file_path) AS n_files FROM g_nodes JOIN m USING (id) GROUP BY 1 HAVING count(*) >= 2")
def wiki_pages(spark, sf):
    g = star_graph(spark, sf)
    members = g.nodes.where("not is_external").select("id", F.get(F.split("file_path", "/"), 2).alias("community"))
    return reports.wiki_pages(g, members).select("community", "n_nodes", "n_files")


@query("""WITH r AS (SELECT source AS q, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), gold AS (SELECT d.source AS q, l.doc_id AS id FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1)
SELECT gold.q AS query, bool_or(r.id IS NOT NULL) AS hit FROM gold LEFT JOIN r ON r.q = gold.q AND r.id = gold.id AND rank <= 10 GROUP BY 1""")
def eval_hit_rate(spark, sf):
    from pyspark.sql import Window as W

    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    best = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = d.select("source", "doc_id", F.row_number().over(best).alias("rank")).select(F.col("source").alias("query"), F.col("doc_id").alias("id"), "rank")
    gold = labels.where("quality = 1").join(d.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("id"))
    return reports.hit_rate(ranked, gold)


@query("""WITH r AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'search_quality' WHEN 1 THEN 'impact_accuracy' WHEN 2 THEN 'flow_completeness' ELSE 'token_efficiency' END AS b, toxic = 0 AS ok, CAST(quality AS DOUBLE) AS s FROM labels), k AS (SELECT unnest(['token_efficiency', 'flow_completeness', 'impact_accuracy', 'search_quality', 'build_performance']) AS b)
SELECT k.b AS benchmark, count(r.b) AS runs, count(*) FILTER (r.ok) AS passed, floor(coalesce(avg(s), 0) * 1000000 + 0.5) / 1000000.0 AS avg_score FROM k LEFT JOIN r USING (b) GROUP BY 1""")
def eval_summary(spark, sf):
    m = F.col("doc_id") % 4
    b = F.when(m == 0, "search_quality").when(m == 1, "impact_accuracy").when(m == 2, "flow_completeness").otherwise("token_efficiency")
    r = table(spark, sf, "labels").select(b.alias("benchmark"), (F.col("toxic") == 0).alias("passed"), F.col("quality").cast("double").alias("score"))
    return reports.eval_summary(r).withColumn("avg_score", round_half_up(F.col("avg_score"), 6))
