"""Registered queries: stored tables, lookups and graph questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import components, graph as ops, store, traverse as tr
from lodegraph.plans.register import query
from lodegraph.sources.tables import EVENT_SQL, GRAPH_SQL, SUPPLY_SQL, event_graph, star_graph, supply_graph, table

G = "WITH RECURSIVE " + GRAPH_SQL
N = ["id", "kind", "name", "file_path"]
MODULE, NATION = "module:region/0", "interface:nation/3"


@query(G + " SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(*) FROM g_nodes WHERE kind = 'file') AS files")
def graph_stats(spark, sf):
    return ops.stats(star_graph(spark, sf))


@query(G + " SELECT kind, count(*) AS n FROM g_nodes GROUP BY kind")
def node_count_by_kind(spark, sf):
    return star_graph(spark, sf).nodes.groupBy("kind").agg(F.count("*").alias("n"))


_LAYER = """, parts AS (SELECT *, string_split(replace(file_path, '\\', '/'), '/') AS p FROM g_nodes), lay AS (
SELECT *, CASE WHEN list_position(p, 'src') > 0 AND len(p) > list_position(p, 'src') THEN p[list_position(p, 'src') + 1] WHEN len(p) > 1 AND p[-2] <> '' THEN p[-2] ELSE 'root' END AS layer
FROM parts WHERE kind = 'file' AND NOT is_external)"""


@query(G + _LAYER + " SELECT layer, count(*) AS n_files FROM lay GROUP BY layer")
def layers(spark, sf):
    return ops.layers(star_graph(spark, sf)).select("layer", "n_files")


@query(G + _LAYER + " SELECT f.layer, n.kind, count(*) AS n FROM (SELECT DISTINCT file_path, layer FROM lay) f JOIN g_nodes n ON n.file_path = f.file_path GROUP BY ALL")
def layer_kinds(spark, sf):
    return ops.layer_kinds(star_graph(spark, sf))


@query(G + " SELECT id, kind, name, file_path FROM g_nodes n WHERE NOT is_external AND id NOT IN (SELECT from_id FROM g_edges UNION ALL SELECT to_id FROM g_edges)")
def orphans(spark, sf):
    return ops.orphans(star_graph(spark, sf)).select(*N)


@query(G + " SELECT id, kind, name, file_path FROM g_nodes WHERE kind IN ('module', 'interface')")
def nodes_by_kind(spark, sf):
    return store.nodes_by_kind(star_graph(spark, sf), ["module", "interface"]).select(*N)


@query(G + " SELECT id, kind, name, file_path FROM g_nodes WHERE file_path = '/src/geo/region1.ts'")
def nodes_by_file(spark, sf):
    return store.nodes_by_file(star_graph(spark, sf), "/src/geo/region1.ts").select(*N)


@query(G + " SELECT id, kind, name, file_path FROM g_nodes WHERE language = 'go'")
def nodes_by_language(spark, sf):
    return store.nodes_by_language(star_graph(spark, sf), "go").select(*N)


@query(G + f" SELECT id, kind, name, file_path, description FROM g_nodes WHERE id = '{MODULE}'")
def node_lookup(spark, sf):
    return store.node(star_graph(spark, sf), MODULE).select(*N, "description")


@query(G + " SELECT id, to_id, kind, reason FROM g_edges WHERE from_id = 'method:part/7'")
def edges_from(spark, sf):
    return store.edges_from(star_graph(spark, sf), "method:part/7").select("id", "to_id", "kind", "reason")


@query(G + f" SELECT id, from_id, kind FROM g_edges WHERE to_id = '{NATION}' AND kind = 'imports'")
def edges_to_by_kind(spark, sf):
    return store.edges_to(star_graph(spark, sf), NATION, "imports").select("id", "from_id", "kind")


@query(G + f" SELECT id, kind, name, file_path FROM g_nodes WHERE id IN (SELECT to_id FROM g_edges WHERE from_id = '{NATION}' UNION ALL SELECT from_id FROM g_edges WHERE to_id = '{NATION}')")
def neighbours(spark, sf):
    return store.neighbours(star_graph(spark, sf), NATION).select(*N)


@query("SELECT page_id, (u LIKE '%/test/%' OR u LIKE '%/tests/%' OR u LIKE '%/spec/%' OR u LIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\' OR regexp_matches(u, '(\\.(test|spec)\\.(ts|js)|_test\\.go|_test\\.py|test\\.cs)$')) AS is_test FROM (SELECT page_id, lower(replace(url, '\\', '/')) AS u FROM pages)")
def is_test_file(spark, sf):
    return table(spark, sf, "pages").select("page_id", ops.is_test_path(F.col("url")).alias("is_test"))


@query(G + " SELECT e.id, e.kind FROM g_edges e JOIN g_nodes a ON a.id = e.from_id JOIN g_nodes b ON b.id = e.to_id")
def view_edges(spark, sf):
    return store.view_edges(star_graph(spark, sf)).select("id", "kind")


@query(G + " SELECT id, name AS label, kind, CASE kind WHEN 'file' THEN 1 WHEN 'class' THEN 2 WHEN 'function' THEN 3 WHEN 'method' THEN 4 WHEN 'interface' THEN 5 WHEN 'module' THEN 6 WHEN 'external_dep' THEN 7 WHEN 'type' THEN 8 ELSE 9 END AS bucket FROM g_nodes WHERE lower(name) LIKE '%widget%' AND kind = 'method'")
def view_nodes(spark, sf):
    return store.view_nodes(star_graph(spark, sf), "method", "Widget").select("id", "label", "kind", "bucket")


@query(G + ", hit AS (SELECT id FROM g_nodes WHERE lower(name) LIKE '%region0%' OR lower(file_path) LIKE '%region0%') SELECT e.id, e.kind FROM g_edges e WHERE from_id IN (SELECT id FROM hit) OR to_id IN (SELECT id FROM hit)")
def panel_search(spark, sf):
    return store.panel_search(star_graph(spark, sf), "Region0")[1].select("id", "kind")


_NEW = ", fresh AS (SELECT id, kind, 'renamed ' || name AS name, file_path FROM g_nodes WHERE kind IN ('module', 'type') UNION ALL SELECT 'test:x', 'test', 'x', '/x')"


@query(G + _NEW + " SELECT id, kind, name, file_path FROM g_nodes WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh")
def upsert_nodes(spark, sf):
    n = star_graph(spark, sf).nodes.select(*N)
    fresh = n.where(F.col("kind").isin("module", "type")).withColumn("name", F.concat(F.lit("renamed "), "name"))
    return store.upsert_nodes(n, fresh.union(spark.range(1).select(F.lit("test:x"), F.lit("test"), F.lit("x"), F.lit("/x"))), ["name"])


@query(G + " SELECT id, from_id, to_id, kind, CASE WHEN kind = 'exports' THEN 'seen again' ELSE reason END AS reason FROM g_edges")
def upsert_edges(spark, sf):
    e = star_graph(spark, sf).edges.select("id", "from_id", "to_id", "kind", "reason")
    return store.upsert_edges(e, e.where("kind = 'exports'").withColumn("reason", F.lit("seen again")))


@query(G + " SELECT 'edge' AS what, id FROM g_edges WHERE from_id NOT IN (SELECT id FROM g_nodes WHERE file_path = '/src/geo/region0.ts') UNION ALL SELECT 'node', id FROM g_nodes WHERE file_path <> '/src/geo/region0.ts'")
def delete_file(spark, sf):
    g, _ = store.delete_files(star_graph(spark, sf), spark.range(1).select(F.lit("/src/geo/region0.ts").alias("file_path")))
    return g.edges.select(F.lit("edge").alias("what"), "id").union(g.nodes.select(F.lit("node"), "id"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR lang = 'fr'")
def incremental_skip(spark, sf):
    d = table(spark, sf, "documents")
    scan = d.select("doc_id", F.col("doc_id").cast("string").alias("file_path"), F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    stored = d.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("file_path"), F.sha2("text", 256).alias("content_hash"))
    return store.changed(scan, stored).select("doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS file_path FROM documents WHERE source = 'src3'")
def vanished_files(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "source")
    return store.vanished(d.where("source <> 'src3'"), d)


@query(G + " SELECT n.id, n.name, e.reason FROM g_edges e JOIN g_nodes n ON n.id = e.from_id WHERE e.kind = 'calls' AND e.to_id = 'function:supplier/3'")
def callers(spark, sf):
    return ops.callers(star_graph(spark, sf), "function:supplier/3").select("id", "name", "reason")


@query(G + " SELECT n.id, n.name, e.reason FROM g_edges e JOIN g_nodes n ON n.id = e.to_id WHERE e.kind = 'calls' AND e.from_id = 'function:supplier/3'")
def callees(spark, sf):
    return ops.callees(star_graph(spark, sf), "function:supplier/3").select("id", "name", "reason")


@query(G + f""" SELECT edge_id, direction, kind, other_id, coalesce(name, other_id) AS other_name FROM (
SELECT id AS edge_id, 'out' AS direction, kind, to_id AS other_id FROM g_edges WHERE from_id = '{NATION}' UNION ALL
SELECT id, 'in', kind, from_id FROM g_edges WHERE to_id = '{NATION}') LEFT JOIN (SELECT id, name FROM g_nodes) n ON n.id = other_id""")
def rename_preview(spark, sf):
    return ops.rename_preview(star_graph(spark, sf), NATION).drop("file_path")


@query(G + f""" , own AS (SELECT file_path, name FROM g_nodes WHERE id = '{NATION}'), t AS (
SELECT DISTINCT n.file_path FROM g_edges e JOIN g_nodes n ON (e.from_id = '{NATION}' AND n.id = e.to_id) OR (e.to_id = '{NATION}' AND n.id = e.from_id))
SELECT file_path, name AS old_name, 'Territory' AS new_name, CAST(0.95 AS DOUBLE) AS confidence FROM own UNION ALL
SELECT t.file_path, own.name, 'Territory', CAST(0.8 AS DOUBLE) FROM t, own WHERE t.file_path <> own.file_path""")
def rename_edits(spark, sf):
    return ops.rename_edits(star_graph(spark, sf), NATION, "Territory").select("file_path", "old_name", "new_name", "confidence")


@query(G + " SELECT n.id, n.name FROM g_edges e JOIN g_nodes n ON n.id = e.to_id WHERE e.kind = 'imports' AND e.from_id = 'class:customer/7'")
def deps_direct(spark, sf):
    return ops.deps_direct(star_graph(spark, sf), "class:customer/7").select("id", "name")


@query(G + """, w AS (SELECT to_id AS id, 1 AS depth FROM g_edges WHERE kind = 'imports' AND from_id = 'class:customer/7' UNION
SELECT e.to_id, w.depth + 1 FROM w JOIN g_edges e ON e.from_id = w.id AND e.kind = 'imports' WHERE w.depth < 3) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id""")
def deps_transitive(spark, sf):
    return ops.deps_transitive(star_graph(spark, sf), "class:customer/7", 3)


_BACK = """, w AS (SELECT id AS seed, id, 0 AS depth FROM g_nodes WHERE {seeds} UNION
SELECT w.seed, e.from_id, w.depth + 1 FROM w JOIN g_edges e ON e.to_id = w.id AND e.kind IN ('imports', 'exports') WHERE w.depth < 10)
"""


@query(G + _BACK.format(seeds=f"id = '{MODULE}'") + " SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE id <> seed GROUP BY id")
def impact(spark, sf):
    g = star_graph(spark, sf)
    return ops.impact(g, store.node(g, MODULE).select("id")).select("id", "depth")


@query(G + _BACK.format(seeds="kind IN ('module', 'type')") + " SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE id <> seed GROUP BY seed, id")
def impact_multi(spark, sf):
    g = star_graph(spark, sf)
    return ops.impact(g, g.nodes.where("kind in ('module', 'type')").select("id"))


_FAR = """, w AS (SELECT id, 0 AS depth FROM g_nodes WHERE id = '{start}' UNION SELECT e.{far}, w.depth + 1 FROM w JOIN g_edges e ON e.{near} = w.id {kinds} WHERE w.depth < 10), d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id),
par AS (SELECT d.id, d.depth, arg_min(p.id, (p.id, e.id)) AS parent, arg_min(e.id, (p.id, e.id)) AS edge FROM d JOIN g_edges e ON e.{far} = d.id {kinds} JOIN d p ON p.id = e.{near} AND p.depth = d.depth - 1 GROUP BY 1, 2)"""


@query(G + _FAR.format(start=MODULE, far="from_id", near="to_id", kinds="AND e.kind IN ('imports', 'exports')") + f""", r AS (SELECT id, id AS path, 0 AS depth FROM d WHERE depth = 0 UNION ALL SELECT par.id, r.path || ' > ' || par.id, par.depth FROM r JOIN par ON par.parent = r.id)
SELECT id, CAST(depth AS INTEGER) AS depth, path FROM r WHERE depth > 0""")
def impact_paths(spark, sf):
    g = star_graph(spark, sf)
    return ops.impact(g, store.node(g, MODULE).select("id"), with_path=True).select("id", "depth", F.array_join("path", " > ").alias("path"))


def _first_order(g):
    return g.edges.where("kind = 'imports' and from_id like 'file:order/%'").agg(F.min(F.substring("from_id", 12, 20).cast("bigint")).alias("k")).first().k


_PATH = """, s AS (SELECT 'file:order/' || min(o_orderkey) AS id FROM orders), w AS (SELECT id, 0 AS depth FROM s UNION
SELECT e.to_id, w.depth + 1 FROM w JOIN g_edges e ON e.from_id = w.id WHERE w.depth < 6) SELECT CAST(min(depth) AS INTEGER) AS depth FROM w WHERE id = 'external_dep:Brand#2' HAVING count(*) > 0"""


@query(G + _PATH)
def shortest_path_len(spark, sf):
    g = star_graph(spark, sf)
    return ops.shortest_path(g, f"file:order/{_first_order(g)}", "external_dep:Brand#2").select("depth")


@query(G + """, w AS (SELECT 'file:order/' || min(o_orderkey) AS id, 0 AS depth FROM orders UNION SELECT e.to_id, w.depth + 1 FROM w JOIN g_edges e ON e.from_id = w.id WHERE w.depth < 6), d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id),
par AS (SELECT d.id, arg_min(p.id, (p.id, e.id)) AS parent, arg_min(e.id, (p.id, e.id)) AS edge FROM d JOIN g_edges e ON e.to_id = d.id JOIN d p ON p.id = e.from_id AND p.depth = d.depth - 1 GROUP BY 1),
b AS (SELECT id, id AS path, '' AS edges FROM d WHERE id = 'external_dep:Brand#2' UNION ALL SELECT par.parent, par.parent || ' > ' || b.path, par.edge || CASE WHEN b.edges = '' THEN '' ELSE ', ' || b.edges END FROM b JOIN par ON par.id = b.id)
SELECT path, edges FROM b WHERE id = (SELECT 'file:order/' || min(o_orderkey) FROM orders)""")
def shortest_path_nodes(spark, sf):
    g = star_graph(spark, sf)
    got = ops.shortest_path(g, f"file:order/{_first_order(g)}", "external_dep:Brand#2")
    return got.select(F.array_join("path", " > ").alias("path"), F.array_join("edge_ids", ", ").alias("edges"))


@query(G + """, w AS (SELECT id, 0 AS depth FROM g_nodes WHERE id = 'function:supplier/3' UNION
SELECT e.to_id, w.depth + 1 FROM w JOIN g_edges e ON e.from_id = w.id AND e.kind = 'calls' WHERE w.depth < 5) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id""")
def call_chain_depth(spark, sf):
    return ops.call_chain(star_graph(spark, sf), "function:supplier/3", 5)


_CLOSURE = "WITH RECURSIVE " + EVENT_SQL + ", c AS (SELECT from_id, to_id FROM v_edges UNION SELECT c.from_id, e.to_id FROM c JOIN v_edges e ON e.from_id = c.to_id)"


@query(_CLOSURE + " SELECT a.from_id AS id, min(b.from_id) AS cycle FROM c a JOIN c b ON a.from_id = b.to_id AND a.to_id = b.from_id GROUP BY a.from_id")
def cycle_members(spark, sf):
    return ops.cycle_members(event_graph(spark, sf))


@query(_CLOSURE.replace(EVENT_SQL, SUPPLY_SQL) + " SELECT a.from_id AS id, min(b.from_id) AS cycle FROM c a JOIN c b ON a.from_id = b.to_id AND a.to_id = b.from_id GROUP BY a.from_id")
def supplier_cycles(spark, sf):
    return ops.cycle_members(supply_graph(spark, sf))


@query(None)
def detect_cycles_dfs(spark, sf):
    paths = ops.cycle_paths(event_graph(spark, sf))
    return spark.createDataFrame([(" > ".join(p), len(p) - 1) for p in paths], "cycle string, length int")


@query(G + """, o AS (SELECT from_id, count(*) AS n FROM g_edges WHERE kind = 'calls' GROUP BY 1), i AS (SELECT DISTINCT to_id FROM g_edges WHERE kind = 'calls')
SELECT id, name, kind, file_path, coalesce(o.n, 0) AS fan_out FROM g_nodes LEFT JOIN o ON o.from_id = id WHERE kind IN ('function', 'method', 'file') AND NOT is_external AND id NOT IN (SELECT to_id FROM i) ORDER BY fan_out DESC, id LIMIT 30""")
def entry_points(spark, sf):
    return ops.entry_points(star_graph(spark, sf))


_DEG = """, d AS (SELECT id, count(*) FILTER (s = 'i') AS fan_in, count(*) FILTER (s = 'o') AS fan_out FROM (
SELECT to_id AS id, 'i' AS s, kind FROM g_edges UNION ALL SELECT from_id, 'o', kind FROM g_edges) WHERE {kinds} GROUP BY id), x AS (
SELECT n.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM g_nodes n LEFT JOIN d ON d.id = n.id) """


@query(G + _DEG.format(kinds="kind IN ('calls', 'imports')") + """SELECT id, name, kind, file_path, fan_in, fan_out, fan_in * 3 + fan_out AS score,
CASE WHEN fan_in * 3 + fan_out >= 30 THEN 'critical' WHEN fan_in * 3 + fan_out >= 15 THEN 'high' WHEN fan_in * 3 + fan_out >= 5 THEN 'medium' ELSE 'low' END AS label
FROM x WHERE kind IN ('class', 'function', 'interface', 'method') AND NOT is_external""")
def criticality(spark, sf):
    return ops.criticality(star_graph(spark, sf), None)


@query(G + _DEG.format(kinds="kind = 'calls'") + "SELECT id, name, kind, file_path, fan_in, fan_out, fan_in + 2 * fan_out AS complexity FROM x WHERE kind IN ('function', 'method') ORDER BY complexity DESC, id LIMIT 20")
def large_functions(spark, sf):
    return ops.large_functions(star_graph(spark, sf))


@query(G + " SELECT id, name, kind, file_path FROM g_nodes WHERE kind IN ('class', 'function', 'interface', 'method', 'type') AND NOT is_external AND id NOT IN (SELECT to_id FROM g_edges)")
def dead_code(spark, sf):
    return ops.dead_code(star_graph(spark, sf), None)


@query(G + _DEG.format(kinds="true") + """SELECT id, name, kind, file_path, fan_in, fan_out, CASE kind WHEN 'file' THEN 'split' ELSE 'extract' END AS suggestion FROM x
WHERE NOT is_external AND ((kind = 'file' AND fan_in >= 15) OR (kind IN ('function', 'method', 'class') AND fan_out >= 10))""")
def refactor_suggestions(spark, sf):
    return ops.suggestions(star_graph(spark, sf), None)


@query(G + """, u AS (SELECT from_id AS a, to_id AS b FROM g_edges WHERE kind = 'imports' UNION SELECT to_id, from_id FROM g_edges WHERE kind = 'imports'),
r AS (SELECT id AS root, id FROM g_nodes WHERE kind = 'module' UNION SELECT r.root, u.b FROM r JOIN u ON u.a = r.id) SELECT id, min(lo) OVER (PARTITION BY root) AS component FROM (SELECT root, id, min(id) OVER (PARTITION BY root) AS lo FROM r)""")
def connected_components(spark, sf):
    return components.connected_components(star_graph(spark, sf).edges.where("kind = 'imports'"), "from_id", "to_id")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_$]+|[^a-zA-Z0-9_$]+') AS p FROM documents)
SELECT doc_id, len(list_filter(p, lambda x: x = 'the')) AS n_replaced, sha256(array_to_string(list_transform(p, lambda x: CASE WHEN x = 'the' THEN '$the' ELSE x END), '')) AS new_sha256 FROM t""")
def apply_rename(spark, sf):
    return ops.apply_rename(table(spark, sf, "documents").select("doc_id", "text"), "text", "the", "$the").select("doc_id", "n_replaced", F.sha2("new_text", 256).alias("new_sha256"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_lines(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").selectExpr("l_orderkey AS o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").selectExpr("o_custkey AS c_custkey"), "c_custkey", "left_anti").select("c_custkey")
