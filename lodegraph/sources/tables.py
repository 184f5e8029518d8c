"""The driver's star schema read as a property graph, and other tables shaped for the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodegraph.schema import Graph
from lodegraph.storage import kept


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; its schema is read from the files once a session."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The star schema's graph as stored tables, both partitioned by kind, so that a filter on kind reads only its files.

    Built once a session. A union of twelve branches under every query would have
    its semi-joins pushed into each branch, and plans grow by the product.
    """
    stored = lambda part: kept(spark, f"star {part} {sf_dir}", lambda: getattr(_star_graph(spark, sf_dir), part), "kind")
    return Graph(stored("nodes"), stored("edges"))


def _star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Eight kinds of edges, nine of nodes, without dangling edges; benchmark items are nodes without edges."""
    t = lambda name: table(spark, sf_dir, name)
    s = lambda c: F.col(c).cast("string")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])

    def node(df, id, kind, name, path, text, language, external=False):
        return df.select(id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("file_path"), text.alias("description"), F.lit(external).alias("is_external"), F.lit(language).cast("string").alias("language"))

    region, nation, customer, supplier, part, orders, lines, items = map(t, "region nation customer supplier part orders lineitem benchmark".split())
    catalog = cat("/src/catalog/", F.lower("p_type"), ".rs")
    nodes = [
        node(region, cat("module:region/", s("r_regionkey")), "module", F.col("r_name"), cat("/src/geo/region", s("r_regionkey"), ".ts"), cat("Region ", F.col("r_name")), "typescript"),
        node(nation, cat("interface:nation/", s("n_nationkey")), "interface", F.col("n_name"), cat("/src/geo/region", s("n_regionkey"), ".ts"), cat("Nation ", F.col("n_name")), "typescript"),
        node(customer, cat("class:customer/", s("c_custkey")), "class", F.col("c_name"), cat("/src/", F.lower("c_mktsegment"), "/nation", s("c_nationkey"), ".py"), cat("Customer in ", F.col("c_mktsegment")), "python"),
        node(supplier, cat("function:supplier/", s("s_suppkey")), "function", F.col("s_name"), cat("/src/supply/nation", s("s_nationkey"), ".go"), cat("Supplier ", F.col("s_name")), "go"),
        node(part, cat("method:part/", s("p_partkey")), "method", F.col("p_name"), catalog, cat("Part ", F.col("p_name"), " ", F.col("p_brand")), "rust"),
        node(part.select("p_type").distinct(), cat("type:ptype/", F.col("p_type")), "type", F.col("p_type"), catalog, cat("Part type ", F.col("p_type")), "rust"),
        node(part.select("p_brand").distinct(), cat("external_dep:", F.col("p_brand")), "external_dep", F.col("p_brand"), F.col("p_brand"), cat("Brand ", F.col("p_brand")), None, True),
        node(orders, cat("file:order/", s("o_orderkey")), "file", cat("order", s("o_orderkey"), ".ts"), cat("/src/", F.lower("o_orderpriority"), "/order", s("o_orderkey"), ".ts"), cat("Order status ", F.col("o_orderstatus")), "typescript"),
        node(items, cat("test:item/", s("item_id")), "test", cat("item", s("item_id")), cat("/tests/item", s("item_id"), ".test.ts"), cat("Item ", s("item_id")), "typescript"),
    ]
    of_nation = lambda c: cat("interface:nation/", s(c))
    order, sup, prt, cus = (lambda c: cat("file:order/", s(c))), (lambda c: cat("function:supplier/", s(c))), (lambda c: cat("method:part/", s(c))), (lambda c: cat("class:customer/", s(c)))
    ptype = cat("type:ptype/", F.col("p_type"))
    edge = lambda df, a, kind, b: df.select(a.alias("from_id"), F.lit(kind).alias("kind"), b.alias("to_id"))
    edges = [
        edge(nation, of_nation("n_nationkey"), "imports", cat("module:region/", s("n_regionkey"))),
        edge(customer, cus("c_custkey"), "imports", of_nation("c_nationkey")),
        edge(supplier, sup("s_suppkey"), "imports", of_nation("s_nationkey")),
        edge(orders, order("o_orderkey"), "imports", cus("o_custkey")),
        edge(customer.where("c_acctbal > 9000"), cus("c_custkey"), "implements", of_nation("c_nationkey")),
        edge(supplier.where("s_acctbal < 0"), sup("s_suppkey"), "tested_by", of_nation("s_nationkey")),
        edge(lines.select("l_orderkey", "l_suppkey").distinct(), order("l_orderkey"), "calls", sup("l_suppkey")),
        edge(lines.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct(), sup("l_suppkey"), "calls", prt("l_partkey")),
        edge(lines.select("l_orderkey", "l_partkey").distinct(), order("l_orderkey"), "contains", prt("l_partkey")),
        edge(part, ptype, "exports", prt("p_partkey")),
        edge(part, prt("p_partkey"), "inherits", ptype),
        edge(part, prt("p_partkey"), "depends_on", cat("external_dep:", F.col("p_brand"))),
    ]
    e = reduce(DataFrame.unionByName, edges)
    e = e.select(F.concat_ws("|", "from_id", "kind", "to_id").alias("id"), "from_id", "to_id", "kind", F.concat_ws(" ", "kind", "to_id").alias("reason"))
    return Graph(reduce(DataFrame.unionByName, nodes), e)


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Which event type follows which, as ``imports``: dense, cyclic, with self-loops; users ``call`` types."""
    from pyspark.sql import Window as W

    ev = table(spark, sf_dir, "events")
    step = ev.select(F.col("event_type").alias("from_id"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("to_id")).where("to_id is not null").distinct()
    names = ev.select(F.col("event_type").alias("id")).distinct()
    nodes = names.select("id", F.lit("file").alias("kind"), F.col("id").alias("name"), F.concat(F.lit("/events/"), "id").alias("file_path"), F.lit("").alias("description"), F.lit(False).alias("is_external"), F.lit(None).cast("string").alias("language"))
    edges = step.select(F.concat_ws("|", "from_id", F.lit("imports"), "to_id").alias("id"), "from_id", "to_id", F.lit("imports").alias("kind"), F.lit("").alias("reason"))
    return Graph(nodes, edges)


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Which supplier stands in the line behind which in an order, as ``imports``: cyclic, and it grows with the lines."""
    from pyspark.sql import Window as W

    name = lambda c: F.concat(F.lit("supplier/"), F.col(c).cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    step = lines.select(name("l_suppkey").alias("from_id"), F.lead(name("l_suppkey")).over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")).alias("to_id")).where("to_id is not null").distinct()
    nodes = table(spark, sf_dir, "supplier").select(name("s_suppkey").alias("id"), F.lit("file").alias("kind"), F.col("s_name").alias("name"), F.concat(F.lit("/supply/"), "s_name").alias("file_path"), F.lit("").alias("description"), F.lit(False).alias("is_external"), F.lit(None).cast("string").alias("language"))
    edges = step.select(F.concat_ws("|", "from_id", F.lit("imports"), "to_id").alias("id"), "from_id", "to_id", F.lit("imports").alias("kind"), F.lit("").alias("reason"))
    return Graph(nodes, edges)


#: The same graphs as SQL, for comparison.
GRAPH_SQL = """g_nodes AS (
SELECT 'module:region/' || r_regionkey AS id, 'module' AS kind, r_name AS name, '/src/geo/region' || r_regionkey || '.ts' AS file_path, 'Region ' || r_name AS description, false AS is_external, 'typescript' AS language FROM region
UNION ALL SELECT 'interface:nation/' || n_nationkey, 'interface', n_name, '/src/geo/region' || n_regionkey || '.ts', 'Nation ' || n_name, false, 'typescript' FROM nation
UNION ALL SELECT 'class:customer/' || c_custkey, 'class', c_name, '/src/' || lower(c_mktsegment) || '/nation' || c_nationkey || '.py', 'Customer in ' || c_mktsegment, false, 'python' FROM customer
UNION ALL SELECT 'function:supplier/' || s_suppkey, 'function', s_name, '/src/supply/nation' || s_nationkey || '.go', 'Supplier ' || s_name, false, 'go' FROM supplier
UNION ALL SELECT 'method:part/' || p_partkey, 'method', p_name, '/src/catalog/' || lower(p_type) || '.rs', 'Part ' || p_name || ' ' || p_brand, false, 'rust' FROM part
UNION ALL SELECT DISTINCT 'type:ptype/' || p_type, 'type', p_type, '/src/catalog/' || lower(p_type) || '.rs', 'Part type ' || p_type, false, 'rust' FROM part
UNION ALL SELECT DISTINCT 'external_dep:' || p_brand, 'external_dep', p_brand, p_brand, 'Brand ' || p_brand, true, NULL FROM part
UNION ALL SELECT 'file:order/' || o_orderkey, 'file', 'order' || o_orderkey || '.ts', '/src/' || lower(o_orderpriority) || '/order' || o_orderkey || '.ts', 'Order status ' || o_orderstatus, false, 'typescript' FROM orders
UNION ALL SELECT 'test:item/' || item_id, 'test', 'item' || item_id, '/tests/item' || item_id || '.test.ts', 'Item ' || item_id, false, 'typescript' FROM benchmark
), g_edges0 AS (
SELECT 'interface:nation/' || n_nationkey AS from_id, 'imports' AS kind, 'module:region/' || n_regionkey AS to_id FROM nation
UNION ALL SELECT 'class:customer/' || c_custkey, 'imports', 'interface:nation/' || c_nationkey FROM customer
UNION ALL SELECT 'function:supplier/' || s_suppkey, 'imports', 'interface:nation/' || s_nationkey FROM supplier
UNION ALL SELECT 'file:order/' || o_orderkey, 'imports', 'class:customer/' || o_custkey FROM orders
UNION ALL SELECT 'class:customer/' || c_custkey, 'implements', 'interface:nation/' || c_nationkey FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT 'function:supplier/' || s_suppkey, 'tested_by', 'interface:nation/' || s_nationkey FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT DISTINCT 'file:order/' || l_orderkey, 'calls', 'function:supplier/' || l_suppkey FROM lineitem
UNION ALL SELECT DISTINCT 'function:supplier/' || l_suppkey, 'calls', 'method:part/' || l_partkey FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT DISTINCT 'file:order/' || l_orderkey, 'contains', 'method:part/' || l_partkey FROM lineitem
UNION ALL SELECT 'type:ptype/' || p_type, 'exports', 'method:part/' || p_partkey FROM part
UNION ALL SELECT 'method:part/' || p_partkey, 'inherits', 'type:ptype/' || p_type FROM part
UNION ALL SELECT 'method:part/' || p_partkey, 'depends_on', 'external_dep:' || p_brand FROM part
), g_edges AS (SELECT from_id || '|' || kind || '|' || to_id AS id, from_id, to_id, kind, kind || ' ' || to_id AS reason FROM g_edges0)"""

SUPPLY_SQL = """v_edges AS (
SELECT DISTINCT a AS from_id, b AS to_id FROM (SELECT 'supplier/' || l_suppkey AS a, 'supplier/' || lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL)"""

EVENT_SQL = """v_edges AS (
SELECT DISTINCT a AS from_id, b AS to_id FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"""
