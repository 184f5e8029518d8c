"""Reading single facts, and changing stored tables by whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.schema import Graph

TABLES = ("nodes", "edges", "files", "embeddings", "communities")


# --- lookups
def nodes_by_kind(graph: Graph, kinds: list[str]) -> DataFrame:
    return graph.nodes.where(F.col("kind").isin(kinds)).orderBy("name", "id")


def nodes_by_file(graph: Graph, path: str) -> DataFrame:
    return graph.nodes.where(F.col("file_path") == path)


def nodes_by_language(graph: Graph, language: str) -> DataFrame:
    return graph.nodes.where(F.col("language") == language)


def node(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == node_id)


def edges_from(graph: Graph, node_id: str, kind: str | None = None) -> DataFrame:
    e = graph.edges.where(F.col("from_id") == node_id)
    return e if kind is None else e.where(F.col("kind") == kind)


def edges_to(graph: Graph, node_id: str, kind: str | None = None) -> DataFrame:
    e = graph.edges.where(F.col("to_id") == node_id)
    return e if kind is None else e.where(F.col("kind") == kind)


def neighbours(graph: Graph, node_id: str) -> DataFrame:
    """The existing nodes one step away in either direction."""
    ids = edges_from(graph, node_id).select(F.col("to_id").alias("id")).union(edges_to(graph, node_id).select("from_id")).distinct()
    return graph.nodes.join(ids, "id", "left_semi")


def induced_edges(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``ids`` (column id)."""
    return graph.edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*graph.edges.columns)


def touching_edges(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges with an end in ``ids``."""
    a = graph.edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(*graph.edges.columns)
    b = graph.edges.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*graph.edges.columns)
    return a.union(b).distinct()


def panel_search(graph: Graph, query: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes whose name or path contains the query, all edges that touch them, and those edges' ends."""
    q = query.lower()
    hit = graph.nodes.where(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("file_path"), F.lit(q))).select("id")
    edges = touching_edges(graph, hit)
    ids = hit.union(edges.select("from_id")).union(edges.select("to_id")).distinct()
    return graph.nodes.join(ids, "id", "left_semi"), edges


GROUPS = {"file": 1, "class": 2, "function": 3, "method": 4, "interface": 5, "module": 6, "external_dep": 7, "type": 8}


def view_nodes(graph: Graph, kind: str | None = None, text: str | None = None) -> DataFrame:
    """id, label, kind, bucket for drawing; filtered as the drawing's own controls do."""
    bucket = F.lit(9)
    for k, v in GROUPS.items():
        bucket = F.when(F.col("kind") == k, v).otherwise(bucket)
    n = graph.nodes.select("id", F.col("name").alias("label"), "kind", "file_path", bucket.alias("bucket"))
    n = n if kind is None else n.where(F.col("kind") == kind)
    return n if text is None else n.where(F.contains(F.lower("label"), F.lit(text.lower())))


def view_edges(graph: Graph, nodes: DataFrame | None = None) -> DataFrame:
    return induced_edges(graph, graph.nodes if nodes is None else nodes)


def file(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("file_path") == path)


def embedding(embeddings: DataFrame, node_id: str, provider: str | None = None) -> DataFrame:
    e = embeddings.where(F.col("node_id") == node_id)
    return e if provider is None else e.where(F.col("provider") == provider)


def embedding_count(embeddings: DataFrame) -> DataFrame:
    """provider, n of stored vectors."""
    return embeddings.groupBy("provider").agg(F.count("*").alias("n"))


def communities(table: DataFrame, level: int | None = None) -> DataFrame:
    """All communities, or those of a level, the largest first."""
    t = table if level is None else table.where(F.col("level") == level)
    return t.orderBy(F.desc("size"), "id")


def community_members(graph: Graph, community_id: int) -> DataFrame:
    return graph.nodes.where(F.col("community_id") == community_id).orderBy("id")


# --- changes
def upsert(table: DataFrame, rows: DataFrame, key: list[str], update: list[str] | None = None, order: list[str] = ()) -> DataFrame:
    """``table`` with ``rows`` merged in by key; of rows with one key the last by ``order`` counts.

    ``update`` names the columns that a conflict overwrites (all, if None).
    """
    last = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order or key])
    new = rows.select(*table.columns).withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    if update is None:
        return table.join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new)
    renamed = new.select(*[F.col(c).alias(c if c in key else f"__{c}") for c in table.columns], F.lit(True).alias("__new"))
    # a key on both sides keeps the old row but for the columns to update
    pick = lambda c: F.col(c) if c in key else F.when(F.col("__old") & ~F.lit(c in update), F.col(c)).otherwise(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))).alias(c)
    merged = table.withColumn("__old", F.lit(True)).join(renamed, key, "full_outer").withColumns({"__old": F.coalesce("__old", F.lit(False)), "__new": F.coalesce("__new", F.lit(False))})
    return merged.select(*[pick(c) for c in table.columns])


def upsert_nodes(nodes: DataFrame, rows: DataFrame, order: list[str] = ()) -> DataFrame:
    return upsert(nodes, rows, ["id"], None, order)


def upsert_edges(edges: DataFrame, rows: DataFrame, order: list[str] = ()) -> DataFrame:
    """A conflict changes reason and updated_at only."""
    return upsert(edges, rows, ["id"], [c for c in ("reason", "updated_at") if c in edges.columns], order)


def delete_files(graph: Graph, paths: DataFrame, files: DataFrame | None = None) -> tuple[Graph, DataFrame | None]:
    """Without the nodes of the files in ``paths`` (column file_path) and those nodes' outgoing edges; incoming edges stay."""
    gone = graph.nodes.join(paths, "file_path", "left_semi").select(F.col("id").alias("from_id"))
    edges = graph.edges.join(gone, "from_id", "left_anti").select(*graph.edges.columns)
    nodes = graph.nodes.join(paths, "file_path", "left_anti").select(*graph.nodes.columns)
    return Graph(nodes, edges), None if files is None else files.join(paths, "file_path", "left_anti").select(*files.columns)


def upsert_files(files: DataFrame, rows: DataFrame, order: list[str] = ()) -> DataFrame:
    return upsert(files, rows, ["file_path"], None, order)


def upsert_embeddings(embeddings: DataFrame, rows: DataFrame, order: list[str] = ()) -> DataFrame:
    """One vector for each node and provider."""
    return upsert(embeddings, rows, ["node_id", "provider"], None, order)


def delete_embeddings(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the vectors of the nodes in ``ids`` (column id)."""
    return embeddings.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(*embeddings.columns)


def assign_communities(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with community_id set from members (id, community_id), null elsewhere."""
    return nodes.drop("community_id").join(members.select("id", "community_id"), "id", "left")


def number_communities(rows: DataFrame, order: list) -> DataFrame:
    """Rows with an id counted from one in a fixed order."""
    return rows.withColumn("id", F.row_number().over(W.orderBy(*order)).cast("bigint"))


def changed(scan: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Scanned files (file_path, content_hash) whose hash is not the stored one."""
    return scan if force else scan.join(files.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")


def vanished(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Stored files that the scan did not see."""
    return files.join(scan.select("file_path"), "file_path", "left_anti").select("file_path")


class Store:
    """A folder of Parquet tables; save() writes beside the old table and swaps names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def load(self, name: str, schema=None) -> DataFrame:
        if not self.exists(name):
            if self.exists(f"{name}.old"):  # a save was cut off between its two renames
                return self.spark.read.parquet(f"{self.path}/{name}.old")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def save(self, name: str, df: DataFrame) -> DataFrame:
        self.save_all({name: df})
        return self.load(name)

    def save_all(self, tables: dict[str, DataFrame]) -> None:
        """Write all tables beside the old ones, then swap all names, so that only renames stand between old and new."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}.new")
        fs = self._fs()
        for name in tables:
            fs.delete(self._path(f"{name}.old"), True)
            if fs.exists(self._path(name)):
                fs.rename(self._path(name), self._path(f"{name}.old"))
            fs.rename(self._path(f"{name}.new"), self._path(name))
        for name in tables:
            fs.delete(self._path(f"{name}.old"), True)

    def graph(self) -> Graph:
        from lodegraph import schema

        return Graph(self.load("nodes", schema.NODES), self.load("edges", schema.EDGES))
