"""Source trees: discovery, hashes, incremental builds into a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.operators import store as st
from lodegraph.sources import parsers
from lodegraph.storage import materialise

#: Directories that are never read, and suffixes of generated files.
IGNORED_DIRS = "__pycache__ node_modules coverage vendor build dist bin obj .git".split()
IGNORED_FILES = (".d.ts", ".min.js")


def wanted(path: Column) -> Column:
    dirs = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS)
    out = ~path.rlike(rf"/({dirs})/") & parsers.language(path).isNotNull()
    for s in IGNORED_FILES:
        out = out & ~path.endswith(s)
    return out


def discover(spark: SparkSession, root: str) -> DataFrame:
    """file_path, language, content, content_hash, mtime of all source files below ``root``; unreadable bytes are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    return raw.withColumn("file_path", path).where(wanted(F.col("file_path"))).select(
        "file_path", parsers.language(F.col("file_path")).alias("language"), F.decode("content", "utf-8").alias("content"), F.sha2("content", 256).alias("content_hash"), (F.col("modificationTime").cast("double") * 1000).alias("mtime")
    )


def apply_scan(store: st.Store, scan: DataFrame, now: int, force: bool = False, remove_missing: bool = True, calls: bool = False) -> dict:
    """Bring a store up to date with a scan; gives counts and the errors table.

    A changed file's own nodes and outgoing edges are replaced; external packages stay.
    """
    files = store.load("files", schema.FILES)
    seen = materialise(scan, "scan")
    todo = materialise(st.changed(seen, files, force), "scan")
    graph, errors = parsers.parse_graph(todo.select("file_path", "language", "content"), calls)
    errors = materialise(errors, "errors")
    done = todo.join(errors.select("file_path"), "file_path", "left_anti")
    gone = done.select("file_path")
    if remove_missing:
        gone = gone.union(st.vanished(seen, files))
    gone = materialise(gone.distinct(), "gone")
    kept, kept_files = st.delete_files(store.graph(), gone, files)
    stamp = F.lit(now).cast("bigint")
    nodes = materialise(graph.nodes.withColumns({"updated_at": stamp, "community_id": F.lit(None).cast("bigint")}), "nodes")
    edges = materialise(graph.edges.withColumn("updated_at", stamp), "edges")
    n_nodes = nodes.groupBy("file_path").agg(F.count("*").cast("int").alias("node_count"))
    n_edges = edges.join(nodes.select(F.col("id").alias("from_id"), "file_path"), "from_id").groupBy("file_path").agg(F.count("*").cast("int").alias("edge_count"))
    rows = done.select("file_path", "language", "content_hash", "mtime").join(n_nodes, "file_path", "left").join(n_edges, "file_path", "left").select("file_path", "language", "content_hash", "mtime", "node_count", "edge_count", stamp.alias("parsed_at"))
    new_nodes = materialise(st.upsert(kept.nodes, nodes, ["id"], None, ["updated_at"]), "nodes")
    new_edges = materialise(st.upsert(kept.edges, edges, ["id"], ["reason", "updated_at"], ["updated_at"]), "edges")
    new_files = materialise(kept_files.unionByName(rows), "files")
    store.save_all({"nodes": new_nodes, "edges": new_edges, "files": new_files})
    return {"parsed": done.count(), "skipped": seen.count() - todo.count(), "errors": errors}


def build(spark: SparkSession, root: str, path: str, now: int = 0, force: bool = False, calls: bool = False) -> dict:
    """Scan a source tree into the store at ``path``."""
    return apply_scan(st.Store(spark, path), discover(spark, root), now, force, True, calls)


def remove_files(spark: SparkSession, path: str, paths: DataFrame) -> None:
    """Take all files in ``paths`` (column file_path) out of a store, with their nodes' vectors, by one rewrite."""
    store = st.Store(spark, path)
    before = store.graph()
    graph, files = st.delete_files(before, paths, store.load("files", schema.FILES))
    tables = {"nodes": graph.nodes, "edges": graph.edges, "files": files}
    if store.exists("embeddings"):
        gone = before.nodes.join(paths, "file_path", "left_semi").select("id")
        tables["embeddings"] = st.delete_embeddings(store.load("embeddings", schema.EMBEDDINGS), gone)
    # all are computed before any is replaced, since edges and vectors are found by the old nodes
    new = {name: materialise(df, name) for name, df in tables.items()}
    store.save_all(new)


def remove_file(spark: SparkSession, path: str, file_path: str) -> None:
    """Take one file out of a store."""
    remove_files(spark, path, spark.range(1).select(F.lit(file_path).alias("file_path")))
