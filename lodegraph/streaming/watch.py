"""Watching: changed files as a stream, gathered into batches and applied to a store."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph import schema
from lodegraph.operators.store import Store
from lodegraph.sources import files, parsers
from lodegraph.storage import materialise

QUIET = "200 milliseconds"
CHANGE = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("file_path", T.StringType()), T.StructField("event", T.StringType())])


def debounce(events: DataFrame, keys: list[str] = (), gap: str = QUIET) -> DataFrame:
    """Batches of events that no quiet gap divides: start, end, n events, distinct paths. Works on streams with a watermark too."""
    w = F.session_window("ts", gap)
    got = events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("file_path")).alias("files"))
    return got.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "files")


def apply_batch(spark: SparkSession, store_path: str, batch: DataFrame, now: int) -> dict:
    """Apply one batch (file_path, event, content): of several events of a path the last by ts counts; unlink removes."""
    last = batch.groupBy("file_path").agg(F.max_by(F.struct("event", "content"), "ts").alias("e")).select("file_path", "e.*")
    gone = materialise(last.where("event = 'unlink'").select("file_path"), "unlinked")
    if not gone.isEmpty():
        files.remove_files(spark, store_path, gone)
    scan = last.where("event != 'unlink'").select("file_path", parsers.language(F.col("file_path")).alias("language"), "content", F.sha2("content", 256).alias("content_hash"), F.lit(float(now)).alias("mtime"))
    return files.apply_scan(Store(spark, store_path), scan.where(files.wanted(F.col("file_path"))), now, remove_missing=False)


def watch(spark: SparkSession, changes: DataFrame, store_path: str, on_update: Callable[[dict], None] | None = None, trigger: dict | None = None, checkpoint: str | None = None):
    """Start a query that applies a stream of changes (ts, file_path, event, content); stop() ends it."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            done = apply_batch(batch.sparkSession, store_path, batch, number)
            if on_update:
                on_update(done)

    writer = changes.writeStream.foreachBatch(each).trigger(**(trigger or {"processingTime": QUIET}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New change files (JSON lines of ts, file_path, event, content) in a folder, as a stream."""
    return spark.readStream.schema(T.StructType([*CHANGE.fields, T.StructField("content", T.StringType())])).json(folder)


def tree_changes(spark: SparkSession, root: str, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes since ``before``: ts, file_path, event, content; listing of the tree now, to be passed next time)."""
    now = materialise(files.discover(spark, root).select("file_path", "content_hash", "content"), "tree")
    old = now.where("false") if before is None else before
    events = snapshot_events(old.select("file_path", "content_hash"), now.select("file_path", "content_hash"))
    return events.join(now.select("file_path", "content"), "file_path", "left").select(F.current_timestamp().alias("ts"), "file_path", "event", "content"), now.select("file_path", "content_hash")


def watch_tree(spark: SparkSession, root: str, store_path: str, on_update: Callable[[dict], None] | None = None, every: float = 2.0, rounds: int | None = None) -> int:
    """Compare the tree with the listing before, again and again, and apply what changed as one batch; returns the number of batches.

    The first round compares with the store's files. Ends after ``rounds``; None: never.
    """
    before = Store(spark, store_path).load("files", schema.FILES).select("file_path", "content_hash")
    done = n = 0
    while rounds is None or n < rounds:
        if n:
            time.sleep(every)
        changes, now = tree_changes(spark, root, before)
        changes = materialise(changes, "changes")
        if not changes.isEmpty():
            result = apply_batch(spark, store_path, changes, int(time.time() * 1000))
            done += 1
            if on_update:
                on_update(result)
        before = now
        n += 1
    return done


def snapshot_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events between two listings (file_path, content_hash): add, change, unlink; what a file source alone can't see."""
    a, b = before.select("file_path", F.col("content_hash").alias("old")), after.select("file_path", F.col("content_hash").alias("new"))
    event = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "unlink").otherwise("change")
    return a.join(b, "file_path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("file_path", event.alias("event"))
