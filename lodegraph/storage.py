"""Tables in the cluster's shared folder: how iterative plans cut their lineage.

Every table is written once as Parquet below ``spark.checkpoint.dir`` and read
back, so that a lost executor costs only the reading of files that all
executors share. ``spark.checkpoint.dir`` is read from the session; only a
purely local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None
_owners: list[str] = ["-"]
_written: dict[str, list[str]] = {}

#: A table may be broadcast up to this size; joins beyond it shuffle.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share."""
    global _local_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
    return _local_dir


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once a session, for jobs started without --py-files."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="lodegraph-code-"), "lodegraph")
        with zipfile.ZipFile(f"{base}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
        spark.sparkContext.addPyFile(f"{base}.zip")


def own_session(spark: SparkSession) -> SparkSession:
    """A copy of the caller's session in which sizes decide on broadcasts only once they are measured.

    The planner takes a table to be as large as its files. Ids and paths compress to a fiftieth, so that it sends
    ten million of them through the driver as "less than 10 MB". Here it joins by shuffle until a stage has
    counted its bytes; explicit hints remain. The caller's own settings stay as they are.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    if own.conf.get("spark.sql.adaptive.enabled") == "true":
        if own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", own.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return own


@contextlib.contextmanager
def owner(name: str):
    """Tables written inside belong to ``name`` and go with ``release(spark, name)``."""
    _owners.append(name)
    try:
        yield
    finally:
        _owners.pop()


def new_path(spark: SparkSession, label: str = "table") -> str:
    path = f"{shared_dir(spark)}/lodegraph-{label}-{uuid.uuid4().hex}"
    _written.setdefault(_owners[-1], []).append(path)
    return path


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the table as written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[tuple, str] = {}


def kept(spark: SparkSession, key: str, build, partition_by: str | None = None) -> DataFrame:
    """A table built once a session under ``key`` and then read, partitioned by a column that queries filter by."""
    at = (spark.sparkContext.applicationId, key)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = _kept.get(at)
    done = path and jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    if not done:
        path = f"{shared_dir(spark)}/lodegraph-kept-{uuid.uuid4().hex}"
        df = build()
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        _kept[at] = path
        _schemas[path] = df.schema
    return spark.read.schema(_schemas[path]).parquet(path).select(*_schemas[path].names)


_schemas: dict = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete a table returned by materialise() that no pending plan reads."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodegraph-" in file:
            _delete(df.sparkSession, file)


def release(spark: SparkSession, name: str) -> None:
    """Delete the tables of an owner, once what reads them has been written."""
    for path in _written.pop(name, []):
        _delete(spark, path)


def size_checked(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A hint to broadcast ``table`` if its counted rows fit ``limit``; else the table, for a shuffled join.

    ``row_bytes`` must bound the width of a row. Pass materialised tables, since this counts.
    """
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def measured(table: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """A materialised table of strings and numbers, with a hint to broadcast it if its rows fit ``limit``; the number of its rows."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, t in table.dtypes if t == "string"), F.lit(24 + 16 * len(table.columns)))
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return (F.broadcast(table) if size <= limit else table), n
