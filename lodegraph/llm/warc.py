"""Operator 3, WARC: a content-addressed archive.

``write_archive`` stores every payload once, under its SHA-256, and the exact
header of every record in a table of its own. ``read_archive`` checks each
payload against its digest and puts the original records together by joins.
Of records with equal payloads of at least ``LEAST`` bytes the one of the
largest page_id is the response, the others revisit it; smaller payloads are
always responses, though stored once all the same.

Defined cases: a null html is an empty payload, a null url an empty target;
line breaks in a url are percent-encoded; rows that repeat a page_id with the
same payload are alike (both response or both revisit); a null page_id counts
as smaller than all others; empty tables make empty archives.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.storage import new_path

LEAST = 1000
SALTS = 16
_URN = "urn:lodegraph:page:"
_DATE = "2024-01-01T00:00:00Z"


def _header(date: str):
    line = lambda name, *value: F.concat(F.lit(name + ": "), *value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", page("page_id")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(line("WARC-Refers-To", page("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")), F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, date: str = _DATE) -> None:
    """Write ``path``/payloads (digest, n, payload) and ``path``/headers (page_id, digest, n, revisit, header)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("bigint").alias("n"))
    # copies meet within a task first, so a payload that a third of all pages share is sent a few times
    rows.groupBy("digest").agg(F.first("n").alias("n"), F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    index = rows.select("page_id", "url", "digest", "n", F.sha1("payload").alias("sha1"))
    held = index.where(F.col("n") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("c")).where("c > 1")
    spread = held.select("digest", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = index.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "salt"], "left")
    joined = joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")))
    joined.select("page_id", "digest", "n", F.col("refers_to").isNotNull().alias("revisit"), _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("a stored payload does not match its digest "), F.col("digest")))
    return stored.withColumn("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(wrong.cast("string")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header, record: every record as it would stand in a file. Revisits have no block."""
    headers = spark.read.parquet(f"{path}/headers")
    salt = F.when(F.col("n") < LEAST, F.pmod(F.xxhash64("page_id", "header"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("n") < LEAST, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    full = headers.where("not revisit").withColumn("salt", salt).drop("n").join(_payloads(spark, path).select("digest", "payload", F.explode(salts).alias("salt")), ["digest", "salt"])
    end = F.lit("\r\n\r\n").cast("binary")
    return full.select("digest", "header", F.concat("header", "payload", end).alias("record")).unionByName(headers.where("revisit").select("digest", "header", F.concat("header", end).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """digest, page_id, record_type, refers_to, stated (digest in the header), block: what the records say."""
    text = F.decode("header", "utf-8")
    field = lambda name, value: F.nullif(F.regexp_extract(text, f"\r\n{name}: {value}\r\n", 1), F.lit(""))
    page = lambda name: field(name, f"<{_URN}([^>]*)>").try_cast("bigint")
    return records.select(
        "digest", page("WARC-Record-ID").alias("page_id"), field("WARC-Type", "([a-z]+)").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("stated"), F.col("record").substr(F.length("header") + 1, field("Content-Length", "([0-9]+)").cast("int")).alias("block"),
    )


def export_files(records: DataFrame, folder: str) -> DataFrame:
    """Write the records as plain .warc files, one a partition, to a folder that all executors share; gives (file, records).

    A file gets its name when it is whole, so a task that runs again replaces its file.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get()
        name = f"{folder}/part-{at.partitionId():06d}.warc"
        n = 0
        with open(f"{name}.{at.taskAttemptId()}", "wb") as f:
            for b in batches:
                for r in b.column("record").to_pylist():
                    f.write(r)
                    n += 1
        os.replace(f"{name}.{at.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return records.select("record").mapInArrow(run, "file string, records bigint")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    parsed = parse_records(read_archive(spark, path)).withColumn("revisit", F.col("record_type") == "revisit")
    broken = F.raise_error(F.concat(F.lit("a record's payload does not match its header, page "), F.col("page_id").cast("string"))).cast("string")
    checked = F.when(F.col("revisit") | (F.sha1("block") == F.col("stated")), F.col("stated")).otherwise(broken)
    out = parsed.select("page_id", "digest", "revisit", "record_type", "refers_to", F.length("block").cast("bigint").alias("own"), checked.alias("payload_digest"))
    # a revisit's payload is the stored one of its digest; only its length is wanted here
    sizes = spark.read.parquet(f"{path}/payloads").where(F.col("n") >= LEAST).select("digest", F.col("n").alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisits = out.where("revisit").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(sizes, ["digest", "salt"])
    columns = ["payload_digest", "record_type", "refers_to"]
    return out.where("not revisit").select("page_id", F.col("own").alias("payload_bytes"), *columns).unionByName(revisits.select("page_id", F.col("whole").alias("payload_bytes"), *columns))


OP3_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS holder FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> holder THEN holder END AS refers_to
FROM k
"""
