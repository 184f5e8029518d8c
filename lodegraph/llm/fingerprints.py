"""Operator 2, document fingerprints: a canonical exact digest, DataFrame functions only.

A text is folded to a canonical form: compatibility composition (NFKC), full
case folding, composition again, and every run of white space made one space
(none at the ends). The fingerprint is 128 bits of xxhash64 under two seeds
plus the canonical length. Texts whose fingerprints are equal are compared byte
for byte: grouping by digest *and* canonical text splits what merely collides.

Defined cases: a null text counts as empty; equal texts have equal
fingerprints; the next document is the one with the next larger doc_id (null
ids come first, equal ids are ordered by hash and length of their text), after
the last comes the first; a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.storage import materialise, size_checked

#: doc_ids in one ordering bucket.
SPAN = 1024
_COMPOSE = "com.ibm.icu.text.Normalizer"  # ships with Spark, which uses it for collations
_FOLD = "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    composed = F.reflect(F.lit(_COMPOSE), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.reflect(F.lit(_COMPOSE), F.lit("compose"), F.reflect(F.lit(_FOLD), F.lit("foldCase"), composed, F.lit(True)), F.lit(True))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """The fingerprint of a canonical text: 48 hex characters."""
    wide = F.concat(F.hex(F.xxhash64(canon)), F.lit("")), F.hex(F.xxhash64(F.lit("second seed"), canon))
    return F.lower(F.concat(F.lpad(wide[0], 16, "0"), F.lpad(wide[1], 16, "0"), F.lpad(F.hex(F.length(canon)), 16, "0")))


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """bucket -> next: the following bucket that exists, for a table of distinct buckets; ordered in two levels."""
    two = buckets.withColumn("over", F.floor(F.col("bucket") / SPAN))
    inner = two.withColumn("next", F.lead("bucket").over(W.partitionBy("over").orderBy("bucket")))
    # one row per SPAN * SPAN ids is left for the only global ordering
    tops = two.groupBy("over").agg(F.min("bucket").alias("first"))
    heads = tops.select("over", F.lead("first").over(W.orderBy("over")).alias("head"))
    return inner.join(heads, "over").select("bucket", F.coalesce("next", "head").alias("next"))


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, next_text: every text beside the following document's, by one shuffle of the texts."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "bucket", F.coalesce(F.floor(F.col("doc_id") / SPAN), F.lit(-(2**62))).cast("bigint")
    )
    order = W.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.length("text"))
    firsts = docs.groupBy("bucket").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))).alias("f"))
    firsts = materialise(firsts.select("bucket", "f.*"), "first")
    after = _next_bucket(firsts.select("bucket"))
    least = firsts.agg(F.min("bucket").alias("least"))
    after = after.join(F.broadcast(least)).select("bucket", F.coalesce("next", "least").alias("next"))
    # the few rows that open a bucket, with their text, keyed by the bucket before
    wanted = size_checked(materialise(after.join(firsts.withColumnRenamed("bucket", "next"), "next").select(F.col("bucket").alias("before"), "doc_id", "h", "n"), "first"), 64)
    heads = (
        docs.select(F.col("doc_id").alias("d"), "text").withColumn("th", F.xxhash64("text")).withColumn("tn", F.length("text"))
        .join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("h")) & (F.col("tn") == F.col("n")))
        .groupBy("before").agg(F.min("text").alias("head"))
    )
    rows = docs.withColumn("lead", F.lead("text").over(order))
    last = rows.join(heads, (F.col("bucket") == F.col("before")) & F.col("lead").isNull(), "left")
    return last.select("doc_id", "text", F.coalesce("lead", "head").alias("next_text"))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, canon_sha256: one row per input row."""
    canon = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("canon", canonical(F.col("text")))
    return canon.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), digest(F.col("canon")).alias("fingerprint"), F.sha2(F.col("canon").cast("binary"), 256).alias("canon_sha256"))


def exact_groups(documents: DataFrame, printed: DataFrame) -> DataFrame:
    """fingerprint, canon_sha256, class_id, copies of every canonical text that occurs more than once.

    ``printed`` is fingerprint_documents(documents), materialised. Only texts whose
    fingerprint repeats are read again and grouped by their bytes; copies meet
    within a task before anything is shuffled, so a hot group costs little.
    """
    repeated = printed.groupBy("fingerprint").agg(F.count("*").alias("c")).where("c > 1").select("fingerprint")
    repeated = size_checked(materialise(repeated, "fp"), 120)
    texts = documents.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    bytewise = texts.join(repeated, "fingerprint", "left_semi").groupBy("fingerprint", "canon").agg(F.count("*").alias("copies"), F.min("doc_id").alias("class_id"))
    return bytewise.where("copies > 1").select("fingerprint", F.sha2(F.col("canon").cast("binary"), 256).alias("canon_sha256"), "class_id", "copies")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.floor(F.length("text") / 4).cast("int")
    rows = with_next(documents).withColumn("n", F.length("text")).withColumn("edited", F.concat(F.expr("left(text, n - cast(floor(n / 4) as int))"), F.expr("left(next_text, cast(floor(n / 4) as int))")))
    rows = rows.withColumn("c", canonical(F.col("text"))).withColumn("e", canonical(F.col("edited")))
    rows = rows.withColumn("nf", F.when(F.length("text") == F.length("next_text"), F.col("text") == F.col("next_text")).otherwise(F.lit(False)))
    printed = materialise(
        rows.select(
            "doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            digest(F.col("c")).alias("fingerprint"), digest(F.col("e")).alias("edited_fingerprint"),
            (F.col("c") == F.col("e")).cast("double").alias("near_edited"),
            (F.col("nf") | (F.col("c") == canonical(F.col("next_text")))).cast("double").alias("near_next"),
            F.sha2(F.col("c").cast("binary"), 256).alias("canon_sha256"),
        ), "fp"
    )
    groups = exact_groups(documents, printed)
    salts = 16  # a fingerprint that a third of all rows share is spread over several tasks
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        printed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .join(spread, ["fingerprint", "canon_sha256", "salt"], "left")
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
    )
