"""Operator 5, line dedup: overlapping three-line windows, DataFrame functions only.

A window is three consecutive lines of one document, known by two seeded
64-bit hashes. Of every window that occurs more than once, the first
occurrence (by doc_id, hash of the text, position) stays; the lines that any
later occurrence covers are removed, covered positions being merged.

Defined cases: a null text counts as one empty line; documents of fewer than
three lines keep all of them; rows that repeat both doc_id and text are one
document and get the same result; the windows are judged on the input; line
breaks are \\n alone; extra columns are carried along by dedup().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.batches import fresh
from lodegraph.llm.hot import join_counted
from lodegraph.storage import materialise

WIDTH = 3


def _cut(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def windows(documents: DataFrame) -> DataFrame:
    """doc_id, th, pos, h1, h2: every window of every document."""
    lines = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), _cut(F.col("text")).alias("lines")).where(F.size("lines") >= WIDTH)
    line = lambda i: [F.col("lines")[i + j] for j in range(WIDTH)]
    each = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WIDTH),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*line(i)).alias("h1"), F.xxhash64(F.lit("second seed"), *line(i)).alias("h2")),
    )
    return lines.select("doc_id", "th", F.inline(each))


def later_windows(found: DataFrame) -> DataFrame:
    """doc_id, th, hits: positions of windows that occurred before, per document."""
    at = F.struct("doc_id", "th", "pos")
    firsts = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where("first != last")
    firsts = materialise(firsts.select("h1", "h2", "first", "n"), "lines")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hits = join_counted(found, firsts, ["h1", "h2"], "n", total, F.xxhash64("doc_id", "th", "pos")).where(at != F.col("first"))
    return hits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("hits"))


def dedup(documents: DataFrame, counts: tuple[str, str] | None = None) -> DataFrame:
    """All columns of the input with ``text`` reduced (and ``n_chars``, where there is one); behind them, if named, the numbers of lines and of removed lines."""
    th, lines, id2, th2, hits, covered, new = fresh(documents, "th", "lines", "id2", "th2", "hits", "covered", "new")
    found = later_windows(windows(documents)).select(F.col("doc_id").alias(id2), F.col("th").alias(th2), F.col("hits").alias(hits))
    keyed = documents.withColumns({th: F.xxhash64(F.coalesce("text", F.lit(""))), lines: _cut(F.col("text"))})
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(id2)) & (F.col(th) == F.col(th2)), "left")
    out = joined.withColumn(covered, F.array_distinct(F.flatten(F.transform(hits, lambda p: F.array(*[p + j for j in range(WIDTH)])))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered))
    out = out.withColumn(new, F.when(F.col(hits).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col(lines)[i]), "\n")))
    columns = [F.col(new).alias("text") if c == "text" else F.length(F.coalesce(new, F.lit(""))).cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in documents.columns]
    numbers = (F.size(lines), F.coalesce(F.size(covered), F.lit(0)))
    return out.select(*columns, *(n.cast("bigint").alias(c) for n, c in zip(numbers, counts or ())))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("kept_text"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, ls, p, ls[p] AS a, ls[p + 1] AS b, ls[p + 2] AS c
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls) - 2)) AS p FROM l WHERE len(ls) >= 3)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w
), x AS (
  SELECT DISTINCT doc_id, p + j AS p FROM r, (VALUES (0), (1), (2)) AS t(j) WHERE k > 1
), e AS (
  SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS p FROM l
)
SELECT e.doc_id, count(*) AS n_lines, count(x.p) AS n_removed,
       coalesce(string_agg(CASE WHEN x.p IS NULL THEN e.line END, chr(10) ORDER BY e.p), '') AS kept_text
FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.p = e.p GROUP BY e.doc_id
"""
