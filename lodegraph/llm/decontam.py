"""Operator 8, benchmark decontamination: SimHash of item-sized windows, DataFrame functions only.

Words are lower-cased runs of letters and digits; the shingles of a word list
are its distinct pairs of neighbours (a single word is its own shingle), weighed
by characters. An item is contained where a window of as many words as the item
has a SimHash within ``RADIUS`` of the item's and a similarity (weight of the
shared shingles over weight of all) of at least ``threshold``.

1. Windows: similarity t needs shared shingles of t times the item's weight W.
   Of an item's shingles the commonest in the benchmark, of less than
   ``LEFT_OUT`` * t * W together, are left out; the others are looked up in every
   text and summed by bins of window starts. Bins that reach t * W less what was
   left out are looked at again with all shingles: sorted starts and ends of
   shingles give the shared weight at every window start as running sums.
   Windows below t * W are left; no other window is, in any alignment.
2. Every such window gets a 128-bit SimHash of its words in eight blocks of 16
   bits. Two fingerprints within 31 bits differ by at most 3 in a block, so each
   item is filed under all values within 3 bits of each of its blocks, and a
   window meets every item of its size within the radius.
3. Hamming distance and exact similarity of the pairs that met.

Defined cases: null texts count as empty; items without a word guard nothing,
those of one word guard that word; items of null item_id are told apart by
their text and reported with a null item_id; repeated items and rows of both
equal doc_id and text count once; a text shorter than an item is one window; an
item whose similarity reaches the threshold at several windows gives one row,
that of the most similar, then first window; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.llm.batches import fresh
from lodegraph.storage import materialise, size_checked

RADIUS = 31
BLOCKS = 8
BLOCK_BITS = 16
THRESHOLD = 0.5
#: Share of a window's necessary weight that may stand in shingles which are not looked up at first.
LEFT_OUT = 0.8
_NEAR = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= RADIUS // BLOCKS]
_DOC = ["doc_id", "th"]
_EPS = 1e-9


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _texts(w: Column) -> Column:
    """The distinct shingles of a word list; a line break can't be part of a word."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit("\n"), w[i + 1]))
    return F.when(F.size(w) >= 2, F.array_distinct(pairs)).otherwise(w)


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("bigint"), lambda a, s: a + F.length(s))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, w, size: distinct items of at least one word."""
    return benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= 1).dropDuplicates(["item_id", "w"]).withColumn("size", F.size("w"))


def fingerprints(windows: DataFrame, key: list[str], w: str, widest: int) -> DataFrame:
    """``windows`` with blocks: array<int>, the SimHash of the words in column ``w`` (at most ``widest``) in blocks of 16 bits.

    A few bits of a word's hash at once add to as many counters in one long: four of 15 bits, two of 30 for longer windows.
    """
    bits = 4 if widest < 1 << 15 else 2
    lane, per = 60 // bits, 64 // bits
    spread = ", ".join(f"{sum(((v >> b) & 1) << (lane * b) for b in range(bits))}L" for v in range(1 << bits))
    word, a, b2 = fresh(windows, "word", "a", "b")
    each = windows.select(*key, F.explode(w).alias(word)).select(*key, F.xxhash64(word).alias(a), F.xxhash64(F.lit("second seed"), word).alias(b2))
    part = lambda i: f"cast(shiftrightunsigned({a if i < per else b2}, {bits * (i % per)}) & {(1 << bits) - 1} as int)"
    sums = each.groupBy(*key).agg(*[F.expr(f"sum(array({spread})[{part(i)}]) as __s{i}") for i in range(2 * per)], F.expr("count(*) as __n"))
    count = lambda at: f"shiftright(__s{at // bits}, {lane * (at % bits)}) & {(1 << lane) - 1}"
    block = lambda j: " + ".join(f"if(({count(j * BLOCK_BITS + b)}) * 2 > __n, {1 << b}, 0)" for b in range(BLOCK_BITS))
    return windows.join(sums.select(*key, F.expr(f"array({', '.join(map(block, range(BLOCKS)))}) as blocks")), key)


def _shingles(items: DataFrame, threshold: float) -> DataFrame:
    """item, size, h, c (weight), all (the item's weight), seed, need (weight of the seeds in a window that is similar enough)."""
    count = items.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    pair = F.split("s", "\n")
    each = items.select("item", "size", F.explode(_texts(F.col("w"))).alias("s")).select(
        "item", "size", F.length("s").alias("c"), pair[0].alias("x"), F.get(pair, F.lit(1)).alias("y"), F.when(F.col("size") > 1, F.xxhash64(pair[0], F.get(pair, F.lit(1)))).otherwise(F.xxhash64("s")).alias("h")
    )
    known = each.join(count.select(F.col("word").alias("x"), F.col("f").alias("fx")), "x").join(count.select(F.col("word").alias("y"), F.col("f").alias("fy")), "y", "left")
    known = known.groupBy("item", "size", "h").agg(F.sum("c").alias("c"), F.max(F.least("fx", F.coalesce("fy", "fx"))).alias("common"))  # equal hashes are looked up as one
    of_item = W.partitionBy("item")
    upto = F.sum("c").over(of_item.orderBy(F.desc("common"), "h").rowsBetween(W.unboundedPreceding, 0))
    marked = known.select("item", "size", "h", "c", F.sum("c").over(of_item).alias("all"), upto.alias("upto"))
    marked = marked.withColumn("seed", F.col("upto") >= LEFT_OUT * threshold * F.col("all"))
    left_out = F.sum(F.when(F.col("seed"), F.lit(0)).otherwise(F.col("c"))).over(of_item)
    return marked.select("item", "size", "h", "c", "all", "seed", (threshold * F.col("all") - left_out).alias("need"))


def _hits(docs: DataFrame, shingles: DataFrame, single: bool) -> DataFrame:
    """``docs`` without words, with the columns of ``shingles`` at each place of one, and lo, hi: the window starts that hold the place."""
    keep = [c for c in docs.columns if c != "w"]
    # not posexplode: its inferred filter would cut the words twice
    at = docs.select(*keep, "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)))).alias("p"))
    pairs = F.xxhash64(F.get("w", "p"), F.get("w", F.col("p") + 1))
    found = at.select(*keep, "n", "p", pairs.alias("h")).join(shingles.where("size > 1"), "h")
    if single:
        found = found.unionByName(at.select(*keep, "n", "p", F.xxhash64(F.get("w", "p")).alias("h")).join(shingles.where("size = 1"), "h"))
    last = F.greatest(F.col("n") - F.col("size"), F.lit(0))
    lo = F.greatest(F.col("p") - F.greatest(F.col("size") - 2, F.lit(0)), F.lit(0))
    return found.withColumn("lo", F.least(lo, last)).withColumn("hi", F.least("p", last))


def _by_bin(hits: DataFrame) -> DataFrame:
    of = lambda c: F.floor(F.col(c) / F.col("size")).cast("int")
    return hits.withColumn("bin", F.explode(F.array_distinct(F.array(of("lo"), of("hi")))))


def windows(documents: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """doc_id, th, size, start, w: every window that shares shingles of ``threshold`` of an item's weight."""
    shingles = materialise(_shingles(items, threshold), "shingles")
    single = not items.where("size = 1").isEmpty()
    docs = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words(F.col("text")).alias("w"))
    seeds = shingles.where("seed").select("h", "item", "size", "c", "need")
    sums = _by_bin(_hits(docs, size_checked(seeds, 48), single)).groupBy(*_DOC, "item", "bin").agg(F.sum("c").alias("c"), F.first("need").alias("need"))
    spots = materialise(sums.where(F.col("c") >= F.col("need") - _EPS).select(F.col("doc_id").alias("id"), F.col("th").alias("t"), F.col("item").alias("of"), F.col("bin").alias("at")), "spots")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t"))
    flagged = docs.join(size_checked(materialise(spots.select("id", "t").distinct(), "flagged"), 48), same, "left_semi")
    flagged = materialise(flagged.dropDuplicates(_DOC), "flagged")
    full = _by_bin(_hits(flagged, size_checked(shingles.select("h", "item", "size", "c", "all"), 48), single))
    full = full.join(size_checked(spots, 64), same & (F.col("item") == F.col("of")) & (F.col("bin") == F.col("at")), "left_semi")
    key = [*_DOC, "item", "bin"]
    # a shingle counts once in a window: the next place of it adds only the starts behind the place before
    before = F.lag("p").over(W.partitionBy(*key, "h").orderBy("p"))
    lo = F.greatest("lo", F.col("bin") * F.col("size"), F.coalesce(before + 1, F.lit(0)))
    hi = F.least("hi", F.col("bin") * F.col("size") + F.col("size") - 1)
    spans = full.select(*key, "size", "all", "c", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    steps = spans.select(*key, "size", "all", F.inline(F.array(F.struct(F.col("lo").alias("s"), F.col("c").alias("d")), F.struct((F.col("hi") + 1).alias("s"), (-F.col("c")).alias("d")))))
    steps = steps.groupBy(*key, "s").agg(F.sum("d").alias("d"), F.first("size").alias("size"), F.first("all").alias("all"))
    in_order = W.partitionBy(*key).orderBy("s")
    runs = steps.select(*_DOC, "size", "all", "s", F.lead("s").over(in_order).alias("next"), F.sum("d").over(in_order).alias("shared"))
    runs = runs.where((F.col("shared") >= threshold * F.col("all") - _EPS) & (F.col("s") < F.col("next")))
    starts = materialise(runs.select(F.col("doc_id").alias("id"), F.col("th").alias("t"), "size", F.explode(F.sequence(F.col("s"), F.col("next") - 1)).alias("start")).distinct(), "starts")
    return flagged.join(size_checked(starts, 48), same).select(*_DOC, "size", "start", F.expr("slice(w, start + 1, size)").alias("w"))


def find(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, item_id, start_word, size, hamming, similarity: the items that each document contains."""
    items = materialise(items_of(benchmark).withColumn("item", F.monotonically_increasing_id()), "items")
    widest = items.agg(F.max("size")).first()[0] or 0
    items = materialise(fingerprints(items, ["item"], "w", widest), "items")
    placed = materialise(windows(documents, items, threshold).withColumn("window", F.monotonically_increasing_id()), "windows")
    marked = materialise(fingerprints(placed, ["window"], "w", widest), "windows")
    near = F.explode(F.expr(f"transform(array({', '.join(map(str, _NEAR))}), m -> v ^ m)")).alias("v")
    keys = items.select("item", "size", F.posexplode("blocks").alias("j", "v")).select("item", "size", "j", near)
    # 5,576 keys an item, of which the optimizer's estimate knows nothing
    met = marked.select("window", "size", "blocks", F.posexplode("blocks").alias("j", "v")).join(keys.hint("merge"), ["size", "j", "v"])
    met = met.join(size_checked(items.select("item", F.col("blocks").alias("ib")), 96), "item")
    met = met.withColumn("hamming", F.aggregate(F.zip_with("blocks", "ib", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x))
    met = met.where(F.col("hamming") <= RADIUS).select("window", "item", "hamming").distinct()
    both = met.join(marked.select("window", *_DOC, "start", "w"), "window").join(items.select("item", "item_id", "size", F.col("w").alias("iw")), "item")
    both = both.withColumn("p", _texts(F.col("w"))).withColumn("q", _texts(F.col("iw"))).withColumn("shared", _weight(F.array_intersect("p", "q")))
    scored = both.withColumn("similarity", F.col("shared") / (_weight(F.col("p")) + _weight(F.col("q")) - F.col("shared"))).where(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("start", "size", "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    return scored.groupBy(*_DOC, "item_id", F.when(F.col("item_id").isNull(), F.col("item"))).agg(best.alias("b")).select(*_DOC, "item_id", F.col("b.start").alias("start_word"), "b.size", "b.hamming", "b.similarity")


def drop_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no benchmark item; all columns as they were."""
    th, leak_id, leak_th = fresh(documents, "th", "leak_id", "leak_th")
    leaks = materialise(find(documents, benchmark, threshold).select(F.col("doc_id").alias(leak_id), F.col("th").alias(leak_th)).distinct(), "leaks")
    tagged = documents.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    return tagged.join(size_checked(leaks, 40), F.col("doc_id").eqNullSafe(F.col(leak_id)) & (F.col(th) == F.col(leak_th)), "left_anti").drop(th)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "item_id", F.col("start_word").cast("bigint"), F.col("size").cast("bigint").alias("n_words"), F.col("hamming").cast("bigint"), "similarity")
