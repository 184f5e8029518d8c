"""Operator 4, near duplicates: random bit-sampling over 256-bit SimHash fingerprints.

Every distinct word of a document counts alike in its fingerprint. Documents
of one fingerprint are one class from the start. Several tables sample random
coordinates of the fingerprint, by ``plan()`` as many as the number of
fingerprints asks for; fingerprints that agree on a table's sample meet in a
bucket and every pair in it is verified by its Hamming distance (at most
``RADIUS``). A bucket of more than ``CAP`` fingerprints is compared completely,
too, in blocks that many tasks share. Nothing is capped away. What is left of a
bucket is a root by fingerprint; roots are joined into groups by connected
components. Of a bucket's pairs only as many are compared as its components
need: what is near one fingerprint is connected, whatever lies between. Links
are then counted within the groups, where all links are and where each pair
comes once, not once for each table where it meets. No table of pairs, which
grows with the square of a group, is ever written.

Defined cases: a null text counts as empty; a text without word characters is
known by its whole string; equal texts have equal fingerprints; a null doc_id
is a value that comes before all others; of rows that repeat doc_id and text,
keep_one() keeps one; long texts are added up in parts.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.batches import fresh, map_batches, map_rows, slices
from lodegraph.llm.hot import join_counted
from lodegraph.operators.components import connected_components
from lodegraph.storage import materialise, size_checked

RADIUS = 44
#: Bits of a sample, at least, and the fingerprints that a bucket has on average, at most.
LEAST_BITS = 18
MEAN_BUCKET = 128
#: Chance that a pair at the radius agrees on the sample of some table.
MEET = 0.94
CAP = 512
#: Without effect since oversized buckets are no longer split; tests still set it.
LEVELS = 3
BLOCK = 2048
#: Near pairs that are held at once.
PAIRS = 300_000
#: Edges between fingerprints that a task holds at once.
EDGES = 1_000_000
#: Words of one text whose bits are held at once.
PART = 8192
_WORD = re.compile(r"[^\W_]+")
_NULL_ID = -(2**63)
FP = ["f0", "f1", "f2", "f3"]
ROW = "bucket bigint, fid bigint, members bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint"


def _features(text: str) -> set[str]:
    return set(_WORD.findall(text.lower())) or {"\0" + text}


def _bits(words) -> np.ndarray:
    """(n, 256) bits of the words' hashes."""
    raw = b"".join(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=32).digest() for w in words)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 32), axis=1)


def fingerprints(texts: list) -> np.ndarray:
    """(n, 4) int64: 256-bit SimHash of every text."""
    out = np.zeros((len(texts), 4), np.int64)
    texts = [t or "" for t in texts]
    for lo, hi in slices(texts):
        if hi - lo == 1:  # perhaps a very long one: its words' bits are not held together
            words = _features(texts[lo])
            ones, left = np.zeros(256, np.int64), iter(words)
            while part := list(islice(left, PART)):
                ones += _bits(part).sum(0, dtype=np.int64)
            out[lo] = np.packbits(2 * ones > len(words)).view(np.int64)
            continue
        ids: dict[str, int] = {}
        docs = [np.fromiter((ids.setdefault(w, len(ids)) for w in _features(t)), np.int64) for t in texts[lo:hi]]
        bits = _bits(ids)
        for i, d in enumerate(docs):
            ones = sum(bits[d[k : k + PART]].sum(0, dtype=np.int64) for k in range(0, len(d), PART))
            out[lo + i] = np.packbits(2 * ones > len(d)).view(np.int64)
    return out


def printed(documents: DataFrame) -> DataFrame:
    """id, th, f0..f3: one row per input row; th tells rows of one doc_id apart."""
    rows = documents.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")

    def run(ids, ths, texts):
        f = fingerprints(texts)
        return {"id": ids, "th": ths, **{c: f[:, j] for j, c in enumerate(FP)}}

    return map_rows(rows, "id bigint, th bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint", run)


def agree(bits: int, distance: int = RADIUS) -> float:
    """The chance that ``bits`` sampled coordinates miss all that a pair differs in."""
    return math.comb(256 - distance, bits) / math.comb(256, bits)


def plan(n: int) -> tuple[int, int]:
    """(tables, bits) for ``n`` fingerprints: buckets stay small, the recall at the radius stays ``MEET``; 95 tables of 18 bits up to 2**25."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / MEAN_BUCKET)))
    return math.ceil(math.log(1 - MEET) / math.log1p(-agree(bits))), bits


def _samples(n: int) -> np.ndarray:
    """(tables, bits) sampled coordinates."""
    rng = np.random.default_rng(977)
    tables, bits = plan(n)
    return np.stack([rng.permutation(256)[:bits] for _ in range(tables)])


def _masks(sample: np.ndarray) -> np.ndarray:
    """(tables, 4) uint64: the sampled coordinates as bits of a fingerprint."""
    bits = np.zeros((len(sample), 256), np.uint8)
    bits[np.arange(len(sample))[:, None], sample] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _buckets(classes: DataFrame, sample: np.ndarray) -> DataFrame:
    """Rows of ROW, one for every table; a bucket's number tells its table, by the remainder."""
    tables, bits = sample.shape
    names = ["fid", "members", *FP]

    def run(batches):
        for b in batches:
            f = np.stack([b.column(c).to_numpy() for c in FP], 1)
            rows = np.ascontiguousarray(np.unpackbits(f.view(np.uint8).reshape(len(f), 32), axis=1).T)
            for t, at in enumerate(sample):
                key = np.zeros(len(f), np.int64)
                for k, byte in enumerate(np.packbits(rows[at], axis=0)):
                    key |= byte.astype(np.int64) << (8 * k)
                yield pa.RecordBatch.from_arrays([pa.array(key * tables + t), *(b.column(c) for c in names)], ["bucket", *names])

    return map_batches(classes.select(*names), run, ROW)


def _near(one: np.ndarray, other: np.ndarray | None = None):
    """(i, j) of fingerprints within the radius: of ``one`` and ``other``, or i < j of ``one`` alone."""
    to = one if other is None else other
    step = max(1, 200_000 // max(1, len(to)))
    for lo in range(0, len(one), step):
        first = lo if other is None else 0
        x = [np.bitwise_count(one[lo : lo + step, k, None] ^ to[None, first:, k]) for k in range(4)]
        i, j = np.nonzero((x[0] + x[1]).astype(np.uint16) + (x[2] + x[3]) <= RADIUS)
        if other is None:
            later = j > i
            i, j = i[later], j[later]
        yield i + lo, j + first


def _near_within(m: np.ndarray):
    """(i, j) of the rows of small buckets, sorted by bucket, that are within the radius of each other."""
    f = m[:, 3:].view(np.uint64)
    at = np.arange(len(m) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(m)]
        at = at[m[at, 0] == m[at + step, 0]]
        for k in range(0, len(at), 100_000):
            i = at[k : k + 100_000]
            ok = np.bitwise_count(f[i] ^ f[i + step]).sum(1) <= RADIUS
            yield i[ok], i[ok] + step
        step += 1


def _met_before(x: np.ndarray, table: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of the pairs that differ in ``x`` meet in a table before theirs, too."""
    met = np.zeros(len(x), bool)
    left = np.arange(len(x))
    for t, mask in enumerate(masks):
        some = table > t
        left, x, table = left[some], x[some], table[some]
        if not len(left):
            break
        same = ~(x & mask).any(1)
        met[left[same]] = True
        left, x, table = left[~same], x[~same], table[~same]
    return met


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows one row of its component under the links a - b, the same for all of them."""
    root = np.arange(n)
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        root[b] = a
        while not np.array_equal(up := root[root], root):
            root = up


class _Forest:
    """Edges fid - root, of which only as many are kept as connect the same."""

    def __init__(self):
        self.held: list[tuple] = []
        self.size = self.least = 0

    def add(self, fid: np.ndarray, root: np.ndarray) -> None:
        self.held.append((fid, root))
        self.size += len(fid)
        if self.size > 2 * self.least + 100_000:
            self.reduce()

    def reduce(self) -> None:
        fid, root = (np.concatenate(x) for x in zip(*self.held))
        ids, at = np.unique(np.concatenate([fid, root]), return_inverse=True)
        to = _roots(len(ids), at[: len(fid)], at[len(fid) :])
        some = np.flatnonzero(to != np.arange(len(ids)))
        self.held = [(ids[some], ids[to[some]])]
        self.size = self.least = len(some)

    def out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.reduce()
        fid, root = self.held[0]
        self.held, self.size, self.least = [], 0, 0
        return fid, root, np.zeros(len(fid), np.int64)


def _joining(f: np.ndarray):
    """Near pairs (i, j) of the rows of ``f`` that connect what all near pairs connect."""
    at = np.arange(len(f))
    while len(at) > 1:
        near = np.bitwise_count(f[at[1:]] ^ f[at[0]]).sum(1) <= RADIUS
        if near.sum() * 8 < len(at):  # a bucket of strangers
            for i, j in _near(f[at]):
                yield at[i], at[j]
            return
        own, rest = at[1:][near], at[1:][~near]
        yield np.full(len(own), at[0]), own
        if len(rest):
            for i, j in _near(f[own], f[rest]):
                yield own[i], rest[j]
        at = rest


def _told(m: np.ndarray, pairs, masks: np.ndarray | None, what: str):
    """What the near pairs (i, j) of ``m`` say, with ``masks`` each in the first table where it meets only: ``what`` is "pairs" as in links(), "sums" as in linked(), or "roots"."""
    f = m[:, 3:].view(np.uint64)
    held: list[tuple] = []
    size = 0

    def tell():
        i, j = (np.concatenate(c) for c in zip(*held))
        if what == "roots":
            root = _roots(len(m), i, j)
            at = np.flatnonzero(root != np.arange(len(m)))
            return m[at, 1], m[root[at], 1], np.zeros(len(at), np.int64)
        if masks is not None:
            new = ~_met_before(f[i] ^ f[j], m[i, 0] % len(masks), masks)
            i, j = i[new], j[new]
        if what == "pairs":
            a, b = m[i, 1], m[j, 1]
            return np.minimum(a, b), np.maximum(a, b), np.bitwise_count(f[i] ^ f[j]).sum(1).astype(np.int64)
        others = np.bincount(i, m[j, 2], len(m)) + np.bincount(j, m[i, 2], len(m))
        at = np.flatnonzero(others)
        return m[at, 1], m[_roots(len(m), i, j)[at], 1], others[at].astype(np.int64)

    for i, j in pairs:
        if len(i):
            held.append((i, j))
            size += len(i)
        if size >= PAIRS:
            yield tell()
            held, size = [], 0
    if held:
        yield tell()


def _compare(batches, masks: np.ndarray | None, cap: int, what: str):
    """FOUND of rows that come sorted by bucket; the rows of buckets of more than ``cap`` are handed on."""
    names = ["bucket", "fid", "members", *FP]

    def on(m: np.ndarray):
        columns = [pa.array(np.ascontiguousarray(m[:, k])) for k in range(7)]
        return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(m), pa.int64())] * 2], [*names, "root", "others"])

    def off(fid, root, others):
        none = pa.nulls(len(fid), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(fid), *[none] * 5, pa.array(root), pa.array(others)], [*names, "root", "others"])

    forest = _Forest()

    def settled(m: np.ndarray):
        edge = np.flatnonzero(np.diff(m[:, 0], prepend=m[:1, 0] - 1, append=m[-1:, 0] + 1))
        sizes = np.diff(edge)
        each = np.repeat(sizes, sizes)
        if (each > cap).any():
            yield on(m[each > cap])
        m, each, sizes = m[each <= cap], each[each <= cap], sizes[sizes <= cap]
        middle = min(cap, 48)
        small = m[(each > 1) & (each <= middle)]

        def pairs():
            ends = sizes.cumsum()
            for hi, n in zip(ends[sizes > middle].tolist(), sizes[sizes > middle].tolist()):
                for i, j in (_joining if what == "roots" else _near)(f[hi - n : hi]):
                    yield i + hi - n, j + hi - n

        f = m[:, 3:].view(np.uint64)
        for part, near in ((small, _near_within(small)), (m, pairs())):
            for fid, root, others in _told(part, near, masks, what):
                if what == "roots":  # the buckets of a task connect the same again and again
                    forest.add(fid, root)
                    if forest.size > EDGES:
                        yield off(*forest.out())
                else:
                    yield off(fid, root, others)

    carry, wide = np.zeros((0, 7), np.int64), None
    for b in batches:
        m = np.stack([b.column(c).to_numpy() for c in names], 1)
        if wide is not None:
            k = int(np.searchsorted(m[:, 0], wide, side="right"))
            yield on(m[:k])
            m = m[k:]
        if not len(m):
            continue
        wide = None
        m = np.concatenate([carry, m])
        cut = int(np.searchsorted(m[:, 0], m[-1, 0], side="left"))
        if cut:
            yield from settled(m[:cut])
        carry = m[cut:]
        if len(carry) > cap:
            yield on(carry)
            carry, wide = carry[:0], carry[0, 0]
    if len(carry):
        yield from settled(carry)
    if forest.size:
        yield off(*forest.out())


def _met(classes: DataFrame, what: str) -> DataFrame:
    """fid, root, others of the pairs that meet in some table: see _told()."""
    sample = _samples(classes.count())
    return _found(_buckets(classes, sample), _masks(sample), what)


def _found(rows: DataFrame, masks: np.ndarray | None, what: str) -> DataFrame:
    """fid, root, others of the near pairs within each bucket of ROW: see _told()."""
    cap = CAP
    met = rows.repartition("bucket").sortWithinPartitions("bucket")
    out = materialise(map_batches(met, lambda batches: _compare(batches, masks, cap, what), f"{ROW}, root bigint, others bigint"), "met")
    found = out.where("root is not null").select("fid", "root", "others")
    rest = out.where("root is null").select("bucket", "fid", "members", *FP)
    wide = materialise(rest.groupBy("bucket").count(), "wide")
    if wide.isEmpty():
        return found
    # oversized: all pairs, by pairs of blocks
    g = F.ceil(F.col("count") / BLOCK).cast("int")
    blocks = rest.join(size_checked(wide, 32), "bucket").withColumns({"g": g, "own": F.pmod(F.xxhash64("fid"), g).cast("int")})
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "fid", "members", *FP)

    def compared(t: pa.Table) -> pa.Table:
        own = t.column("own").to_numpy()
        order = np.argsort(own, kind="stable")
        m = np.stack([t.column(c).to_numpy() for c in ("bucket", "fid", "members", *FP)], 1)[order]
        f, k = m[:, 3:].view(np.uint64), int((own == own.min()).sum())
        if t.column("one")[0].as_py() == t.column("two")[0].as_py():
            near = (_joining if what == "roots" else _near)(f)
        else:  # empty if one of the blocks is
            near = ((i, j + k) for i, j in _near(f[:k], f[k:]))
        parts = [np.stack(x, 1) for x in _told(m, near, masks, what)] or [np.zeros((0, 3), np.int64)]
        got = np.concatenate(parts)
        return pa.table({c: pa.array(np.ascontiguousarray(got[:, i])) for i, c in enumerate(("fid", "root", "others"))})

    return found.unionByName(cells.groupBy("bucket", "one", "two").applyInArrow(compared, "fid bigint, root bigint, others bigint"))


def links(classes: DataFrame) -> DataFrame:
    """(a, b, distance): pairs of different fingerprints within the radius that met in a bucket, one row each."""
    found = _met(classes.select("fid", F.lit(1).cast("bigint").alias("members"), *FP), "pairs")
    return found.select(F.col("fid").alias("a"), F.col("root").alias("b"), F.col("others").cast("int").alias("distance"))


def linked(classes: DataFrame) -> DataFrame:
    """(fid, root, others): what links() has, without its pairs, which grow with the square of a group.

    The sum of ``others`` by fid is the members of all fingerprints that it is linked with; the edges fid - root have the components of all links.
    """
    return _met(classes, "sums")


def groups(documents: DataFrame, counted: bool = True) -> DataFrame:
    """id, th, f0..f3, class_id, class_th, n_links: one row per input row.

    n_links is the exact number of other rows of the class within the radius, met in a table or not; null unless ``counted``.
    """
    rows = materialise(printed(documents), "simhash")
    classes = rows.groupBy(*FP).agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("members"))
    classes = materialise(classes.withColumn("fid", F.monotonically_increasing_id()), "simhash")
    found = materialise(_met(classes, "roots").select("fid", "root").distinct(), "simhash")
    component = connected_components(found, "fid", "root").withColumnRenamed("id", "fid")
    whole = materialise(classes.join(component, "fid", "left"), "simhash")
    n_links = F.lit(None).cast("bigint")
    if counted:
        together = whole.where("component is not null").select(F.col("component").alias("bucket"), "fid", "members", *FP)
        others = _found(together, None, "sums").groupBy("fid").agg(F.sum("others").alias("others"))
        whole, n_links = whole.join(others, "fid", "left"), F.coalesce("others", F.lit(0)) + F.col("members") - 1
    whole = whole.select("fid", *FP, "first", "members", F.coalesce("component", "fid").alias("component"), n_links.alias("n_links"))
    whole = materialise(whole, "simhash")
    heads = materialise(whole.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("n")), "simhash")
    whole = join_counted(whole, heads, ["component"], "n", classes.count(), F.xxhash64("fid"))
    whole = materialise(whole.select(*FP, F.col("head.id").alias("class_id"), F.col("head.th").alias("class_th"), "n_links", "members"), "simhash")
    return join_counted(rows, whole, FP, "members", rows.count(), F.xxhash64("id", "th")).drop("members")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id; all columns as they were."""
    found = groups(documents, counted=False).where("id = class_id and th = class_th").groupBy("id", "th").agg(F.count("*").alias("n"))
    keep = materialise(found, "keep")
    own_id, own_th, kept_id, kept_th = fresh(documents, "id", "th", "kept_id", "kept_th")
    tagged = documents.withColumns({own_id: F.coalesce("doc_id", F.lit(_NULL_ID)), own_th: F.xxhash64(F.coalesce("text", F.lit("")))})
    match = [F.col(own_id) == F.col(kept_id), F.col(own_th) == F.col(kept_th)]
    named = [F.col("id").alias(kept_id), F.col("th").alias(kept_th)]
    single = tagged.join(size_checked(keep.where("n = 1").select(*named), 40), match, "left_semi")
    repeated = keep.where("n > 1").select(*named)
    if repeated.isEmpty():
        return single.select(*documents.columns)
    again = tagged.join(size_checked(repeated, 40), match, "left_semi").dropDuplicates([own_id, own_th])
    return single.unionByName(again).select(*documents.columns)


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    back = lambda c: F.when(F.col(c) == _NULL_ID, F.lit(None)).otherwise(F.col(c))
    text = F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in FP]))
    return got.select(back("id").alias("doc_id"), back("class_id").alias("class_id"), F.col("n_links").cast("bigint"), text.alias("fingerprint"))
