"""Operator 9, substring dedup: prefix-partitioned sparse suffix trees over words.

Every window of ``WINDOW`` words has one anchor: the eight-word sequence of
smallest hash in it, the leftmost of equals. Equal windows have equal anchors at
equal places, so only suffixes that start at anchors need to be in a tree.

1. Anchors are counted by their eight-word prefix. Those whose prefix repeats
   are told by a bitmap of bounded size, or, when the repeated prefixes outgrow
   it, by a join of the anchors with them.
2. Suffixes with such a prefix go, with the words of the windows that have this
   anchor and no others, to the group of their prefix. Places of one text whose
   windows are all equal, as in runs of one word, are one suffix. A group's suffixes are sorted and their longest common
   prefixes taken, to the right and to the left: the intervals of common
   prefixes are the internal nodes of the two trees. Suffixes that share a node
   of depth 35 - d to the right and one of depth d to the left repeat the window
   that starts d words before the anchor. Words are compared as they are; hashes
   only choose anchors and gather groups.
3. Prefixes of more than ``GROUP`` suffixes are lengthened: all windows that
   start lo to hi words before an anchor share the 35 - (hi - lo) words from lo
   before it, so that the suffixes are grouped by these words for four ranges of
   starts, and where that is still too many, by all 35 words for each start. A
   group of equal windows needs no tree: it is counted, with partial aggregation.

All occurrences of a repeated window are removed, as judged on the input.

Defined cases: a null text has no words; words are cut at the six ASCII white
space characters only; texts of fewer than 35 words stay whole; rows that
repeat are occurrences of their own, so all their windows repeat; a null
doc_id is a value.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodegraph.llm.batches import map_batches, slices
from lodegraph.llm.hot import join_counted
from lodegraph.storage import drop, materialise, size_checked

WINDOW = 35
PREFIX = 8
SPREAD = WINDOW - PREFIX + 1
#: Suffixes of one prefix that are handled in one task.
GROUP = 20_000
#: Bits of the bitmap: 16 for each repeated prefix, between these bounds (the upper is 32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

#: Windows starts that share a prefix: all of an anchor's, four ranges of them, single ones.
WIDTHS = (SPREAD, SPREAD // 4, 1)

_rng = np.random.default_rng(35)
_VALUE = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 2**63, PREFIX, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []
_CHUNK = 1 << 18
SUFFIX = "doc_id bigint, th bigint, spots array<int>, lo int, hi int, key bigint, before binary, after binary"
FOUND = "doc_id bigint, th bigint, pos int, mask bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash (a polynomial, so different words may share it), the start and the length of every word of ``raw``."""
    out: list[tuple] = []
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + _CHUNK)
        if hi < len(raw):  # end a chunk behind white space; a single longer word makes a longer chunk
            back = max(raw.rfind(c, lo, hi) for c in _SPACES)
            if back < lo:
                ahead = [p for p in (raw.find(c, hi) for c in _SPACES) if p >= 0]
                back = min(ahead, default=len(raw) - 1)
            hi = back + 1
        a = np.frombuffer(raw, np.uint8, hi - lo, lo)
        if not _powers or len(_powers[0]) <= len(a):
            n = max(_CHUNK, len(a)) + 1
            _powers[:] = [np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE)]
        space = _SPACE[a]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_VALUE[a] * _powers[0][: len(a)], out=total[1:])
        out.append((_mixed((total[end] - total[start]) * _powers[1][start] + (end - start).astype(np.uint64)), start + lo, end - start))
        lo = hi
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def _same_bytes(raw: bytes, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> bool:
    """Whether raw[one : one + size] equals raw[other : other + size] for all, by eight bytes at once."""
    at = np.flatnonzero(one != other)
    one, other, size = one[at], other[at], size[at]
    eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    for _ in range(8):
        if not len(one):
            return True
        differ = eight[one] ^ eight[other]
        if (differ << (64 - 8 * np.minimum(size, 8)).astype(np.uint64)).any():
            return False
        longer = size > 8
        one, other, size = one[longer] + 8, other[longer] + 8, size[longer] - 8
    return all(raw[i : i + n] == raw[j : j + n] for i, j, n in zip(one.tolist(), other.tolist(), size.tolist()))


def _numbered(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal for equal words of ``raw`` and for no others, and where the words start.

    Words are gathered by hash and compared with the first of their hash; if one differs, all are numbered by dictionary.
    """
    h, start, size = _word_hashes(raw)
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    if not ((size[first][ids] == size).all() and _same_bytes(raw, start, start[first][ids], size)):
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in raw.split()])
    return ids, start


def _least(gram: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost smallest value of every window of ``width`` stands; windows double, the last two overlap."""
    v, p, size = gram, np.arange(len(gram)), 1
    while size < width:
        step = min(size, width - size)
        take = v[step:] < v[:-step]
        v, p = np.where(take, v[step:], v[:-step]), np.where(take, p[step:], p[:-step])
        size += step
    return p


def _anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word position, prefix hash, least and most words that its windows start before it) of every anchor."""
    h, starts, _ = _word_hashes(b"\n".join(raws))
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none, none, np.zeros(0, np.uint64), none, none
    owner = np.searchsorted(np.array([len(r) + 1 for r in raws]).cumsum(), starts, "right")
    first = np.searchsorted(owner, np.arange(len(raws)), "left")
    n = len(h) - PREFIX + 1
    gram = np.zeros(n, np.uint64)
    for j in range(PREFIX):
        gram += h[j : j + n] * _MIX[j]
    gram = _mixed(gram)
    least = _least(gram, SPREAD)
    window = np.flatnonzero(owner[: len(least)] == owner[WINDOW - 1 :])  # windows inside one text
    at = least[window]
    edge = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if len(at) else none  # places never fall
    lo, hi = at[edge[1:] - 1] - window[edge[1:] - 1], at[edge[:-1]] - window[edge[:-1]]
    at = at[edge[:-1]]
    return owner[at], at - first[owner[at]], gram[at], lo, hi


def _raw(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def _anchor_rows(documents: DataFrame) -> DataFrame:
    """doc_id, th, pos, key of every anchor."""

    def run(batches):
        for b in batches:
            ids, ths, texts = b.column("doc_id"), b.column("th"), b.column("text").to_pylist()
            for lo, hi in slices(texts):
                owner, pos, key, _, _ = _anchors(_raw(texts[lo:hi]))
                at = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([ids.take(at), ths.take(at), pa.array(pos, pa.int32()), pa.array(key.view(np.int64))], ["doc_id", "th", "pos", "key"])

    return map_batches(_keyed(documents), run, "doc_id bigint, th bigint, pos int, key bigint")


_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
_NAMES = ["doc_id", "th", "spots", "lo", "hi", "key", "before", "after"]


def _around(i: int | None, th: int, words: list[bytes], pos: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """The suffixes of one text at ``pos``, with the words of their own windows; places whose windows are equal, as in runs of one word, are one suffix."""
    spots: dict[tuple, list[int]] = {}
    for p, k, least, most in zip(pos.tolist(), key.view(np.int64).tolist(), lo.tolist(), hi.tolist()):
        spots.setdefault((least, most, k, b" ".join(words[p - most : p]), b" ".join(words[p : p + WINDOW - least])), []).append(p)
    least, most, keys, before, after = zip(*spots)
    columns = ([i] * len(spots), [th] * len(spots), list(spots.values()), least, most, keys, before, after)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], _NAMES)


def _gathered(parts, least: int = 2000):
    """Small record batches as fewer ones."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += p.num_rows
        if n >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _suffixes(documents: DataFrame, bitmap, bits: int) -> DataFrame:
    """The suffixes at anchors whose prefix may repeat, by the bitmap."""

    def parts(batches):
        flags = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            ids, ths, texts = (b.column(c).to_pylist() for c in ("doc_id", "th", "text"))
            for lo, hi in slices(texts):
                raws = _raw(texts[lo:hi])
                anchors = _anchors(raws)
                bit = anchors[2] & np.uint64(bits - 1)
                seen = (flags[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                owner, *rest = (a[seen] for a in anchors)
                cut = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1, [len(owner)]]) if len(owner) else [0]
                for i, j in zip(cut[:-1], cut[1:]):
                    o = int(owner[i])
                    yield _around(ids[lo + o], ths[lo + o], raws[o].split(), *(a[i:j] for a in rest))

    return map_batches(_keyed(documents), lambda batches: _gathered(parts(batches)), SUFFIX)


def _joined_suffixes(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """The suffixes at anchors whose prefix repeats, by a join of all anchors with the repeated prefixes."""
    total = counts.agg(F.sum("c")).first()[0] or 0
    hit = join_counted(_anchor_rows(documents), counts, ["key"], "c", total, F.xxhash64("doc_id", "th", "pos"))
    spots = hit.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("t")).agg(F.collect_set("pos").alias("spots"))
    docs = _keyed(documents).join(spots, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "text", "spots")

    def parts(batches):
        for b in batches:
            for i, th, text, spots in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "text", "spots"))):
                raw = _raw([text])
                _, pos, *rest = _anchors(raw)
                seen = np.isin(pos, spots)
                yield _around(i, th, raw[0].split(), pos[seen], *(a[seen] for a in rest))

    return map_batches(docs, lambda batches: _gathered(parts(batches)), SUFFIX)


def _lengthened(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` for ranges of ``width`` starts, keyed by the words that all windows of a range share."""

    def parts(batches):
        for b in batches:
            out: list[tuple] = []
            for i, th, spots, least, most, left, right in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "spots", "lo", "hi", "before", "after"))):
                before, after = left.split(), right.split()
                n = len(before)
                for first in range(least - least % width, most + 1, width):
                    lo, hi = max(least, first), min(most, first + width - 1)
                    shared = before[n - first :] + after[: WINDOW - first - width + 1]
                    key = hashlib.blake2b(b" ".join(shared), digest_size=16, salt=first.to_bytes(2, "little")).digest()
                    rest = (b"", b"") if width == 1 else (b" ".join(before[n - hi :]), b" ".join(after[: WINDOW - lo]))
                    out.append((i, th, spots, lo, hi, int.from_bytes(key[:8], "little", signed=True), *rest, int.from_bytes(key[8:], "little", signed=True)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*_KINDS, pa.int64()))], [*_NAMES, "key2"])

    return map_batches(rows.select("doc_id", "th", "spots", "lo", "hi", "before", "after"), parts, f"{SUFFIX}, key2 bigint")


def _order(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows of ``m`` and, in that order, the common prefix of each row with the one before."""
    order = np.argsort(np.ascontiguousarray(m.astype(">u4")).view(f"V{4 * m.shape[1]}").ravel())
    s = m[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return order, np.concatenate([[0], common])


def _matrix(ids: np.ndarray, owner: np.ndarray, n: int, width: int, backwards: bool) -> np.ndarray:
    """Word numbers of ``n`` short texts as rows (reversed, if asked), 0 behind the last word."""
    sizes = np.bincount(owner, minlength=n)
    at = np.arange(len(ids)) - (sizes.cumsum() - sizes)[owner]
    m = np.zeros((n, width), np.uint32)
    m[owner, sizes[owner] - 1 - at if backwards else at] = ids + 1
    return m


def _repeated(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: list[bytes], after: list[bytes]) -> np.ndarray:
    """For each suffix the set, as bits d, of windows that start d words before it, lo <= d <= hi, and are those of another suffix, too."""
    n = len(keys)
    texts = [*after, *before]
    ids, starts = _numbered(b"\n".join(texts))
    owner = np.searchsorted(np.array([len(t) + 1 for t in texts]).cumsum(), starts, "right")
    cut = np.searchsorted(owner, n)
    top = np.unique(keys, return_inverse=True)[1].astype(np.uint32)[:, None]
    right = _matrix(ids[:cut], owner[:cut], n, WINDOW, False)
    left = _matrix(ids[cut:], owner[cut:] - n, n, SPREAD - 1, True)
    (ro, rc), (lf, lc) = (_order(np.concatenate([top, m], 1)) for m in (right, left))
    mask = np.zeros(n, np.int64)
    node, leaf = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(SPREAD):
        fit = np.flatnonzero((lo <= d) & (d <= hi))
        if len(fit) < 2:
            continue
        node[ro] = (rc < WINDOW - d + 1).cumsum()  # nodes at depth 35 - d of the right tree, the prefix's key above them
        leaf[lf] = (lc < d + 1).cumsum()
        pair = (node * (n + 2) + leaf)[fit]
        order = np.argsort(pair)
        same = pair[order[1:]] == pair[order[:-1]]
        hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        mask[fit[order[hit]]] |= 1 << d
    return mask


def _trees(rows: DataFrame) -> DataFrame:
    """doc_id, th, pos, mask: what the trees of each group say."""

    def done(t: pa.Table):
        lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
        mask = _repeated(t.column("key").to_numpy(), lo, hi, t.column("before").to_pylist(), t.column("after").to_pylist())
        spots = t.column("spots").combine_chunks()
        own = (np.int64(2) << hi) - (np.int64(1) << lo)
        mask = np.where(pc.list_value_length(spots).to_numpy() > 1, own, mask)
        each = pc.list_parent_indices(spots)
        found = pa.table({"doc_id": t.column("doc_id").take(each), "th": t.column("th").take(each), "pos": pc.list_flatten(spots), "mask": mask[each.to_numpy()]})
        yield from found.filter(pc.greater(found.column("mask"), 0)).combine_chunks().to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 30_000:
                t = pa.Table.from_batches(held)
                keys = t.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                if cut:
                    yield from done(t.slice(0, cut))
                held, size = t.slice(cut).to_batches(), len(t) - cut
        if size:
            yield from done(pa.Table.from_batches(held))

    return map_batches(rows.select(*_NAMES).repartition("key").sortWithinPartitions("key"), run, FOUND)


def _equal_windows(rows: DataFrame) -> DataFrame:
    """doc_id, th, pos, mask of rows keyed by single whole windows."""
    each = materialise(rows.select("doc_id", "th", "spots", "lo", "key", "key2"), "each")
    twice = materialise(each.groupBy("key", "key2").agg(F.sum(F.size("spots")).alias("c")).where("c > 1"), "twice")
    total = twice.agg(F.sum("c")).first()[0] or 0
    hit = join_counted(each, twice, ["key", "key2"], "c", total, F.xxhash64("doc_id", "th", "spots"))
    return hit.select("doc_id", "th", F.explode("spots").alias("pos"), F.expr("shiftleft(1L, lo)").alias("mask"))


def repeated_windows(documents: DataFrame) -> DataFrame:
    """doc_id, th, pos, mask: bit d says that the window that starts at word pos - d repeats; several rows for a pos are joined by or."""
    spark = documents.sparkSession
    counts = materialise(_anchor_rows(documents).groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "prefix")
    n = counts.count()
    bits = max(LEAST_BITS, 1 << (16 * n).bit_length())
    if bits > MOST_BITS:
        suffixes = _joined_suffixes(documents, counts)
    else:
        place = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1  # bitmap functions count from one
        parts = counts.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("flags"))
        whole = bytearray(bits // 8)
        for r in parts.toLocalIterator():  # at most MOST_BITS bits in all
            i = (r.bucket - 1) * 4096
            whole[i : i + 4096] = r.flags[: len(whole) - i]
        suffixes = _suffixes(documents, spark.sparkContext.broadcast(bytes(whole)), bits)
    wide = materialise(counts.where(F.col("c") > GROUP).select("key"), "wide")
    if wide.isEmpty():
        return materialise(_trees(suffixes), "windows")
    # written once, since both the groups that fit and the wide ones read it
    suffixes = materialise(suffixes, "suffixes")
    found = [materialise(_trees(suffixes.join(size_checked(wide, 24), "key", "left_anti")), "windows")]
    rows = materialise(suffixes.join(size_checked(wide, 24), "key", "left_semi"), "wide")
    drop(suffixes)
    for width in WIDTHS[1:-1]:
        longer = materialise(_lengthened(rows, width), "longer")
        wide = materialise(longer.groupBy("key").count().where(F.col("count") > GROUP).select("key"), "wide")
        found.append(materialise(_trees(longer.join(size_checked(wide, 24), "key", "left_anti")), "windows"))
        rows = longer.join(size_checked(wide, 24), "key", "left_semi")
        if wide.isEmpty():
            drop(longer)
            return reduce(DataFrame.unionByName, found)
    found.append(materialise(_equal_windows(_lengthened(rows, 1)), "windows"))
    drop(longer)
    return reduce(DataFrame.unionByName, found)


def _kept(text: str | None, pos: np.ndarray | None, mask: np.ndarray | None) -> tuple[int, int, bytes]:
    """(words, removed words, the words left joined by spaces) of one text with its anchors' sets of repeated windows."""
    words = (text or "").encode("utf-8", "replace").split()
    if pos is None or not len(pos):
        return len(words), 0, b" ".join(words)
    at, d = np.nonzero((mask[:, None] >> np.arange(SPREAD)) & 1)  # the same window may come twice
    start = pos[at] - d
    change = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + WINDOW, minlength=len(words) + 1)
    left = change.cumsum()[:-1] == 0
    return len(words), int((~left).sum()), b" ".join(compress(words, left.tolist()))


def map_kept(documents: DataFrame, schema: str, fn) -> DataFrame:
    """``fn(doc ids, list of _kept())`` over all documents with their repeated windows."""
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            hits = b.column("hits")
            flat = hits.flatten()
            pos, mask = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("pos", "mask"))
            none = hits.is_null().to_numpy(zero_copy_only=False)
            size = np.where(none, 0, pc.fill_null(pc.list_value_length(hits), 0).to_numpy())
            end = size.cumsum()
            got = [_kept(t, pos[e - n : e], mask[e - n : e]) for t, e, n in zip(b.column("text").to_pylist(), end.tolist(), size.tolist())]
            cols = fn(b.column("doc_id").to_pylist(), got)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return map_batches(with_hits(documents), run, T._parse_datatype_string(schema))


def with_hits(documents: DataFrame) -> DataFrame:
    """doc_id, text, hits: one row per input row."""
    hits = repeated_windows(documents).groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "mask")).alias("hits"))
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("th").alias("__t"), "hits")
    return _keyed(documents).join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__t")), "left").select("doc_id", "text", "hits")


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, text: the words that are left of each document, joined by single spaces."""
    return map_kept(documents, "doc_id bigint, text string", lambda ids, got: {"doc_id": ids, "text": [g[2].decode() for g in got]})


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def columns(ids, got):
        return {"doc_id": ids, "n_words": [g[0] for g in got], "n_removed": [g[1] for g in got], "kept_sha256": [hashlib.sha256(g[2]).hexdigest() for g in got]}

    return map_kept(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", columns)


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, p, sha256(array_to_string(ws[p : p + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS p FROM w WHERE len(ws) >= 35)
), r AS (
  SELECT doc_id, p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)
), x AS (
  SELECT DISTINCT doc_id, p + j AS p FROM r, (SELECT unnest(generate_series(0, 34)) AS j)
), e AS (
  SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w
), k AS (
  SELECT e.doc_id, count(x.p) AS n_removed, string_agg(CASE WHEN x.p IS NULL THEN e.word END, ' ' ORDER BY e.p) AS kept
  FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.p = e.p GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
