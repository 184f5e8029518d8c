"""Operator 1, personal data: seeds by regular expression, more by bootstrapped contextual extraction.

Four base kinds are found by exact rules; they are the seeds. Around every seed
and every other identifier-shaped span stand its lexical contexts, the
*patterns*: the word before it (``LEFT_WORDS`` of them where a mark or a part of
its own word stands right before it), and the same with the word behind it; a
word that holds several spans is context only as far as the next of them.
Identifier-shaped is a word that holds a digit or @, without the marks around
it and without a name glued to its front by = : ( or a quote; words of digits
and marks with single spaces (and brackets) between them are one span; five characters are the
least. Spark scores the bipartite graph of patterns and instances in rounds: a
pattern counts by the instances of one kind among all that it surrounds, an
instance by the patterns around it. Spans that confident patterns surround
become further spans of that kind.

Words and spans are never cut, and every step over a text is linear in its length.

Defined cases: a null text counts as empty: no spans; repeated rows give
repeated results, and count once for a pattern, since patterns weigh distinct
instances; without seeds nothing is added; doc_id may be null or repeated
(rows are told apart by a number of their own).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.batches import map_rows
from lodegraph.llm.hot import join_counted
from lodegraph.storage import BROADCAST_BYTES, materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# possessive forms of the same rules: no digit run is ever tried twice
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# tried at the start of a word only, and never again inside it
_SHAPED = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_NUMERIC = re.compile(r"[0-9()+./-]+")
_GLUE = re.compile(r"[=\"':(]")
_SPACE = re.compile(r"\s")
_FIRST = re.compile(r"\s*+(\S++)")
LEFT_WORDS, LEAST_CHARS = 2, 5
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&="


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            start = at
            while start > done:  # back through the local part, in steps
                step = max(done, start - 64)
                gap = None
                for gap in _NOT_LOCAL.finditer(text, step, start):
                    pass
                if gap is not None:
                    start = gap.end()
                    break
                start = step
            if start < at:
                out.append((start, 0, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _norm(words: list[str]) -> str:
    return re.sub(r"[0-9]+", "0", " ".join(words).lower())


def _before(text: str, end: int, n: int, floor: int) -> list[str]:
    """The last ``n`` words that end before ``end``; only what stands between, if the span that ends at ``floor`` is in the same word."""
    near = text[max(floor, end - 64) : end]
    if len(near.split(None, 1)) < 2 and not near[:1].isspace() and not near[-1:].isspace():
        glued = text[floor:end]
        if floor and _SPACE.search(glued) is None:
            return [glued] if glued else []
    width = 64
    while True:
        words = text[max(0, end - width) : end].split()
        if len(words) > n or width >= end:
            return words[-n:]
        width *= 4


def _behind(text: str, start: int, ceiling: int) -> str:
    """The word behind ``start``; only what stands between, if the span that starts at ``ceiling`` is in the same word."""
    if start == ceiling:
        return ""
    m = _FIRST.match(text, start, ceiling)
    if m is None or m.end() == ceiling and m.start(1) > start:
        m = _FIRST.match(text, start)
    return m.group(1) if m else ""


def shaped(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of identifier-shaped spans outside of the base spans."""
    taken = sorted((s, e) for s, _, e in base)
    found: list[tuple[int, int]] = []
    i, joins = 0, -2
    for m in _SHAPED.finditer(text):
        word, until = m.span()
        s, e = word, until
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        # name="value" holds its identifier behind the last of these
        for g in _GLUE.finditer(text, s, e):
            s = g.end()
        while s < e and text[s] in _EDGE:
            s += 1
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s == e or i < len(taken) and taken[i][0] < e:
            joins = -2
            continue
        numeric = _NUMERIC.fullmatch(text, s, e) is not None
        if numeric and joins == word - 1 and text[found[-1][1] : s].strip("()") == " ":
            found[-1] = (found[-1][0], e)
        else:
            found.append((s, e))
        joins = until if numeric else -2
    return [(s, e) for s, e in found if e - s >= LEAST_CHARS]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and identifier-shaped spans outside of them, with the words around each."""
    spots = [(s, e, k) for s, k, e in base] + [(s, e, -1) for s, e in shaped(text, base)]
    starts, ends = sorted(s for s, _, _ in spots), [0, *sorted(e for _, e, _ in spots)]
    starts.append(len(text))
    out = []
    for s, e, k in spots:
        before = _before(text, s, LEFT_WORDS, ends[bisect_right(ends, s) - 1])
        glued = before and not text[s - 1].isspace()
        left = before if glued or before and before[-1] in ("=", ":", ":=") else before[-1:]
        right = _behind(text, e, starts[bisect_left(starts, e)])
        out.append({"start": s, "end": e, "kind": k, "value": text[s:e].lower(), "left": _norm(left), "right": _norm([right])})
    return out


SCAN = (
    "doc_id bigint, base array<struct<start:int, kind:int, end:int>>, "
    "cands array<struct<start:int, end:int, kind:int, value:string, left:string, right:string>>"
)


def _scan(ids, texts):
    out = {"doc_id": ids, "base": [], "cands": []}
    for t in texts:
        t = t or ""
        base = base_spans(t)
        out["base"].append([{"start": s, "kind": k, "end": e} for s, k, e in base])
        out["cands"].append(candidates(t, base))
    return out


def _patterns() -> Column:
    left, both = F.concat(F.lit("L "), "left"), F.concat(F.lit("B "), "left", F.lit(" _ "), "right")
    return F.explode(F.array_compact(F.array(F.when(F.col("left") != "", left), F.when((F.col("left") != "") & (F.col("right") != ""), both)))).alias("pattern")


def bootstrap(cands: DataFrame, rounds: int = 3, least: int = 5, confidence: float = 0.8) -> DataFrame:
    """pattern, of, confidence: the patterns that surround, beside unknown spans, only or nearly only identifiers of one kind.

    ``cands``: value, kind (-1: unknown), left, right. A pattern needs ``least`` distinct
    instances that count for its kind. Rows are made distinct before anything
    else, with partial aggregation; joins on patterns and instances that may be hot are spread.
    """
    edges = materialise(cands.select(F.xxhash64("value").alias("instance"), "kind", _patterns()).distinct(), "pii")
    total = edges.count()
    of_instance = materialise(edges.groupBy("instance").agg(F.count("*").alias("n")), "pii")
    of_pattern = materialise(edges.groupBy("pattern", "instance").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.count("*").alias("size"), F.sum("n").alias("n")), "pii")
    seeds = edges.where("kind >= 0").select("instance", F.col("kind").alias("of"), F.lit(1.0).alias("weight")).distinct()
    weights = seeds
    accepted = None
    for _ in range(rounds):
        by_instance = weights.groupBy("instance").agg(F.collect_list(F.struct("of", "weight")).alias("w"))  # at most one of each kind
        by_instance = materialise(by_instance.join(of_instance, "instance"), "pii")
        votes = join_counted(edges, by_instance, ["instance"], "n", total, F.xxhash64("pattern")).select("pattern", F.inline("w")).groupBy("pattern", "of").agg(F.sum("weight").alias("w"))
        accepted = materialise(
            votes.join(of_pattern, "pattern").withColumn("confidence", F.col("w") / F.col("size")).where((F.col("w") >= least) & (F.col("confidence") >= confidence))
            .groupBy("pattern").agg(F.max_by(F.struct("of", "confidence"), F.struct("confidence", -F.col("of"))).alias("b"), F.first("n").alias("n")).select("pattern", "b.of", "b.confidence", "n"), "pii"
        )
        found = join_counted(edges.where("kind < 0"), accepted, ["pattern"], "n", total, F.xxhash64("instance")).groupBy("instance", "of").agg(F.max("confidence").alias("weight"))
        weights = seeds.unionByName(found).groupBy("instance", "of").agg(F.max("weight").alias("weight"))
    return accepted.select("pattern", "of", "confidence")


def find(documents: DataFrame, **options) -> DataFrame:
    """doc_id, base and added spans as array<struct<start, kind, end>>, one row per input row."""
    scanned = materialise(
        map_rows(documents.select("doc_id", "text"), SCAN, _scan).withColumn("row", F.monotonically_increasing_id()), "pii"
    )
    each = scanned.select("row", F.explode("cands").alias("c")).select("row", "c.*")
    patterns = bootstrap(each.select("value", "kind", "left", "right"), **options)
    unknown = each.where("kind < 0").select("row", "start", "end", _patterns())
    size = patterns.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("pattern")), F.lit(0)).alias("widest")).first()
    if size["n"] * (size["widest"] + 64) <= BROADCAST_BYTES:
        met = unknown.join(F.broadcast(patterns), "pattern")
    else:
        table = materialise(patterns.join(unknown.groupBy("pattern").agg(F.count("*").alias("n")), "pattern"), "pii")
        met = join_counted(unknown, table, ["pattern"], "n", unknown.count(), F.xxhash64("row", "start"))
    added = (
        met.groupBy("row", "start", "end").agg(F.max_by("of", F.struct("confidence", -F.col("of"))).alias("of"))
        .groupBy("row").agg(F.collect_list(F.struct("start", F.col("of").alias("kind"), "end")).alias("added"))
    )
    return scanned.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", *map(count, range(4)), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
    )
