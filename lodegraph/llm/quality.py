"""Operator 10, quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted with numpy on the driver from a bounded sample of labelled
rows (``MAX_FIT_ROWS``, taken by the smallest hash of doc_id), on statistics
that Spark computes; the fitted trees are flattened into arrays, and scoring
walks all trees of a batch of documents at once.

Defined cases: a null text counts as empty; an empty text gets statistics of
zero and a score like any other; without labels, or with labels of one class,
the score is the smoothed share of label 1; repeated rows score alike; a null
doc_id is not held out; columns other than the text are never inputs.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.batches import filter_rows, map_rows

#: Labelled rows that a fit uses at most; their statistics (not texts) reach the driver.
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.7

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_SPACE = b" \t\n\r\x0b\x0c"
_STOP = b".,;:'\"?-()"
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP)
_HIGH = bytes(range(128, 256))
NAMES = (
    "log_chars log_words mean_word sd_word long_word distinct top_word repeats upper lower digit stop mark high "
    "space words_a_line distinct_lines short_lines stops_a_word caps_words"
).split()


def features(text: str | None) -> list[float]:
    """Statistics of one whole text, in the order of NAMES."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, k = max(1, len(raw)), max(1, len(words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stops = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    return [
        math.log1p(len(raw)), math.log1p(len(words)), float(sizes.mean()), float(sizes.std()), math.log1p(float(sizes.max())),
        len(counts) / k, max(counts.values(), default=0) / k, sum(map(eq, words, islice(words, 1, None))) / k,
        share(_UPPER), share(_LOWER), share(_DIGIT), share(_STOP), share(_MARK), share(_HIGH), share(_SPACE),
        math.log1p(k / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        stops / k, sum(map(bytes.isupper, words)) / k,
    ]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 8) -> dict:
    """Boosted trees for the log-loss, flattened: node arrays of shape (trees, 2 ** (depth + 1) - 1) in heap order."""
    size = 2 ** (depth + 1) - 1
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    flat = {"base": base, "depth": depth, "feature": np.zeros((0, size), np.int32), "above": np.zeros((0, size)), "value": np.zeros((0, size))}
    if len(y) == 0 or y.min() == y.max():
        return flat
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1).astype(np.int64)
    score = np.full(len(y), base)
    every = np.arange(d) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        feature, above, value = np.full(size, 0, np.int32), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (node - first)[:, None] * (d * bins) + every + code
            hist = lambda w: np.bincount(at.ravel(), None if w is None else np.repeat(w, d), width * d * bins).reshape(width, d, bins)
            g, h, c = (hist(w).cumsum(2) for w in (grad, hess, None))
            tg, th, tc = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
            gain = g**2 / (h + l2) + (tg - g) ** 2 / (th - h + l2) - tg**2 / (th + l2)
            gain[(c < least) | (tc - c < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], above[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > above[node])
        leaf = 2**depth - 1
        g, h = (np.bincount(node - leaf, w, 2**depth) for w in (grad, hess))
        value[leaf:] = -rate * g / (h + l2)
        score += value[node]
        for k, row in (("feature", feature), ("above", above), ("value", value)):
            flat[k] = np.vstack([flat[k], row])
    return flat


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities: every row walks every tree, one level at a time."""
    t = np.arange(len(model["feature"]))[None, :]
    rows = np.arange(len(x))[:, None]
    node = np.zeros((len(x), t.shape[1]), np.int64)
    for _ in range(model["depth"]):
        node = 2 * node + 1 + (x[rows, model["feature"][t, node]] > model["above"][t, node])
    return 1 / (1 + np.exp(-(model["base"] + model["value"][t, node].sum(1))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> dict:
    """Fit on labelled rows that are not held out; of doc_ids labelled twice, the lower label counts."""
    picked = (
        labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("__y"))
        .where(F.col("doc_id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("__y").alias("__y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # at most max_rows pairs of numbers, so this side can be sent to every executor
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "__y", "text")
    rows = map_rows(texts, "doc_id bigint, y int, x array<double>", lambda i, y, t: {"doc_id": i, "y": y, "x": [features(v) for v in t]})
    kept = rows.groupBy("doc_id").agg(F.max(F.struct("x", "y")).alias("r")).select("doc_id", "r.x", "r.y").collect()  # one of a repeated doc_id
    kept.sort(key=lambda r: r.doc_id)
    return fit(np.array([r.x for r in kept]).reshape(-1, len(NAMES)), np.array([r.y for r in kept], float))


def _scorer(model: dict, block: int = 2000):
    def score(texts: list) -> list[float]:
        x = np.array([features(t) for t in texts]).reshape(-1, len(NAMES))
        return np.concatenate([predict(model, x[i : i + block]) for i in range(0, len(x), block)]).tolist()

    return score


def score_documents(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row."""
    scored = map_rows(documents.select("doc_id", "text"), "doc_id bigint, score double", lambda i, t, f=_scorer(model): {"doc_id": i, "score": f(t)})
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, all columns as they were."""
    score = _scorer(model)
    return filter_rows(documents, "text", lambda t: [s >= threshold for s in score(t)])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
