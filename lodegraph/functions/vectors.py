"""Dense vectors: cosine ranking, centroids, incremental embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import round_half_up


def dot(a: Column, b: Column) -> Column:
    """Over the dimensions that both have."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common dimensions, 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm)


def cosine_to(vectors: DataFrame, query: DataFrame, limit: int | None = None) -> DataFrame:
    """node_id, score > 0 against a one-row table (vector)."""
    out = vectors.crossJoin(F.broadcast(query.limit(1).select(F.col("vector").alias("__q")))).select("node_id", cosine(F.col("vector"), F.col("__q")).alias("score")).where("score > 0")
    out = out.orderBy(F.desc(round_half_up(F.col("score"), 9)), "node_id")
    return out if limit is None else out.limit(limit)


def cosine_top(vectors: DataFrame, query: list[float], limit: int = 50) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select("node_id", cosine(F.col("vector"), q).alias("score")).where("score > 0")
    return out.orderBy(F.desc(round_half_up(F.col("score"), 9)), "node_id").limit(limit)


def centroid(vectors: DataFrame) -> DataFrame:
    """One row (vector): the mean of each dimension; no row for no vectors."""
    each = vectors.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector")).where(F.size("vector") > 0)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hashing_provider(texts: list[str], dims: int = 64) -> list[list[float]]:
    """A stand-in for a model: unit vectors of hashed words, the same everywhere."""
    out = []
    for t in texts:
        v = [0.0] * dims
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % dims] += 1.0 if (h >> 32) & 1 else -1.0
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / norm for x in v])
    return out


def pending(nodes: DataFrame, stored: DataFrame, provider: str, text: Column | None = None) -> DataFrame:
    """node_id, text, text_hash of non-external nodes that this provider has not embedded as they are now."""
    text = F.concat_ws(" ", "name", "kind", "file_path", "description") if text is None else text
    new = nodes.where("not is_external").select(F.col("id").alias("node_id"), text.alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    return new.join(stored.where(F.col("provider") == provider).select("node_id", "text_hash"), ["node_id", "text_hash"], "left_anti").select("node_id", "text", "text_hash")


def embed(nodes: DataFrame, stored: DataFrame, provider=hashing_provider, name: str = "hashing-64", batch: int = 64) -> DataFrame:
    """Embeddings (node_id, vector, text_hash, provider) of what is pending; texts go to the provider in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v: list = []
            for i in range(0, len(f), batch):
                v += provider(f["text"].iloc[i : i + batch].tolist())
            yield pd.DataFrame({"node_id": f["node_id"], "vector": v, "text_hash": f["text_hash"], "provider": name})

    return pending(nodes, stored, name).mapInPandas(run, "node_id string, vector array<float>, text_hash string, provider string")
