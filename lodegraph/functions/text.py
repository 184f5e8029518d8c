"""Ranked retrieval over names and texts: substring, prefix, BM25, TF-IDF, rank fusion."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.storage import materialise, size_checked

FIELDS = ("name", "description", "file_path")


def round_half_up(x: Column, digits: int) -> Column:
    """Rounding as floor(x * 10^k + 0.5) / 10^k, the same in any engine."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def tokens(text: Column) -> Column:
    """Lower-cased ASCII letters and digits, 2 to 40 of them; case never splits a token."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & (F.length(t) <= 40))


def index_tokens(text: Column) -> Column:
    """The full-text index's tokens: all runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def search_like(nodes: DataFrame, query: str, limit: int | None = 100, literal: bool = False) -> DataFrame:
    """Nodes whose name, description or path holds the query; % and _ are wildcards unless ``literal``."""
    q = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if literal else query
    out = nodes.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{q}%") for c in FIELDS])).orderBy("id")
    return out if limit is None else out.limit(limit)


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)``, with the value computed once a row."""
    return F.transform(F.array(value), fn)[0]


def counted(tokens: Column) -> Column:
    """array of (term, tf) in order of term: the tokens are sorted in their row and runs are counted, without a shuffle."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _once(first, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s))), lambda i, j: F.struct(F.get(s, i).alias("term"), (j - i).alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return _once(F.array_sort(tokens), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def _terms(query: str) -> list[str]:
    clean = "".join(" " if c in "\"*^()" else c for c in query).strip()
    return [t for t in "".join(c if c.isalnum() else " " for c in clean.lower()).split() if t]


def _raises(query: str) -> bool:
    """Queries that full-text syntax would refuse: those with . or - in them."""
    return any(c in query for c in ".-")


def _frequencies(text: Column, terms: list[str]) -> Column:
    """(len, tf of each term, the last as a prefix) of one text; texts that hold no term as a substring are only counted."""
    each = lambda t, last: (lambda x: F.startswith(x, F.lit(t))) if last else (lambda x: x == t)
    tf = lambda tok, i: F.when(F.contains(F.lower(text), F.lit(terms[i])), F.size(F.filter(tok, each(terms[i], i == len(terms) - 1)))).otherwise(0)
    return _once(index_tokens(text), lambda tok: F.struct(F.size(tok).alias("len"), F.array(*[tf(tok, i) for i in range(len(terms))]).alias("tf")))


def fts_prefix(nodes: DataFrame, query: str, limit: int | None = 100) -> DataFrame:
    """Nodes that hold all terms, the last as a prefix; a filter over the rows."""
    terms = _terms(query)
    if not terms or _raises(query):
        out = nodes.where("false")
    else:
        text = F.concat_ws(" ", *FIELDS)
        likely = reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(t)) for t in terms])
        out = nodes.where(likely & ~F.array_contains(_frequencies(text, terms)["tf"], 0))
    out = out.orderBy("id")
    return out if limit is None else out.limit(limit)


def bm25(nodes: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """id, score by BM25 over the indexed columns together; higher is better. Document frequencies are the whole table's.

    Lengths and term counts are taken row by row and kept as a narrow table; only totals are aggregated.
    """
    terms = _terms(query)
    if not terms or _raises(query):
        return nodes.where("false").select("id", F.lit(0.0).alias("score"))
    rows = materialise(nodes.select("id", _frequencies(F.concat_ws(" ", *FIELDS), terms).alias("f")).select("id", "f.len", "f.tf"), "terms")
    n = [F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"n{i}") for i in range(len(terms))]
    c = rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"), *n).first()
    mean = c["total"] / c["n_docs"] if c["total"] else 1.0

    def part(i: int) -> Column:
        idf = math.log((c["n_docs"] - c[f"n{i}"] + 0.5) / (c[f"n{i}"] + 0.5))
        tf = F.get("tf", F.lit(i))
        return (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("len") / mean))

    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))])
    out = rows.where(~F.array_contains("tf", 0)).select("id", score.alias("score")).orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


class Index(NamedTuple):
    """What repeated searches read: docs (id, total, norm, terms: array of (term, tf)) and idf (term, idf)."""

    docs: DataFrame
    idf: DataFrame


def tfidf_index(nodes: DataFrame, text: Column | None = None, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> Index:
    """The index of non-external nodes. ``keep(name, build)`` says where its tables are; the shared folder, if None.

    One pass cuts and counts row by row; document frequencies are one partial aggregation by term, norms one by document.
    """
    keep = keep or (lambda name, build: materialise(build(), name))
    docs = nodes.where("not is_external")
    text = F.concat_ws(" ", "name", "kind", "file_path", "description") if text is None else text
    cut = materialise(docs.select("id", counted(tokens(text)).alias("terms")), "cut")
    n_docs = cut.count()
    idf = keep("tfidf_idf", lambda: cut.select(F.explode("terms.term").alias("term")).groupBy("term").agg((F.log((F.lit(n_docs) + 1) / (F.count("*") + 1)) + 1).alias("idf")))
    total = F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + t["tf"])
    each = cut.select("id", F.inline("terms")).join(size_checked(idf, 64), "term")  # tokens have 40 characters at most
    squares = each.groupBy("id").agg(F.sum((F.col("tf") * F.col("idf")) * (F.col("tf") * F.col("idf"))).alias("squares"))
    built = keep("tfidf_docs", lambda: cut.join(squares, "id").select("id", total.alias("total"), (F.sqrt("squares") / total).alias("norm"), "terms"))
    return Index(built, idf)


def _best(dots: DataFrame, norm: float | Column, limit: int | None) -> DataFrame:
    """id, score from id, norm, dot: cosines above zero, the best first."""
    out = dots.select("id", (F.col("dot") / (norm * F.col("norm"))).alias("raw")).where("raw > 0")
    out = out.orderBy(F.desc(round_half_up(F.col("raw"), 9)), "id")
    out = out if limit is None else out.limit(limit)
    return out.select("id", round_half_up(F.col("raw"), 3).alias("score"))


def tfidf_search(nodes: DataFrame, query: str, limit: int | None = 20, index: Index | None = None) -> DataFrame:
    """Documents like the query's words; a term that the corpus lacks has idf 1. A filter over the index's rows."""
    docs, idf = index or tfidf_index(nodes)
    words = [t for t in re.split("[^a-z0-9]+", query.lower()) if 2 <= len(t) <= 40]
    count = Counter(words)
    known = {r.term: r.idf for r in idf.where(F.col("term").isin(list(count))).collect()} if count else {}
    q = {t: c / len(words) * known.get(t, 1.0) for t, c in count.items()}
    if not known:
        return nodes.where("false").select("id", F.lit(0.0).alias("score"))
    weight = F.create_map(*[F.lit(x) for t in sorted(known) for x in (t, known[t] * q[t])])
    hit = F.filter("terms", lambda t: F.map_contains_key(weight, t["term"]))
    dot = F.aggregate(hit, F.lit(0.0), lambda a, t: a + t["tf"] * F.element_at(weight, t["term"])) / F.col("total")
    return _best(docs.select("id", "norm", dot.alias("dot")), math.sqrt(sum(x * x for x in q.values())), limit)


def tfidf_similar(nodes: DataFrame, node_id: str, limit: int | None = 10, index: Index | None = None) -> DataFrame:
    """Documents like a node's, itself left out; none if it is unknown or external."""
    docs, idf = index or tfidf_index(nodes)
    own = docs.where(F.col("id") == node_id).select("total", F.col("norm").alias("own"), F.inline("terms")).join(idf, "term")
    own = materialise(own.select("term", "own", (F.col("tf") / F.col("total") * F.col("idf") * F.col("idf")).alias("q")), "query")
    each = docs.where(F.col("id") != node_id).select("id", "norm", "total", F.inline("terms")).join(size_checked(own, 96), "term")
    dots = each.groupBy("id").agg(F.first("norm").alias("norm"), F.first("own").alias("own"), F.sum(F.col("tf") / F.col("total") * F.col("q")).alias("dot"))
    return _best(dots, F.col("own"), limit)


def rrf(legs: list[DataFrame], k: int = 60) -> DataFrame:
    """id, score = sum of 1 / (k + rank + 1) over legs of (id, rank), ranks from zero."""
    each = reduce(DataFrame.unionByName, [leg.select("id", "rank") for leg in legs])
    return each.groupBy("id").agg(F.sum(1.0 / (F.col("rank") + k + 1)).alias("score"))


def ranked(scored: DataFrame, limit: int, by: list) -> DataFrame:
    """The best ``limit`` rows with their rank from zero; the window runs over those few rows only."""
    return scored.orderBy(*by).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*by)) - 1)


def hybrid_search(nodes: DataFrame, query: str, vectors: DataFrame | None = None, query_vec: list[float] | None = None, context_files: list[str] = (), use_bm25: bool = True, limit: int = 20, index=None) -> DataFrame:
    """id, score, name, kind, file_path: three legs of 50 fused by rank, boosted, rounded to four places.

    ``vectors``: node_id, vector. Without a query vector the mean of the vectors of the ten best TF-IDF hits stands in for it.
    """
    from lodegraph.functions import vectors as vec

    legs = [ranked(search_like(nodes, query).select("id"), 50, [F.col("id")])]
    if use_bm25:
        legs.append(ranked(bm25(nodes, query), 50, [F.desc("score"), F.col("id")]))
    if vectors is not None:
        if query_vec is None:
            best = tfidf_search(nodes, query, 10, index)
            near = vec.cosine_to(vectors, vec.centroid(vectors.join(F.broadcast(best.select(F.col("id").alias("node_id"))), "node_id")))
        else:
            near = vec.cosine_top(vectors, query_vec, 50)
        legs.append(ranked(near.select(F.col("node_id").alias("id"), "score"), 50, [F.desc("score"), F.col("id")]))
    fused = rrf(legs).join(nodes.select("id", "name", "kind", "file_path"), "id")
    boost = F.lit(1.0)
    if query[:1].isascii() and query[:1].isupper():
        boost = boost * F.when(F.col("kind") == "class", 1.5).otherwise(1.0)
    if "_" in query:
        boost = boost * F.when(F.col("kind").isin("function", "method"), 1.5).otherwise(1.0)
    if "." in query:
        boost = boost * F.when(F.col("kind") == "file", 2.0).otherwise(1.0)
    if context_files:
        boost = boost * F.when(F.col("file_path").isin(list(context_files)), 1.5).otherwise(1.0)
    return fused.select("id", round_half_up(F.col("score") * boost, 4).alias("score"), "name", "kind", "file_path").orderBy(F.desc("score"), "id").limit(limit)


def token_estimate(text: Column) -> Column:
    """One token for every four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")
