"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.batches import fresh

#: A key is hot from so many rows on, and from a 100,000th of all rows on, so that at most HOT_KEYS keys are hot.
HOT_ROWS = 10_000
HOT_KEYS = 100_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, spread: Column) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has unique ``keys`` and in ``count`` how many of the ``total`` rows have them.

    Entries of hot keys are broadcast, at most HOT_KEYS of them whatever the size of the data. The rows that
    met one go through the shuffle for all other keys under ``spread``, a hash of theirs, so that no task gets them all.
    Pass a ``table`` that is cheap to read again, and rows without nulls in the keys.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = table.where(F.col(count) >= least)
    if hot.isEmpty():
        return rows.join(table, keys)
    carried = [c for c in table.columns if c not in keys]
    h, c, by, *theirs = fresh(rows, "hot", "cold", "by", *(f"key{i}" for i in range(len(keys))))
    entry = F.struct(*carried)
    met = rows.join(F.broadcast(hot.select(*keys, entry.alias(h))), keys, "left").withColumn(by, F.when(F.col(h).isNull(), F.col(keys[0])).otherwise(spread))
    cold = table.where(F.col(count) < least).select(*(F.col(k).alias(t) for k, t in zip(keys, theirs)), entry.alias(c))
    on = [F.col(by if i == 0 else k) == F.col(t) for i, (k, t) in enumerate(zip(keys, theirs))]
    both = met.join(cold, on, "left")
    found = F.coalesce(h, c)
    return both.where(found.isNotNull()).select(*rows.columns, *(found[x].alias(x) for x in carried))
