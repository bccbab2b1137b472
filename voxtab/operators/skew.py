"""Joins and top-k that hold when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAVY_KEYS = 1000


def group_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
               how: str = "left") -> DataFrame:
    """Join on group columns of which any may be NULL; a NULL group meets itself."""
    renamed = right.withColumnsRenamed({k: f"_{i}_{k}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}_{k}"))
    return left.join(renamed, same, how).drop(*[f"_{i}_{k}" for i, k in enumerate(keys)])


def split_join(big: DataFrame, dim: DataFrame, keys: Sequence[str], weight: str,
               parts: int = HEAVY_KEYS) -> DataFrame:
    """Inner join to a table with unique keys that knows each key's number of big rows.

    A key with more than 1/parts of all rows is heavy. There are fewer than
    ``parts`` of those, whatever the data, so they are broadcast and their rows
    stay where they are; every other key is light enough for one shuffle task.
    """
    keys = list(keys)
    total = dim.agg(F.sum(weight)).scalar()
    is_heavy = F.col(weight) * parts > total
    heavy = dim.where(is_heavy)
    hot = big.join(F.broadcast(heavy), keys)
    rest = big.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return hot.unionByName(rest.join(dim.where(~is_heavy), keys))


def top_k(df: DataFrame, k: int, order: Sequence[Column], group_cols: Sequence[str] = (),
          rank: str = "rank") -> DataFrame:
    """First k rows overall, or per group, with their rank.

    Overall: a heap per partition. Per group: a window with a row-number limit,
    which Spark applies per partition before the shuffle, so a group of any size
    sends at most k rows per partition.
    """
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    best = df.orderBy(*order).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  value: Column, out: str, carry: Sequence[str] = ()) -> DataFrame:
    """Up to k values per key in order, as an array; same early limit as ``top_k``.

    ``carry`` names columns that are constant within a key and kept as they are.
    """
    kept = [*keys, *carry]
    ranked = top_k(df, k, order, keys, "_rn").select(*kept, "_rn", value.alias("_v"))
    packed = F.sort_array(F.collect_list(F.struct("_rn", "_v")))
    return ranked.groupBy(*kept).agg(F.transform(packed, lambda s: s["_v"]).alias(out))
