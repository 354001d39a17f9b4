"""Ranks and running totals that hold up when one group owns much of the data.

A plain ranking window puts a whole group into one task. Here each group is cut
into blocks along its order (`block` must grow with the order columns). Blocks
are ranked or summed in parallel, and the small table of block totals supplies
the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _offsets(df: DataFrame, keys, block: Column, value: Column) -> DataFrame:
    totals = df.groupBy(*keys, block.alias("_block")).agg(F.sum(value).alias("_total"))
    w = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"),
                         F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_before"))


def _with_offsets(df: DataFrame, keys, block: Column, value: Column) -> DataFrame:
    offs = _offsets(df, keys, block, value)
    df = df.withColumn("_block", block)
    on = F.col("_block").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(offs, on)


def _tidy(df: DataFrame, keys) -> DataFrame:
    return df.drop("_block", "_b", "_before", *[f"_k{i}" for i in range(len(keys))])


def ordered_rank(df: DataFrame, keys, order, block: Column, name: str = "rn") -> DataFrame:
    """1-based position within each group along `order`."""
    d = _with_offsets(df, keys, block, F.lit(1))
    w = W.partitionBy(*keys, "_block").orderBy(*order)
    return _tidy(d.withColumn(name, (F.row_number().over(w) + F.col("_before")).cast("long")), keys)


def running_before(df: DataFrame, keys, order, block: Column, value: Column, name: str) -> DataFrame:
    """Total of `value` over the rows that come before this one within its group."""
    d = _with_offsets(df, keys, block, value)
    w = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return _tidy(d.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("_before")), keys)


def first_per_group(df: DataFrame, keys, order) -> DataFrame:
    """First row of each group. `order`: columns, ascending; wrap numbers in a minus for descending.

    An aggregate with map-side combine, so a hot group is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_per_group(df: DataFrame, keys, order, n: int, name: str = "rn") -> DataFrame:
    """First `n` rows of each group. Spark limits each group on the map side before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
