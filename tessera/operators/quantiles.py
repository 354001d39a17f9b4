"""Exact quantiles of many groups at once, without a sort and without a group in one buffer.

Every round cuts the open range of each group into `BINS` equal parts, counts the rows per part in
one pass (combined map-side) and goes on in the part that holds the wanted rank, between the least and the largest
value seen there. A range of one value is the answer. A group may own all rows: what is kept per
group is one row per part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import stage, unstage

BINS = 256


def _joined(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(right[f"_k{i}"])
    return left.join(right, on)


def exact_quantiles(df: DataFrame, keys, value: str, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """The `q`-quantile of `value` per group, between the two nearest ranks by linear interpolation; 0.5 is the median.

    Nulls and NaNs don't count; a group without values has a null. Values are taken as doubles and must be finite. Keys may be null.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v"))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = rows.withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    all_groups = stage(rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "quantile-groups")
    at = (F.col("_n") - 1) * q
    ranks = F.array(F.struct(F.lit(0).alias("w"), (F.floor(at) + 1).alias("r")), F.struct(F.lit(1).alias("w"), (F.ceil(at) + 1).alias("r")))
    todo = stage(all_groups.filter("_n > 0").select(*own, "_low", "_high", F.explode(ranks).alias("_t")).select(*ks, "_t.w", "_t.r", "_low", "_high"), "quantile-open")
    done = []
    while True:
        done.append(todo.filter("_low = _high").select(*ks, "w", F.col("_low").alias("x")))
        left = todo.filter("_low < _high")
        if left.isEmpty():
            break
        d = _joined(rows, left, keys).filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        # halves first: the difference of two doubles may overflow, that of their halves never does
        share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        part = F.when(F.col("_v") == F.col("_high"), BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 2))).cast("int")
        counts = d.groupBy(*ks, "w", "r", part.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.sum("_c").over(W.partitionBy(*ks, "w").orderBy("_bin")) - F.col("_c")
        held = counts.withColumn("_before", before).filter((F.col("r") > F.col("_before")) & (F.col("r") <= F.col("_before") + F.col("_c")))
        todo = stage(held.select(*ks, "w", (F.col("r") - F.col("_before")).alias("r"), "_low", "_high"), "quantile-open")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    ends = found.groupBy(*ks).agg(F.max(F.when(F.col("w") == 0, F.col("x"))).alias("_a"), F.max(F.when(F.col("w") == 1, F.col("x"))).alias("_b"))
    ends = stage(ends, "quantile-found")
    unstage(todo)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & all_groups[k].eqNullSafe(ends[f"_k{i}"])
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))
    return all_groups.join(ends, on, "left").select(*keys, value.alias(name))
