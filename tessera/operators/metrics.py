"""Call statistics, costs, labelled-set metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.operators.quantiles import exact_quantiles


def call_stats(calls: DataFrame, keys=("task", "model")) -> DataFrame:
    """Per (task, model): calls, ok rate, exact median and total time, repairs, tokens."""
    have = set(calls.columns)
    extra = [F.sum(c).alias(c) for c in ("repairs", "prompt_tokens", "completion_tokens") if c in have]
    sums = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.col("ok").cast("double")).alias("ok_rate"),
        (F.sum("ms") / 60000).alias("total_min"), *extra)
    middle = exact_quantiles(calls, keys, "ms", 0.5, "median_ms").select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], "median_ms")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & sums[k].eqNullSafe(middle[f"_m{i}"])
    first = [*keys, "calls", "ok_rate", "median_ms", "total_min"]
    return sums.join(middle, on).select(*first, *[c for c in ("repairs", "prompt_tokens", "completion_tokens") if c in have])


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per (task, model) from token counts and a price table (model, price_in, price_out per million)."""
    c = R.call_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price_in"), F.col("price_out"))
    return calls.join(prices, "model", "left").groupBy("task", "model").agg(F.sum(F.coalesce(c, F.lit(0.0))).alias("cost"))


def label_metrics(guesses: DataFrame, confident: float = 0.8, unknown: float = 0.4) -> DataFrame:
    """Top-1, accuracy where confident, unknown rate. `guesses`: (ok, confidence, method)."""
    sure = F.col("confidence") >= confident
    return guesses.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("top1"), F.count_if(sure).alias("confident_n"),
        F.avg(F.when(sure, F.col("ok").cast("double"))).alias("confident_accuracy"),
        F.avg(((F.col("method") == "unknown") | (F.col("confidence") <= unknown)).cast("double")).alias("unknown_rate"))


def by_kind(guesses: DataFrame) -> DataFrame:
    return guesses.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("misses"))
