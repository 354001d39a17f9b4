import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, quantiles


@pytest.mark.parametrize("q", [0.5, 0.0, 0.9, 1.0])
def test_quantiles_of_many_groups(spark, monkeypatch, q):
    monkeypatch.setattr(quantiles, "BINS", 4)
    rng, groups = random.Random(3), {}
    for k in ["a", "b", None, "one", "same", "far", "none"]:
        n = {"one": 1, "none": 0}.get(k, 77 if k == "a" else 40)
        groups[k] = [5.0] * n if k == "same" else [rng.choice([-1e308, 1e308, 1e-308, 0.0, 3.0]) if k == "far" else rng.gauss(0, 10) for _ in range(n)]
    rows = [(k, 1, v) for k, vs in groups.items() for v in vs] + [("none", 1, None), ("none", 1, math.nan), ("a", 1, None)]
    rng.shuffle(rows)
    got = {r["k"]: r["quantile"] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, j int, v double").repartition(5), ["k", "j"], "v", q).collect()}
    assert got.keys() == groups.keys() and got["none"] is None
    for k, vs in groups.items():
        if vs and k != "far":
            assert got[k] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12)
    far = sorted(groups["far"])
    assert min(far) <= got["far"] <= max(far)


def test_call_statistics_hold_no_group_in_a_buffer(spark):
    calls = spark.createDataFrame([("t", "m", True, float(v), 1, 2, 3) for v in (4, 1, 9, 2)] + [("t", None, False, 7.0, 0, 1, 1)], "task string, model string, ok boolean, ms double, repairs int, prompt_tokens int, completion_tokens int")
    out = metrics.call_stats(calls)
    got = {r["model"]: (r["calls"], r["ok_rate"], r["median_ms"], r["repairs"]) for r in out.collect()}
    assert got == {"m": (4, 1.0, 3.0, 4), None: (1, 0.0, 7.0, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert not any(x in plan for x in ("median(", "percentile", "collect_list", "collect_set"))
    assert metrics.call_stats(calls.limit(0)).collect() == [] and metrics.call_stats(calls.withColumn("ms", F.lit(None).cast("double"))).count() == 2
