"""From candidates to the terms worth a closer look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.columns import in_turn
from tessera.operators.ordering import first_per_group
from tessera.session import stage


def with_zscore(df: DataFrame, value: Column, name: str, over: DataFrame | None = None) -> DataFrame:
    """Population z-score of a column; all equal gives 0. The two moments are one scalar subquery."""
    v = value.cast("double")
    src = over if over is not None else df
    m = src.agg(F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))).scalar()
    return df.withColumn(name, F.when(m["sd"] > 1e-12, (v - m["mean"]) / m["sd"]).otherwise(0.0))


def sub_phrases(term: Column) -> Column:
    """Distinct token runs of a term that are shorter than the term itself."""
    return X.shorter_runs(F.split(term, " "))


def subsumed_terms(cands: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(term, longer): the longer candidate that accounts for at least `ratio` of a term's uses."""
    longer = cands.select(F.col("term").alias("longer"), F.col("count").alias("longer_count"),
                          F.explode(sub_phrases(F.col("term"))).alias("term"))
    pairs = longer.join(cands.filter("count > 0").select("term", "count"), "term").filter(
        F.col("longer_count") >= ratio * F.col("count"))
    return first_per_group(pairs.select("term", "longer", "longer_count"), ["term"],
                           [-F.col("longer_count"), F.col("longer")]).select("term", "longer")


def exclusions(cands: DataFrame, generic: DataFrame, ref: DataFrame, subsumed: DataFrame, max_ref_freq: float = 1.5e-4,
               max_share: float = 1.0) -> DataFrame:
    """Candidates with the first reason that rules them out, or null. Seeds are exempt."""
    d = (cands.join(generic.select("term").distinct().withColumn("_g", F.lit(True)), "term", "left")
         .join(ref.select("term", "ref_freq", "z_english"), "term", "left")
         .join(subsumed.select("term", F.lit(True).alias("_s")), "term", "left"))
    reason = in_turn([(F.col("seed"), F.lit(None).cast("string")), (F.col("_g"), "generic"),
                      (F.coalesce("ref_freq", F.lit(0.0)) > max_ref_freq, "common_english"), (F.col("_s"), "subsumed"),
                      (F.col("top_source_share") > max_share, "one_source")], F.lit(None).cast("string"))
    return d.withColumn("excluded", reason).drop("_g", "_s")


def shortlist(judged: DataFrame, phrases: DataFrame, generic: DataFrame, ref_freq: DataFrame, subsumed: DataFrame,
              size: int = 300, max_ref_freq: float = 1.5e-4) -> DataFrame:
    """(term, reason): all seeds, phrases asked for twice, then the best scores until `size` terms are chosen.

    `judged` comes from `exclusions`; `phrases` has (phrase, count). Seeds and phrases may exceed `size`.
    """
    ok = judged.filter("excluded is null").join(
        phrases.select(F.col("phrase").alias("term"), F.col("count").alias("asked")), "term", "left")
    demand = F.log1p((F.coalesce("asked", F.lit(0)) + F.col("seeker")).cast("double"))
    # two moments and a top-k read this, so it is written once
    ok = stage(ok.select("term", "seed", demand.alias("demand"), F.coalesce("z_english", F.lit(0.0)).alias("z")), "eligible")
    d = with_zscore(with_zscore(ok, F.col("demand"), "zd"), F.col("z"), "zk")
    scored = d.select("term", "seed", F.round(F.col("zd") + F.col("zk") + F.col("seed").cast("double"), 9).alias("score"))
    asked = (phrases.filter("count >= 2").select(F.col("phrase").alias("term"))
             .join(generic.select("term"), "term", "left_anti").join(subsumed.select("term"), "term", "left_anti")
             .join(ref_freq.filter(F.col("freq") > max_ref_freq).select("term"), "term", "left_anti"))
    pool = (scored.select("term", F.when(F.col("seed"), 1).otherwise(3).alias("prio"), "score")
            .unionByName(asked.select("term", F.lit(2).alias("prio"), F.lit(0.0).alias("score"))))
    one = pool.groupBy("term").agg(F.min("prio").alias("prio"), F.max("score").alias("score"))
    fixed = one.filter("prio < 3")
    room = F.greatest(F.lit(size) - F.coalesce(fixed.agg(F.count(F.lit(1))).scalar(), F.lit(0)), F.lit(0))
    # at most `size` rows can be filled by score: a top-k, then the exact room that is left
    best = one.filter("prio = 3").orderBy(F.desc("score"), F.desc("term")).limit(size)
    from pyspark.sql import Window as W
    filled = best.withColumn("rn", F.row_number().over(W.partitionBy("prio").orderBy(F.desc("score"), F.desc("term")))).filter(
        F.col("rn") <= room).drop("rn")
    return fixed.unionByName(filled).select(
        "term", F.when(F.col("prio") == 1, "seed").when(F.col("prio") == 2, "seeker_phrase").otherwise("score").alias("reason"))


def exclusion_counts(judged: DataFrame) -> DataFrame:
    return judged.filter("excluded is not null").groupBy("excluded").agg(F.count(F.lit(1)).alias("n"))
