"""Human review: risk tiers, votes, agreement, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions.columns import in_turn, lookup


def yes_no(c: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.startswith("y"), 1).when(v.startswith("n"), 0)


def assign_tiers(entries: DataFrame, drift_threshold: float = 0.3, tier_b: int = 50, audit: int = 20, seed: str = "13") -> DataFrame:
    """Tier A by risk, B the next `tier_b` by demand, `audit` of the rest by a seeded hash, C the others.

    Both picks are top-k queries; nothing is ranked as a whole.
    `entries`: (term, term_types array, drift, demand, rank).
    """
    risky = F.arrays_overlap("term_types", F.array(*[F.lit(t) for t in V.HIGH_RISK_TYPES])) | (
        F.array_contains("term_types", "polysemous") & (F.coalesce("drift", F.lit(0.0)) >= drift_threshold))
    d = entries.withColumn("_a", F.coalesce(risky, F.lit(False)))
    b = d.filter("not _a").orderBy(F.desc("demand"), F.coalesce("rank", F.lit(1_000_000_000)), "term").limit(tier_b).select("term")
    rest = d.filter("not _a").join(b, "term", "left_anti")
    au = rest.orderBy(F.sha1(F.concat(F.lit(seed + "|"), "term")), "term").limit(audit).select("term")
    marks = b.withColumn("_m", F.lit("B")).unionByName(au.withColumn("_m", F.lit("audit")))
    return d.join(marks, "term", "left").withColumn("tier", in_turn([(F.col("_a"), "A")], F.coalesce("_m", F.lit("C")))).drop("_a", "_m")


def cohen_kappa(pairs: DataFrame, keys, a: str, b: str) -> DataFrame:
    """Per key: n, raw agreement, kappa, and a warning when one rater gave a single answer. `a`, `b` are 0/1."""
    d = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("agreement"), F.avg(x).alias("_pa"), F.avg(y).alias("_pb")]
    g = d.groupBy(*keys).agg(*aggs) if keys else d.agg(*aggs)
    pe = F.col("_pa") * F.col("_pb") + (1 - F.col("_pa")) * (1 - F.col("_pb"))
    kappa = F.when(pe == 1, 1.0).otherwise((F.col("agreement") - pe) / (1 - pe))
    return g.select(*keys, "n", "agreement", kappa.alias("kappa"),
                    (F.col("_pa").isin(0.0, 1.0) | F.col("_pb").isin(0.0, 1.0)).alias("degenerate"))


def reviewer_agreement(sheet_a: DataFrame, sheet_b: DataFrame) -> DataFrame:
    """Kappa per question between two reviewers on the terms both judged."""
    long = lambda s, n: s.select("term", *[yes_no(F.col(c)).alias(c) for c in V.REVIEW_COLUMNS]).unpivot(
        ["term"], V.REVIEW_COLUMNS, "question", n)
    return cohen_kappa(long(sheet_a, "a").join(long(sheet_b, "b"), ["term", "question"]), ["question"], "a", "b")


def review_outcomes(tiered: DataFrame, votes: DataFrame) -> DataFrame:
    """Outcome per term: rejected, vetted, under_reviewed or open. `votes`: (term, reviewer, keep, types_ok, features_ok, neutral_ok)."""
    v = votes.select("term", "reviewer", *[yes_no(F.col(c)).alias(c) for c in V.REVIEW_COLUMNS]).filter("keep is not null")
    any_no = F.lit(False)
    for c in V.REVIEW_COLUMNS:
        any_no = any_no | F.coalesce(F.col(c) == 0, F.lit(False))
    agg = v.groupBy("term").agg(
        F.count(F.lit(1)).alias("votes"), F.bool_or(F.col("keep") == 0).alias("_rejected"),
        F.bool_and(F.coalesce(F.col("neutral_ok") == 1, F.lit(False))).alias("_neutral"), F.bool_or(any_no).alias("has_error"))
    d = tiered.select("term", "tier").join(agg, "term", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    need = lookup(F.col("tier"), V.REVIEWS_REQUIRED)
    return d.select("term", "tier", "votes", need.alias("need"), F.coalesce("has_error", F.lit(False)).alias("has_error"),
                    in_turn([(F.coalesce("_rejected", F.lit(False)), "rejected"), (need.isNull(), "open"), (F.col("votes") < need, "under_reviewed"),
                             (F.col("_neutral"), "vetted")], "open").alias("outcome"))


def review_summary(outcomes: DataFrame) -> DataFrame:
    """One row: outcome counts, audit error rate, and the hours a full review of the tiers takes."""
    t = lambda x: F.count_if(F.col("tier") == x)
    audited = F.count_if((F.col("tier") == "audit") & (F.col("votes") > 0))
    wrong = F.count_if((F.col("tier") == "audit") & (F.col("votes") > 0) & F.col("has_error"))
    return outcomes.agg(
        F.count_if(F.col("outcome") == "vetted").alias("vetted"), F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        F.count_if(F.col("outcome") == "under_reviewed").alias("under_reviewed"), audited.alias("audited"), wrong.alias("with_any_error"),
        F.try_divide(wrong, audited).alias("audit_error_rate"), ((6 * t("A") + 1.5 * t("B") + 1.5 * t("audit")) / 60).alias("person_hours"))
