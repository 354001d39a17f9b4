"""How distinctive terms are: against a reference corpus and between traditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_odds_z(y_i: Column, n_i: Column, y_j: Column, n_j: Column, a_w: Column, a0: float) -> Column:
    """z-score of the log-odds ratio with an informative Dirichlet prior."""
    a = F.greatest(a_w, F.lit(1e-6))
    side = lambda y, n: F.log((y + a) / F.greatest(n + a0 - y - a, F.lit(1e-9)))
    return (side(y_i, n_i) - side(y_j, n_j)) / F.sqrt(1.0 / (y_i + a) + 1.0 / (y_j + a))


def reference_z(cands: DataFrame, reference: DataFrame, totals: DataFrame, n_ref: float = 1e7, a0: float = 500.0) -> DataFrame:
    """(term, ref_freq, z_english) against a table of reference frequencies (term, freq)."""
    n = F.greatest(totals.filter("scope = 'all'").agg(F.coalesce(F.sum("tokens"), F.lit(1))).scalar(), F.lit(1)).cast("double")
    d = cands.join(reference.select("term", "freq"), "term", "left")
    f = F.greatest(F.coalesce("freq", F.lit(0.0)), F.lit(1e-9))
    y, y_ref = F.col("count").cast("double"), f * F.lit(n_ref)
    z = F.when(F.col("count") > 0, log_odds_z(y, n, y_ref, F.lit(n_ref), a0 * (y + y_ref) / (n + n_ref), a0)).otherwise(0.0)
    return d.select("term", f.alias("ref_freq"), z.alias("z_english"))


def tradition_z(cands: DataFrame, by_tradition: DataFrame, totals: DataFrame, min_docs: int = 20,
                a0: float = 500.0) -> DataFrame:
    """One row per (term, tradition) with its one-against-the-rest z-score; traditions come with enough documents."""
    church = F.coalesce(totals.filter("scope = 'church'").agg(F.sum("tokens")).scalar(), F.lit(1)).cast("double")
    trads = totals.filter(F.col("scope").startswith("t:") & (F.col("docs") >= min_docs)).select(
        F.substring("scope", 3, 1000).alias("tradition"), F.col("tokens").cast("double").alias("n_i"))
    used = by_tradition.select(F.col("gram").alias("term"), "tradition", "count", "n_sources", "top_share")
    # the list of traditions is a label set; each term row carries it as one array
    label_set = F.coalesce(trads.agg(F.collect_list(F.struct("tradition", "n_i"))).scalar(),
                           F.array().cast("array<struct<tradition:string,n_i:double>>"))
    grid = cands.select("term", "church", F.inline(label_set))
    d = grid.join(used, ["term", "tradition"], "left")
    yi = F.coalesce("count", F.lit(0)).cast("double")
    all_ = F.col("church").cast("double")
    aw = a0 * F.greatest(all_, F.lit(0.5)) / F.greatest(church, F.lit(1.0))
    z = log_odds_z(yi, F.col("n_i"), all_ - yi, F.greatest(church - F.col("n_i"), F.lit(1.0)), aw, a0)
    return d.select("term", "tradition", z.alias("z"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
                    F.coalesce("top_share", F.lit(0.0)).alias("top_share"))


def markers(cands: DataFrame, ref: DataFrame, tz: DataFrame, excluded: DataFrame | None = None, max_ref_freq: float = 1.5e-4,
            min_sources: int = 0, max_share: float = 1.0, digits: int = 3) -> DataFrame:
    """The tradition a term marks most: best z among those that share the word widely enough; else (null, 0)."""
    d = cands.select("term", "seed").join(ref, "term", "left")
    if excluded is not None:
        d = d.join(excluded.select("term").distinct().withColumn("_ex", F.lit(True)), "term", "left")
    else:
        d = d.withColumn("_ex", F.lit(None).cast("boolean"))
    blocked = ~F.col("seed") & (F.coalesce("_ex", F.lit(False)) | (F.col("ref_freq") > max_ref_freq))
    usable = tz.filter((F.col("n_sources") >= min_sources) & (F.col("top_share") <= max_share))
    z = F.round("z", digits)
    best = usable.groupBy("term").agg(F.max_by("tradition", F.struct(z, F.col("tradition"))).alias("_t"), F.max(z).alias("_z"))
    out = d.join(best, "term", "left")
    return out.select("term", F.round("z_english", digits).alias("z_english"), "ref_freq",
                      F.when(~blocked, F.col("_t")).alias("top_tradition"),
                      F.when(~blocked, F.coalesce("_z", F.lit(0.0))).otherwise(0.0).alias("top_tradition_z"))
