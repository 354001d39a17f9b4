"""All signals of a term in one row, its score and rank; draft list and evidence text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import half_up
from tessera.operators.ordering import ordered_rank
from tessera.operators.shortlist import with_zscore

WEIGHTS = {"seeker": 1.0, "keyness": 0.6, "ambiguity": 1.0, "seed": 0.5}


def merge_signals(short: DataFrame, cands: DataFrame, markers: DataFrame, occ: DataFrame, phrases: DataFrame,
                  senses: DataFrame | None = None, drift: DataFrame | None = None, stance: DataFrame | None = None) -> DataFrame:
    """Shortlist left-joined to every signal table; missing signals take their defaults."""
    d = (short.join(cands.select("term", F.col("seed").alias("_seed")), "term", "left")
         .join(occ.select("term", "count", F.col("seeker").alias("seeker_count"), F.col("church").alias("church_count"),
                          "negation_rate"), "term", "left")
         .join(markers.select("term", "z_english", "top_tradition", "top_tradition_z"), "term", "left")
         .join(phrases.select(F.col("phrase").alias("term"), F.col("count").alias("seeker_requests"),
                              F.col("want").alias("seeker_want"), F.col("avoid").alias("seeker_avoid"),
                              F.col("category").alias("seeker_category")), "term", "left"))
    for table, cols in ((senses, ["polysemy"]), (drift, ["drift"]), (stance, ["contestedness", "tradition_split"])):
        if table is not None:
            d = d.join(table.select("term", *cols), "term", "left")
        else:
            for c in cols:
                d = d.withColumn(c, F.lit(None).cast("double"))
    zero = lambda c, t="long": F.coalesce(c, F.lit(0)).cast(t)
    for c in ("count", "seeker_count", "church_count", "seeker_requests", "seeker_want", "seeker_avoid"):
        d = d.withColumn(c, zero(c))
    for c in ("negation_rate", "z_english", "top_tradition_z"):
        d = d.withColumn(c, zero(c, "double"))
    amb = (0.35 * F.coalesce("polysemy", F.lit(0.0)) + 0.25 * F.coalesce("drift", F.lit(0.0))
           + 0.25 * F.coalesce("contestedness", F.lit(0.0)) + 0.15 * F.col("negation_rate"))
    return (d.withColumn("ambiguity_raw", half_up(amb, 4))
            .withColumn("seed", (F.col("reason") == "seed") | F.coalesce("_seed", F.lit(False))).drop("_seed"))


def rank_terms(merged: DataFrame, weights: dict | None = None, digits: int = 4) -> DataFrame:
    """Score and rank 1..N. The ranks come from blocks of the score, not from one global task."""
    w = {**WEIGHTS, **(weights or {})}
    demand = F.log1p((F.col("seeker_requests") + F.col("seeker_count")).cast("double"))
    d = with_zscore(with_zscore(with_zscore(merged, demand, "_zd"), F.col("z_english"), "_zk"), F.col("ambiguity_raw"), "_za")
    score = (w["seeker"] * F.col("_zd") + w["keyness"] * F.col("_zk") + w["ambiguity"] * F.col("_za")
             + w["seed"] * F.col("seed").cast("double"))
    d = d.withColumn("score", F.round(score, digits)).drop("_zd", "_zk", "_za").withColumn("_all", F.lit(1))
    return ordered_rank(d, ["_all"], [F.desc("score"), F.col("term")], F.floor(-F.col("score") * 8), "rank").drop("_all")


def draft_list(ranked: DataFrame, top_n: int = 150, seed_min_count: int = 3) -> DataFrame:
    return ranked.filter((F.col("rank") <= top_n) | (F.col("seed") & (F.col("count") >= seed_min_count)))


def top_by(ranked: DataFrame, metric: str, n: int = 15) -> DataFrame:
    return ranked.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), "rank").limit(n).select("term", metric)


def evidence_blocks(ranked: DataFrame, by_tradition: DataFrame, ground: DataFrame, contexts: DataFrame, n_contexts: int = 8) -> DataFrame:
    """(term, text): the facts about a term as one request text. Every list in it is capped upstream or a label set."""
    text_list = lambda d, key, order, item, sep, name: d.groupBy("term").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct(*order, item.alias("s")))), lambda s: s["s"]), sep).alias(name))
    trad = text_list(by_tradition, "term", [(-F.col("count")).alias("o"), F.col("tradition").alias("o2")],
                     F.concat_ws(":", "tradition", F.col("count").cast("string")), ", ", "trad")
    obs = text_list(ground, "term", [F.col("rank").alias("o")],
                    F.format_string("%s (x%d)", "observable", "cooc"), ", ", "obs")
    ctx = text_list(contexts.filter(F.col("pick_no") <= n_contexts), "term", [F.col("pick_no").alias("o")],
                    F.format_string("[%s] ...%s...", "grp", "text"), "\n", "ctx")
    d = ranked.join(trad, "term", "left").join(obs, "term", "left").join(ctx, "term", "left")
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    lines = [F.format_string('TERM: "%s"', "term"),
             F.format_string("Corpus count: %d (seeker-side %d, church-side %d)", "count", "seeker_count", "church_count"),
             F.format_string("Seekers asked for it %dx and asked to avoid it %dx", "seeker_want", "seeker_avoid"),
             F.concat(F.lit("Church-side use by tradition: "), F.coalesce("trad", F.lit("none"))),
             F.concat(F.lit("Most distinctive of tradition: "), s("top_tradition"), F.lit(" (z="), s("top_tradition_z"), F.lit(")")),
             F.concat(F.lit("Co-occurring observable words: "), F.coalesce("obs", F.lit("none measured"))),
             F.lit(""), F.lit("SAMPLE CONTEXTS:"), F.coalesce("ctx", F.lit("(none in corpus)"))]
    return d.select("term", F.concat_ws("\n", *lines).alias("text"))
