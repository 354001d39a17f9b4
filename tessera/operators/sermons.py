"""Recordings: observed evidence from analyses, stated positions, feed items, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.operators.evidence import value_check
from tessera.operators.ordering import first_per_group


def _mode(d: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, top, k, n): the commonest value per key, the one met first on ties."""
    c = d.filter(F.coalesce(value, F.lit("")) != "").groupBy(key, value).agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("f"))
    return c.groupBy(key).agg(F.min_by(value, F.struct(-F.col("c"), F.col("f"))).alias("top"), F.max("c").alias("k"), F.sum("c").alias("n"))


def upper_median(d: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): element n div 2 of the sorted values. Counted per distinct value, then found by running totals."""
    from pyspark.sql import Window as W
    c = d.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(key)
    run = c.withColumn("_upto", F.sum("c").over(w.orderBy(value))).withColumn("_n", F.sum("c").over(w))
    return run.filter(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(key).agg(F.min(value).alias("median"))


def observed_evidence(analyses: DataFrame, vocabulary: DataFrame, key: str = "church_id", known_min: int = 5) -> DataFrame:
    """Tier-D rows from sermon analyses with notes of the form `k of n`.

    `analyses`: (church_id, seq, speaker_gender, minutes, style, audience, scripture_density, politics_mentions).
    """
    a = analyses
    g = F.lower(F.coalesce("speaker_gender", F.lit("unknown")))
    base = a.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(g.isin("female", "male")).alias("known"), F.count_if(g == "female").alias("female"),
        F.avg(F.coalesce(F.col("politics_mentions").cast("double"), F.lit(0.0))).alias("politics"),
        F.count_if(F.coalesce("politics_mentions", F.lit(0)) > 0).alias("mentioned"))
    row = lambda d, f, v, note: d.select(key, F.lit(f).alias("feature"), v.alias("value"), note.alias("note"))
    share = F.when(F.col("female") <= 0, "never").when(F.col("female") >= F.greatest(F.lit(1), F.floor(F.col("known") / 2)), "regularly").otherwise("occasionally")
    women = row(base.filter(F.col("known") >= known_min), "women.preach", share,
                F.format_string("%d of %d sermons with an identifiable speaker were preached by women", "female", "known"))
    freq = F.when(F.col("politics") >= 2, "frequent").when(F.col("politics") >= 0.5, "occasional").otherwise("rare")
    politics = row(base, "preaching.politics_frequency", freq, F.format_string("%d of %d sermons mentioned politics or current events", "mentioned", "n"))
    timed = a.filter(F.coalesce("minutes", F.lit(0.0)) != 0).withColumn("_b", R.length_bucket(F.col("minutes")))
    length = _mode(timed, key, "_b", "seq").join(upper_median(timed, key, "minutes"), key)
    parts = [women, politics, row(length, "logistics.sermon_length", F.col("top"),
                                  F.format_string("%d of %d sermons; median %s min", F.col("k"), F.col("n"), F.bround("median").cast("long").cast("string")))]
    for f, c in (("preaching.style", "style"), ("preaching.audience", "audience"), ("preaching.scripture_density", "scripture_density")):
        m = _mode(a, key, c, "seq")
        parts.append(row(m, f, F.col("top"), F.format_string("%d of %d sermons %s", F.col("k"), F.col("n"), F.replace("top", F.lit("_"), F.lit(" ")))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    listed = vocabulary.select("feature", F.explode("values").alias("value"))
    return out.join(listed, ["feature", "value"], "left_semi").select(
        key, "feature", "value", F.lit("D").alias("tier"), F.lit("observed").alias("how"), F.lit("sermon_transcript").alias("source_kind"), "note")


def stated_positions(analyses: DataFrame, texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tier-A rows from positions stated in a sermon whose quote stands in its text, whose value is allowed and whose topic fits.

    `analyses`: (sermon_id, positions array<struct<feature,value,quote>>); `texts`: (sermon_id, church_id, page_url, title, text).
    """
    from tessera.functions import text as X
    d = analyses.select("sermon_id", F.inline("positions")).join(texts, "sermon_id")
    d = value_check(d, vocabulary).filter("value_ok")
    d = d.filter(X.quote_exact(F.col("quote"), F.col("text"), 12, X.blank_form)
                 & R.topic_scope_reason(F.col("feature"), F.col("value"), F.col("quote")).isNull() & (F.coalesce("page_url", F.lit("")) != ""))
    return d.select("church_id", "feature", "value", F.lit("A").alias("tier"), F.lit("stated").alias("how"), F.lit("sermon_transcript").alias("source_kind"),
                    F.substring("quote", 1, 300).alias("quote"), F.col("page_url").alias("url"),
                    F.concat(F.lit("sermon: "), F.substring(F.coalesce("title", F.lit("")), 1, 80)).alias("note"))


def throughput(steps: DataFrame) -> DataFrame:
    """Audio minutes per minute of work, per action."""
    return steps.groupBy("action").agg(
        F.count(F.lit(1)).alias("steps"), F.sum("audio_minutes").alias("audio_minutes"), (F.sum("wall_ms") / 60000).alias("wall_minutes"),
        F.coalesce(F.try_divide(F.sum("audio_minutes"), F.sum("wall_ms") / 60000), F.lit(0.0)).alias("throughput"))
