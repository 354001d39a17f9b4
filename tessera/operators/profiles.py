"""Append-only preference logs folded into current beliefs and profiles.

Log rows: session_id, id (order), op (assert/confirm/revise/retract), key, vals
array<string>, stance (want/avoid/neutral), strength, conf, src, ev. Every fold
is an aggregate over (session, key); none needs the log in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import rules as R
from tessera.functions.columns import in_turn, lookup


def valid_ops(log: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Log rows whose key and values are in the vocabulary; retractions need only a known key."""
    voc = vocabulary.select(F.col("feature").alias("key"), "values")
    d = log.join(voc, "key", "left")
    free = F.arrays_overlap("values", F.array(*[F.lit(p) for p in V.PLACEHOLDER_VALUES if p != "percent"]))
    listed = F.size(F.array_except("vals", "values")) == 0
    ok = F.col("key").isin(V.NON_FEATURE_KEYS) | (F.col("values").isNotNull() & (free | (F.col("op") == "retract") | listed))
    return d.filter(F.coalesce(ok, F.lit(False))).drop("values")


def clean_proposed_ops(ops: DataFrame) -> DataFrame:
    """Rewrite proposed log rows: synonyms, strength caps and mis-aimed keys, as ordered rules.

    Needs op, key, vals, stance, strength, src, ev, text; location rows are dropped.
    """
    ev, text = F.lower(F.coalesce("ev", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    said = F.when(text == "", ev).otherwise(text)
    firm = ev.rlike(V.FIRM_WISH)
    d = ops.filter("key <> 'location'").withColumn("op", F.when(F.col("op") == "add", "assert").otherwise(F.col("op")))
    strength = F.coalesce("strength", F.lit(0.6))
    d = d.withColumn("strength", F.when((F.coalesce("src", F.lit("stated")) != "user_edit") & ~firm,
                                        F.least(strength, F.lit(0.7))).otherwise(strength))
    one = lambda *v: F.array(*[F.lit(x) for x in v])
    exact = ev.rlike(V.EXACT_BODY)
    families = F.array_compact(F.array(F.when(ev.contains("lutheran"), "lutheran"), F.when(ev.contains("anglican"), "anglican_episcopal")))
    affil = F.col("key").isin("denomination", "identity.denomination")
    to_family = affil & ~exact & (F.size(families) > 0)
    to_branch = affil & ~to_family & ev.contains("catholic") & (F.col("stance") == "avoid")
    d = d.select("*", in_turn([(to_family, "identity.tradition"), (to_branch, "identity.branch")], F.col("key")).alias("_k"),
                 F.when(to_family, families).when(to_branch, one("catholic")).otherwise(F.col("vals")).alias("_v")
                 ).drop("key", "vals").withColumnsRenamed({"_k": "key", "_v": "vals"})
    broad = ((F.col("key") == "identity.branch") & (F.col("stance") == "want") & said.contains("protestant")
             & ~said.contains("mainline") & ~said.contains("evangelical"))
    authority = (F.col("key") == "theology.scripture") & ev.contains("biblical authority") & ~ev.rlike(V.STRICT_SCRIPTURE)
    d = d.withColumn("vals", in_turn([
        (broad, one(*V.PROTESTANT_BRANCHES)),
        (authority, one(*V.SCRIPTURE_VALUES))], F.col("vals")))
    hymns = (F.col("key") == "worship.style") & (F.col("vals") == one("traditional_hymns"))
    lead = ((F.col("key") == "women.senior_pastor") & (F.col("stance") == "avoid") & (F.col("vals") == one("no"))
            & said.rlike(V.LEAD_ROLE_ONLY))
    return d.select(*[c for c in d.columns if c not in ("key", "vals", "stance")],
                    F.when(hymns, "worship.music_sources").otherwise(F.col("key")).alias("key"),
                    F.when(hymns, one("hymns")).otherwise(F.col("vals")).alias("vals"),
                    F.when(lead, "want").otherwise(F.col("stance")).alias("stance"))


def exclusive_branch_ops(ops: DataFrame) -> DataFrame:
    """Messages that insist on one branch: their branch rows become one wanted and one avoided list.

    `ops`: cleaned rows with t (message), key, vals, op, stance, strength, src, ev, text. Messages without rows have none here.
    """
    strict = F.coalesce(F.col("text").rlike(V.EXCLUSIVE_BRANCH), F.lit(False))
    kept = ops.filter(~(strict & (F.col("key") == "identity.branch")))
    lists = F.explode(F.array(*[F.struct(F.array(*[F.lit(b) for b in branches]).alias("_v"), F.lit(stance).alias("_s"))
                                for branches, stance in ((V.PROTESTANT_BRANCHES, "want"), (V.OTHER_BRANCHES, "avoid"))])).alias("_n")
    made = ops.filter(strict).groupBy("t").agg(F.min("text").alias("text")).select("*", lists)
    made = made.select("t", "text", F.lit("revise").alias("op"), F.lit("identity.branch").alias("key"), F.col("_n._v").alias("vals"), F.col("_n._s").alias("stance"),
                       F.lit(0.9).alias("strength"), F.lit("stated").alias("src"), F.substring("text", 1, 200).alias("ev"))
    return kept.unionByName(made, allowMissingColumns=True)


def ladder_preferences(answers: DataFrame) -> DataFrame:
    """One preference per role feature from (session_id, rung, mode)."""
    spark = answers.sparkSession
    rungs = spark.createDataFrame([(i, r, f) for i, (r, f) in enumerate(V.LADDER)], "pos int, rung string, feature string")
    chosen = answers.join(rungs.select("rung", F.col("pos").alias("at")), "rung", "left")
    roles = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature")) for i, (_, f) in enumerate(V.LADDER) if f])
    d = chosen.select("session_id", "rung", "mode", "at", F.inline(roles))
    none = F.col("mode").isNull() | F.col("at").isNull()
    below = F.col("pos") <= F.col("at")
    preach = F.col("feature") == "women.preach"
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    want = in_turn([
        (none, F.array().cast("array<string>")),
        (below & F.col("mode").isin("minimum", "both"), F.when(preach, arr("regularly", "occasionally")).otherwise(arr("yes"))),
        (~below & F.col("mode").isin("maximum", "both"), F.when(preach, arr("never")).otherwise(arr("no"))),
    ], F.array().cast("array<string>"))
    d = d.withColumn("want", want)
    return d.select("session_id", "feature", "want", F.when(F.size("want") > 0, "important").otherwise("dont_care").alias("weight"))


def current_beliefs(log: DataFrame) -> DataFrame:
    """Last row per (session, key), unless it retracts."""
    rest = [c for c in log.columns if c not in ("session_id", "key")]
    last = log.groupBy("session_id", "key").agg(F.max_by(F.struct(*rest), "id").alias("r"))
    return last.select("session_id", "key", "r.*").filter("op <> 'retract'")


def preference_states(log: DataFrame) -> DataFrame:
    """Standing values per (session, key, stance).

    A retraction or a neutral row clears the key; a revision replaces the values of
    its stance; assertions and confirmations add. Two threshold aggregates mark
    where the live segment starts, then values are joined in order. Values repeat
    heavily in a log, so each distinct value is reduced to its first place before
    anything is collected.
    """
    d = log.filter(~F.col("key").isin("location", "for_whom"))
    clears = (F.col("op") == "retract") | (F.col("stance") == "neutral")
    cut = d.groupBy("session_id", "key").agg(F.max(F.when(clears, F.col("id"))).alias("_clear"))
    live = d.join(cut, ["session_id", "key"]).filter(~clears & (F.col("_clear").isNull() | (F.col("id") > F.col("_clear"))))
    k = ["session_id", "key", "stance"]
    start = live.groupBy(*k).agg(F.max(F.when(F.col("op") == "revise", F.col("id"))).alias("_start"))
    seg = live.join(start, k).filter(F.col("_start").isNull() | (F.col("id") >= F.col("_start")))
    firsts = seg.select(*k, "id", F.posexplode("vals").alias("_p", "_v")).groupBy(*k, "_v").agg(
        F.min(F.struct("id", "_p")).alias("_at"))
    vals = firsts.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("vals"))
    last = seg.groupBy(*k).agg(F.max_by(F.struct("strength", "conf", "src", "ev", "id"), "id").alias("r"))
    return last.join(vals, k).select(*k, "vals", "r.*")


def profiles(log: DataFrame, features: DataFrame) -> DataFrame:
    """(session_id, feature, want, avoid, weight, strength, conf): both stances of a key merged, higher weight kept.

    `features`: (feature, sensitive). The key `denomination` stands for `identity.denomination`.
    """
    return profiles_of_states(preference_states(log), features)


def profiles_of_states(st: DataFrame, features: DataFrame) -> DataFrame:
    """Profiles from standing values, see `preference_states`."""
    fid = F.when(F.col("key") == "denomination", "identity.denomination").otherwise(F.col("key"))
    d = st.withColumn("feature", fid).join(features.select("feature", "sensitive"), "feature")
    d = d.withColumn("step", R.preference_step(F.col("strength"), F.col("conf"), F.col("sensitive"), F.col("src")))
    side = lambda s: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("stance") == s, F.struct("id", "vals")))), lambda x: x["vals"])))
    return d.groupBy("session_id", "feature").agg(
        side("want").alias("want"), side("avoid").alias("avoid"), R.weight_name(F.max("step")).alias("weight"),
        F.max_by("strength", "id").alias("strength"), F.max_by("conf", "id").alias("conf"))


def origins(current: DataFrame) -> DataFrame:
    """(session_id, text, lat, lng, max_miles) from the standing location row, whose `location` is a struct."""
    return current.filter("key = 'location' and location is not null").select(
        "session_id", "location.text", "location.lat", "location.lng", F.col("location.limit_miles").alias("max_miles"))


def belief_summary(current: DataFrame, states: DataFrame, features: DataFrame) -> DataFrame:
    """Plain sentences for every standing belief with its display order."""
    level = F.when(F.col("strength") >= 0.8, "a must").when(F.col("strength") >= 0.5, "important").otherwise("nice to have")
    d = states.filter("stance <> 'neutral'").withColumn(
        "feature", F.when(F.col("key") == "denomination", "identity.denomination").otherwise(F.col("key"))).join(
        features.select("feature", "label"), "feature", "left")
    vals = F.array_join(F.transform("vals", lambda v: F.replace(v, F.lit("_"), F.lit(" "))), ", ")
    label = F.coalesce("label", "key")
    text = F.when(F.col("stance") == "avoid", F.format_string("%s: would rather avoid %s (%s)", label, vals, level)).otherwise(
        F.format_string("%s: %s (%s)", label, vals, level))
    rows = d.select("session_id", "key", text.alias("text"), "src", "conf")
    whom = current.filter("key = 'for_whom'").select(
        "session_id", "key", F.when(F.array_contains("vals", "other"), "Looking for a church for someone else").otherwise(
            "Looking for a church for yourself").alias("text"), "src", "conf")
    out = rows.unionByName(whom)
    if "location" in current.columns:
        lim = F.col("location.limit_miles")
        out = out.unionByName(current.filter("key = 'location' and location is not null").select(
            "session_id", "key", F.concat(F.lit("Starting from "), F.coalesce("location.text", F.lit("?")),
                                          F.when(lim > 0, F.format_string(", within %s miles", F.regexp_replace(lim.cast("string"), r"\.0$", ""))).otherwise("")).alias("text"),
            "src", "conf"))
    order = F.coalesce(lookup(F.col("key"), [("location", 0), ("for_whom", 1), ("denomination", 2)]), F.lit(3))
    from pyspark.sql import Window as W
    w = W.partitionBy("session_id").orderBy(order, F.desc("conf"), "text")
    return out.withColumn("line", F.row_number().over(w))


def live_rows(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of the session's current generation only."""
    return rows.join(state.select("session_id", "generation"), ["session_id", "generation"], "left_semi")


def messages_after(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Messages numbered above what the session has already read. `seen`: (session_id, since)."""
    return messages.join(seen, "session_id").filter("n > since").drop("since")
