import math
import random
from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import evidence as E
from tessera.operators import jobs, matching, profiles, sermons

FEATURES = [("worship.style", "Worship style", ["contemporary", "traditional_hymns"], False), ("women.preach", "Women preach", ["regularly", "never"], True),
            ("identity.tradition", "Tradition", ["baptist", "lutheran"], False), ("logistics.service_times", "Times", ["schedule"], False),
            ("preaching.style", "Preaching", ["expository", "topical"], False)]


def vocab(spark):
    return spark.createDataFrame(FEATURES, "feature string, label string, values array<string>, sensitive boolean")


def prefs(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "session_id string, feature string, want array<string>, avoid array<string>, weight string")


def ev(spark, rows):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([("c", f, v, tier, "q", "https://a.org", "website", "stated", t, note, i) for i, (f, v, tier, note) in enumerate(rows)],
                                 "church_id string, feature string, value string, tier string, quote string, url string, source_kind string, how string, checked_at timestamp, note string, row_id int")


def score(spark, p, e, **pair):
    base = {"session_id": "s", "church_id": "c", **pair}
    d = spark.createDataFrame([tuple(base.values())], list(base))
    return matching.score_pairs(d, matching.profile_arrays(prefs(spark, p), vocab(spark)), matching.evidence_maps(E.best_evidence(ev(spark, e)))).first()


def test_full_match_is_strong(spark):
    r = score(spark, [("worship.style", ["contemporary"], [], "important")], [("worship.style", "contemporary", "A", "")])
    assert (r["score"], r["fit"], r["excluded"], r["matched"]) == (100.0, "strong", False, ["worship.style"])
    assert r["why"] == ["✓ Worship style: contemporary — their website says so"]


def test_distance_penalty(spark):
    far = score(spark, [], [("worship.style", "x", "A", "")], distance_miles=10.0, max_miles=10.0)
    near = score(spark, [], [("worship.style", "x", "A", "")], distance_miles=2.0, max_miles=10.0)
    assert (far["score"], near["score"]) == (40.0, 50.0) and far["fit"] == "unknown"


def test_practice_never_excludes_but_identity_does(spark):
    r = score(spark, [("worship.style", [], ["contemporary"], "dealbreaker")], [("worship.style", "contemporary", "A", "")])
    assert not r["excluded"] and r["score"] == 0.0
    r = score(spark, [("identity.tradition", [], ["baptist"], "important")], [("identity.tradition", "baptist", "A", "")])
    assert r["excluded"]
    r = score(spark, [("identity.tradition", [], ["baptist"], "important")], [("identity.tradition", "lutheran", "A", "")])
    assert not r["excluded"] and r["score"] == 50.0      # not being avoided earns nothing


def test_firm_identity_wish_needs_a_verified_affiliation(spark):
    p = [("identity.tradition", ["baptist"], [], "dealbreaker")]
    e = [("identity.tradition", "lutheran", "A", "")]
    assert score(spark, p, e, denom_conf=0.9, denom_method="name")["excluded"]
    assert not score(spark, p, e, denom_conf=0.6, denom_method="name")["excluded"]


def test_unknown_dealbreaker_and_reason_limit(spark):
    p = [("worship.style", ["contemporary"], [], "important"), ("women.preach", ["regularly"], [], "dealbreaker"), ("preaching.style", ["topical"], [], "nice_to_have"),
         ("logistics.service_times", ["sunday"], [], "nice_to_have"), ("identity.tradition", ["baptist"], [], "nice_to_have")]
    e = [("worship.style", "traditional_hymns", "A", ""), ("preaching.style", "topical", "B", ""), ("logistics.service_times", "Sunday 10am", "C", ""), ("identity.tradition", "baptist", "D", "3 of 7")]
    r = score(spark, p, e)
    c = -3 * 1.0 - 0.1 * 5 + 0.8 + 0.5 + 0.6
    assert r["score"] == round(50 + 50 * c / 11, 1) and r["unknown"] == ["women.preach"] and len(r["why"]) == 4
    assert r["why"][-1] == "1 thing to check later"
    assert r["fit"] != "strong"


def test_priors_fill_gaps_and_lose_to_evidence(spark):
    den = spark.createDataFrame([("c", "g")], "church_id string, denomination_id string")
    pri = spark.createDataFrame([("g", "worship.style", "contemporary", "n"), ("g", "preaching.style", "topical", "n")], "group_id string, feature string, value string, note string")
    m = matching.evidence_maps(E.best_evidence(ev(spark, [("worship.style", "traditional_hymns", "C", "")])), "church_id", den, pri).first()["ev"]
    assert m["worship.style"]["tier"] == "C" and m["preaching.style"]["tier"] == "prior"


def test_worship_mismatch_lowers_the_fit(spark):
    p = [("worship.style", ["contemporary"], [], "important"), ("preaching.style", ["topical"], [], "dealbreaker"), ("women.preach", ["regularly"], [], "dealbreaker")]
    e = [("worship.style", "traditional_hymns", "C", ""), ("preaching.style", "topical", "A", ""), ("women.preach", "regularly", "A", "")]
    r = score(spark, p, e)
    assert r["score"] >= 58 and r["fit"] == "unlikely"


def test_group_match_equals_scoring_every_group(spark):
    r = random.Random(5)
    feats = [f[0] for f in FEATURES]
    vals = {f[0]: f[2] for f in FEATURES}
    p = spark.createDataFrame([(f"s{i}", f, [r.choice(vals[f])], [], r.choice(["dealbreaker", "important", "nice_to_have"])) for i in range(6) for f in r.sample(feats, 2)],
                              "session_id string, feature string, want array<string>, avoid array<string>, weight string")
    pri = spark.createDataFrame([(f"g{i:02d}", f, r.choice(vals[f]), "n") for i in range(20) for f in r.sample(feats, r.randint(0, 2))], "group_id string, feature string, value string, note string")
    g = spark.createDataFrame([(f"g{i:02d}", f"G{i}", float(i * 997 % 5000), 0.3) for i in range(20)], "group_id string, name string, adherents double, variability double")
    got = {(x["session_id"], x["row_no"]): (x["group_id"], x["score"]) for x in matching.match_groups(p, vocab(spark), pri, g, 8).collect()}
    pairs = p.select("session_id").distinct().join(g.select("group_id", F.col("name").alias("denom_label"), "adherents", "variability"), how="cross").withColumn("denom_conf", F.lit(1.0))
    evm = matching.evidence_maps(pri.select("group_id", "feature", "value", F.lit("prior").alias("tier"), "note", F.lit("k").alias("source_kind")), "group_id")
    full = matching.score_pairs(pairs, matching.profile_arrays(p, vocab(spark)), evm, "session_id", "group_id").withColumn(
        "score", F.round(F.col("score") + matching.size_boost(F.col("adherents")) / 5, 1)).collect()
    for s in {x["session_id"] for x in full}:
        best = sorted((x["excluded"], -x["score"], -x["adherents"], x["group_id"]) for x in full if x["session_id"] == s)[:8]
        assert [got[(s, i + 1)] for i in range(8)] == [(b[3], -b[1]) for b in best]


def test_settled_rules(spark):
    t = datetime(2024, 1, 1)
    rows = [("c", "a", "v", "A", "quote", "u", "stated", t, ""), ("c", "b", "v", "B", "", "https://www.x.org/1", "stated", t, ""), ("c", "b", "v", "B", "", "https://x.org/2", "stated", t, ""),
            ("c", "d", "v", "B", "", "https://x.org/2", "stated", t, ""), ("c", "d", "v", "B", "", "https://y.org/2", "stated", t, ""), ("c", "e", "v", "D", "", "", "observed", t, "4 of 6 sermons"),
            ("c", "f", "v", "D", "", "", "observed", t, "2 of 4 sermons"), ("c", "g", "unknown", "A", "quote", "u", "stated", t, "")]
    d = spark.createDataFrame(rows, "church_id string, feature string, value string, tier string, quote string, url string, how string, checked_at timestamp, note string")
    got = {r["feature"]: r["settled"] for r in E.settled_features(d).collect()}
    assert got == {"a": True, "b": False, "d": True, "e": True, "f": False}


# ---------------------------------------------------------------- log folds
def fold_by_loop(rows):
    states = {}
    for s, i, op, key, vals, stance, *_ in sorted(rows, key=lambda x: x[1]):
        if key in ("location", "for_whom"):
            continue
        if op == "retract" or stance == "neutral":
            states = {k: v for k, v in states.items() if k[:2] != (s, key)}
            continue
        old = states.get((s, key, stance))
        if old and op in ("assert", "confirm"):
            vals = list(dict.fromkeys(old[0] + vals))
        states[(s, key, stance)] = (vals, i)
    return states


def random_log(n=400, seed=7):
    r = random.Random(seed)
    return [(r.choice("xy"), i, r.choices(["assert", "confirm", "revise", "retract"], [5, 3, 2, 1])[0], r.choice(["worship.style", "women.preach", "for_whom"]),
             list(dict.fromkeys(r.choice("abcd") for _ in range(2))), r.choices(["want", "avoid", "neutral"], [6, 3, 1])[0], r.random(), r.random(), r.choice(["stated", "inferred"]), "e") for i in range(n)]


LOG = "session_id string, id long, op string, key string, vals array<string>, stance string, strength double, conf double, src string, ev string"


def test_preference_fold_matches_a_loop_in_any_order(spark):
    rows = random_log()
    for seed in (0, 1):
        shuffled = random.Random(seed).sample(rows, len(rows))
        d = spark.createDataFrame(shuffled, LOG).repartition(3 + seed)
        got = {(x["session_id"], x["key"], x["stance"]): (x["vals"], x["id"]) for x in profiles.preference_states(d).collect()}
        assert got == fold_by_loop(rows)


def test_sensitive_guess_counts_little(spark):
    d = spark.createDataFrame([("s", 1, "assert", "women.preach", ["never"], "want", 0.9, 0.9, "inferred", "e"), ("s", 2, "assert", "worship.style", ["contemporary"], "want", 0.9, 0.4, "stated", "e")], LOG)
    got = {x["feature"]: x["weight"] for x in profiles.profiles(d, vocab(spark)).collect()}
    assert got == {"women.preach": "nice_to_have", "worship.style": "important"}


def test_op_clean_up(spark):
    rows = [("s", 1, "add", "denomination", ["x"], "want", 0.9, 1.0, "stated", "I like Lutheran churches", ""), ("s", 2, "assert", "denomination", ["x"], "avoid", 0.9, 1.0, "stated", "only not Catholic", ""),
            ("s", 3, "assert", "worship.style", ["traditional_hymns"], "want", 0.5, 1.0, "stated", "hymns", ""), ("s", 4, "assert", "location", ["x"], "want", 0.5, 1.0, "stated", "", "")]
    d = spark.createDataFrame(rows, LOG + ", text string")
    got = {r["id"]: (r["op"], r["key"], r["vals"], r["strength"]) for r in profiles.clean_proposed_ops(d).collect()}
    assert got == {1: ("assert", "identity.tradition", ["lutheran"], 0.7), 2: ("assert", "identity.branch", ["catholic"], 0.9), 3: ("assert", "worship.music_sources", ["hymns"], 0.5)}


def test_ladder(spark):
    d = spark.createDataFrame([("s", "d", "both"), ("t", None, None)], "session_id string, rung string, mode string")
    got = {(r["session_id"], r["feature"]): (r["want"], r["weight"]) for r in profiles.ladder_preferences(d).collect()}
    assert got[("s", "women.preach")] == (["regularly", "occasionally"], "important") and got[("s", "women.elder")] == (["no"], "important")
    assert got[("s", "women.deacon")] == (["yes"], "important") and got[("t", "women.elder")] == ([], "dont_care") and len(got) == 12


def test_first_terminal_state_stands(spark):
    d = spark.createDataFrame([(1, 1, "running"), (1, 2, "cancelled"), (1, 3, "complete"), (2, 1, "pending"), (2, 2, "running")], "job_id int, seq int, status string")
    assert {r["job_id"]: r["status"] for r in jobs.job_states(d).collect()} == {1: "cancelled", 2: "running"}


def test_sermon_aggregate(spark):
    rows = [("c", i, g, m, "expository", "mixed", "high", p) for i, (g, m, p) in enumerate([("female", 30.0, 0), ("male", 30.0, 1), ("male", 40.0, 0), ("male", 18.0, 2), ("male", 33.0, 0), ("unknown", 25.0, 0)])]
    d = spark.createDataFrame(rows, "church_id string, seq int, speaker_gender string, minutes double, style string, audience string, scripture_density string, politics_mentions int")
    voc = spark.createDataFrame([("women.preach", ["occasionally", "regularly", "never"]), ("logistics.sermon_length", ["20_35"]), ("preaching.style", ["topical"]), ("preaching.politics_frequency", ["occasional"])],
                                "feature string, values array<string>")
    got = {r["feature"]: (r["value"], r["note"]) for r in sermons.observed_evidence(d, voc).collect()}
    assert got["women.preach"][0] == "occasionally" and got["women.preach"][1].startswith("1 of 5 ")
    assert got["logistics.sermon_length"] == ("20_35", "4 of 6 sermons; median 30 min")
    assert got["preaching.politics_frequency"][0] == "occasional" and "preaching.style" not in got   # value not in the vocabulary


def test_radius_join_equals_all_distances(spark):
    r = random.Random(9)
    pts = [(i, 38 + r.random() * 2, -97 + r.random() * 2) for i in range(80)]
    cs = [(i, 38 + r.random() * 2, -97 + r.random() * 2, r.choice([5.0, 25.0, 50.0])) for i in range(15)]
    p = spark.createDataFrame(pts, "pid int, lat double, lng double")
    c = spark.createDataFrame(cs, "cid int, c_lat double, c_lng double, radius_mi double")
    got = {(x["cid"], x["pid"]) for x in matching.within_radius(p, c, 50.0, 0.3).collect()}
    from tessera.functions import geo
    full = c.join(p, how="cross").filter(geo.miles(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng")) <= F.col("radius_mi"))
    assert got == {(x["cid"], x["pid"]) for x in full.collect()} and got


def test_insisting_on_one_branch_replaces_branch_rows(spark):
    rows = [("m1", "identity.branch", ["catholic"], "assert", "avoid", 0.5, "stated", "e", "It must be Protestant, please"), ("m1", "worship.style", ["contemporary"], "assert", "want", 0.5, "stated", "e", "It must be Protestant, please"),
            ("m2", "identity.branch", ["catholic"], "assert", "want", 0.5, "stated", "e", "Protestant or Catholic")]
    d = spark.createDataFrame(rows, "t string, key string, vals array<string>, op string, stance string, strength double, src string, ev string, text string")
    got = sorted((r["t"], r["key"], r["stance"], len(r["vals"]), r["strength"]) for r in profiles.exclusive_branch_ops(d).collect())
    assert got == [("m1", "identity.branch", "avoid", 3, 0.9), ("m1", "identity.branch", "want", 6, 0.9), ("m1", "worship.style", "want", 1, 0.5), ("m2", "identity.branch", "want", 1, 0.5)]


def test_only_pairs_that_can_be_listed_are_scored_and_once(spark):
    rows = [(1, 1, False, "strong", 90.0, 50.0, False), (1, 2, True, "poor", 10.0, 60.0, True), (1, 3, None, "strong", 80.0, 5.0, False), (1, 4, False, "strong", 85.0, 5.0, True)]
    d = spark.createDataFrame(rows, "session_id long, church_id long, pinned boolean, fit string, score double, distance_miles double, excluded boolean")
    assert sorted(r.church_id for r in matching.listed_pairs(d, 15.0).collect()) == [2, 3, 4]
    t = matching.ranked_table(d, 15.0)
    assert sorted((r.church_id, r.row_no, r.total) for r in t.collect()) == [(2, 1, 2), (3, 2, 2)]
    key = lambda x: sorted(map(str, x.collect()))
    assert key(t) == key(matching.ranked_table(matching.listed_pairs(d, 15.0), 15.0))
    assert all("table_rows" in f for f in t.inputFiles())          # pages and totals read rows that are kept


def test_radius_pairs_of_a_small_file_are_made_by_all_cores(spark, tmp_path):
    rows = [(i, 40.0 + i / 100, -90.0, 20.0) for i in range(200)]
    spark.createDataFrame(rows, "c long, c_lat double, c_lng double, radius_mi double").coalesce(1).write.parquet(str(tmp_path / "c"))
    points = spark.createDataFrame([(i, 40.0 + i / 100, -90.0) for i in range(200)], "p long, lat double, lng double")
    d = matching.within_radius(points, spark.read.parquet(str(tmp_path / "c")), 20.0)
    assert d.count() == sum(abs(i - j) / 100 * 3958.8 * math.pi / 180 <= 20.0 for i in range(200) for j in range(200))
    assert d.select(F.spark_partition_id().alias("n")).distinct().count() > 1


def test_pair_states_stay_one_row(spark):
    """What is read from a pair's states equals what its rows give; a pair without own evidence is open, two sites of one host are one."""
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 7)], "session_id long, church_id long")
    pref = spark.createDataFrame([(1, "a", "A", "dealbreaker"), (1, "b", "B", "important"), (1, "c", "C", "nice_to_have"), (2, "a", "A", "important"), (2, "b", "B", "dealbreaker")],
                                 "session_id long, feature string, label string, weight string")
    ev = spark.createDataFrame([(1, 7, "a", "v", "B", "", "https://x.org/1", "", "stated"), (1, 7, "a", "v", "B", "", "https://www.x.org/2", "", "stated"),
                                (1, 7, "b", "v", "A", "q", "", "", "stated"), (2, 7, "b", "v", "B", "", "https://x.org", "", "stated"), (2, 7, "b", "v", "B", "", "https://y.org", "", "stated"),
                                (2, 7, "a", "v", "D", "", "", "3 of 4 seen", "observed"), (1, 8, "a", "unknown", "A", "q", "", "", "stated")],
                               "session_id long, church_id long, feature string, value string, tier string, quote string, url string, note string, how string")
    own = E.settled_features(ev, ("session_id", "church_id"))
    states = matching.pair_states(pairs, pref, own)
    assert states.count() == 3
    rows = pairs.join(pref, "session_id").join(own, ["session_id", "church_id", "feature"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.select(*x.columns).collect()))
    assert {(r[0], r[1], r[2]) for r in rows.filter("settled").select("session_id", "church_id", "feature").collect()} == {(1, 7, "b"), (2, 7, "b")}
    assert same(matching.open_must_haves_of(states), matching.open_must_haves(pref, rows.select("session_id", "church_id", "feature", "settled")))
    assert same(matching.priorities_settled_of(states), matching.priorities_settled(pref, rows.select("session_id", "church_id", "feature", "settled")))
    asked = matching.visit_questions(rows.filter("not settled").withColumn("is_unknown", F.lit(True)).withColumn("pos", F.col("feature")))
    assert same(matching.visit_questions_of(states), asked.select("session_id", "church_id", "line", "question"))


def test_priors_move_only_what_ranks_them(spark, sf):
    from __spark_entry__ import queries
    plan = queries()["priors_available"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "https://" not in plan and " seen" not in plan
