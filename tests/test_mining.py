import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import contexts, corpus, demand, grams, keyness, lexicon, review, senses, shortlist, signals
from tessera.plans import pipelines
from tessera.session import stage


def test_log_odds_direction(spark):
    z = lambda a, b: spark.range(1).select(keyness.log_odds_z(*[F.lit(float(x)) for x in (a, 1000, b, 1000)], F.lit(1.0), 100.0).alias("z")).first()["z"]
    assert z(50, 5) > 2 and z(5, 50) < -2 and abs(z(5, 5)) < 1e-9


def make_docs(spark, rows):
    d = spark.createDataFrame([(str(i), side, trad, src, text, i) for i, (side, trad, src, text) in enumerate(rows)], "id string, side string, tradition string, source string, text string, ord int")
    return corpus.clean_posts(d.withColumn("date", F.lit(None).cast("string")), 0.0, 1)


def test_counts_are_the_same_however_the_data_is_split(spark):
    r = random.Random(4)
    rows = [(r.choice(["seeker", "church"]), r.choice(["x", "y", None]), r.choice("pqr"), " ".join(r.choice("grace hope the altar call choir".split()) for _ in range(12))) for _ in range(80)]
    docs = make_docs(spark, rows)
    key = lambda d: {x["gram"]: tuple(x) for x in d.collect()}
    one = key(grams.gram_counts(grams.source_grams(docs.coalesce(1))))
    many = key(grams.gram_counts(grams.source_grams(docs.repartition(7))))
    assert one == many
    kept = docs.collect()
    toks = [d["toks"] for d in kept]
    for g in ("altar call", "grace", "hope the choir"):
        n = len(g.split())
        hits = [sum(" ".join(t[i:i + n]) == g for i in range(len(t) - n + 1)) for t in toks]
        if sum(hits):
            assert one[g][1] == sum(hits) and one[g][4] == sum(h > 0 for h in hits)


def test_grams_move_once(spark):
    docs = make_docs(spark, [("church", t, s, f"the altar call and number{i} of {s}") for i, (t, s) in enumerate([("x", "a"), ("y", "a"), (None, "b")] * 4)])
    docs = stage(docs, "docs")
    g = grams.source_grams(docs)
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(gram") == 1
    assert grams.gram_counts(g)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(gram") == 1
    t = grams.tradition_counts(g, grams.source_traditions(docs))
    assert t._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(gram") == 1
    few = spark.createDataFrame([("altar call",), ("number1",)], "term string")
    key = lambda d: sorted(map(str, d.collect()))
    assert key(grams.tradition_counts(grams.source_grams(docs, only=few), grams.source_traditions(docs))) == key(t.filter(F.col("gram").isin("altar call", "number1")))


def test_candidates_of_possible_terms_are_those_of_all_counts(spark):
    docs = stage(make_docs(spark, [("church", "x", "ab"[i % 2], f"altar call number{i} altar call once only{i}") for i in range(6)]), "docs")
    seeds = spark.createDataFrame([("number1 altar",), ("Missing Term",)], "term string")
    counts = stage(grams.gram_counts(grams.source_grams(docs)), "counts")
    some = stage(grams.possible_terms(counts, seeds), "counts")
    key = lambda c: sorted(map(str, grams.candidates(docs, seeds, counts=c).collect()))
    assert some.count() < counts.count() and key(some) == key(counts)


def test_a_place_costs_the_same_however_many_terms_share_its_opening(spark):
    docs = stage(make_docs(spark, [("church", "x", "a", f"the word number{i} the word") for i in range(5)]), "docs")
    terms = stage(spark.createDataFrame([(f"the word number{i}",) for i in range(300)] + [("the word",)], "term string"), "terms")
    h = contexts.phrase_hits(docs, terms)
    h.collect()
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "[tok" in plan and "[run" in plan            # the run is looked up by equality, not tried term by term
    assert h.count() == 15 and h.filter("term = 'the word'").count() == 10


def test_sampled_hits_get_the_snippets_of_all_hits(spark):
    docs = stage(make_docs(spark, [("church", t, "a", f"they sang hymns word{i} and more {t}") for i in range(30) for t in ("x", "y")]), "docs")
    h = contexts.phrase_hits(docs, spark.createDataFrame([("hymns",)], "term string"))
    key = lambda d: sorted(map(str, d.collect()))
    assert key(contexts.context_sample(h.drop("text", "around"), 10, 12, docs=docs)) == key(contexts.context_sample(h, 10, 12))


def test_npmi_and_absent_seed(spark):
    docs = make_docs(spark, [("church", "x", "a", f"altar call number{i} altar call") for i in range(6)])
    seeds = spark.createDataFrame([("altar call",), ("Missing Term",)], "term string")
    c = {r["term"]: r for r in grams.candidates(docs, seeds, min_count=5).collect()}
    n1, n2 = 30, 24
    want = math.log((12 / n2) / ((12 / n1) ** 2)) / -math.log(12 / n2)
    assert abs(c["altar call"]["npmi"] - want) < 1e-9 and c["missing term"]["count"] == 0 and c["missing term"]["seed"]


def test_subsumed_and_containment(spark):
    c = spark.createDataFrame([("call", 10), ("altar call", 9), ("call to worship", 8), ("altar", 30)], "term string, count long")
    assert {r["term"]: r["longer"] for r in shortlist.subsumed_terms(c).collect()} == {"call": "altar call"}
    ph = spark.createDataFrame([("loud praise band",), ("praise",), ("organ",)], "phrase string")
    t = spark.createDataFrame([("praise band",)], "term string")
    assert {r["phrase"] for r in demand.covered_phrases(ph, t).collect()} == {"loud praise band", "praise"}


def test_hits_agree_between_small_and_long_term_lists(spark, monkeypatch):
    docs = make_docs(spark, [("church", "x", "a", f"we never hold an altar call here on day{i} but an altar call came") for i in range(5)])
    terms = spark.createDataFrame([("altar call",), ("day1",)], "term string")
    a = sorted(map(str, contexts.phrase_hits(docs, terms).select("term", "id", "pos", "negated", "text").collect()))
    monkeypatch.setattr(contexts, "is_small", lambda d: False)
    b = sorted(map(str, contexts.phrase_hits(docs, terms).select("term", "id", "pos", "negated", "text").collect()))
    assert a == b and len(a) == 11


@pytest.mark.parametrize("small", [True, False])
def test_terms_of_any_length_and_repeated_ids(spark, monkeypatch, small):
    docs = make_docs(spark, [("church", "x", "a", f"they say once saved always saved number{i} and grace") for i in range(3)])
    docs = docs.unionByName(docs.limit(1).withColumn("toks", F.array(*[F.lit(t) for t in "no such words in here".split()])).withColumn("hash", F.lit("other")))
    terms = spark.createDataFrame([("once saved always saved",), ("always saved number1 and grace",), ("saved saved",)], "term string")
    monkeypatch.setattr(contexts, "is_small", lambda d: small)
    h = contexts.phrase_hits(docs, terms)
    assert sorted((r["term"], r["pos"]) for r in h.collect()) == [("always saved number1 and grace", 4)] + [("once saved always saved", 2)] * 3
    assert {r["term"]: r["docs"] for r in contexts.occurrences(h, terms).collect()} == {"once saved always saved": 3, "always saved number1 and grace": 1, "saved saved": 0}


def test_long_phrases_contain_and_are_contained(spark):
    ph = spark.createDataFrame([("a b c d e f",), ("c d e f g",), ("x",)], "phrase string")
    t = spark.createDataFrame([("b c d e",), ("b c d e f g h",)], "term string")
    assert {r["phrase"] for r in demand.covered_phrases(ph, t).collect()} == {"a b c d e f", "c d e f g"}


def test_sample_is_balanced_capped_and_stable(spark):
    docs = make_docs(spark, [("church", t, "a", f"hymns word{i} and more {t}") for i in range(60) for t in (["x"] * (i < 50) + ["y"] * (i < 8))])
    h = contexts.phrase_hits(docs, spark.createDataFrame([("hymns",)], "term string"))
    s = contexts.context_sample(h, 10, 12).collect()
    groups = pd.Series([r["grp"] for r in s]).value_counts()
    assert len(s) == 12 and groups["church:x"] == 6 and groups["church:y"] == 6
    again = contexts.context_sample(contexts.phrase_hits(docs.repartition(9), spark.createDataFrame([("hymns",)], "term string")), 10, 12).collect()
    assert {(r["id"], r["pos"]) for r in s} == {(r["id"], r["pos"]) for r in again}


def test_planted_senses_are_found(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:3] * 5
    rows = [("poly", i, (centres[i % 3] + rng.normal(0, .1, 8)).tolist()) for i in range(30)] + [("thin", i, rng.normal(0, 1, 8).tolist()) for i in range(5)]
    d = spark.createDataFrame(rows, "term string, item int, embedding array<double>")
    got = {r["term"]: r for r in senses.sense_clusters(d).collect()}
    assert got["poly"]["best_k"] == 3 and got["poly"]["polysemy"] > 0.9 and got["thin"]["polysemy"] is None
    cl = {m["item"]: m["cluster"] for m in got["poly"]["members"]}
    assert all((cl[str(i)] == cl[str(j)]) == (i % 3 == j % 3) for i in range(30) for j in range(30))


def test_drift_and_information(spark):
    rows = [("t", "a", [1.0, 0.0])] * 5 + [("t", "b", [0.0, 1.0])] * 5 + [("t", "c", [1.0, 1.0])] * 2
    d = spark.createDataFrame(rows, "term string, grp string, embedding array<double>")
    assert abs(signals.group_drift(d, "term", "grp").first()["drift"] - 1.0) < 1e-6
    m = spark.createDataFrame([("t", x, x) for x in "aabbcc"] + [("u", x, "z") for x in "aabbcc"], "term string, a string, b string")
    got = {r["term"]: r["nmi"] for r in signals.normalized_mutual_information(m, ["term"], "a", "b").collect()}
    assert abs(got["t"] - 1) < 1e-9 and abs(got["u"]) < 1e-9


def test_stance_numbers(spark):
    d = spark.createDataFrame([("t", "g1", s) for s in ["approving", "approving", "critical", "mixed"]] + [("t", "g2", s) for s in ["critical", "critical", "neutral"]] + [("u", "g1", "neutral")], "term string, grp string, stance string")
    r = {x["term"]: x for x in signals.stance(d).collect()}
    assert abs(r["t"]["contestedness"] - 2 * 2.5 / 7) < 1e-9 and abs(r["t"]["tradition_split"] - 0.5) < 1e-9 and r["u"]["contestedness"] is None


def test_review_rules(spark):
    e = spark.createDataFrame([("a", ["contested"], 0.0, 1, 1), ("b", ["polysemous"], 0.4, 1, 2), ("c", ["polysemous"], 0.1, 9, 3), ("d", [], 0.0, 0, 4), ("e", [], 0.0, 0, 5)],
                              "term string, term_types array<string>, drift double, demand int, rank int")
    t = review.assign_tiers(e, tier_b=1, audit=1)
    tiers = {r["term"]: r["tier"] for r in t.collect()}
    assert tiers["a"] == tiers["b"] == "A" and tiers["c"] == "B" and sorted([tiers["d"], tiers["e"]]) == ["C", "audit"]
    v = spark.createDataFrame([("a", "r1", "y", "y", "y", "y"), ("a", "r2", "Yes", "", "y", "y"), ("b", "r1", "y", "y", "y", "y"), ("c", "r1", "n", "y", "y", "y")],
                              "term string, reviewer string, keep string, types_ok string, features_ok string, neutral_ok string")
    out = {r["term"]: r["outcome"] for r in review.review_outcomes(t, v).collect()}
    assert out["a"] == "vetted" and out["b"] == "under_reviewed" and out["c"] == "rejected"


def test_migrated_entries_and_hints(spark):
    f = lambda *p: [{"feature": a, "value": b} for a, b in p]
    e = spark.createDataFrame([("Bible believing", [{"gloss": "g0", "features": f(("belief.scripture_authority", "odd"))}, {"gloss": "g1", "features": f(("belief.scripture_authority", "inerrant"))}]),
                               ("hymns", [{"gloss": "h", "features": f(("worship.style", "traditional_hymns"), ("worship.style", "odd"))}])],
                              "term string, senses array<struct<gloss:string,features:array<struct<feature:string,value:string>>>>")
    v = spark.createDataFrame([("theology.scripture", ["inerrant"]), ("worship.style", ["traditional_hymns"])], "feature string, values array<string>")
    got = {(r["term"], r["gloss"], r["feature"], r["value"]) for r in lexicon.usable_entries(e, v).collect()}
    assert got == {("bible believing", "g1", "theology.scripture", "inerrant"), ("hymns", "h", "worship.style", "traditional_hymns")}
    m = spark.createDataFrame([(1, "We love old hymns and Bible-believing people"), (2, "hymnshop")], "message_id int, text string")
    t = spark.createDataFrame([("hymns", "hymns"), ("bible-believing", "bible-believing"), ("old hymns", "old hymns")], "term string, alias string")
    assert [(r["message_id"], r["term"]) for r in lexicon.hints(m, t).orderBy("rank").collect()] == [(1, "bible-believing"), (1, "old hymns"), (1, "hymns")]
    long = spark.createDataFrame([("x", "one two three four five six")], "term string, alias string")
    m = spark.createDataFrame([(1, "so One two, three four five six."), (2, "say one two three four five six!")], "message_id int, text string")
    assert [r["message_id"] for r in lexicon.hints(m, long).collect()] == [2]


def test_glossary_comes_first_and_general_words_go(spark):
    one = [{"gloss": "g", "features": [{"feature": "worship.style", "value": "contemporary"}]}]
    e = spark.createDataFrame([("Grace", one, None), (" Hymns", one, None), ("drums", one, "not_relevant"), ("drum kit", one, "church_vocabulary"), ("  ", one, None)],
                              "term string, senses array<struct<gloss:string,features:array<struct<feature:string,value:string>>>>, relevance string")
    v = spark.createDataFrame([("worship.style", ["contemporary", "traditional_hymns"])], "feature string, values array<string>")
    got = {(r["term"], r["value"]) for r in lexicon.all_entries(e, v).collect()}
    assert ("hymns", "traditional_hymns") in got and ("hymns", "contemporary") not in got and ("drum kit", "contemporary") in got
    assert not {t for t, _ in got} & {"grace", "drums", ""}


def test_whole_pipeline_on_given_data(spark, sf):
    from tessera.queries import derive as D
    out = pipelines.mine_terms(D.posts(spark, sf), D.seeds(spark, sf), D.reference_freq(spark, sf), D.generic(spark, sf), D.observables(spark, sf), patterns=D.REQUESTS,
                               config={"shortlist": 40, "dims": 32, "max_ref_freq": 1e-3})
    ranked = out["ranked"].orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) >= 40
    assert all(a["score"] >= b["score"] for a, b in zip(ranked, ranked[1:]))
    assert out["contexts"].groupBy("term").count().agg(F.max("count")).first()[0] <= 40
    assert out["requests"].count() == out["drafts"].count()


def test_bm25_matches_a_plain_loop(spark):
    from tessera.operators import retrieval
    r = random.Random(6)
    words = "baptism infant believer creed elder bishop hymn organ".split()
    chunks = [("g", f"u{i}", 0, "t", r.choice(["official", "wikipedia"]), " ".join(r.choice(words) for _ in range(r.randint(5, 15)))) for i in range(30)]
    d = spark.createDataFrame(chunks, "group_id string, url string, chunk_no int, title string, source_type string, text string")
    q = spark.createDataFrame([("g", "q", "infant baptism baptism")], "group_id string, query_id string, query string")
    got = [(x["url"], x["score"]) for x in retrieval.bm25(d, q, 5).orderBy("rank").collect()]
    docs = [c[5].split() + ["t"] for c in chunks]
    avg = sum(map(len, docs)) / len(docs)
    score = []
    for c, t in zip(chunks, docs):
        s = 0.0
        for w in "infant baptism baptism".split():
            df, f = sum(w in x for x in docs), t.count(w)
            s += math.log(1 + (30 - df + .5) / (df + .5)) * f * 2.4 / (f + 1.4 * (.25 + .75 * len(t) / avg))
        score.append((round(s * (1 if c[4] == "official" else .9), 9), c[1]))
    want = sorted([x for x in score if x[0] > 0], key=lambda x: (x[0], x[1]), reverse=True)[:5]
    assert [g[0] for g in got] == [w[1] for w in want] and all(abs(g[1] - w[0]) < 1e-8 for g, w in zip(got, want))


def test_registered_rank_takes_senses_and_drift(spark, sf):
    from __spark_entry__ import queries
    got = queries()["ranked_terms_whole"](spark, sf).collect()
    assert any((r.polysemy or 0) > 0 for r in got) and any((r.drift or 0) > 0 for r in got)
    for r in got:
        want = 0.35 * (r.polysemy or 0) + 0.25 * (r.drift or 0) + 0.25 * (r.contestedness or 0) + 0.15 * r.negation_rate
        assert abs(r.ambiguity_raw - want) < 6e-5
    assert [r.rank for r in sorted(got, key=lambda r: (-r.score, r.term))] == list(range(1, len(got) + 1))


def test_terms_taken_whole_agree_with_terms_spread_over_tasks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"t{t}", i, [float(x) for x in rng.integers(-2, 3, 6)]) for t in range(12) for i in range(3 + 4 * t)]
    rows += [("alike", i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(14)] + [("zero", i, [0.0] * 6) for i in range(13)]
    d = spark.createDataFrame(rows, "term string, item int, embedding array<double>").repartition(5)
    key = lambda x: sorted(map(str, x.select("term", "n", "polysemy", "best_k", "members").collect()))
    whole = senses.sense_clusters(d)
    assert "centres" not in str(whole.inputFiles()) and key(whole) == key(senses.sense_clusters(d, whole=0)) == key(senses.sense_clusters(d, whole=20))


def test_hashed_vectors_are_made_batch_by_batch(spark):
    d = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["x", None]), (5, ["a"])], "i int, t array<string>")
    made = d.select("i", signals.hash_embedding(F.col("t"), 8).alias("v"))
    assert "Arrow" in made._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r["v"] for r in made.collect()}
    assert got[2] == [0.0] * 8 and got[3] == [None] * 8 and got[5] == [0.0, -1.0] + [0.0] * 6 and sum(x * x for x in got[4]) == 1.0
    assert [round(x, 12) for x in got[1]] == [0.0, -0.894427191, 0.0, 0.0, 0.0, 0.0, 0.0, 0.4472135955]
