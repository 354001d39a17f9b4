from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import evidence as E
from tessera.operators import knowledge as K
from tessera.operators import pages, responses, retrieval

T = datetime(2024, 1, 1)


def test_fills_conflicts_and_marks(spark):
    cells = spark.createDataFrame([("g", "a", "Unknown"), ("g", "b", "old"), ("g", "c", "Unknown")], "group_id string, field_id string, value string")
    p = spark.createDataFrame([("g", "a", "fill", "new", T, 1, "q", "u", "official", "high"), ("g", "b", "conflict", "other", T, 2, "q", "u", "official", "high"), ("g", "c", "not_applicable", "Not applicable", T, 3, "q", "", "classification", "medium")],
                              "group_id string, field_id string, action string, new_value string, checked_at timestamp, seq int, quote string, url string, source_type string, confidence string")
    w = K.wide_output(cells, p, ["a", "b", "c"]).first()
    assert (w["a"], w["b"], w["c"]) == ("new", "old", "Not applicable")
    g = spark.createDataFrame([("g", "G")], "group_id string, name string")
    m = {r["field_id"]: (r["value"], r["status"]) for r in K.merged_table(g, cells, p).collect()}
    assert m == {"a": ("new", "model_extracted_needs_review"), "b": ("old", "conflict_needs_review"), "c": ("Not applicable", "not_applicable")}


def test_wide_output_of_ties(spark):
    """A fill and a mark of one time and one text: the first by seq counts, in whatever order the rows come."""
    cells = spark.createDataFrame([("g", "a", "old"), ("g", "b", "old")], "group_id string, field_id string, value string")
    rows = [("g", "a", "fill", "new", T, 1), ("g", "a", "not_applicable", "new", T, 2), ("g", "b", "fill", "new", T, 4), ("g", "b", "not_applicable", "new", T, 3)]
    for order in (rows, rows[::-1]):
        p = spark.createDataFrame(order, "group_id string, field_id string, action string, new_value string, checked_at timestamp, seq int").coalesce(1)
        w = K.wide_output(cells, p, ["a", "b"]).first()
        assert (w["a"], w["b"]) == ("new", "Not applicable")
        w = K.wide_output(cells, p.drop("seq"), ["a", "b"]).first()
        assert (w["a"], w["b"]) == ("new", "new")


def test_apply_rule(spark):
    rows = [("accept", "x.y", "fill", "official", "unsupported", True), ("reject", "x.y", "fill", "official", "supported", False), ("", "practice_culture.abortion", "fill", "official", "supported", False),
            ("", "x.y", "not_applicable", "classification", None, True), ("", "x.y", "fill", "wikidata", None, True), ("", "x.y", "fill", "official", None, True), ("", "x.y", "fill", "official", "partial", False)]
    d = spark.createDataFrame(rows, "human_decision string, field_id string, action string, source_type string, verdict string, want boolean")
    assert all(r["got"] == r["want"] for r in d.withColumn("got", K.is_applied()).collect())


def test_graph_facts(spark):
    body = '{"entities":{"Q1":{"claims":{"P856":[{"mainsnak":{"datavalue":{"value":"https://x.org"}}}],"P571":[{"mainsnak":{"datavalue":{"value":{"time":"+1845-05-08T00:00:00Z"}}}}],"P112":[{"mainsnak":{"datavalue":{"value":{"id":"Q7"}}}},{"mainsnak":{"datavalue":{"value":{"id":"Q8"}}}}]}}}}'
    facts = K.graph_facts(spark.createDataFrame([("g", "Q1", body)], "group_id string, qid string, body string"))
    assert {r["fact"]: r["value"] for r in facts.collect()} == {"official_website": "https://x.org", "founding_year": "1845", "founders": "Q7,Q8"}
    cells = spark.createDataFrame([("g", "history.founding_date", "1845"), ("g", "identity.official_website", "Unknown")], "group_id string, field_id string, value string")
    labels = spark.createDataFrame([("Q7", "Ann"), ("Q8", "Bob")], "id string, label string")
    got = {r["field_id"]: r["new_value"] for r in K.graph_fills(facts, cells, labels).collect()}
    assert got == {"identity.official_website": "https://x.org", "history.founders": "Ann, Bob"}


def test_priors_respect_sensitive_holds_and_variation(spark):
    g = spark.createDataFrame([("g", "G")], "group_id string, name string")
    ev = "evidence array<struct<action:string,human_decision:string>>"
    rows = [("g", "f1", "Infants are baptized", []), ("g", "f2", "Women are permitted to lead", [("fill", "")]), ("g", "f3", "Varies by region, often weekly", []), ("g", "f4", "not applicable: none", [])]
    f = spark.createDataFrame(rows, f"group_id string, field_id string, value string, {ev}")
    feats = spark.createDataFrame([("theology.baptism", "f1", False), ("women.senior_pastor", "f2", True), ("worship.communion_frequency", "f3", False), ("theology.gifts", "f4", False)], "feature string, denom_field string, sensitive boolean")
    got = {r["feature"]: r["value"] for r in E.identity_priors(g, f, feats).collect()}
    assert got == {"theology.baptism": "infant_and_adult", "identity.denomination": "g"}


def test_quotes(spark):
    pages_ = spark.createDataFrame([("u", "We believe in the “plain” teaching of scripture, and in grace for all people.")], "url string, text string")
    q = ['the "plain" teaching of scripture', "the plain teeching of scriptures and in grace", "words that were never said by anyone", "grace", "other page entirely wrong"]
    d = spark.createDataFrame([(("u" if i < 4 else "v"), x) for i, x in enumerate(q)], "url string, quote string")
    got = {r["quote"]: r["quote_ok"] for r in E.verified_quotes(d, pages_, 12, 90.0).collect()}
    assert [got[x] for x in q] == [True, True, False, False, False]
    exact = {r["quote"]: r["quote_ok"] for r in E.verified_quotes(d, pages_).collect()}
    assert not exact[q[1]]


def test_topic_scope(spark):
    voc = spark.createDataFrame([("lgbtq.inclusion", ["full"]), ("lgbtq.marriage", ["traditional", "affirming"])], "feature string, values array<string>")
    text = "Marriage is between one man and one woman. All are welcome to serve and to lead as members here."
    items = [("u", "beliefs", "lgbtq.inclusion", "full", "stated", "between one man and one woman"), ("u", "beliefs", "lgbtq.marriage", "traditional", "stated", "between one man and one woman"),
             ("u", "beliefs", "lgbtq.marriage", "traditional", "stated", "welcome to serve and to lead"), ("u", "beliefs", "lgbtq.inclusion", "full", "stated", "welcome to serve and to lead"), ("u", "beliefs", "lgbtq.inclusion", "odd", "stated", "welcome to serve and to lead")]
    d = spark.createDataFrame(items, "url string, page_kind string, feature string, value string, status string, quote string")
    got = {(r["feature"], r["quote"]) for r in E.page_evidence(d, spark.createDataFrame([("u", text)], "url string, text string"), voc).collect()}
    assert got == {("lgbtq.marriage", "between one man and one woman"), ("lgbtq.inclusion", "welcome to serve and to lead")}


def test_verdict_batches_must_be_complete(spark):
    claims = spark.createDataFrame([("k", 0), ("k", 1), ("m", 0)], "key string, pos long")
    body = [("k", '[{"id": 1, "verdict": "supported"}]'), ("m", '```json\n{"1": "Partial"}\n```')]
    v = responses.normalized_verdicts(spark.createDataFrame(body, "key string, body string"))
    got = {(r["key"], r["pos"]): r["verdict"] for r in responses.attach_verdicts(claims, v, "m1", "v1").collect()}
    assert got == {("k", 0): None, ("k", 1): None, ("m", 0): "partial"}


def test_site_flags(spark):
    p = spark.createDataFrame([("a", "https://a.org/sermons", "sermons"), ("b", "https://b.org/", "home")], "site string, url string, kind string")
    f = spark.createDataFrame([("a", "Worship and service times")], "site string, label string")
    s = spark.createDataFrame([("a", "x")], "site string, name string")
    e = spark.createDataFrame([("a", "community.ministries")], "site string, feature string")
    got = {r["site"]: (r["deep_dive"], r["missing_basics"]) for r in pages.site_coverage(p, f, s, e).collect()}
    assert got["a"] == ("strong", []) and got["b"] == ("weak", ["service times", "public staff names and positions", "active ministries"])


def test_resources_for_a_question(spark):
    r = spark.createDataFrame([("c", "https://a.org/cal", "calendar", "What is on"), ("c", "https://a.org/cal", "home", "twice"), ("c", "https://a.org/staff", "staff", "People"), ("c", "ftp://a", "calendar", "x"), ("c", "https://a.org/b", "x", "y"), ("c", "https://a.org/c", "x", "y")],
                              "church_id string, url string, kind string, label string")
    q = spark.createDataFrame([("c", 1, "Any upcoming concerts?")], "church_id string, question_id int, question string")
    got = [x["url"] for x in retrieval.resource_candidates(r, q).orderBy("rank").collect()]
    assert got[0] == "https://a.org/cal" and len(got) == 3


def test_captions_and_transcript_choice(spark):
    from tessera.operators import corpus
    seg = spark.createDataFrame([("v", 20.0, 5.0, "two [Music]"), ("v", 5.0, 5.0, "one"), ("v", 95.0, 5.0, "late")], "video string, start double, duration double, text string")
    r = corpus.caption_window(seg, F.lit(0.0), 60.0).first()
    assert r["text"] == "one two" and round(r["minutes"], 3) == 1.667
    t = spark.createDataFrame([("e", "text/vtt", "w " * 300, 0), ("e", "text/plain", "too short", 1), ("e", "text/html", "h " * 300, 2)], "episode string, type string, text string, ord int")
    assert corpus.best_transcript(t).first()["type"] == "text/vtt"


def test_knowledge_pipeline(spark):
    from tessera.plans import pipelines
    g = spark.createDataFrame([("g", "Grace Synod", "Grace Synod", 10.0), ("h", "Zen Buddhist Temple", "Zen", 5.0)], "group_id string, census_name string, name string, adherents double")
    specs = K.field_specs(spark.createDataFrame([("theology.baptism_recipients", "theology", "baptism_recipients", "Who is baptized"), ("governance.polity", "governance", "polity", "Form of church government")], "field_id string, layer string, subtopic string, description string"))
    cells = spark.createDataFrame([(x, f, "Unknown") for x in "gh" for f in ("theology.baptism_recipients", "governance.polity")], "group_id string, field_id string, value string")
    docs = spark.createDataFrame([("g", "u1", "Beliefs", "official", "Infants are baptized in this church and so are adults. " * 6), ("g", "u2", "Rule", "wikipedia", "The form of government is by a synod of elders and bishops in council. " * 6)],
                                 "group_id string, url string, title string, source_type string, text string")
    out = pipelines.fill_knowledge(g, cells, specs, docs)
    assert {(r["group_id"], r["field_id"]) for r in out["not_applicable"].collect()} == {("h", "theology.baptism_recipients")}
    top = {r["query_id"]: r["url"] for r in out["hits"].filter("rank = 1").collect()}
    assert top == {"theology.baptism_recipients": "u1", "governance.polity": "u2"}
    assert "[1] (" in out["requests"].first()["text"]


def test_recording_window_and_page_text(spark):
    from tessera.functions import text as X
    from tessera.operators import corpus
    d = spark.createDataFrame([(None,), (100.0,), (1000.0,), (5000.0,)], "d double").select("d", corpus.window_start(F.col("d"), 60.0, 600.0).alias("s"))
    assert {r["d"]: r["s"] for r in d.collect()} == {None: 60.0, 100.0: 0.0, 1000.0: 60.0, 5000.0: 2200.0}
    t = spark.range(1).select(X.merge_page_text(F.lit("Main article body."), F.lit("Hero line\nmain ARTICLE body.\nHero line\nAll rights reserved\nmail me@x.org")).alias("t")).first()["t"]
    assert t == "Hero line\nmail [email redacted]\nMain article body."
    s = spark.createDataFrame([("a", "", "baptist", True), ("b", "sbc", "baptist", None), ("c", "x", "y", False)], "name string, denomination string, tradition string, enabled boolean")
    assert {r["name"]: r["label"] for r in corpus.source_labels(s, "denomination").collect()} == {"a": "baptist", "b": "sbc"}


def test_gap_questions(spark):
    from tessera.operators import matching
    d = spark.createDataFrame([("s", "c", f"f{i}", "Hope", f"Topic {i}", "important", i) for i in range(6)], "session_id string, church_id string, feature string, name string, label string, weight string, pos int")
    got = [r["question"] for r in matching.gap_questions(d).orderBy("line").collect()]
    assert len(got) == 4 and got[0] == "What does Hope say about topic 0?"
