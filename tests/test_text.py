import re

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.functions import rules as R
from tessera.operators.ordering import ordered_rank, running_before


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_scrub_masks_everything_personal(spark):
    t = "Write bob.x@mail.org or @bobby, see https://x.org/a?b=1 and www.y.org now, call (555) 123-4567."
    got = one(spark, X.scrub(F.lit(t)))
    assert got == "Write [email] or [user] , see [url] and [url] now, call [phone] ."
    assert one(spark, X.scrub(F.lit("a@b.co @joe"), emails=False, handles=False)) == "a@b.co @joe"


def test_contact_scrub_keeps_the_known_contact(spark):
    t = "office@hope.org, me@x.org, 555-123-4567, 1-555-765-4321"
    assert one(spark, X.scrub_contacts(F.lit(t), F.lit("Office@hope.org"))) == "office@hope.org, [email redacted], [phone redacted], [phone redacted]"
    assert "555-123-4567" in one(spark, X.scrub_contacts(F.lit(t), F.lit("(555) 123-4567")))


def test_contact_scrub_query_agrees_with_its_sql_on_numbers_side_by_side(spark, tmp_path):
    texts = ["ab5551234567e5559876543cf", "555-123-4567 555-765-4321 555-111-2222", "555-123-4567\n", "x (555)123-4567", "55512345678", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["contact_scrub"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(oracle_sql()["contact_scrub"]).fetchall())


def test_tokens_keep_hyphens_and_apostrophes(spark):
    assert one(spark, X.tokens(F.lit("Spirit-filled, don’t STOP — now"))) == ["spirit-filled", "don't", "stop", "now"]


def test_sentences_ngrams_negation(spark):
    assert one(spark, X.sentences(F.lit("One. Two!\n\nThree"))) == ["One.", "Two!", "Three"]
    toks = F.array(*[F.lit(x) for x in "not too loud music".split()])
    assert one(spark, X.ngrams(toks, 3)) == ["not too loud", "too loud music"]
    assert one(spark, X.ngrams(toks, 5)) == []
    assert one(spark, X.negated(toks, F.lit(3))) and not one(spark, X.negated(toks, F.lit(0)))
    assert one(spark, X.negated(F.array(*[F.lit(x) for x in ["no", "a", "b", "c", "d"]]), F.lit(4))) is False


def test_term_counts_count(spark):
    xs = "b a b c a b".split()
    got = {r["gram"]: r["tf"] for r in one(spark, X.term_counts(F.array(*[F.lit(x) for x in xs])))}
    assert got == {"a": 2, "b": 3, "c": 1}


def test_content_rule(spark):
    ok = ["altar call", "hymns"]
    no = ["the call", "call of", "2020", "12 34", "ab", "of"]
    for g in ok:
        assert one(spark, X.is_content(F.lit(g)))
    for g in no:
        assert not one(spark, X.is_content(F.lit(g)))


def test_requests_and_wishes(spark):
    t = "Hi all. I am looking for a church with hymns. Not loud music please. Bye."
    assert one(spark, X.request_chunks(F.lit(t))) == ["I am looking for a church with hymns. Not loud music please."]
    got = [(a["phrase"], a["polarity"]) for a in one(spark, X.wanted_phrases(F.lit("not loud music but organ")))]
    assert got == [("loud music", "avoid"), ("loud", "avoid"), ("music", "avoid"), ("organ", "want")]
    assert one(spark, X.trim_stopwords(F.lit("with the loud music of"))) == "loud music"
    assert one(spark, X.trim_stopwords(F.lit("of the"))) == ""


def test_small_parsers(spark):
    assert one(spark, X.duration_seconds(F.lit("01:02:03"))) == 3723.0
    assert one(spark, X.duration_seconds(F.lit("90"))) == 90.0
    assert one(spark, X.duration_seconds(F.lit("soon"))) is None
    assert one(spark, X.slug(F.lit(" Hello, World! "))) == "hello-world"
    assert one(spark, R.clean_group_name(F.lit("Faith Assembly, Inc., International"))) == "Faith Assembly"
    assert one(spark, R.city_of(F.lit("1 Main St, Hesston, KS"))) == "Hesston"
    assert one(spark, R.clean_origin(F.lit("Hesston, KS, within 15 miles"))) == "Hesston, KS"
    assert one(spark, R.data_points(F.lit("3 of 12 sermons"))) == 12
    assert one(spark, R.needs_care(F.lit("I don't want to live"))) is True


def packs_by_loop(text, target):
    text = re.sub(r"\s+", " ", text).strip()
    out, cur, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+(?=[\"'A-Z0-9])", text):
        w = s.split()
        if len(w) > 2 * target:
            for i in range(0, len(w), target):
                if cur:
                    out.append(" ".join(cur))
                    cur, n = [], 0
                out.append(" ".join(w[i:i + target]))
            continue
        cur.append(s)
        n += len(w)
        if n >= target:
            out.append(" ".join(cur))
            cur, n = [], 0
    if cur and n >= target // 3:
        out.append(" ".join(cur))
    return out


def test_sentence_packs_match_a_plain_loop(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", X.sentence_packs(F.col("text"), 40).alias("p")).collect()
    # texts without labels or time stamps, which the loop leaves alone
    plain = [r for r in rows if not re.search(r"\d:\d\d|SPEAKER|Speaker", r["text"])]
    assert len(plain) > 100
    for r in plain:
        assert r["p"] == packs_by_loop(r["text"], 40)


def test_transcripts(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<v A>Hello there\nHello there\n\n2\n00:00:03.000 --> 00:00:04.000\nAgain"
    assert one(spark, X.transcript_text(F.lit(vtt), F.lit("vtt"))) == "Hello there Again"
    assert one(spark, X.transcript_text(F.lit('{"segments":[{"body":" a "},{"text":"b"}]}'), F.lit("json"))) == "a b"
    assert one(spark, X.transcript_text(F.lit("<p>x &amp; y</p><script>z</script>"), F.lit("html"))) == "x & y"


def test_urls(spark):
    assert one(spark, U.page_key(F.lit("https://www.A.org/b/?q=1#t"))) == "a.org|/b|q=1"
    assert one(spark, U.absolute(F.lit("https://a.org/b/c"), F.lit("d#e"))) == "https://a.org/b/d"
    for bad in ("http://localhost/x", "http://10.1.2.3/", "ftp://a.org", "http://u:p@a.org/"):
        assert not one(spark, U.is_public(F.lit(bad))), bad
    assert one(spark, U.is_public(F.lit("https://a.org/x")))
    assert one(spark, U.is_blocked(F.lit("https://a.org/give"))) and one(spark, U.is_blocked(F.lit("https://tithe.ly/x")))
    assert one(spark, U.video_id(F.lit("https://www.youtube.com/watch?v=abcdefghijk&t=1"))) == "abcdefghijk"
    assert one(spark, U.video_id(F.lit("https://evil.org/watch?v=abcdefghijk"))) is None
    assert one(spark, U.feed_kind(F.lit("https://a.org/feed"), F.lit(""))) == "rss"
    assert one(spark, U.safe_link(F.lit("javascript:x"))) == ""
    assert one(spark, U.resource_kind(F.lit("https://a.org/small-groups"), F.lit("x"))) == "groups"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30)), min_size=1, max_size=40))
def test_blocked_ranks_equal_plain_ranks(spark, pairs):
    rows = [(g, v, i) for i, (g, v) in enumerate(pairs)]
    d = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r["i"]: (r["rn"], r["before"]) for r in running_before(
        ordered_rank(d, ["g"], [F.col("v"), F.col("i")], F.floor(F.col("v") / 7)), ["g"], [F.col("v"), F.col("i")], F.floor(F.col("v") / 7), F.col("v"), "before").collect()}
    for g in "ab":
        mine, total = sorted((v, i) for gg, v, i in rows if gg == g), 0
        for k, (v, i) in enumerate(mine, 1):
            assert got[i] == (k, total)
            total += v
