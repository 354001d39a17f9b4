import json

import pytest

from pyspark.sql import functions as F

from tessera.operators import corpus, pages
from tessera.sources import readers


def test_posts_from_jsonl_and_csv_without_identities(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    a = [{"id": "1", "side": "seeker", "text": "I am looking for a quiet church @joe99 here", "author": "Joe"},
         {"id": "2", "side": "Church", "tradition": " Baptist ", "source": "blog", "text": "We sing old hymns every Sunday morning"}]
    (tmp_path / "sub" / "a.jsonl").write_text("\n".join(json.dumps(x) for x in a))
    (tmp_path / "b.csv").write_text('side,username,text\nchurch,x,"We sing old hymns, every Sunday morning"\nother,y,nothing to see here at all\nchurch,z,too short\n')
    posts = readers.read_posts(spark, str(tmp_path))
    assert set(posts.columns) == {"id", "text", "side", "tradition", "source", "date", "ord"}
    docs = corpus.clean_posts(posts).collect()
    assert len(docs) == 2                                     # the CSV row repeats the tokens of the second post
    by = {d["side"]: d for d in docs}
    assert by["church"]["source"] == "b.csv" and by["church"]["tradition"] is None   # b.csv sorts before sub/a.jsonl
    assert "[user]" in by["seeker"]["text"] and "joe99" not in by["seeker"]["text"]
    stats = {r["stat"]: r["n"] for r in corpus.ingest_stats(posts).collect()}
    assert (stats["read"], stats["dropped_bad_row"], stats["dropped_short"], stats["dropped_duplicate"]) == (5, 1, 1, 1)


def test_term_list_and_features(spark, tmp_path):
    p = tmp_path / "terms.txt"
    p.write_text("# comment\nAltar Call\n\n hymns \n")
    assert sorted(r["term"] for r in readers.read_terms(spark, str(p)).collect()) == ["altar call", "hymns"]
    y = tmp_path / "f.yaml"
    y.write_text("features:\n  b.x: {label: X, values: [1, two], ask: core, question: 'q?'}\n  a.y: {label: Y, values: [n], ask: core}\n  a.z: {label: Z, values: [n], ask: core, question: 'r?'}\n")
    f = readers.read_features(spark, str(y))
    assert [r["feature"] for r in readers.questions_at(f, "core").collect()] == ["b.x", "a.z"]
    assert f.filter("feature = 'b.x'").first()["values"] == ["1", "two"]


def test_place_pages(spark, tmp_path):
    place = lambda i, name, lat, **k: {"id": i, "displayName": {"text": name}, "formattedAddress": "1 A St, Town, KS", "location": {"latitude": lat, "longitude": -97.0}, **k}
    (tmp_path / "p1.json").write_text(json.dumps({"places": [place("a", "A", 38.2), place("b", "B", 38.1, businessStatus="CLOSED_PERMANENTLY"), place("c", "Old", 38.05)], "nextPageToken": "x"}))
    (tmp_path / "p2.json").write_text(json.dumps({"places": [place("c", "New", 38.05, websiteUri="https://c.org", types=["church"])]}))
    rows = readers.read_places(spark, str(tmp_path), 38.0, -97.0).collect()
    assert [(r["church_id"], r["name"]) for r in rows] == [("c", "New"), ("a", "A")] and rows[0]["distance_miles"] == 3.45


def test_map_elements(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"elements": [
        {"type": "node", "id": 5, "lat": 38.1, "lon": -97.0, "tags": {"name": "N", "denomination": "baptist", "website": "n.org", "addr:city": "Town"}},
        {"type": "way", "id": 6, "center": {"lat": 38.01, "lon": -97.0}, "tags": {"operator": "W"}}]}))
    rows = readers.read_map_elements(spark, str(tmp_path), 38.0, -97.0).collect()
    assert [(r["church_id"], r["name"], r["website"], r["osm_denomination"]) for r in rows] == [("osm:6", "W", None, None), ("osm:5", "N", "https://n.org", "baptist")]


FEED = """<?xml version="1.0"?><rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:podcast="https://podcastindex.org/namespace/1.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<item><title>Old one</title><guid>g1</guid><pubDate>Sun, 07 Jan 2024 10:00:00 GMT</pubDate><enclosure url="https://a.org/1.mp3" type="audio/mpeg" length="123"/><itunes:duration>00:30:05</itunes:duration><dc:creator>Ann</dc:creator></item>
<item><title> New one </title><pubDate>Sun, 14 Jan 2024 23:30:00 -0600</pubDate><enclosure url="https://a.org/2.mp4" type="video/mp4" length="x"/><itunes:author>Bob</itunes:author><podcast:transcript url="https://a.org/2.vtt" type="text/VTT"/><itunes:episodeType>Trailer</itunes:episodeType></item>
<item><title>No date</title><pubDate>soon</pubDate></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    p = tmp_path / "feed.xml"
    p.write_text(FEED)
    e = {r["title"]: r for r in readers.read_feed(spark, str(p)).collect()}
    assert (e["Old one"]["date"], e["Old one"]["duration"], e["Old one"]["length"], e["Old one"]["type"]) == ("2024-01-07", 1805.0, 123, "full")
    assert e["New one"]["guid"] == "https://a.org/2.mp4" and e["New one"]["type"] == "trailer" and e["New one"]["transcripts"][0]["type"] == "text/vtt"
    assert e["No date"]["date"] is None and not e["No date"]["has_media"]
    s = readers.read_sermons(spark, str(p), 2).orderBy("item_no").collect()
    assert [(r["title"], r["speaker"], r["audio_url"], r["video_url"], r["transcript_url"]) for r in s] == [
        ("New one", "Bob", None, "https://a.org/2.mp4", "https://a.org/2.vtt"), ("Old one", "Ann", "https://a.org/1.mp3", None, None)]


def test_transcript_files_and_kb(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHello\nHello\n\n2\n00:00:03,000 --> 00:00:04,000\nworld\n")
    assert readers.read_transcripts(spark, str(tmp_path / "t")).first()["text"] == "Hello world"
    kb = {"groups": [{"id": "g", "census_name": "G", "name": "G", "census_2020": {"adherents": 5}, "processed": True,
                      "fields": {"theology.baptism_recipients": {"value": "Infants", "status": "x", "evidence": [{"action": "fill", "quote": "q"}]}, "a.b": {"value": None, "status": "unknown", "evidence": []}}}]}
    (tmp_path / "kb.json").write_text(json.dumps(kb))
    t = readers.read_kb(spark, str(tmp_path / "kb.json"))
    assert t["groups"].first()["adherents"] == 5.0 and t["fields"].count() == 2 and t["evidence"].first()["quote"] == "q"


def test_logs_sheets_and_stage_tables(spark, tmp_path):
    (tmp_path / "calls.jsonl").write_text('{"task":"t","model":"m","ok":true,"ms":10,"extra":1}\n{"task":"t","model":"m","ok":false,"ms":30}\n')
    from tessera.operators import metrics
    r = metrics.call_stats(readers.read_call_log(spark, str(tmp_path / "calls.jsonl"))).first()
    assert (r["calls"], r["ok_rate"], r["median_ms"]) == (2, 0.5, 20.0)
    d = spark.createDataFrame([("A", "hymns", "y")], "tier string, term string, keep string")
    readers.write_sheet(d, str(tmp_path / "sheet"))
    assert spark.read.csv(str(tmp_path / "sheet"), header=True).first()["keep"] == "y"
    readers.write_stage(spark.range(3).withColumn("p", F.col("id") % 2), str(tmp_path / "st"), "p")
    readers.write_stage(spark.range(1).withColumn("p", F.lit(0).cast("long")), str(tmp_path / "st"), "p")
    assert spark.read.parquet(str(tmp_path / "st")).count() == 2      # only partition 0 was replaced


HTML = """<html><head><title>Our  Church</title><style>x</style></head><body><nav><a href="/skip">Nav</a></nav><h1>Welcome</h1><p>We meet <b>Sundays</b> at 10.</p>
<script>var a = "<p>no</p>";</script><div>Call us<br>today</div><a href="staff/#top">Our Staff</a><a href="mailto:x@y.z">m</a><footer>Copyright</footer></body></html>"""


def test_html_reader(spark):
    d = spark.createDataFrame([("https://a.org/home/x", HTML)], "url string, html string")
    r = pages.read_html(d).first()
    assert r["title"] == "Our Church" and r["text"].split("\n") == ["Welcome", "We meet Sundays at 10.", "Call us", "today", "Our Staff m"]
    assert [(x["href"], x["text"]) for x in r["links"]] == [("/skip", "Nav"), ("staff/#top", "Our Staff")]
    links = {x["url"]: x for x in pages.page_links(pages.read_html(d)).collect()}
    assert links["https://a.org/home/staff"]["score"] == 95 and links["https://a.org/home/staff"]["kind"] == "staff"


@pytest.mark.parametrize("page, text, links", [
    (None, "", []), ("", "", []), ("<p>a<nav>b<form>c</nav>d", "a\nd", []), ("<p>a<aside>b", "a", []), ("a<nav><nav>b</nav>c</nav>d", "a d", []),
    ("x<!-- <nav> -->y<script>'<nav>'</script> z", "xy z", []), ("<a href=\"/q?a=1&amp;b=2\">go <b>on</b>", "go on", [("/q?a=1&b=2", "go on")]),
    ("<nav><a href='/n'>N</a></nav><a>none</a><a href='#x'>top</a>t &lt; u", "none top t < u", [("/n", "N")]),
])
def test_html_reader_on_odd_pages(spark, page, text, links):
    r = pages.read_html(spark.createDataFrame([("u", page)], "url string, html string")).first()
    assert "".join(r["text"].split()) == "".join(text.split()) and [(x["href"], x["text"]) for x in r["links"]] == links


def test_links_of_start_pages_in_order(spark):
    links = spark.createDataFrame([("a", "b", 90), ("a", "c", 100), ("a", "b", 95), ("a", "a", 99), ("b", "d", 80)], "page_key string, url_key string, score int")
    starts = spark.createDataFrame([("s", "a")], "site string, url_key string")
    got = [(r["url_key"], r["level"]) for r in pages.link_order(links, starts).orderBy("visit_no").collect()]
    assert got == [("a", 0), ("c", 1), ("b", 1)]


def test_passages_of_any_length(spark):
    d = spark.createDataFrame([(1, "the quick brown fox jumps high over it"), (2, "thequick brownish"), (3, "")], "doc_id long, t string")
    passages = ["quick brown fox", "the quick brown fox jumps hi", "quick brown", "ck", "rown", "x jumps h", "", "absent words here"]
    q = spark.createDataFrame(list(enumerate(passages)), "item_id int, q string")
    want = {(i, r["doc_id"]) for i, p in enumerate(passages) for r in d.collect() if p and p in r["t"]}
    assert {tuple(r) for r in pages.passages_in(d, q).collect()} == want


def test_repeated_lines_leave_text_in_order(spark):
    d = spark.createDataFrame([(f"https://a.org/{i}", f"Page {i}\nCopyright A\nmore") for i in range(3)] + [("https://b.org/1", "Copyright B\nx")], "url string, text string")
    rep = pages.repeated_lines(d)
    assert [(r["site"], r["line"], r["pages"]) for r in rep.collect()] == [("a.org", "Copyright A", 3)]
    got = {r["url"]: r["scan_text"] for r in pages.without_repeated_lines(d, rep).collect()}
    assert got["https://a.org/1"] == "Page 1\nmore" and got["https://b.org/1"] == "Copyright B\nx"
