"""Web pages as data: text and links of stored HTML, link graph, repeated lines, crawl order."""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.functions.columns import in_turn, strip
from tessera.operators.ordering import first_per_group, ordered_rank, top_per_group

# Elements without readable text, page furniture, and elements that break lines.
HIDDEN = "script|style|noscript|svg|form|iframe|template"
FURNITURE = "nav|header|footer|aside"
BREAKS = "p|div|section|article|li|br|h1|h2|h3|h4|h5|h6|tr|td|ul|ol|table"

_COMMENT = re.compile(r"(?s)<!--.*?(?:-->|\Z)")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\Z)")
_ANCHOR = re.compile(r"""(?is)<a\b([^>]*)>(.*?)(?=</a\b|<a\b|\Z)""")
_HREF = re.compile(r"""(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_BREAK, _TAG = re.compile(rf"(?i)</?(?:{BREAKS})\b[^>]*>"), re.compile(r"<[!/?a-zA-Z][^>]*(?:>|\Z)")
_SPACE = re.compile(r"\s+")


def _without(page: str, names: str) -> str:
    """The page without whole regions, innermost first; one that nobody closes ends with what holds it, or the page."""
    inside = rf"(?is)<({names})\b[^>]*>(?:(?!<(?:{names})\b).)*?"
    closed, left_open = re.compile(inside + r"</\1\s*>"), re.compile(inside + rf"(?=</(?:{FURNITURE})\s*>|\Z)")
    cuts = 1
    while cuts:
        page, cuts = closed.subn(" ", page)
        if not cuts:
            page, cuts = left_open.subn(" ", page)
    return page


def _plain(piece: str) -> str:
    return _SPACE.sub(" ", html_lib.unescape(_TAG.sub("", piece))).strip()


def _read(page: str):
    """Title, visible text and links. Regions go first, so what is left has no nesting to follow."""
    page = _without(_COMMENT.sub("", page or ""), HIDDEN)
    title = _TITLE.search(page)
    page = _TITLE.sub(" ", page)
    links = []
    for attributes, label in _ANCHOR.findall(page):
        target = _HREF.search(attributes)
        href = html_lib.unescape(target[1] or target[2] or target[3] or "").strip() if target else ""
        if href and not href.lower().startswith(("#", "javascript:", "mailto:", "tel:")):
            links.append({"href": href, "text": _plain(label)[:120]})
    text = _BREAK.sub("\n", _SPACE.sub(" ", _without(page, FURNITURE)))
    lines = (_plain(_TAG.sub(" ", x)) for x in text.split("\n"))
    return _plain(title[1])[:200] if title else "", "\n".join(x for x in lines if x), links


def read_html(pages: DataFrame) -> DataFrame:
    """Parse stored HTML in Arrow batches: adds title, text (navigation, header, footer, scripts dropped) and links.

    Whole pages go in and out; rows are independent, so the job scales with partitions.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html")
    schema += ", title string, text string, links array<struct<href:string,text:string>>"

    def work(batches):
        for pdf in batches:
            parsed = [_read(h) for h in pdf["html"]]
            out = pdf.drop(columns=["html"])
            yield out.assign(title=[p[0] for p in parsed], text=[p[1] for p in parsed], links=[p[2] for p in parsed])
    return pages.mapInPandas(work, schema)


def page_links(read: DataFrame) -> DataFrame:
    """(page_url, url, text, score, kind, resource, blocked, public): every distinct absolute link of a page with its class."""
    d = read.select(F.col("url").alias("page_url"), F.posexplode("links").alias("pos", "l"))
    d = d.select("page_url", "pos", U.absolute(F.col("page_url"), F.col("l.href")).alias("url"), F.col("l.text").alias("text"))
    d = first_per_group(d.filter(F.col("url").rlike("^https?://")), ["page_url", "url"], [F.col("pos")]).drop("pos")
    k = U.link_kind(F.col("url"), F.col("text"))
    return d.select("page_url", "url", "text", k["score"].alias("score"), U.page_kind(F.col("url"), k["kind"]).alias("kind"),
                    U.resource_kind(F.col("url"), F.col("text")).alias("resource"),
                    (U.is_blocked(F.col("url")) | F.col("url").rlike(V.LINK_BLOCK)).alias("blocked"), U.is_public(F.col("url")).alias("public"))


def crawlable_links(links: DataFrame) -> DataFrame:
    """Same-site page links worth following: no blocked, asset, query or dated addresses, no calendars or registrations."""
    p = U.path(F.col("url"))
    return links.filter(~F.col("blocked") & U.same_site(F.col("page_url"), F.col("url")) & ~F.col("url").rlike(V.ASSET_LINK)
                        & (U.query(F.col("url")) == "") & ~p.rlike(V.DATED_LINK)
                        & ~F.coalesce(F.col("resource").isin("calendar", "registration"), F.lit(False)))


def hinted_links(links: DataFrame) -> DataFrame:
    """Links that a crawl for statements would follow, with the score of the hints in their text and address."""
    return links.filter(~F.col("url").rlike(V.CRAWL_SKIP)).withColumn("hints", U.crawl_score(F.col("url"), F.col("text")))


def resources(links: DataFrame) -> DataFrame:
    """Public collections linked from a page, once per address."""
    d = links.filter(F.col("resource").isNotNull() & ~F.col("blocked"))
    return first_per_group(d.select("url", F.col("resource").alias("kind"), F.coalesce(F.nullif("text", F.lit("")), F.col("resource")).alias("label")),
                           ["url"], [F.col("kind"), F.col("label")])


def link_order(links: DataFrame, starts: DataFrame, max_pages: int = 30) -> DataFrame:
    """(site, url_key, level, score, visit_no): the start page of each site, then the pages it links to, best link first.

    The order in which stored links of a site should be visited; a site keeps `max_pages` (a setting of the crawl).
    `links`: (page_key, url_key, score); `starts`: (site, url_key).
    """
    first = starts.select("site", "url_key", F.lit(0).alias("level"), F.lit(200).alias("score"))
    on_start = (starts.select("site", F.col("url_key").alias("page_key")).join(links, "page_key").filter("url_key <> page_key")
                .groupBy("site", "url_key").agg(F.lit(1).alias("level"), F.max("score").alias("score")))
    return top_per_group(first.unionByName(on_start), ["site"], [F.col("level"), F.desc("score"), F.col("url_key")], max_pages, "visit_no")


def passages_in(docs: DataFrame, passages: DataFrame, most_words: int = 5) -> DataFrame:
    """(item_id, doc_id): passages (item_id, q) that stand in documents (doc_id, t), both in match form, word borders or not.

    The first and last word of a passage may be cut off longer ones, those between stand whole: up to `most_words`
    of them are the join key, fewer for shorter passages. A passage without whole words is keyed by its first
    letters, up to three. Every key is a necessary condition; `contains` is the last test. An empty passage stands nowhere.
    """
    words, inside = F.col("_w"), F.greatest(F.size(F.split("q", " ")) - 2, F.lit(0))
    p = (passages.filter("q <> ''").withColumn("n", F.least(inside, F.lit(most_words)))
         .withColumn("key", F.when(F.col("n") > 0, F.array_join(F.slice(F.split("q", " "), F.lit(2), F.greatest("n", F.lit(1))), " ")).otherwise(F.substring("q", 1, 3)))
         .withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(-F.length("key"))))
    lengths = [r["n"] for r in p.select("n").distinct().collect()]          # eight values at most

    def letters(k):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1))), lambda i: F.substr(F.col("t"), i, F.lit(k)))
    split = docs.withColumn("_w", F.split("t", " "))
    keys = [split.select("doc_id", F.lit(n).alias("n"), F.explode(F.array_distinct(X.ngrams(words, n) if n > 0 else letters(-n))).alias("key")) for n in lengths]
    if not keys:
        return p.select("item_id", F.lit(None).cast("long").alias("doc_id"))
    some = keys[0]
    for k in keys[1:]:
        some = some.unionByName(k)
    pairs = some.join(p, ["n", "key"]).select("item_id", "q", "doc_id")
    return pairs.join(docs, "doc_id").filter(F.contains("t", F.col("q"))).select("item_id", "doc_id")


def page_lines(read: DataFrame) -> DataFrame:
    return read.select("url", U.host(F.col("url")).alias("site"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn(
        "line", strip(F.col("raw"))).filter("line <> ''")


def repeated_lines(read: DataFrame, share: float = 0.7, least: int = 3, pattern: str = V.BOILERPLATE) -> DataFrame:
    """(site, line, pages): boilerplate-worded lines that stand on most pages of a site with three pages or more."""
    lines = page_lines(read).filter(F.col("line").rlike(pattern))
    n = read.select(U.host(F.col("url")).alias("site")).groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))
    used = lines.groupBy("site", "line", "url").agg(F.count(F.lit(1)).alias("_")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages"))
    return used.join(n, "site").filter((F.col("site_pages") >= 3) & (F.col("pages") >= F.greatest(F.lit(least), F.col("site_pages") * share))).select(
        "site", "line", "pages")


def without_repeated_lines(read: DataFrame, repeated: DataFrame) -> DataFrame:
    """(url, scan_text): page text with the repeated lines of its site left out, order kept.

    The few repeated lines of a site meet the page as one array; pages are not taken apart and regrouped.
    """
    per_site = repeated.groupBy("site").agg(F.collect_set("line").alias("_drop"))
    d = read.withColumn("site", U.host(F.col("url"))).join(per_site, "site", "left")
    kept = F.filter(F.split("text", "\n"), lambda s: ~F.coalesce(F.array_contains("_drop", strip(s)), F.lit(False)))
    return d.select("url", F.array_join(kept, "\n").alias("scan_text"))


def feed_links(read: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site, url, kind): feed addresses linked from pages, plus common root feed paths of each website; rss first."""
    d = read.select(F.col("url").alias("page_url"), F.inline("links"))
    d = d.select(U.host(F.col("page_url")).alias("site"), U.absolute(F.col("page_url"), F.col("href")).alias("url"), F.col("text"))
    d = d.withColumn("kind", U.feed_kind(F.col("url"), F.col("text"))).filter("kind is not null").select("site", "url", "kind", F.lit(0).alias("_g"))
    if sites is not None:
        root = F.regexp_extract("website", r"^([a-z][a-z0-9+.-]*://[^/?#]+)", 1)
        guess = sites.select(U.host(F.col("website")).alias("site"), F.explode(F.transform(
            F.array(*[F.lit(p) for p in V.ROOT_FEED_PATHS]), lambda p: F.concat(root, p))).alias("url"), F.lit("rss").alias("kind"), F.lit(1).alias("_g"))
        d = d.unionByName(guess)
    d = first_per_group(d, ["site", "url"], [F.col("_g"), F.col("kind")]).drop("_g")
    return d.withColumn("is_rss", F.col("kind") == "rss")


def reuse_plan(pages: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """Route of each fetched page: `reuse` when address, text and extractor version are unchanged, else `extract`."""
    s = stored.select("url", F.col("text_hash").alias("_h"), F.col("version").alias("_v"))
    d = pages.withColumn("text_hash", F.sha2("text", 256)).join(s, "url", "left")
    same = (F.col("text_hash") == F.col("_h")) & (F.col("_v") == version)
    return d.withColumn("route", F.when(F.coalesce(same, F.lit(False)), "reuse").otherwise("extract")).drop("_h", "_v", "text")


def latest_sources(rows: DataFrame) -> DataFrame:
    """Saved public text: newest row per (church_id, url, scope). Blank texts and unknown scopes are ignored."""
    d = rows.filter(F.col("scope").isin("medium", "deep") & (F.coalesce("url", F.lit("")) != "") & (strip(F.coalesce("text", F.lit(""))) != ""))
    d = d.withColumn("text_hash", F.sha2("text", 256))
    return first_per_group(d, ["church_id", "url", "scope"], [-F.unix_micros(F.col("checked_at")), F.col("text_hash")])


def site_coverage(pages: DataFrame, facts: DataFrame, staff: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per site: pages read, deep-dive rating and which basics are missing."""
    p = pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages_scanned"),
        F.bool_or((F.col("kind") == "sermons") | F.lower("url").contains("sermon")).alias("_sermons"),
        F.bool_or((F.col("kind") == "beliefs") | F.lower("url").contains("belief")).alias("_beliefs"))
    lab = F.lower("label")
    f = facts.groupBy("site").agg(F.bool_or(lab.rlike("service|worship.*time")).alias("_times"), F.bool_or(lab.contains("ministr")).alias("_min"))
    s = staff.groupBy("site").agg(F.lit(True).alias("_staff"))
    e = evidence.groupBy("site").agg(F.bool_or(F.col("feature") == "logistics.service_times").alias("_etimes"),
                                     F.bool_or(F.col("feature").isin("community.ministries", "community.small_groups")).alias("_emin"))
    d = p.join(f, "site", "left").join(s, "site", "left").join(e, "site", "left")
    yes = lambda *cs: F.coalesce(*[F.when(F.col(c), F.lit(True)) for c in cs], F.lit(False))
    missing = F.array_compact(F.array(F.when(~yes("_times", "_etimes"), "service times"), F.when(~yes("_staff"), "public staff names and positions"),
                                      F.when(~yes("_min", "_emin"), "active ministries")))
    rating = in_turn([(F.col("_sermons"), "strong"), (~F.col("_beliefs"), "weak")], "possible")
    return d.select("site", "pages_scanned", rating.alias("deep_dive"), missing.alias("missing_basics"))
