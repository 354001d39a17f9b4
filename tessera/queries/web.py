"""Registered queries: stored web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.operators import pages
from tessera.queries.registry import cte, query, table
from tessera.session import stage

HOST = r"regexp_replace(regexp_extract(lower({u}), '^[a-z]+://([^/?#]*)', 1), '^www\.', '')"
PATH = r"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def read(spark, sf):
    return pages.read_html(table(spark, sf, "pages"))


cte("anchors", r"""
SELECT page_id, page_url, href, txt, root, CASE WHEN href LIKE '/%' THEN root || href WHEN regexp_matches(href, '^[a-z]+:') THEN href ELSE root || folder || href END AS raw, pos FROM (
 SELECT page_id, url AS page_url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder,
  unnest(list_transform(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), lambda x: regexp_extract(x, '<a href="([^"]*)">', 1))) AS href,
  unnest(list_transform(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), lambda x: regexp_extract(x, '>([^<]*)<', 1))) AS txt,
  unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS pos FROM pages)
""")
cte("links", r"""
SELECT page_url, regexp_replace(regexp_replace(raw, '#.*$', ''), '/+$', '') AS url, substr(trim(regexp_replace(txt, '\s+', ' ', 'g')), 1, 120) AS text FROM anchors WHERE raw LIKE 'http%'
QUALIFY row_number() OVER (PARTITION BY page_url, regexp_replace(regexp_replace(raw, '#.*$', ''), '/+$', '') ORDER BY pos) = 1
""", "anchors")
KINDS_SQL = " ".join(f"WHEN regexp_matches(lower(url || ' ' || text), '{p}') THEN {w}" for _, p, w in V.LINK_KINDS)


_PLAIN = lambda x: "trim(regexp_replace(replace(replace(replace(regexp_replace(replace(" + x + r", '&copy;', '©'), '&middot;', '·', 'g'), '&quot;', chr(34)), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))"
cte("page_parts", rf"""
SELECT page_id, url, html, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
 string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<title>.*?</title>|<script>.*?</script>|<style>.*?</style>', ' ', 'gs'),
  '<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'gs'), '\s+', ' ', 'g'), '</?({pages.BREAKS})[^>]*>', chr(10), 'g'), chr(10)) AS lines FROM pages""")


@query("page_read", rf"""
SELECT page_id, url, substr({_PLAIN('title')}, 1, 200) AS title,
 length(array_to_string(list_filter(list_transform(lines, lambda x: {_PLAIN("regexp_replace(x, '<[^>]*>', ' ', 'g')")}), lambda x: x <> ''), chr(10)))::BIGINT AS n_chars,
 len(regexp_extract_all(html, '<a href="[^"#][^"]*">'))::BIGINT AS n_links FROM page_parts""", ("page_parts",))
def page_read(spark, sf):
    """Title, size of the visible text and number of links of every stored page."""
    return read(spark, sf).select("page_id", "url", "title", F.length("text").cast("long").alias("n_chars"), F.size("links").cast("long").alias("n_links"))


@query("page_links", f"SELECT page_url, url, text, CASE {KINDS_SQL} ELSE 0 END AS score FROM links", ("links",))
def page_links(spark, sf):
    return pages.page_links(read(spark, sf)).select("page_url", "url", "text", "score")


@query("crawlable_links", rf"""
SELECT page_url, url FROM links WHERE {HOST.format(u='page_url')} = {HOST.format(u='url')} AND {QUERY.format(u='url')} = '' AND NOT regexp_matches(url, '(?i)\.(?:jpg|png|gif|svg|mp3|mp4|zip|css|js)$')
 AND NOT regexp_matches({PATH.format(u='url')}, '/(?:event|events)/.+|/20\d\d/') AND NOT regexp_matches(lower(url || ' ' || text), 'calendar|events|registration|register')
 AND NOT regexp_matches(url, '(?i)(/prayer|prayer[-_]?request|member[-_]?directory|/directory|/members|/login|sign[-_]?in|/giv|/donate|/offering|check[-_]?in)')""", ("links",))
def crawlable_links(spark, sf):
    return pages.crawlable_links(pages.page_links(read(spark, sf))).select("page_url", "url")


_HINTS = "[" + ", ".join(f"'{h}'" for h in V.CRAWL_HINTS) + "]"


@query("hinted_links", f"""
SELECT page_url, url, list_sum([CASE WHEN contains(lower(text), h) THEN 2 WHEN contains(lower(url || ' ' || text), h) THEN 1 ELSE 0 END FOR h IN {_HINTS}])::BIGINT AS hints
FROM links WHERE NOT regexp_matches(url, '{V.CRAWL_SKIP}')""", ("links",))
def hinted_links(spark, sf):
    return pages.hinted_links(pages.page_links(read(spark, sf))).select("page_url", "url", F.col("hints").cast("long").alias("hints"))


@query("url_keys", rf"""
SELECT page_id, {HOST.format(u='url')} || '|' || CASE WHEN regexp_replace({PATH.format(u='url')}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH.format(u='url')}, '/+$', '') END
  || '|' || {QUERY.format(u='url')} AS page_key, {HOST.format(u='url')} AS site, url LIKE 'http%' AS is_public FROM pages""")
def url_keys(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", U.page_key(u).alias("page_key"), U.host(u).alias("site"), U.is_public(u).alias("is_public"))


def _lines(spark, sf):
    """Pages as plain lines: every tag is a line break."""
    t = F.array_join(F.filter(F.transform(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")
    return table(spark, sf, "pages").select("url", t.alias("text"))


cte("line_rows", rf"""
SELECT url, {HOST.format(u='url')} AS site, unnest([trim(s) FOR s IN string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) IF trim(s) <> '']) AS line FROM pages""")
cte("repeated", rf"""
SELECT r.site, r.line, r.pages FROM (SELECT site, line, count(DISTINCT url) AS pages FROM line_rows WHERE regexp_matches(line, '(?i)copy|middot|track|margin') GROUP BY ALL) r
JOIN (SELECT {HOST.format(u='url')} AS site, count(*) AS n FROM pages GROUP BY 1) s USING (site) WHERE n >= 3 AND pages >= greatest(3, n * 0.7)
""", "line_rows")


@query("boilerplate_lines", "SELECT site, line, pages FROM repeated", ("repeated",))
def boilerplate_lines(spark, sf):
    return pages.repeated_lines(_lines(spark, sf), pattern="(?i)copy|middot|track|margin")


@query("pages_without_boilerplate", rf"""
SELECT url, md5(array_to_string([s FOR s IN lines IF d IS NULL OR NOT list_contains(d, s)], chr(10))) AS digest FROM (
 SELECT url, {HOST.format(u='url')} AS site, [trim(s) FOR s IN string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) IF trim(s) <> ''] AS lines FROM pages)
LEFT JOIN (SELECT site, list(line) AS d FROM repeated GROUP BY site) USING (site)""", ("repeated",))
def pages_without_boilerplate(spark, sf):
    p = _lines(spark, sf)
    d = pages.without_repeated_lines(p, pages.repeated_lines(p, pattern="(?i)copy|middot|track|margin"))
    return d.select("url", F.md5("scan_text").alias("digest"))


cte("link_graph", rf"""
SELECT DISTINCT {HOST.format(u='page_url')} AS page_site, page_url, {HOST.format(u='url')} AS site, url, CASE {KINDS_SQL} ELSE 0 END AS score,
 regexp_matches(lower(url || ' ' || text), 'calendar|events|sermon|podcast|messages|/watch|/media|bulletin|newsletter|register|registration') AS collection FROM links
""", "links")


@query("crawl_frontier", rf"""
SELECT site, url_key, level, visit_no FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY level, score DESC, url_key) AS visit_no FROM (
 SELECT site, url_key, 0 AS level, 200 AS score FROM (SELECT {HOST.format(u='url')} AS site, min(url) AS url_key FROM pages GROUP BY 1)
 UNION ALL
 SELECT l.page_site, l.url, 1, max(l.score) FROM link_graph l JOIN (SELECT {HOST.format(u='url')} AS site, min(url) AS url_key FROM pages GROUP BY 1) s ON s.url_key = l.page_url
 WHERE l.url <> s.url_key GROUP BY ALL)) WHERE visit_no <= 30""", ("link_graph",))
def crawl_frontier(spark, sf):
    """Stored links of the first page of each site in visiting order."""
    li = pages.page_links(read(spark, sf)).select(F.col("page_url").alias("page_key"), F.col("url").alias("url_key"), "score")
    starts = table(spark, sf, "pages").groupBy(U.host(F.col("url")).alias("site")).agg(F.min("url").alias("url_key"))
    return pages.link_order(li, starts).select("site", "url_key", F.col("level"), F.col("visit_no").cast("long").alias("visit_no"))


@query("feed_links", rf"""
SELECT DISTINCT {HOST.format(u='url')} AS site, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || f AS url, 'rss' AS kind, TRUE AS is_rss
FROM pages, (VALUES ('/feed'), ('/feed/'), ('/rss'), ('/rss/'), ('/podcast/feed')) v(f)""")
def feed_links(spark, sf):
    return pages.feed_links(read(spark, sf), table(spark, sf, "pages").select(F.col("url").alias("website")).distinct())


@query("page_reuse", """
SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 4 <> 0 THEN 'reuse' ELSE 'extract' END AS route, sha256(html) AS text_hash FROM pages""")
def page_reuse(spark, sf):
    """A page is reused unless its text changed (every third here) or an older extractor read it (every fourth)."""
    p = table(spark, sf, "pages").select("page_id", F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("url"), F.col("html").alias("text"))
    stored = p.select("url", F.sha2(F.when(F.col("page_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("text_hash"),
                      F.when(F.col("page_id") % 4 == 0, "v1").otherwise("v2").alias("version"))
    return pages.reuse_plan(p, stored, "v2").select("page_id", "route", "text_hash")


@query("latest_sources", """
SELECT church_id, url, scope, sha256(text) AS text_hash, turn FROM (SELECT conv_id % 50 AS church_id, 'http://c/' || (turn % 2) AS url, CASE WHEN role = 'user' THEN 'medium' ELSE 'deep' END AS scope, text, conv_id * 1000 + turn AS turn
 FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') QUALIFY row_number() OVER (PARTITION BY church_id, url, scope ORDER BY turn DESC) = 1""")
def latest_sources(spark, sf):
    k = F.col("conv_id") * 1000 + F.col("turn")
    d = table(spark, sf, "conversations").select((F.col("conv_id") % 50).alias("church_id"), F.concat(F.lit("http://c/"), (F.col("turn") % 2).cast("string")).alias("url"),
                                                 F.when(F.col("role") == "user", "medium").when(F.col("role") == "assistant", "deep").otherwise("none").alias("scope"), "text",
                                                 F.timestamp_seconds(k).alias("checked_at"), k.alias("turn"))
    return pages.latest_sources(d).select("church_id", "url", "scope", "text_hash", "turn")


@query("quote_check", """
SELECT b.item_id, count(*) AS n_docs FROM benchmark b JOIN (SELECT trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'' ]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents) d
 ON contains(d.t, trim(regexp_replace(regexp_replace(lower(b.text), '[^a-z0-9'' ]', ' ', 'g'), '\\s+', ' ', 'g'))) GROUP BY b.item_id""")
def quote_check(spark, sf):
    """Benchmark passages standing verbatim in documents: joined on a piece of the passage, then the exact test."""
    d = stage(table(spark, sf, "documents").select("doc_id", X.match_form(F.col("text")).alias("t")), "quote-documents")
    q = table(spark, sf, "benchmark").select("item_id", X.match_form(F.col("text")).alias("q"))
    return pages.passages_in(d, stage(q, "quote-passages")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
