"""URL expressions: keys, policy, link scores, feed and video kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions.columns import in_turn, strip


def part(url: Column, what: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(what)), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host and port, without a leading `www.`."""
    net = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(net, r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def page_key(url: Column) -> Column:
    """Canonical page identity: host, path without end slashes, query."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat_ws("|", host(url), F.when(p == "", F.lit("/")).otherwise(p), query(url))


def absolute(base: Column, href: Column) -> Column:
    """Resolve a link against its page, drop the fragment and end slashes."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    full = in_turn([
        (href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href),
        (href.startswith("//"), F.concat(scheme, F.lit(":"), href)),
        (href.startswith("/"), F.concat(root, href)),
        (href.startswith("?"), F.concat(root, path(base), href)),
        ((href == "") | href.startswith("#"), base),
    ], F.concat(root, folder, href))
    return F.regexp_replace(F.regexp_replace(full, "#.*$", ""), "/+$", "")


def same_site(a: Column, b: Column) -> Column:
    return b.rlike("^(?i)https?://") & (host(a) == host(b))


def is_blocked(url: Column) -> Column:
    """Giving, sign-in, prayer, directory and check-in pages."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)
    return (F.concat(path(url), F.lit("?"), query(url)).rlike(V.PAGE_BLOCK) | h.rlike(V.HOST_BLOCK)
            | F.concat(h, path(url)).rlike(V.HOST_PATH_BLOCK))


def is_public(url: Column) -> Column:
    """A plain http(s) address without credentials whose host is not local or private."""
    net = F.regexp_extract(F.lower(url), r"^https?://([^/?#]*)", 1)
    h = F.regexp_replace(F.regexp_replace(net, r":\d+$", ""), r"\.$", "")
    local = (h.isin("localhost", "localhost.localdomain") | h.rlike(r"\.(localhost|local|internal)$") | h.contains("%"))
    private = h.rlike(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|"
                      r"12[0-7])\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2[4-5]\d\.|\[(::1|::|f[cd]|fe[89ab]))")
    return url.rlike("^(?i)https?://") & (h != "") & ~net.contains("@") & ~local & ~private


def safe_link(url: Column) -> Column:
    """The trimmed link when it is http(s), else an empty string."""
    u = strip(F.coalesce(url, F.lit("")))
    return F.when(F.lower(u).rlike("^https?://"), u).otherwise(F.lit(""))


def link_kind(url: Column, text: Column) -> Column:
    """struct<score, kind>: the strongest kind whose pattern occurs in the link or its text."""
    hay = F.lower(F.concat_ws(" ", url, text))
    best = None
    for kind, pattern, weight in V.LINK_KINDS:
        hit = F.struct(F.lit(weight).alias("score"), F.lit(kind).alias("kind"))
        best = F.when(hay.rlike(pattern), hit) if best is None else best.when(hay.rlike(pattern), hit)
    return best.otherwise(F.struct(F.lit(0).alias("score"), F.lit("other").alias("kind")))


def page_kind(url: Column, from_link: Column) -> Column:
    p = F.lower(path(url))
    return in_turn([(p.rlike(pattern), kind) for kind, pattern, _ in V.LINK_KINDS if kind != "other"], from_link)


def resource_kind(url: Column, label: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", url, label))
    return in_turn([(hay.rlike(p), k) for k, p in V.RESOURCE_KINDS], F.lit(None).cast("string"))


def crawl_score(url: Column, text: Column) -> Column:
    """Two points for each hint in the link text, one for each only in the address."""
    t, hay = F.lower(text), F.lower(F.concat_ws(" ", url, text))
    hints = F.array(*[F.lit(h) for h in V.CRAWL_HINTS])
    return F.aggregate(hints, F.lit(0), lambda a, h: a + F.when(F.contains(t, h), 2).when(F.contains(hay, h), 1).otherwise(0))


def feed_kind(url: Column, text: Column) -> Column:
    hay = F.concat_ws(" ", url, text)
    return in_turn([(hay.rlike(p), k) for k, p in V.FEED_KINDS], F.lit(None).cast("string"))


def video_id(url: Column) -> Column:
    """The 11-character id of a public video address, else null."""
    h = F.lower(part(url, "HOST"))
    p = path(url)
    short = F.regexp_extract(p, r"^/*([^/]*)", 1)
    long_ = F.coalesce(F.nullif(F.regexp_extract(query(url), r"(?:^|&)v=([^&]*)", 1), F.lit("")),
                       F.regexp_extract(p, r"^/(?:embed|live|shorts)/([^/]*)", 1))
    found = F.when(h == "youtu.be", short).when(h.isin(V.VIDEO_HOSTS), long_)
    return F.when(found.rlike(r"^[A-Za-z0-9_-]{11}$"), found)
