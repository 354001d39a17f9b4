"""Registered queries: evidence, matching, profiles from logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import rules as R
from tessera.functions import urls as U
from tessera.functions.columns import rounded
from tessera.operators import evidence as E
from tessera.operators import jobs, matching, metrics, profiles, sermons
from tessera.queries import facts as T
from tessera.queries.registry import body, cte, query, table

joined = lambda c, sep=",": F.array_join(c, sep)
RANKED = ("church_id", "feature", "tier", "checked_at", "row_id")      # what the best evidence is found by; whole rows are moved only where they are wanted

cte("best", """
SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY church_id, feature ORDER BY
  CASE tier WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'D' THEN 3 WHEN 'C' THEN 2 ELSE 1 END DESC, checked_at DESC, row_id) = 1
""", "evidence")
cte("settled", """
SELECT church_id, feature, coalesce(bool_or(tier = 'A' AND quote <> ''), FALSE) OR count(DISTINCT regexp_extract(url, '//(?:www\\.)?([^/]+)', 1)) FILTER (tier = 'B') >= 2
   OR coalesce(bool_or(tier = 'D' AND how = 'observed' AND points >= 5), FALSE) AS settled
FROM evidence WHERE value <> 'unknown' GROUP BY ALL
""", "evidence")


@query("best_evidence", """
SELECT church_id, feature, value, tier, quote, url, note, strftime(checked_at, '%Y-%m-%d') AS checked_on FROM best""", ("best",))
def best_evidence(spark, sf):
    return E.best_evidence(T.evidence(spark, sf)).select("church_id", "feature", "value", "tier", "quote", "url", "note",
                                                        F.date_format("checked_at", "yyyy-MM-dd").alias("checked_on"))


@query("settled_open", """
SELECT w.church_id, w.feature, coalesce(s.settled, FALSE) AS settled FROM
 (SELECT DISTINCT c.church_id, p.feature FROM candidates_met c JOIN preferences p USING (session_id)) w LEFT JOIN settled s USING (church_id, feature)""",
       ("settled", "candidates_met", "preferences"))
def settled_open(spark, sf):
    c = T.candidates(spark, sf).select("session_id", "church_id")
    wanted = c.join(T.preferences(spark, sf).select("session_id", "feature"), "session_id").select("church_id", "feature").distinct()
    return E.settled_open(wanted, E.settled_features(T.evidence(spark, sf)))


@query("stated_vs_observed", """
SELECT church_id, feature, max(value) FILTER (how = 'stated') AS stated, max(value) FILTER (how = 'observed') AS observed,
  max(value) FILTER (how = 'stated') = max(value) FILTER (how = 'observed') AS agrees
FROM (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY church_id, feature, how ORDER BY checked_at DESC, row_id) = 1)
GROUP BY church_id, feature HAVING count(DISTINCT how) = 2""", ("evidence",))
def stated_vs_observed(spark, sf):
    return E.stated_vs_observed(T.evidence(spark, sf))


cte("value_checked", """
SELECT e.*, f.feature IS NOT NULL AND CASE WHEN f.free_form THEN e.value <> '' AND e.value <> 'schedule' AND length(e.value) <= 300
   ELSE list_contains(f."values", e.value) OR e.value IN ('unstated', 'unknown') END AS value_ok, f.feature IS NOT NULL AS known
FROM evidence e LEFT JOIN features f USING (feature)
""", "evidence", "features")


@query("evidence_validation", """
SELECT feature, tier, coalesce(error, 'accepted') AS outcome, count(*) AS n FROM (
 SELECT feature, tier, CASE WHEN NOT known THEN 'unknown feature' WHEN NOT value_ok THEN 'invalid value' WHEN tier IN ('D', 'prior') THEN 'tier cannot be recorded'
   WHEN url = '' THEN 'url required' WHEN quote = '' AND value NOT IN ('unstated', 'unknown') THEN 'quote required' END AS error FROM value_checked) GROUP BY ALL""",
       ("value_checked",))
def evidence_validation(spark, sf):
    d = E.submitted_evidence(T.evidence(spark, sf), T.features(spark, sf))
    return d.groupBy("feature", "tier", F.coalesce("error", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


cte("page_ranked", """
SELECT *, CASE l WHEN 1 THEN 'beliefs' WHEN 2 THEN 'staff' WHEN 3 THEN 'about' WHEN 4 THEN 'home' ELSE 'other' END AS page_kind,
  length(trim(quote)) - CASE WHEN upper(trim(quote)) = trim(quote) AND lower(trim(quote)) <> trim(quote) THEN 60 ELSE 0 END AS quality
FROM (SELECT *, split_part(note, ' ', 1)::INT AS l FROM evidence)
""", "evidence")


@query("better_page_evidence", """
SELECT church_id, feature, value, page_kind, quote FROM page_ranked QUALIFY row_number() OVER (PARTITION BY church_id, feature ORDER BY
  CASE page_kind WHEN 'beliefs' THEN 0 WHEN 'staff' THEN 1 WHEN 'about' THEN 2 WHEN 'home' THEN 3 ELSE 7 END, quality DESC, row_id) = 1""", ("page_ranked",))
def better_page_evidence(spark, sf):
    l = F.substring_index("note", " ", 1).cast("int")
    kind = F.when(l == 1, "beliefs").when(l == 2, "staff").when(l == 3, "about").when(l == 4, "home").otherwise("other")
    return E.better_page_evidence(T.evidence(spark, sf).withColumn("page_kind", kind)).select("church_id", "feature", "value", "page_kind", "quote")


# ---------------------------------------------------------------- scoring
cte("rated", """
SELECT c.session_id, c.church_id, p.feature, p.weight, p.w, p.want, p.avoid, b.value, b.tier, c.denom_conf,
  CASE WHEN b.value IS NULL OR trim(b.value) IN ('unknown', 'unstated', 'not_found', '') THEN 0
   WHEN f.free_form THEN CASE WHEN len([a FOR a IN p.avoid IF contains(b.value, a)]) > 0 THEN -1 WHEN len(p.want) > 0 THEN CASE WHEN len([a FOR a IN p.want IF contains(b.value, a)]) > 0 THEN 1 ELSE -1 END ELSE 0 END
   WHEN list_has_any([trim(x) FOR x IN string_split(b.value, ';')], p.avoid) THEN -1
   WHEN len(p.want) > 0 THEN CASE WHEN list_has_any([trim(x) FOR x IN string_split(b.value, ';')], p.want) THEN 1 ELSE -1 END
   WHEN len(p.avoid) > 0 THEN 1 ELSE 0 END AS m,
  CASE WHEN b.value IS NOT NULL AND trim(b.value) <> 'unknown' AND len(p.want) > 0 AND NOT list_has_any([trim(x) FOR x IN string_split(b.value, ';')], p.want) THEN TRUE ELSE FALSE END AS off_want,
  CASE b.tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 WHEN 'C' THEN 0.5 ELSE CASE WHEN b.points >= 5 THEN 0.6 ELSE 0.4 END END AS s,
  p.feature IN ('identity.denomination', 'identity.tradition', 'identity.branch') AS identity
FROM candidates_met c JOIN preferences p USING (session_id) JOIN features f ON f.feature = p.feature LEFT JOIN best b ON b.church_id = c.church_id AND b.feature = p.feature
WHERE p.w > 0 AND p.feature <> 'logistics.distance'
""", "candidates_met", "preferences", "features", "best")
cte("pair_sums", """
SELECT session_id, church_id, sum(w) FILTER (NOT skip) AS w, sum(w) FILTER (NOT skip AND m <> 0) AS k,
  sum(CASE WHEN m = 0 THEN CASE WHEN weight = 'dealbreaker' THEN -0.1 * w ELSE 0 END ELSE w * s * m END) FILTER (NOT skip) AS c,
  bool_or(identity AND len(avoid) > 0 AND m < 0) AS ban, bool_or(identity AND len(want) > 0 AND weight = 'dealbreaker' AND off_want) AS firm,
  bool_or(feature IN ('worship.style', 'worship.liturgy') AND len(want) > 0 AND weight IN ('important', 'dealbreaker') AND m < 0) AS worship,
  string_agg(feature, ',' ORDER BY feature) FILTER (NOT skip AND m > 0) AS matched, string_agg(feature, ',' ORDER BY feature) FILTER (NOT skip AND m < 0) AS unmatched,
  string_agg(feature, ',' ORDER BY feature) FILTER (NOT skip AND m = 0) AS unknown
FROM (SELECT *, identity AND len(avoid) > 0 AND len(want) = 0 AND m >= 0 AS skip FROM rated) GROUP BY ALL
""", "rated")
cte("scored", """
SELECT *, round(share, 2) AS known_share, CASE WHEN worship AND base_fit IN ('strong', 'possible') THEN 'unlikely' ELSE base_fit END AS fit FROM (
 SELECT *, CASE WHEN coalesce(w, 0) = 0 OR share < 0.4 THEN 'unknown' WHEN score >= 70 THEN 'strong' WHEN score >= 58 THEN 'possible' WHEN score >= 45 THEN 'unlikely' ELSE 'poor' END AS base_fit FROM (
  SELECT c.session_id, c.church_id, c.name, c.distance_miles, p.w, coalesce(p.worship, FALSE) AS worship, coalesce(p.ban, FALSE) OR (c.denom_conf >= 0.8 AND coalesce(p.firm, FALSE)) AS excluded,
   coalesce(p.matched, '') AS matched, coalesce(p.unmatched, '') AS unmatched, coalesce(p.unknown, '') AS unknown,
   CASE WHEN coalesce(p.w, 0) = 0 THEN 1.0 ELSE coalesce(p.k, 0) / p.w END AS share,
   round(round(greatest(0, least(100, CASE WHEN coalesce(p.w, 0) = 0 THEN 50.0 ELSE 50 + 50 * p.c / p.w END
     - CASE WHEN c.distance_miles > 0.6 * c.max_miles THEN least(10.0, 10 * (c.distance_miles - 0.6 * c.max_miles) / (0.4 * c.max_miles)) ELSE 0 END)), 9), 1) AS score
  FROM candidates_met c LEFT JOIN pair_sums p USING (session_id, church_id)))
""", "candidates_met", "pair_sums")


def scored(spark, sf, pairs=None):
    prof = matching.profile_arrays(T.preferences(spark, sf), T.features(spark, sf))
    ev = matching.evidence_maps(E.best_evidence(T.evidence(spark, sf).select(*RANKED, "value", "note", "source_kind")))
    return matching.score_pairs(T.candidates(spark, sf) if pairs is None else pairs, prof, ev)


@query("match_scores", "SELECT session_id, church_id, score, known_share, fit, excluded, matched, unmatched, unknown FROM scored", ("scored",))
def match_scores(spark, sf):
    return scored(spark, sf).select("session_id", "church_id", "score", "known_share", "fit", "excluded", joined("matched").alias("matched"),
                                    joined("unmatched").alias("unmatched"), joined("unknown").alias("unknown"))


cte("nation_priors", """
SELECT s_nationkey AS group_id, feature, value FROM evidence JOIN supplier ON s_suppkey = church_id QUALIFY row_number() OVER (PARTITION BY s_nationkey, feature ORDER BY
  CASE tier WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'D' THEN 3 WHEN 'C' THEN 2 ELSE 1 END DESC, checked_at DESC, row_id, church_id) = 1
""", "evidence")
cte("nation_variability", """
SELECT n_nationkey AS group_id, kind, CASE (n_nationkey + length(kind)) % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.5 ELSE 0.3 END AS var FROM nation, (VALUES ('doctrinal'), ('worship'), ('governance'), ('cultural')) k(kind)""")
cte("held", """
SELECT church_id, feature, value, tier, points, NULL AS var FROM best
UNION ALL SELECT s_suppkey, n.feature, n.value, 'prior', 0, v.var FROM supplier JOIN (SELECT * FROM nation_priors WHERE value <> 'unknown') n ON n.group_id = s_nationkey
JOIN nation_variability v ON v.group_id = n.group_id AND v.kind = CASE split_part(n.feature, '.', 1) WHEN 'theology' THEN 'doctrinal' WHEN 'social' THEN 'doctrinal' WHEN 'lgbtq' THEN 'doctrinal'
  WHEN 'worship' THEN 'worship' WHEN 'preaching' THEN 'worship' WHEN 'polity' THEN 'governance' WHEN 'women' THEN 'governance' ELSE 'cultural' END
WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.church_id = s_suppkey AND b.feature = n.feature)""", "best", "nation_priors", "nation_variability")
cte("rated_held", body("rated").replace("b.value", "v.value").replace("LEFT JOIN best b ON b.church_id = c.church_id AND b.feature = p.feature", "LEFT JOIN held v ON v.church_id = c.church_id AND v.feature = p.feature")
    .replace("CASE b.tier", "CASE v.tier WHEN 'prior' THEN CASE WHEN p.feature LIKE 'identity.%' THEN c.denom_conf ELSE 0.5 * c.denom_conf * (1 - v.var) END").replace("b.points", "v.points").replace("b.tier", "v.tier"),
    "candidates_met", "preferences", "features", "held")
cte("pair_sums_held", body("pair_sums").replace("FROM rated)", "FROM rated_held)"), "rated_held")


@query("match_scores_priors", "SELECT session_id, church_id, score, known_share, fit, excluded FROM (" + body("scored").strip().replace("LEFT JOIN pair_sums p", "LEFT JOIN pair_sums_held p") + ")", ("candidates_met", "pair_sums_held"))
def match_scores_priors(spark, sf):
    """Scores in which a supplier without evidence on a feature falls back to what its nation typically holds, weighed by the nation's variability."""
    n = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("church_id"), F.col("s_nationkey").alias("group_id"))
    pri = E.best_evidence(T.evidence(spark, sf).select(*RANKED, "value").join(n, "church_id"), "group_id", ("row_id", "church_id")).filter("value <> 'unknown'").select("group_id", "feature", "value", F.lit("").alias("note"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("doctrinal", "worship", "governance", "cultural")])).alias("kind")
    meta = table(spark, sf, "nation").select(F.col("n_nationkey").alias("group_id"), kinds)
    turn = (F.col("group_id") + F.length("kind")) % 3
    meta = meta.select("group_id", F.concat(F.lit("distinguishing_metadata."), "kind", F.lit("_variability")).alias("field_id"), F.when(turn == 0, "rather low").when(turn == 1, "High").alias("value"))
    prof = matching.profile_arrays(T.preferences(spark, sf), T.features(spark, sf))
    ev = matching.evidence_maps(E.best_evidence(T.evidence(spark, sf).select(*RANKED, "value", "note", "source_kind")), denom=n.withColumnRenamed("group_id", "denomination_id"), priors=E.with_variability(pri, meta))
    return matching.score_pairs(T.candidates(spark, sf), prof, ev).select("session_id", "church_id", "score", "known_share", "fit", "excluded")


cte("reasons", """
SELECT session_id, church_id, string_agg(txt, ' / ' ORDER BY part, o, feature) AS why FROM (
 SELECT session_id, church_id, feature, CASE WHEN c > 0 THEN 1 ELSE 2 END AS part, CASE WHEN c > 0 THEN -c ELSE c END AS o, txt,
   row_number() OVER (PARTITION BY session_id, church_id, c > 0 ORDER BY CASE WHEN c > 0 THEN -c ELSE c END, feature) AS rn FROM (
  SELECT r.session_id, r.church_id, r.feature, r.w * r.s * r.m AS c, CASE WHEN m > 0 THEN '✓ ' ELSE '✗ ' END || f.label || ': ' || replace(r.value, '_', ' ') || ' — ' ||
    CASE r.tier WHEN 'A' THEN 'their ' || CASE b.source_kind WHEN 'staff_page' THEN 'staff page' WHEN 'news' THEN 'local news' ELSE 'website' END || ' says so'
     WHEN 'B' THEN 'local news reports it' WHEN 'C' THEN 'a third-party listing suggests it' ELSE 'inferred: ' || b.note END
    || CASE WHEN m < 0 AND len(r.avoid) > 0 THEN ' (you''d rather avoid this)' ELSE '' END AS txt
  FROM rated r JOIN features f ON f.feature = r.feature JOIN best b ON b.church_id = r.church_id AND b.feature = r.feature
  WHERE m <> 0 AND NOT (identity AND len(r.avoid) > 0 AND len(r.want) = 0 AND m >= 0)))
WHERE rn <= CASE part WHEN 1 THEN 2 ELSE 1 END GROUP BY ALL
""", "rated", "features", "best")


@query("match_reasons", """
SELECT s.session_id, s.church_id, concat_ws(' / ', nullif(why, ''), CASE WHEN n = 1 THEN '1 thing to check later' WHEN n > 1 THEN n || ' things to check later' END) AS why
FROM (SELECT *, CASE WHEN unknown = '' THEN 0 ELSE len(string_split(unknown, ',')) END AS n FROM scored) s LEFT JOIN reasons r USING (session_id, church_id)""", ("scored", "reasons"))
def match_reasons(spark, sf):
    return scored(spark, sf).select("session_id", "church_id", joined("why", " / ").alias("why"))


cte("table_rows", """
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pinned DESC, CASE fit WHEN 'strong' THEN 0 WHEN 'possible' THEN 1 WHEN 'unknown' THEN 2 WHEN 'unlikely' THEN 3 ELSE 4 END,
   score DESC, distance_miles, church_id) AS row_no, count(*) OVER (PARTITION BY session_id) AS total
FROM (SELECT *, church_id = session_id % 100 AS pinned FROM scored) WHERE pinned OR (NOT excluded AND distance_miles <= 40)
""", "scored")


@query("ranked_table", """
SELECT session_id, church_id, row_no, fit, score, round(distance_miles, 4) AS distance_miles, excluded OR distance_miles > 40 AS mismatch, total, ceil(total / 10)::BIGINT AS pages
FROM table_rows WHERE row_no <= 10""", ("table_rows",))
def ranked_table(spark, sf):
    pairs = T.candidates(spark, sf).withColumn("pinned", F.col("church_id") == F.col("session_id") % 100)
    d = scored(spark, sf, matching.listed_pairs(pairs, 40)).select("session_id", "church_id", "pinned", "fit", "score", "distance_miles", "excluded")
    t = matching.ranked_table(d, radius=40, size=10)
    return t.select("session_id", "church_id", F.col("row_no").cast("long").alias("row_no"), "fit", "score", rounded(F.col("distance_miles"), 4).alias("distance_miles"),
                    "mismatch", "total", "pages")


@query("top_candidates", """
SELECT session_id, church_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE fit WHEN 'strong' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END, score DESC, distance_miles, church_id) AS row_no, fit, score
FROM scored WHERE NOT excluded AND distance_miles <= 60 AND fit IN ('strong', 'possible', 'unknown') QUALIFY row_no <= 5""", ("scored",))
def top_candidates(spark, sf):
    return matching.top_candidates(scored(spark, sf), 5, 60.0).select("session_id", "church_id", F.col("row_no").cast("long").alias("row_no"), "fit", "score")


cte("group_priors", """
SELECT church_id AS group_id, feature, value, '' AS note FROM best WHERE value <> 'unknown'
""", "best")
cte("group_rated", """
SELECT p.session_id, g.group_id, p.feature, p.weight, p.w, g.adherents, len(p.avoid) > 0 AS has_avoid, len(p.want) > 0 AS has_want, p.feature IN ('identity.denomination', 'identity.tradition', 'identity.branch') AS identity,
  CASE WHEN b.value IS NULL THEN 0 WHEN f.free_form THEN CASE WHEN len([a FOR a IN p.avoid IF contains(b.value, a)]) > 0 THEN -1 WHEN len(p.want) > 0 THEN CASE WHEN len([a FOR a IN p.want IF contains(b.value, a)]) > 0 THEN 1 ELSE -1 END ELSE 0 END
   WHEN list_has_any([trim(x) FOR x IN string_split(b.value, ';')], p.avoid) THEN -1
   WHEN len(p.want) > 0 THEN CASE WHEN list_has_any([trim(x) FOR x IN string_split(b.value, ';')], p.want) THEN 1 ELSE -1 END WHEN len(p.avoid) > 0 THEN 1 ELSE 0 END AS m,
  CASE WHEN b.value IS NOT NULL AND len(p.want) > 0 AND NOT list_has_any([trim(x) FOR x IN string_split(b.value, ';')], p.want) THEN TRUE ELSE FALSE END AS off_want,
  CASE WHEN p.feature LIKE 'identity.%' THEN 1.0 ELSE 0.5 * 0.7 END AS s
FROM preferences p JOIN features f ON f.feature = p.feature CROSS JOIN (SELECT n_nationkey AS group_id, count(c_custkey) * 9100 AS adherents FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) g
LEFT JOIN (SELECT * FROM nation_priors WHERE value <> 'unknown') b ON b.group_id = g.group_id AND b.feature = p.feature WHERE p.w > 0 AND p.feature <> 'logistics.distance'
""", "preferences", "features", "nation_priors")


@query("group_ranking", """
SELECT session_id, group_id, score, excluded, row_number() OVER (PARTITION BY session_id ORDER BY excluded, score DESC, adh DESC, group_id) AS row_no FROM (
 SELECT session_id, group_id, coalesce(bool_or(identity AND has_avoid AND m < 0), FALSE) OR coalesce(bool_or(identity AND has_want AND weight = 'dealbreaker' AND off_want), FALSE) AS excluded,
  round(round(round(greatest(0, least(100, coalesce(50 + 50 * sum(CASE WHEN m = 0 THEN CASE WHEN weight = 'dealbreaker' THEN -0.1 * w ELSE 0 END ELSE w * s * m END) FILTER (NOT skip) / sum(w) FILTER (NOT skip), 50.0))), 9), 1)
    + least(5.0, log10(max(adherents) + 1) / 1.6) / 5, 1) AS score, max(adherents) AS adh
 FROM (SELECT *, identity AND has_avoid AND NOT has_want AND m >= 0 AS skip FROM group_rated) GROUP BY ALL) QUALIFY row_no <= 8""", ("group_rated",))
def group_ranking(spark, sf):
    """Nations as the known groups: their priors are the best evidence of their suppliers, their size the number of customers."""
    n = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("church_id"), F.col("s_nationkey").alias("group_id"))
    pri = E.best_evidence(T.evidence(spark, sf).select(*RANKED, "value").join(n, "church_id"), "group_id", ("row_id", "church_id")).filter("value <> 'unknown'").select(
        "group_id", "feature", "value", F.lit("").alias("note"))
    size = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.count(F.lit(1)) * 9100).alias("adherents"))
    g = table(spark, sf, "nation").join(size, "n_nationkey", "left").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"),
                                                                            F.coalesce("adherents", F.lit(0)).alias("adherents"), F.lit(0.3).alias("variability"))
    d = matching.match_groups(T.preferences(spark, sf), T.features(spark, sf), pri, g)
    return d.select("session_id", "group_id", "score", "excluded", F.col("row_no").cast("long").alias("row_no"))


@query("group_comparison", """
SELECT a, b, feature, value_a, value_b, CASE WHEN value_a = value_b THEN 'yes' WHEN value_a <> value_b THEN 'no' ELSE 'unknown' END AS same FROM (
 SELECT a, a + 1 AS b, feature, max(value) FILTER (first) AS value_a, max(value) FILTER (NOT first) AS value_b FROM (
  SELECT group_id AS a, feature, value, TRUE AS first FROM group_priors UNION ALL SELECT group_id - 1, feature, value, FALSE FROM group_priors) JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = a + 1
 GROUP BY a, feature)""", ("group_priors",))
def group_comparison(spark, sf):
    pri = E.best_evidence(T.evidence(spark, sf)).filter("value <> 'unknown'").select(F.col("church_id").alias("group_id"), "feature", "value")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"))
    pairs = s.select("a", (F.col("a") + 1).alias("b")).join(s.select(F.col("a").alias("b")), "b", "left_semi")
    return E.compare_groups(pri, pairs, T.features(spark, sf)).select("a", "b", "feature", "value_a", "value_b", F.when(F.col("same"), "yes").when(~F.col("same"), "no").otherwise("unknown").alias("same"))


@query("priors_available", "SELECT feature, count(*) AS n_groups FROM group_priors GROUP BY feature", ("group_priors",))
def priors_available(spark, sf):
    return E.priors_available(E.best_evidence(T.evidence(spark, sf).select(*RANKED, "value")).filter("value <> 'unknown'"))


cte("pair_settled", """
SELECT session_id, church_id, feature, coalesce(bool_or(tier = 'A' AND quote <> ''), FALSE) OR count(DISTINCT regexp_extract(url, '//(?:www\\.)?([^/]+)', 1)) FILTER (tier = 'B') >= 2
   OR coalesce(bool_or(tier = 'D' AND how = 'observed' AND points >= 5), FALSE) AS settled
FROM evidence WHERE value <> 'unknown' GROUP BY ALL
""", "evidence")
cte("pair_states", """
SELECT c.session_id, c.church_id, p.feature, p.weight, f.label, coalesce(s.settled, FALSE) AS settled
FROM candidates_met c JOIN preferences p USING (session_id) JOIN features f ON f.feature = p.feature
LEFT JOIN pair_settled s ON s.session_id = c.session_id AND s.church_id = c.church_id AND s.feature = p.feature
""", "candidates_met", "preferences", "features", "pair_settled")


def _pair_states(spark, sf, *weights):
    p = T.preferences(spark, sf).select("session_id", "feature", "weight").filter(F.col("weight").isin(*weights)).join(T.features(spark, sf).select("feature", "label"), "feature")
    # what a session itself has seen of a place decides what is settled for it
    own = E.settled_features(T.evidence(spark, sf), ("session_id", "church_id"))
    return matching.pair_states(T.candidates(spark, sf), p, own)


@query("open_must_haves", "SELECT session_id, church_id, feature FROM pair_states WHERE weight = 'dealbreaker' AND NOT settled", ("pair_states",))
def open_must_haves(spark, sf):
    return matching.open_must_haves_of(_pair_states(spark, sf, "dealbreaker"))


@query("priorities_settled", """
SELECT session_id, church_id, bool_and(settled) AS all_settled, count(*) AS n_priority, count(*) FILTER (NOT settled) AS n_open FROM pair_states
WHERE weight IN ('dealbreaker', 'important') GROUP BY ALL""", ("pair_states",))
def priorities_settled(spark, sf):
    return matching.priorities_settled_of(_pair_states(spark, sf, "dealbreaker", "important"))


@query("visit_questions", """
SELECT session_id, church_id, line, question FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id, church_id ORDER BY prio, pos, question) AS line FROM (
  SELECT session_id, church_id, question, min(prio) AS prio, min(pos) AS pos FROM (
   SELECT session_id, church_id, 2 AS prio, feature AS pos, 'What is your church''s position on ' || label || '?' AS question FROM pair_states WHERE NOT settled AND weight IN ('dealbreaker', 'important')
   UNION ALL SELECT session_id, church_id, 3, feature, 'Could you clarify ' || label || '? (this is a must-have for you)' FROM pair_states WHERE NOT settled AND weight = 'dealbreaker') GROUP BY ALL))
WHERE line <= 6""", ("pair_states",))
def visit_questions(spark, sf):
    return matching.visit_questions_of(_pair_states(spark, sf, "dealbreaker", "important")).select("session_id", "church_id", F.col("line").cast("long").alias("line"), "question")


# ---------------------------------------------------------------- distance
@query("radius_join", f"""
SELECT session_id, church_id, round(d, 4) AS distance_miles FROM (SELECT h.session_id, p.church_id, h.radius_mi, {T.MILES_SQL.format(a='h', b='p')} AS d FROM homes h, places p) WHERE d <= radius_mi""",
       ("homes", "places"))
def radius_join(spark, sf):
    c = T.homes(spark, sf).withColumnsRenamed({"lat": "c_lat", "lng": "c_lng"})
    return matching.within_radius(T.places(spark, sf), c, 50.0).select("session_id", "church_id", rounded(F.col("distance_miles"), 4).alias("distance_miles"))


@query("covered_radius", f"""
SELECT p.church_id AS place_id, coalesce(max(h.radius_mi) FILTER ({T.MILES_SQL.format(a='h', b='p')} < 0.5), 0.0) AS covered FROM places p, homes h GROUP BY 1""", ("homes", "places"))
def covered_radius(spark, sf):
    return matching.covered_radius(T.homes(spark, sf), T.places(spark, sf).withColumnRenamed("church_id", "place_id"))


# ---------------------------------------------------------------- logs
cte("log_current", "SELECT * FROM oplog QUALIFY row_number() OVER (PARTITION BY session_id, key ORDER BY id DESC) = 1", "oplog")


@query("oplog_current", """
SELECT session_id, key, id, op, array_to_string(vals, ',') AS vals, stance, round(strength, 4) AS strength, src FROM log_current WHERE op <> 'retract'""", ("log_current",))
def oplog_current(spark, sf):
    return profiles.current_beliefs(T.oplog(spark, sf)).select("session_id", "key", "id", "op", joined("vals").alias("vals"), "stance",
                                                               rounded(F.col("strength"), 4).alias("strength"), "src")


cte("log_live", """
SELECT * FROM (SELECT *, max(id) FILTER (op = 'retract' OR stance = 'neutral') OVER (PARTITION BY session_id, key) AS clear_id FROM oplog WHERE key <> 'for_whom')
WHERE op <> 'retract' AND stance <> 'neutral' AND (clear_id IS NULL OR id > clear_id)
""", "oplog")
cte("log_segment", """
SELECT * FROM (SELECT *, max(id) FILTER (op = 'revise') OVER (PARTITION BY session_id, key, stance) AS start_id FROM log_live) WHERE start_id IS NULL OR id >= start_id
""", "log_live")
cte("log_states", """
SELECT session_id, key, stance, v.vals, l.id, l.strength, l.conf, l.src FROM
 (SELECT * FROM log_segment QUALIFY row_number() OVER (PARTITION BY session_id, key, stance ORDER BY id DESC) = 1) l
 JOIN (SELECT session_id, key, stance, list(v ORDER BY id, p) AS vals FROM (
   SELECT session_id, key, stance, v, min(id) AS id, arg_min(p, id * 10 + p) AS p FROM (
     SELECT session_id, key, stance, id, unnest(vals) AS v, generate_subscripts(vals, 1) AS p FROM log_segment) GROUP BY ALL) GROUP BY ALL) v USING (session_id, key, stance)
""", "log_segment")


@query("oplog_preferences", """
SELECT session_id, key, stance, array_to_string(vals, ',') AS vals, id, round(strength, 4) AS strength, round(conf, 4) AS conf, src FROM log_states""", ("log_states",))
def oplog_preferences(spark, sf):
    return profiles.preference_states(T.oplog(spark, sf)).select("session_id", "key", "stance", joined("vals").alias("vals"), "id",
                                                                 rounded(F.col("strength"), 4).alias("strength"), rounded(F.col("conf"), 4).alias("conf"), "src")


@query("oplog_profiles", """
SELECT session_id, feature, coalesce(max(array_to_string(vals, ',')) FILTER (stance = 'want'), '') AS want, coalesce(max(array_to_string(vals, ',')) FILTER (stance = 'avoid'), '') AS avoid,
 ['dont_care', 'nice_to_have', 'important', 'dealbreaker'][max(CASE WHEN sensitive AND src IN ('inferred', 'lexicon') THEN least(step, 1) ELSE step END) + 1] AS weight FROM (
 SELECT l.*, f.feature, f.sensitive, CASE WHEN conf < 0.5 THEN greatest(0, base - 1) ELSE base END AS step FROM (
   SELECT *, CASE WHEN key = 'denomination' THEN 'identity.denomination' ELSE key END AS fid,
     CASE WHEN strength >= 0.8 THEN 3 WHEN strength >= 0.5 THEN 2 WHEN strength > 0.15 THEN 1 ELSE 0 END AS base FROM log_states) l JOIN features f ON f.feature = l.fid) GROUP BY session_id, feature""",
       ("log_states", "features"))
def oplog_profiles(spark, sf):
    p = profiles.profiles(T.oplog(spark, sf), T.features(spark, sf))
    return p.select("session_id", "feature", joined("want").alias("want"), joined("avoid").alias("avoid"), "weight")


@query("valid_ops", """
SELECT l.session_id, l.id, l.key FROM oplog l LEFT JOIN features f ON f.feature = l.key
WHERE l.key IN ('location', 'for_whom', 'denomination') OR (f.feature IS NOT NULL AND (f.free_form OR l.op = 'retract' OR list_has_all(f."values", l.vals)))""", ("oplog", "features"))
def valid_ops(spark, sf):
    return profiles.valid_ops(T.oplog(spark, sf), T.features(spark, sf)).select("session_id", "id", "key")


@query("belief_summary", """
SELECT session_id, key, text, row_number() OVER (PARTITION BY session_id ORDER BY CASE key WHEN 'for_whom' THEN 1 WHEN 'denomination' THEN 2 ELSE 3 END, conf DESC, text) AS line FROM (
 SELECT l.session_id, l.key, l.conf, CASE WHEN l.stance = 'avoid' THEN coalesce(f.label, l.key) || ': would rather avoid ' || array_to_string(l.vals, ', ') ELSE coalesce(f.label, l.key) || ': ' || array_to_string(l.vals, ', ') END
   || CASE WHEN strength >= 0.8 THEN ' (a must)' WHEN strength >= 0.5 THEN ' (important)' ELSE ' (nice to have)' END AS text
 FROM log_states l LEFT JOIN features f ON f.feature = CASE WHEN l.key = 'denomination' THEN 'identity.denomination' ELSE l.key END
 UNION ALL SELECT session_id, key, conf, 'Looking for a church for yourself' FROM log_current WHERE key = 'for_whom' AND op <> 'retract')""", ("log_states", "features", "log_current"))
def belief_summary(spark, sf):
    log = T.oplog(spark, sf)
    d = profiles.belief_summary(profiles.current_beliefs(log), profiles.preference_states(log), T.features(spark, sf))
    return d.select("session_id", "key", "text", F.col("line").cast("long").alias("line"))
