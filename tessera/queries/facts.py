"""Evidence, preferences, candidates and log tables derived from the sales tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.queries.registry import cte, table

# ---------------------------------------------------------------- vocabulary: one feature per brand
NAMED = {1: "identity.denomination", 2: "identity.tradition", 3: "worship.style", 4: "logistics.distance", 5: "logistics.service_times"}


def features(spark, sf) -> DataFrame:
    """(feature, label, values, sensitive): a feature per brand, its product types as allowed values."""
    b = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    d = table(spark, sf, "part").select(b.alias("b"), F.lower("p_type").alias("v")).groupBy("b").agg(F.array_sort(F.collect_set("v")).alias("values"))
    return d.select(feature_of(F.col("b")).alias("feature"), F.concat(F.lit("Topic "), "b").alias("label"),
                    F.when(F.col("b") == 5, F.array_append("values", "schedule")).otherwise(F.col("values")).alias("values"), (F.col("b") % 7 == 0).alias("sensitive"))


def feature_of(b):
    out = None
    for k, v in NAMED.items():
        out = F.when(b == k, v) if out is None else out.when(b == k, v)
    return out.otherwise(F.concat(F.lit("topic."), b.cast("string")))


FEATURE_SQL = "CASE b " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMED.items()) + " ELSE 'topic.' || b END"
cte("features", f"""
SELECT {FEATURE_SQL} AS feature, 'Topic ' || b AS label, CASE WHEN b = 5 THEN list_append(vals, 'schedule') ELSE vals END AS "values", b % 7 = 0 AS sensitive, b = 5 AS free_form
FROM (SELECT regexp_extract(p_brand, '(\\d+)', 1)::INT AS b, list_sort(list(DISTINCT lower(p_type))) AS vals FROM part GROUP BY 1)
""")


# ---------------------------------------------------------------- evidence: one row per line item
def evidence(spark, sf) -> DataFrame:
    """Supplier as the place, brand as the feature, product type as the value; flags give tier and kind."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("b"),
                                        F.lower("p_type").alias("v"), "p_name")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).alias("pr"),
                                          F.col("o_custkey").alias("session_id"))
    d = table(spark, sf, "lineitem").join(p, "l_partkey").join(o, "l_orderkey")
    tier = (F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").when(F.col("l_linestatus") == "F", "C").otherwise("D"))
    value = F.when(F.col("l_quantity") == 50, "unknown").when(F.col("l_tax") == 0.08, F.concat("v", F.lit("; economy"))).otherwise(F.col("v"))
    return d.select(
        F.col("l_suppkey").alias("church_id"), "session_id", feature_of(F.col("b")).alias("feature"), value.alias("value"), tier.alias("tier"),
        F.when(tier == "D", "observed").otherwise("stated").alias("how"), F.when(F.col("l_linenumber") <= 5, F.col("p_name")).otherwise("").alias("quote"),
        F.concat(F.lit("https://www.site"), "pr", F.lit(".example.org/p/"), F.col("l_partkey").cast("string")).alias("url"),
        F.when(tier == "B", "news").when(F.col("l_linenumber") == 1, "staff_page").otherwise("website").alias("source_kind"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_quantity").cast("int").cast("string"), F.lit(" seen")).alias("note"),
        F.col("l_shipdate").cast("timestamp").alias("checked_at"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("row_id"))


cte("evidence", f"""
SELECT l_suppkey AS church_id, session_id, {FEATURE_SQL} AS feature, CASE WHEN l_quantity = 50 THEN 'unknown' WHEN l_tax = 0.08 THEN v || '; economy' ELSE v END AS value, tier,
  CASE WHEN tier = 'D' THEN 'observed' ELSE 'stated' END AS how, CASE WHEN l_linenumber <= 5 THEN p_name ELSE '' END AS quote,
  'https://www.site' || pr || '.example.org/p/' || l_partkey AS url, CASE WHEN tier = 'B' THEN 'news' WHEN l_linenumber = 1 THEN 'staff_page' ELSE 'website' END AS source_kind,
  l_linenumber || ' of ' || l_quantity::INT || ' seen' AS note, l_quantity::INT AS points, l_shipdate AS checked_at,
  (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS row_id
FROM (SELECT l.*, p_name, lower(p_type) AS v, regexp_extract(p_brand, '(\\d+)', 1)::INT AS b, substr(o_orderpriority, 1, 1) AS pr, o_custkey AS session_id,
        CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'B' WHEN l_linestatus = 'F' THEN 'C' ELSE 'D' END AS tier
      FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)
""")


# ---------------------------------------------------------------- preferences: one row per order
def preferences(spark, sf) -> DataFrame:
    """Customer as the session, an order's key, status, priority and price as feature, stance, weight and wanted value."""
    types = F.array(*[F.lit(t) for t in ("economy", "small", "medium", "promo", "standard", "large")])
    v = F.get(types, (F.floor("o_totalprice") % 6).cast("int"))
    w = F.get(F.array(*[F.lit(x) for x in ("dealbreaker", "important", "nice_to_have", "nice_to_have", "dont_care")]), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), feature_of((1 + F.col("o_orderkey") % 25).cast("int")).alias("feature"), v.alias("v"),
                                          (F.col("o_orderstatus") == "P").alias("off"), w.alias("weight"), F.col("o_orderkey").alias("id"))
    order = ["dont_care", "nice_to_have", "important", "dealbreaker"]
    step = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("weight"))
    vals = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("v"))))
    g = d.withColumn("_s", step).groupBy("session_id", "feature").agg(vals(~F.col("off")).alias("want"), vals(F.col("off")).alias("avoid"), F.max("_s").alias("_s"))
    return g.select("session_id", "feature", "want", "avoid", F.get(F.array(*[F.lit(x) for x in order]), (F.col("_s") - 1).cast("int")).alias("weight"))


cte("preferences", f"""
SELECT session_id, feature, list_sort(coalesce(list(DISTINCT v) FILTER (NOT off), [])) AS want, list_sort(coalesce(list(DISTINCT v) FILTER (off), [])) AS avoid,
  ['dont_care', 'nice_to_have', 'important', 'dealbreaker'][max(s)] AS weight, [0.0, 1.0, 3.0, 5.0][max(s)]::DOUBLE AS w
FROM (SELECT o_custkey AS session_id, {FEATURE_SQL} AS feature, ['economy', 'small', 'medium', 'promo', 'standard', 'large'][floor(o_totalprice)::BIGINT % 6 + 1] AS v,
        o_orderstatus = 'P' AS off, [4, 3, 2, 2, 1][substr(o_orderpriority, 1, 1)::INT] AS s FROM (SELECT *, (1 + o_orderkey % 25)::INT AS b FROM orders)) GROUP BY ALL
""")


# ---------------------------------------------------------------- places and candidates
def _spot(key, nation, lat0):
    lat = F.lit(lat0) + (key * 37 % 1000) / 500.0 + nation / 50.0
    lng = F.lit(-97.0) + (key * 91 % 1000) / 400.0
    return lat.cast("double").alias("lat"), lng.cast("double").alias("lng")


def places(spark, sf) -> DataFrame:
    """Suppliers as places with made-up coordinates."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("church_id"), F.col("s_name").alias("name"), *_spot(F.col("s_suppkey"), F.col("s_nationkey"), 38.0))


def homes(spark, sf) -> DataFrame:
    """Customers as starting points with a radius of 5 to 50 miles."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("session_id"), *_spot(F.col("c_custkey"), F.col("c_nationkey"), 38.0), (5 + F.col("c_custkey") % 46).cast("double").alias("radius_mi"))


SPOT = "{lat0} + ({k} * 37 % 1000) / 500.0::DOUBLE + {n} / 50.0::DOUBLE AS lat, -97.0 + ({k} * 91 % 1000) / 400.0::DOUBLE AS lng"
cte("places", "SELECT s_suppkey AS church_id, s_name AS name, " + SPOT.format(lat0="38.0::DOUBLE", k="s_suppkey", n="s_nationkey") + " FROM supplier")
cte("homes", "SELECT c_custkey AS session_id, " + SPOT.format(lat0="38.0::DOUBLE", k="c_custkey", n="c_nationkey") + ", (5 + c_custkey % 46)::DOUBLE AS radius_mi FROM customer")
MILES_SQL = ("2 * 3958.8 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) "
             "* pow(sin(radians({b}.lng - {a}.lng) / 2), 2))))")


def candidates(spark, sf) -> DataFrame:
    """Places each session has met: suppliers a customer bought from, with the distance between them."""
    from tessera.functions import geo
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session_id"))
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("church_id"))
    pairs = li.join(o, "l_orderkey").select("session_id", "church_id").distinct()
    h = homes(spark, sf).select("session_id", F.col("lat").alias("hl"), F.col("lng").alias("hg"), F.col("radius_mi").alias("max_miles"))
    d = pairs.join(h, "session_id").join(places(spark, sf), "church_id")
    conf = F.when(F.col("church_id") % 3 == 0, 0.9).otherwise(0.5)
    return d.select("session_id", "church_id", "name", geo.miles(F.col("hl"), F.col("hg"), F.col("lat"), F.col("lng")).alias("distance_miles"), "max_miles",
                    conf.alias("denom_conf"), F.lit(0.3).alias("variability"), F.lit("its denomination").alias("denom_label"), F.lit("name").alias("denom_method"))


cte("candidates_met", f"""
SELECT p.session_id, p.church_id, s.name, {MILES_SQL.format(a='h', b='s')} AS distance_miles, h.radius_mi AS max_miles,
  CASE WHEN p.church_id % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS denom_conf
FROM (SELECT DISTINCT o_custkey AS session_id, l_suppkey AS church_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey) p
JOIN homes h USING (session_id) JOIN places s USING (church_id)
""", "homes", "places")


# ---------------------------------------------------------------- preference log: one row per event
def oplog(spark, sf) -> DataFrame:
    return oplog_of(table(spark, sf, "events"))


def oplog_of(events: DataFrame) -> DataFrame:
    """User as the session, event type as the operation, the number in the properties as key and stance."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.withColumn("k", k)
    op = F.when(F.col("event_type").isin("signup", "purchase"), "assert").when(F.col("event_type") == "click", "revise").when(
        F.col("event_type") == "view", "confirm").otherwise("retract")
    key = F.when(F.col("k") % 9 == 0, "for_whom").when(F.col("k") % 9 == 1, "denomination").otherwise(feature_of((F.col("k") % 9).cast("int")))
    types = F.array(*[F.lit(t) for t in ("economy", "small", "medium", "promo", "standard", "large")])
    at = lambda n: F.get(types, ((F.floor("value") + n) % 6).cast("int"))
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), op.alias("op"), key.alias("key"),
        F.when(F.col("k") % 2 == 0, F.array(at(0), at(1))).otherwise(F.array(at(0))).alias("vals"),
        F.when(F.col("k") % 10 < 6, "want").when(F.col("k") % 10 < 9, "avoid").otherwise("neutral").alias("stance"),
        F.least(F.lit(1.0), F.floor(F.col("value") * 2) / 100).alias("strength"), ((F.col("k") % 10) / 10).cast("double").alias("conf"),
        F.get(F.array(F.lit("stated"), F.lit("inferred"), F.lit("lexicon")), (F.col("event_id") % 3).cast("int")).alias("src"),
        F.concat(F.lit("said "), "event_type").alias("ev"), F.col("ts"))


LOG_FEATURE = FEATURE_SQL.replace("CASE b", "CASE k % 9").replace("|| b END", "|| (k % 9) END")
cte("oplog", f"""
SELECT user_id AS session_id, event_id AS id,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'assert' WHEN event_type = 'click' THEN 'revise' WHEN event_type = 'view' THEN 'confirm' ELSE 'retract' END AS op,
  CASE WHEN k % 9 = 0 THEN 'for_whom' WHEN k % 9 = 1 THEN 'denomination' ELSE {LOG_FEATURE} END AS key,
  CASE WHEN k % 2 = 0 THEN [t[f % 6 + 1], t[(f + 1) % 6 + 1]] ELSE [t[f % 6 + 1]] END AS vals,
  CASE WHEN k % 10 < 6 THEN 'want' WHEN k % 10 < 9 THEN 'avoid' ELSE 'neutral' END AS stance, least(1.0, floor(value * 2) / 100) AS strength,
  ((k % 10) / 10)::DOUBLE AS conf, ['stated', 'inferred', 'lexicon'][event_id % 3 + 1] AS src, 'said ' || event_type AS ev, ts
FROM (SELECT *, (props->>'$.k')::INT AS k, floor(value)::BIGINT AS f, ['economy', 'small', 'medium', 'promo', 'standard', 'large'] AS t FROM events)
""")
