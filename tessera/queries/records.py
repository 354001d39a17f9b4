"""Registered queries: review, metrics, jobs, responses, vectors, recordings, episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import rules as R
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.functions.columns import rounded, stable_fraction
from tessera.operators import corpus, jobs, lexicon, metrics, responses, retrieval, review, senses, sermons, signals
from tessera.queries.registry import cte, query, table

pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
b_ = lambda: F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")

# ---------------------------------------------------------------- review
TYPES = ["descriptive", "polysemous", "contested", "evaluative", "descriptive", "descriptive", "negatable", "descriptive", "descriptive", "descriptive"]


def entries(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("term"), F.array(pick(TYPES, F.col("p_size") % 10)).alias("term_types"),
                                        ((F.col("p_partkey") % 10) / 10).alias("drift"), (F.col("p_partkey") * 7 % 101).alias("demand"), F.col("p_partkey").alias("rank"))
    return d


cte("tiered", f"""
SELECT e.term, p_partkey, CASE WHEN a THEN 'A' WHEN b.term IS NOT NULL THEN 'B' WHEN x.term IS NOT NULL THEN 'audit' ELSE 'C' END AS tier FROM entries e
LEFT JOIN (SELECT term FROM entries WHERE NOT a ORDER BY demand DESC, p_partkey, term LIMIT 50) b USING (term)
LEFT JOIN (SELECT term FROM entries WHERE NOT a AND term NOT IN (SELECT term FROM entries WHERE NOT a ORDER BY demand DESC, p_partkey, term LIMIT 50) ORDER BY sha1('13|' || term), term LIMIT 20) x USING (term)
""", "entries")
cte("entries", f"""SELECT *, t IN ('contested', 'evaluative') OR (t = 'polysemous' AND drift >= 0.3) AS a FROM (
 SELECT p_partkey, p_name || ' ' || p_partkey AS term, {TYPES}[p_size % 10 + 1] AS t, (p_partkey % 10) / 10 AS drift, p_partkey * 7 % 101 AS demand FROM part)""")
cte("votes", """SELECT p_partkey, l_suppkey % 3 AS reviewer, max(l_returnflag) AS rf, max(l_linestatus) AS ls, max(l_linenumber) AS ln FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
cte("outcomes", """
SELECT term, tier, votes, need, has_error, CASE WHEN rejected THEN 'rejected' WHEN need IS NULL THEN 'open' WHEN votes < need THEN 'under_reviewed' WHEN neutral THEN 'vetted' ELSE 'open' END AS outcome FROM (
 SELECT t.term, t.tier, coalesce(v.n, 0) AS votes, CASE t.tier WHEN 'A' THEN 2 WHEN 'B' THEN 1 WHEN 'audit' THEN 1 END AS need, coalesce(v.err, FALSE) AS has_error, coalesce(v.rej, FALSE) AS rejected, coalesce(v.neu, FALSE) AS neutral
 FROM tiered t LEFT JOIN (SELECT p_partkey, count(*) AS n, bool_or(rf = 'N') AS rej, bool_and(ls = 'O') AS neu, bool_or(rf = 'N' OR ls = 'F' OR ln = 3) AS err FROM votes GROUP BY 1) v USING (p_partkey))
""", "tiered", "votes")


def _votes(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 3).alias("reviewer")).agg(
        F.max("l_returnflag").alias("rf"), F.max("l_linestatus").alias("ls"), F.max("l_linenumber").alias("ln"))
    e = entries(spark, sf).select("term", F.col("p_partkey").alias("l_partkey"))
    yn = lambda no: F.when(no, " No").otherwise("yes")
    return d.join(e, "l_partkey").select("term", "reviewer", yn(F.col("rf") == "N").alias("keep"), yn(F.lit(False)).alias("types_ok"), yn(F.col("ln") == 3).alias("features_ok"), yn(F.col("ls") == "F").alias("neutral_ok"))


@query("review_tiers", "SELECT term, tier FROM tiered", ("tiered",))
def review_tiers(spark, sf):
    return review.assign_tiers(entries(spark, sf)).select("term", "tier")


@query("review_outcomes", "SELECT term, tier, votes, outcome FROM outcomes", ("outcomes",))
def review_outcomes(spark, sf):
    return review.review_outcomes(review.assign_tiers(entries(spark, sf)), _votes(spark, sf)).select("term", "tier", "votes", "outcome")


@query("review_summary", """
SELECT count(*) FILTER (outcome = 'vetted') AS vetted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'under_reviewed') AS under_reviewed,
 count(*) FILTER (tier = 'audit' AND votes > 0) AS audited, count(*) FILTER (tier = 'audit' AND votes > 0 AND has_error) AS with_any_error,
 round(count(*) FILTER (tier = 'audit' AND votes > 0 AND has_error) / nullif(count(*) FILTER (tier = 'audit' AND votes > 0), 0), 6) AS audit_error_rate,
 round((6 * count(*) FILTER (tier = 'A') + 1.5 * count(*) FILTER (tier IN ('B', 'audit'))) / 60, 6) AS person_hours FROM outcomes""", ("outcomes",))
def review_summary(spark, sf):
    s = review.review_summary(review.review_outcomes(review.assign_tiers(entries(spark, sf)), _votes(spark, sf)))
    return s.withColumn("audit_error_rate", rounded(F.col("audit_error_rate"), 6)).withColumn("person_hours", rounded(F.col("person_hours"), 6))


@query("kappa_labels", """
SELECT lang, n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa, pa IN (0, 1) OR pb IN (0, 1) AS degenerate FROM (
 SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (SELECT lang, count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels JOIN documents USING (doc_id) GROUP BY lang))""")
def kappa_labels(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return review.cohen_kappa(d, ["lang"], "quality", "toxic").withColumn("agreement", rounded(F.col("agreement"), 6)).withColumn("kappa", rounded(F.col("kappa"), 6))


@query("reviewer_agreement", """
SELECT question, n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (
 SELECT q AS question, count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb FROM (
  SELECT unnest(['keep', 'types_ok', 'features_ok', 'neutral_ok']) AS q, unnest([(x.rf <> 'N')::INT, 1, (x.ln <> 3)::INT, (x.ls <> 'F')::INT]) AS a,
    unnest([(y.rf <> 'N')::INT, 1, (y.ln <> 3)::INT, (y.ls <> 'F')::INT]) AS b FROM votes x JOIN votes y USING (p_partkey) WHERE x.reviewer = 0 AND y.reviewer = 1) GROUP BY q))""", ("votes",))
def reviewer_agreement(spark, sf):
    v = _votes(spark, sf)
    d = review.reviewer_agreement(v.filter("reviewer = 0"), v.filter("reviewer = 1"))
    return d.select("question", "n", rounded(F.col("agreement"), 6).alias("agreement"), rounded(F.col("kappa"), 6).alias("kappa"))


# ---------------------------------------------------------------- metrics
def calls(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(F.col("event_type").alias("task"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), (F.col("event_type") != "error").alias("ok"),
                                             F.col("value").alias("ms"), (k % 3).alias("repairs"), (k * 10).alias("prompt_tokens"), k.alias("completion_tokens"))


cte("calls", """SELECT event_type AS task, 'm' || (user_id % 4) AS model, event_type <> 'error' AS ok, value AS ms, (props->>'$.k')::BIGINT AS k FROM events""")


@query("call_stats", """SELECT task, model, count(*) AS calls, avg(ok::INT) AS ok_rate, round(median(ms), 6) AS median_ms, round(sum(ms) / 60000, 6) AS total_min, sum(k % 3)::BIGINT AS repairs,
 sum(k * 10)::BIGINT AS prompt_tokens, sum(k)::BIGINT AS completion_tokens FROM calls GROUP BY ALL""", ("calls",))
def call_stats(spark, sf):
    return metrics.call_stats(calls(spark, sf)).withColumn("median_ms", rounded(F.col("median_ms"), 6)).withColumn("total_min", rounded(F.col("total_min"), 6))


@query("call_costs", """SELECT task, model, round(sum(CASE model WHEN 'm0' THEN (k * 10 * 0.5 + k * 1.5) / 1e6 WHEN 'm1' THEN (k * 10 * 2.0 + k * 8.0) / 1e6 ELSE 0 END), 9) AS cost FROM calls GROUP BY ALL""", ("calls",))
def call_costs(spark, sf):
    prices = spark.createDataFrame([("m0", 0.5, 1.5), ("m1", 2.0, 8.0)], "model string, price_in double, price_out double")
    return metrics.call_costs(calls(spark, sf), prices).withColumn("cost", rounded(F.col("cost"), 9))


cte("guesses", """SELECT floor(o_totalprice)::BIGINT % 3 <> 0 AS ok, (o_orderkey % 11) / 10 AS confidence, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'name' END AS method, o_orderpriority AS kind FROM orders""")


def guesses(spark, sf):
    return table(spark, sf, "orders").select((F.floor("o_totalprice") % 3 != 0).alias("ok"), ((F.col("o_orderkey") % 11) / 10).alias("confidence"),
                                             F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("name").alias("method"), F.col("o_orderpriority").alias("kind"))


@query("label_metrics", """SELECT count(*) AS n, round(avg(ok::INT), 6) AS top1, count(*) FILTER (confidence >= 0.8) AS confident_n, round(avg(ok::INT) FILTER (confidence >= 0.8), 6) AS confident_accuracy,
 round(avg((method = 'unknown' OR confidence <= 0.4)::INT), 6) AS unknown_rate FROM guesses""", ("guesses",))
def label_metrics(spark, sf):
    m = metrics.label_metrics(guesses(spark, sf))
    return m.select("n", "confident_n", *[rounded(F.col(c), 6).alias(c) for c in ("top1", "confident_accuracy", "unknown_rate")])


@query("label_metrics_by_kind", "SELECT kind, count(*) AS n, count(*) FILTER (NOT ok) AS misses FROM guesses GROUP BY kind", ("guesses",))
def label_metrics_by_kind(spark, sf):
    return metrics.by_kind(guesses(spark, sf))


# ---------------------------------------------------------------- jobs and messages
JOB_STATUS = ["pending", "running", "complete", "error", "cancelled", "running", "complete"]


@query("job_states", f"""
SELECT job_id, coalesce(arg_min(status, seq) FILTER (status IN ('complete', 'error', 'cancelled', 'expired')), arg_max(status, seq)) AS status FROM (
 SELECT l_orderkey AS job_id, (l_partkey * 1000 + l_suppkey) * 10 + l_linenumber AS seq, {JOB_STATUS}[l_linenumber] AS status FROM lineitem) GROUP BY job_id""")
def job_states(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("seq"), pick(JOB_STATUS, F.col("l_linenumber") - 1).alias("status"))
    return jobs.job_states(d)


def job_table(spark, sf):
    return job_table_of(table(spark, sf, "orders"))


def job_table_of(orders):
    k = F.col("o_orderkey")
    return orders.select(k.alias("job_id"), (F.col("o_custkey") % 200).alias("session_id"), (k % 37).alias("church_id"), F.when(k % 2 == 0, "medium").otherwise("deep").alias("kind"), (k % 5 != 0).alias("visible"),
                    (k % 3).alias("generation"), F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("error").alias("status"),
                    F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_orderdate").cast("timestamp").alias("finished_at"),
                    F.when(k % 4 == 0, F.col("o_orderdate").cast("timestamp") - F.expr("INTERVAL 3 DAYS")).alias("verified_at"), (k % 50).alias("done"), (k % 7 * 10).alias("total"),
                    F.when(k % 6 == 0, 4).otherwise(5).alias("research_version"))


cte("job_table", """SELECT o_orderkey AS job_id, o_custkey % 200 AS session_id, o_orderkey % 37 AS church_id, CASE WHEN o_orderkey % 2 = 0 THEN 'medium' ELSE 'deep' END AS kind, o_orderkey % 5 <> 0 AS visible,
 o_orderkey % 3 AS generation, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'error' END AS status, o_orderdate AS started,
 CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate - INTERVAL 3 DAY END AS verified_at, o_orderkey % 50 AS done, o_orderkey % 7 * 10 AS total, CASE WHEN o_orderkey % 6 = 0 THEN 4 ELSE 5 END AS version FROM orders""")
NOW = "2000-06-01 00:00:00"


@query("latest_jobs", """
SELECT session_id, church_id, kind, job_id, status, CASE WHEN status = 'complete' THEN 100 WHEN total > 0 THEN round(100 * done / total)::INT ELSE -1 END AS pct FROM (
 SELECT * FROM job_table WHERE visible AND generation = session_id % 3) QUALIFY row_number() OVER (PARTITION BY session_id, church_id, kind ORDER BY started DESC, job_id DESC) = 1""", ("job_table",))
def latest_jobs(spark, sf):
    j = job_table(spark, sf)
    state = j.select("session_id").distinct().withColumn("generation", F.col("session_id") % 3)
    d = jobs.latest_jobs(j, state)
    return d.select("session_id", "church_id", "kind", "job_id", "status", F.coalesce("pct", F.lit(-1)).alias("pct"))


@query("retention_latest", f"""
SELECT church_id, kind, job_id, coalesce(verified_at, started) >= TIMESTAMP '{NOW}' - CASE kind WHEN 'medium' THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END AND (kind <> 'medium' OR version = 5) AS reusable FROM (
 SELECT * FROM job_table WHERE status = 'complete') QUALIFY row_number() OVER (PARTITION BY church_id, kind ORDER BY started DESC, job_id DESC) = 1""", ("job_table",))
def retention_latest(spark, sf):
    return jobs.reusable_jobs(job_table(spark, sf), F.lit(NOW).cast("timestamp")).select("church_id", "kind", "job_id", "reusable")


@query("job_expiry", f"""
SELECT kind, status, CASE WHEN status = 'complete' AND coalesce(verified_at, started) < TIMESTAMP '{NOW}' - CASE kind WHEN 'medium' THEN INTERVAL 90 DAY ELSE INTERVAL 365 DAY END THEN 'expired'
 WHEN status IN ('pending', 'running') THEN 'error' ELSE status END AS new_status, count(*) AS n FROM job_table GROUP BY ALL""", ("job_table",))
def job_expiry(spark, sf):
    return jobs.expire_jobs(job_table(spark, sf), F.lit(NOW).cast("timestamp")).groupBy("kind", "status", "new_status").agg(F.count(F.lit(1)).alias("n"))


@query("retention_purge", f"""SELECT kind AS scope, count(*) AS n FROM job_table WHERE started >= TIMESTAMP '{NOW}' - CASE kind WHEN 'medium' THEN INTERVAL 90 DAY ELSE INTERVAL 365 DAY END GROUP BY kind""", ("job_table",))
def retention_purge(spark, sf):
    d = job_table(spark, sf).select(F.col("kind").alias("scope"), F.col("started_at").alias("checked_at"))
    return jobs.purge(d, F.lit(NOW).cast("timestamp")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("message_numbers", "SELECT user_id AS session_id, event_id AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def message_numbers(spark, sf):
    m = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.number_messages(m, F.floor(F.unix_seconds("ts") / 86400)).select("session_id", "message_id", "n")


@query("messages_after", """SELECT session_id, message_id FROM (SELECT user_id AS session_id, event_id AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n > session_id % 50""")
def messages_after(spark, sf):
    from tessera.operators import profiles
    m = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    seen = m.select("session_id").distinct().withColumn("since", F.col("session_id") % 50)
    return profiles.messages_after(jobs.number_messages(m, F.floor(F.unix_seconds("ts") / 86400)), seen).select("session_id", "message_id")


@query("generation_fence", "SELECT user_id AS session_id, event_id FROM events WHERE (props->>'$.k')::INT % 3 = user_id % 3")
def generation_fence(spark, sf):
    from tessera.operators import profiles
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", (F.get_json_object("props", "$.k").cast("long") % 3).alias("generation"))
    return profiles.live_rows(e, e.select("session_id").distinct().withColumn("generation", F.col("session_id") % 3)).select("session_id", "event_id")


@query("state_versions", "SELECT user_id AS session_id, count(*) FILTER (event_type <> 'error') AS memory_version, count(*) AS table_version FROM events GROUP BY 1")
def state_versions(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "error", "table").otherwise("memory").alias("kind"))
    return jobs.state_versions(e)


@query("evidence_touch", "SELECT l_suppkey AS church_id, count(*) AS rows, strftime(max(l_shipdate), '%Y-%m-%d') AS last_checked FROM lineitem GROUP BY 1")
def evidence_touch(spark, sf):
    d = jobs.last_checked(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("church_id"), F.col("l_shipdate").alias("checked_at")))
    return d.withColumn("last_checked", F.date_format("last_checked", "yyyy-MM-dd"))


@query("cascade_delete", """
WITH l AS (SELECT DISTINCT o_custkey AS session_id, l_partkey AS church_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey), gone AS (SELECT c_custkey AS s FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT p_partkey AS church_id FROM part WHERE p_partkey NOT IN (SELECT church_id FROM l WHERE session_id IN (SELECT s FROM gone) EXCEPT SELECT church_id FROM l WHERE session_id NOT IN (SELECT s FROM gone))""")
def cascade_delete(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session_id"))
    links = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("church_id")).join(o, "l_orderkey").select("session_id", "church_id").distinct()
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("session_id"))
    return jobs.delete_sessions(gone, links, {"churches": table(spark, sf, "part").select(F.col("p_partkey").alias("church_id"))})["churches"]


@query("distinct_questions", """
SELECT id FROM (SELECT p_partkey AS id, p_partkey % 10 AS s, p_size AS c, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) || '?' ELSE p_name END AS text FROM part)
QUALIFY row_number() OVER (PARTITION BY s, c, trim(regexp_replace(lower(text), '[^\\pL\\pN_]+', ' ', 'g')) ORDER BY id) = 1""")
def distinct_questions(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("session_id"), F.col("p_size").alias("church_id"),
                                        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_name"), F.lit("?"))).otherwise(F.col("p_name")).alias("text"))
    return jobs.distinct_questions(d).select("id")


@query("merge_places", """
SELECT c_custkey AS church_id, 'customer' AS origin FROM customer UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)""")
def merge_places(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("church_id"), F.lit("customer").alias("origin"))
    return jobs.merge_places(a, table(spark, sf, "orders").select(F.col("o_orderkey").alias("church_id"), F.lit("order").alias("origin")))


# ---------------------------------------------------------------- responses
def _bodies(spark, sf):
    """Verdict answers in four shapes, one per order, built from its line items."""
    v = pick(["supported", "partial", "unsupported", "odd"], F.col("l_linenumber") % 4)
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("id")).agg(F.min("l_returnflag").alias("f"), F.min("l_linenumber").alias("l_linenumber"))
    d = li.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", v.alias("verdict"), "f"))).alias("xs"))
    lst = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: F.concat(F.lit('{"id": "['), x["id"].cast("string"), F.lit(']", "verdict": "'), F.upper(x["verdict"]), F.lit('", "reason": "'), x["f"], F.lit('"}'))), ", "), F.lit("]"))
    bare = F.concat(F.lit("{"), F.array_join(F.transform("xs", lambda x: F.concat(F.lit('"'), x["id"].cast("string"), F.lit('": "'), x["verdict"], F.lit('"'))), ", "), F.lit("}"))
    objs = F.concat(F.lit("{"), F.array_join(F.transform("xs", lambda x: F.concat(F.lit('"'), x["id"].cast("string"), F.lit('": {"verdict": "'), x["verdict"], F.lit('", "reason": "'), x["f"], F.lit('"}'))), ", "), F.lit("}"))
    wrap = lambda c: F.concat(F.lit('{"verdicts": '), c, F.lit("}"))
    k = F.col("key") % 5
    body = F.when(k == 0, lst).when(k == 1, wrap(lst)).when(k == 2, bare).when(k == 3, wrap(objs)).otherwise(F.concat(F.lit("```json\n"), objs, F.lit("\n```")))
    return d.select("key", body.alias("body"))


cte("verdict_rows", """SELECT l_orderkey AS key, l_linenumber AS id, ['supported', 'partial', 'unsupported', 'odd'][l_linenumber % 4 + 1] AS verdict, CASE WHEN l_orderkey % 5 = 2 THEN '' ELSE min(l_returnflag) END AS reason
FROM lineitem GROUP BY l_orderkey, l_linenumber""")


@query("verdict_shapes", "SELECT key, id, verdict, reason FROM verdict_rows WHERE verdict <> 'odd'", ("verdict_rows",))
def verdict_shapes(spark, sf):
    return responses.normalized_verdicts(_bodies(spark, sf))


@query("verdict_attach", """
SELECT key, pos, verdict FROM (SELECT v.key, v.id, o.n, row_number() OVER (PARTITION BY v.key ORDER BY v.id) - 1 AS pos FROM verdict_rows v JOIN (SELECT key, count(*) AS n FROM verdict_rows GROUP BY key) o USING (key)) c
LEFT JOIN (SELECT key, id - 1 AS pos, verdict FROM verdict_rows WHERE verdict <> 'odd' AND key IN (SELECT key FROM verdict_rows GROUP BY key HAVING count(*) FILTER (verdict <> 'odd') = count(*) AND max(id) = count(*))) x USING (key, pos)""", ("verdict_rows",))
def verdict_attach(spark, sf):
    claims = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key"), "l_linenumber").count()
    claims = retrieval.in_batches(claims, ["key"], [F.col("l_linenumber")], 1000, F.lit(0)).select("key", "pos")
    return responses.attach_verdicts(claims, responses.normalized_verdicts(_bodies(spark, sf)), "m", "v1").select("key", "pos", "verdict")


@query("json_checks", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k' WHEN event_id % 3 = 1 THEN '' ELSE 'name' END AS missing FROM events""")
def json_checks(spark, sf):
    """Objects with a number and a name; every third has the number as text, every third lacks the name."""
    k = F.get_json_object("props", "$.k")
    i = F.col("event_id") % 3
    body = F.when(i == 0, F.concat(F.lit('```\n{"k": "'), k, F.lit('", "name": "x"}\n```'))).when(i == 1, F.concat(F.lit('{"k": '), k, F.lit(', "name": "x"}'))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.array_join(responses.missing_keys(body, {"k": "number", "name": "string"}), ",").alias("missing"))


@query("pending_requests", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05)")
def pending_requests(spark, sf):
    key = lambda c: responses.request_key(F.lit("m"), c.cast("string"))
    r = table(spark, sf, "orders").select("o_orderkey", key(F.col("o_orderkey")).alias("key"))
    s = table(spark, sf, "lineitem").select(key(F.col("l_orderkey")).alias("key"), F.when(F.col("l_discount") > 0.05, "x").alias("response"))
    return responses.pending_requests(r, s).select("o_orderkey")


@query("extract_checks", """
SELECT l_orderkey AS group_id, l_linenumber AS field_id, array_to_string(list_filter([CASE WHEN l_linenumber > 5 THEN 'field not asked for' END, CASE WHEN l_tax > 0.06 THEN 'excerpt out of range' END,
  CASE WHEN l_tax <= 0.06 AND NOT contains('the passage says ' || lower(p_type) || ' ' || p_name || ' is fine', CASE WHEN l_discount < 0.05 THEN 'passage says ' || lower(p_type) ELSE 'passage tells ' || p_name END) THEN 'quote not in excerpt' END], lambda x: x IS NOT NULL), ',') AS errors,
 count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def extract_checks(spark, sf):
    """Each line item is one answer: asked for when its number is at most 5, its excerpt given unless the tax is high."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("v"), "p_name")
    d = table(spark, sf, "lineitem").join(p, "l_partkey").withColumn("ex", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_extendedprice"))
    base = d.select(F.col("l_orderkey").alias("group_id"), F.lit(0).alias("batch"), F.col("l_linenumber").alias("field_id"), F.lit("stated").alias("status"), F.col("v").alias("value"), F.col("ex").alias("excerpt"),
                    F.when(F.col("l_discount") < 0.05, F.concat(F.lit("Passage says, "), "v")).otherwise(F.concat(F.lit("passage tells "), "p_name")).alias("quote"), "l_tax", "v", "p_name")
    exc = base.filter("l_tax <= 0.06").groupBy("group_id", "batch", "excerpt").agg(F.lit("u").alias("url"), F.lit("official").alias("source_type"),
                                                                                  F.first(F.concat(F.lit("The passage says "), "v", F.lit(" "), "p_name", F.lit(" is fine."))).alias("text"))
    want = base.filter("field_id <= 5").select("group_id", "batch", "field_id").distinct()
    r = responses.extract_checks(base.select("group_id", "batch", "field_id", "status", "value", "excerpt", "quote"), exc, want)
    return r.groupBy("group_id", "field_id", F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query("complete_batches", """
SELECT o_orderkey AS group_id, 3::BIGINT AS asked, coalesce(good = 3 AND got = 3, FALSE) AS complete FROM orders LEFT JOIN (
 SELECT l_orderkey, count(*) FILTER (l_linenumber <= 3 AND c = 1) AS good, count(*) AS got FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1) ON l_orderkey = o_orderkey""")
def complete_batches(spark, sf):
    w = table(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), F.lit(0).alias("batch"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("field_id"))
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.lit(0).alias("batch"), F.col("l_linenumber").alias("field_id"))
    return responses.complete_batches(r, w).select("group_id", "asked", "complete")


@query("stance_label_check", """SELECT o_orderkey AS term, coalesce(got = 2 AND d = 2 AND lo = 1 AND hi = 2, FALSE) AS labels_ok FROM orders LEFT JOIN (
 SELECT l_orderkey, count(*) AS got, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def stance_label_check(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("term"), F.lit(2).alias("n"))
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("term"), F.col("l_linenumber").alias("i"), F.lit("neutral").alias("stance"))
    return responses.stance_label_check(r, asked).select("term", "labels_ok")


@query("stand_in_verdicts", """
SELECT p_partkey, CASE WHEN len(w) > 0 AND hits >= greatest(1, len(w) // 2) THEN 'supported' ELSE 'unsupported' END AS verdict FROM (SELECT *, len([x FOR x IN w IF contains(q, x)]) AS hits FROM (
 SELECT p_partkey, [x FOR x IN string_split(p_name || ' ' || lower(p_type), ' ') IF length(x) > 3] AS w, CASE WHEN p_size % 2 = 0 THEN p_name ELSE lower(p_type) END AS q FROM part))""")
def stand_in_verdicts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", responses.stand_in_verdict(F.concat_ws(" ", "p_name", "p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type"))).alias("verdict"))


@query("draft_routes", """
SELECT p_partkey AS term, CASE WHEN p_size > 40 THEN 'failed' WHEN p_size > 30 THEN 'rejected' WHEN p_size % 5 = 0 OR (p_size % 3 = 0) THEN 'failed' ELSE 'accepted' END AS route, p_size < 5 AS low_evidence FROM part""")
def draft_routes(spark, sf):
    """Drafts of every part: none above size 40, not relevant above 30; every fifth names an unknown feature, every third lacks senses."""
    p = table(spark, sf, "part")
    feat = lambda f: F.struct(f.alias("feature"), F.lit("x").alias("value"))
    sense = F.struct(F.lit("g").alias("gloss"), F.array(feat(F.when(F.col("p_size") % 5 == 0, "nope").otherwise("topic.1"))).alias("features"))
    d = p.filter("p_size <= 40").select(F.col("p_partkey").alias("term"), F.when(F.col("p_size") > 30, "not_relevant").otherwise("church_vocabulary").alias("relevance"),
                                        F.when(F.col("p_size") % 3 == 0, F.array(F.lit("polysemous"))).otherwise(F.array(F.lit("descriptive"))).alias("term_types"), F.array(sense).alias("senses"),
                                        F.array(F.lit("a")).alias("neutral_options"), F.lit("why?").alias("disambiguation_question"))
    known = spark.createDataFrame([("topic.1",)], "feature string")
    r = p.select(F.col("p_partkey").alias("term"), F.col("p_partkey").alias("rank"), F.col("p_size").alias("count"))
    return responses.route_drafts(r, responses.draft_errors(known, d)).select("term", "route", "low_evidence")


@query("fact_rows", """
SELECT site, label, value FROM (SELECT l_suppkey AS site, p_name AS label, lower(p_type) AS value, l_orderkey * 10 + l_linenumber AS seq, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount < 0.05)
QUALIFY row_number() OVER (PARTITION BY site, label, value ORDER BY seq) = 1""")
def fact_rows(spark, sf):
    p = table(spark, sf, "part")
    pages = p.select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.concat(F.lit("We   make "), "p_name", F.lit(" here.")).alias("text"))
    li = table(spark, sf, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    items = li.select(F.col("l_suppkey").alias("site"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.col("p_name").alias("label"), F.lower("p_type").alias("value"),
                      F.when(F.col("l_discount") < 0.05, F.concat(F.lit("we make "), "p_name")).otherwise(F.lit("we sell")).alias("quote"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return responses.fact_rows(items, pages).select("site", "label", "value")


@query("staff_rows", """SELECT DISTINCT l_suppkey AS site, p_name AS name, 'maker' AS position FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_tax < 0.04""")
def staff_rows(spark, sf):
    p = table(spark, sf, "part")
    pages = p.select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.concat(F.lit("Our Maker is "), F.upper("p_name"), F.lit(" today.")).alias("text"))
    li = table(spark, sf, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    items = li.select(F.col("l_suppkey").alias("site"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.col("p_name").alias("name"),
                      F.lit("maker").alias("position"), F.when(F.col("l_tax") < 0.04, F.concat(F.lit("maker is "), "p_name")).otherwise(F.concat(F.lit("is "), "p_name")).alias("quote"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return responses.staff_rows(items, pages).select("site", "name", "position")


@query("area_reports", """
SELECT o_orderkey AS session_id, coalesce(missing, 0) AS missing, o_orderstatus <> 'F' OR (n > 0 AND coalesce(missing, 0) = 0) AS accepted FROM (
 SELECT o_orderkey, o_orderstatus, count(l_partkey) AS n, count(DISTINCT l_partkey) FILTER (l_partkey IS NOT NULL AND l_suppkey % 2 = 1 AND NOT f) AS missing FROM orders LEFT JOIN (
   SELECT *, bool_or(l_suppkey % 2 = 0) OVER (PARTITION BY l_orderkey, l_partkey) AS f FROM lineitem) ON l_orderkey = o_orderkey GROUP BY ALL)""")
def area_reports(spark, sf):
    li = table(spark, sf, "lineitem")
    urls = li.groupBy(F.col("l_orderkey").alias("session_id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("urls"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), F.lit("staff").alias("area"), F.when(F.col("o_orderstatus") == "F", "supported").otherwise("partial").alias("status"))
    rep = o.join(urls, "session_id", "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))
    fetched = li.filter("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").cast("string").alias("url"))
    return responses.area_reports(rep, fetched).select("session_id", "missing", "accepted")


# ---------------------------------------------------------------- vectors
cte("means", """
SELECT term, label, list(x ORDER BY i) AS v FROM (SELECT vec_id % 5 AS term, label, i, avg(x::DOUBLE) AS x, count(*) AS n FROM (
 SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) WHERE n >= 5 GROUP BY ALL""")


@query("cluster_drift", """
SELECT term, round(greatest(0.0, max(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9))), 6) AS drift
FROM means a JOIN means b USING (term) WHERE a.label <> b.label GROUP BY term""", ("means",))
def cluster_drift(spark, sf):
    d = table(spark, sf, "embeddings").withColumn("term", F.col("vec_id") % 5)
    return signals.group_drift(d, "term", "label").select("term", rounded(F.col("drift"), 6).alias("drift"))


@query("cluster_nmi", """
WITH j AS (SELECT vec_id % 3 AS term, label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT term, sum(n) AS nn FROM j GROUP BY term),
 ha AS (SELECT term, sum(-(n / nn) * ln(n / nn)) AS h FROM (SELECT term, a, sum(n) AS n FROM j GROUP BY ALL) JOIN t USING (term) GROUP BY term),
 hb AS (SELECT term, sum(-(n / nn) * ln(n / nn)) AS h FROM (SELECT term, b, sum(n) AS n FROM j GROUP BY ALL) JOIN t USING (term) GROUP BY term),
 hab AS (SELECT term, sum(-(n / nn) * ln(n / nn)) AS h FROM j JOIN t USING (term) GROUP BY term)
SELECT term, round((ha.h + hb.h - hab.h) / ((ha.h + hb.h) / 2), 6) AS nmi FROM ha JOIN hb USING (term) JOIN hab USING (term)""")
def cluster_nmi(spark, sf):
    d = table(spark, sf, "embeddings").select((F.col("vec_id") % 3).alias("term"), F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b"))
    return signals.normalized_mutual_information(d, ["term"], "a", "b").select("term", rounded(F.col("nmi"), 6).alias("nmi"))


@query("centroid_cosine", """
WITH c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 6) AS cosine FROM embeddings JOIN c USING (label)""")
def centroid_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    m = signals.mean_vectors(e, ["label"]).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "mean"))), lambda s: s["mean"]).alias("v"))
    return e.join(m, "label").select("vec_id", rounded(signals.cosine(F.col("embedding"), F.col("v")), 6).alias("cosine"))


cte("vector_points", f"SELECT 0 AS term, vec_id AS item, list_transform(embedding, lambda v: floor(v::DOUBLE * {senses.SCALE} + 0.5)) AS x FROM embeddings WHERE embedding IS NOT NULL")
for _name, _body, _needs in senses.sql_clusters("vector", "vector_points", [10]):
    cte(_name, _body, *_needs)


@query("kmeans_purity", """
SELECT cluster, sum(n)::BIGINT AS size, arg_min(label, (-n, label)) AS top_category, round(max(n) / sum(n), 6) AS purity, count(*) AS categories FROM (
 SELECT cluster, label, count(*) AS n FROM vector_labels JOIN embeddings ON vec_id = item GROUP BY ALL) GROUP BY cluster""", ("vector_labels",))
def kmeans_purity(spark, sf):
    """Clusters of all vectors against their labels."""
    e = table(spark, sf, "embeddings")
    d = senses.corpus_clusters(e, "vec_id").join(e.select("vec_id", "label"), "vec_id")
    return signals.cluster_purity(d, "cluster", "label").select(F.col("cluster").cast("long").alias("cluster"), F.col("size").cast("long").alias("size"), "top_category", rounded(F.col("purity"), 6).alias("purity"), "categories")


@query("purity_by_cluster", """
SELECT cluster, sum(n)::BIGINT AS size, arg_min(label, -n * 100 + label) AS top_category, round(max(n) / sum(n), 6) AS purity FROM (SELECT vec_id % 6 AS cluster, label, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY cluster""")
def purity_by_cluster(spark, sf):
    d = table(spark, sf, "embeddings").withColumn("cluster", F.col("vec_id") % 6)
    return signals.cluster_purity(d, "cluster", "label").select("cluster", "size", "top_category", rounded(F.col("purity"), 6).alias("purity"))


@query("hash_embeddings", """
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[''-][a-z0-9]+)*')) AS tok FROM benchmark),
 s AS (SELECT item_id, ('0x' || substr(md5(tok), 31, 2))::INT % 64 AS idx, sum(CASE WHEN ('0x' || substr(md5(tok), 29, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM t GROUP BY ALL)
SELECT item_id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM s WHERE v <> 0""")
def hash_embeddings(spark, sf):
    e = table(spark, sf, "benchmark").select("item_id", signals.hash_embedding(X.tokens(F.col("text")), 64).alias("v"))
    return e.select("item_id", F.posexplode("v").alias("idx", "value")).filter("value <> 0").withColumn("value", rounded(F.col("value"), 6))


# ---------------------------------------------------------------- recordings and episodes
VOCAB = [("women.preach", ["regularly", "occasionally", "never"]), ("preaching.politics_frequency", ["frequent", "occasional", "rare"]),
         ("logistics.sermon_length", ["under_20", "20_35", "over_35"]), ("preaching.style", ["F", "O"])]


@query("sermon_evidence", """
WITH a AS (SELECT l_suppkey AS c, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq, l_returnflag AS g, l_quantity AS m, l_linestatus AS st, CASE WHEN l_discount > 0.07 THEN l_linenumber ELSE 0 END AS p FROM lineitem),
 base AS (SELECT c, count(*) AS n, count(*) FILTER (g IN ('A', 'N')) AS known, count(*) FILTER (g = 'A') AS fem, avg(p) AS pol, count(*) FILTER (p > 0) AS men FROM a GROUP BY c),
 len AS (SELECT c, arg_min(b, -k * 1e15 + f) AS top, max(k) AS k, sum(k)::BIGINT AS n FROM (SELECT c, CASE WHEN m < 20 THEN 'under_20' WHEN m <= 35 THEN '20_35' ELSE 'over_35' END AS b, count(*) AS k, min(seq) / 1e7 AS f FROM a GROUP BY ALL) GROUP BY c),
 med AS (SELECT c, list_sort(list(m))[len(list(m)) // 2 + 1] AS med FROM a GROUP BY c),
 sty AS (SELECT c, arg_min(st, -k * 1e15 + f) AS top, max(k) AS k, sum(k)::BIGINT AS n FROM (SELECT c, st, count(*) AS k, min(seq) / 1e7 AS f FROM a GROUP BY ALL) GROUP BY c)
SELECT c AS church_id, 'women.preach' AS feature, CASE WHEN fem = 0 THEN 'never' WHEN fem >= greatest(1, known // 2) THEN 'regularly' ELSE 'occasionally' END AS value,
  fem || ' of ' || known || ' sermons with an identifiable speaker were preached by women' AS note FROM base WHERE known >= 5
UNION ALL SELECT c, 'preaching.politics_frequency', CASE WHEN pol >= 2 THEN 'frequent' WHEN pol >= 0.5 THEN 'occasional' ELSE 'rare' END, men || ' of ' || n || ' sermons mentioned politics or current events' FROM base
UNION ALL SELECT c, 'logistics.sermon_length', top, k || ' of ' || n || ' sermons; median ' || med::INT || ' min' FROM len JOIN med USING (c)
UNION ALL SELECT c, 'preaching.style', top, k || ' of ' || n || ' sermons ' || top FROM sty""")
def sermon_evidence(spark, sf):
    a = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("church_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("seq"),
        F.when(F.col("l_returnflag") == "A", "female").when(F.col("l_returnflag") == "N", "male").otherwise("unknown").alias("speaker_gender"), F.col("l_quantity").alias("minutes"),
        F.col("l_linestatus").alias("style"), F.lit(None).cast("string").alias("audience"), F.lit(None).cast("string").alias("scripture_density"),
        F.when(F.col("l_discount") > 0.07, F.col("l_linenumber")).otherwise(0).alias("politics_mentions"))
    voc = spark.createDataFrame(VOCAB, "feature string, values array<string>")
    return sermons.observed_evidence(a, voc).select("church_id", "feature", "value", "note")


@query("step_throughput", """SELECT event_type AS action, count(*) AS steps, round(sum(value), 4) AS audio_minutes, round(sum(value) / (sum((props->>'$.k')::BIGINT * 1000) / 60000), 4) AS throughput FROM events GROUP BY 1""")
def step_throughput(spark, sf):
    d = table(spark, sf, "events").select(F.col("event_type").alias("action"), F.col("value").alias("audio_minutes"), (F.get_json_object("props", "$.k").cast("long") * 1000).alias("wall_ms"))
    return sermons.throughput(d).select("action", "steps", rounded(F.col("audio_minutes"), 4).alias("audio_minutes"), rounded(F.col("throughput"), 4).alias("throughput"))


def episodes(spark, sf):
    """Orders as episodes of customers' nations, newest first; price gives the length."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return o.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source"), F.col("o_orderkey").alias("episode"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
                    (-F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1_000_000 + F.col("o_orderkey")).alias("ord"), (F.col("o_totalprice") / 25).alias("duration"),
                    F.when(F.col("o_orderpriority") == "5-LOW", "bonus").otherwise("full").alias("type"), F.lit(True).alias("has_media"), F.concat(F.lit("Part "), "o_orderstatus").alias("title"))


cte("episodes", """SELECT 'n' || c_nationkey AS source, o_orderkey AS episode, o_orderdate::DATE AS d, o_totalprice / 25 AS duration FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderpriority <> '5-LOW' AND o_totalprice / 25 BETWEEN 480 AND 14400""")
_day = lambda: F.floor(F.col("ord") / 86_400_000_000 / 30)


@query("episode_latest", "SELECT source, episode FROM episodes QUALIFY row_number() OVER (PARTITION BY source ORDER BY d DESC, episode) <= 12", ("episodes",))
def episode_latest(spark, sf):
    return corpus.pick_episodes(corpus.eligible_episodes(episodes(spark, sf)), F.lit(12), _day(), "latest").select("source", "episode")


@query("episode_spread", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d DESC, episode) - 1 AS r, count(*) OVER (PARTITION BY source) AS n_ok,
   d >= max(d) OVER (PARTITION BY source) - 365 AS recent FROM episodes),
 f AS (SELECT *, count(*) FILTER (recent) OVER (PARTITION BY source) AS y FROM e),
 pool AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM f
   WHERE n_ok <= 12 OR CASE WHEN y >= 12 THEN recent ELSE r < greatest(12, y) END),
 grid AS (SELECT DISTINCT source, round_even(i * (n - 1) / 11, 0)::BIGINT AS p FROM (SELECT DISTINCT source, n FROM pool), range(12) r(i))
SELECT source, episode FROM pool WHERE n_ok <= 12 OR (source, p) IN (SELECT (source, p) FROM grid)""", ("episodes",))
def episode_spread(spark, sf):
    return corpus.pick_episodes(corpus.eligible_episodes(episodes(spark, sf)), F.lit(12), _day(), "spread").select("source", "episode")


@query("source_quota", """SELECT s_suppkey, greatest(2, least(30, ceil(60 / count(*) OVER (PARTITION BY s_nationkey))))::BIGINT AS quota FROM supplier""")
def source_quota(spark, sf):
    return corpus.source_quota(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", 60, 2, 30).select("s_suppkey", "quota")


def _chunk_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"), "source", F.posexplode(X.word_windows(F.col("text"), 60, 0, 1)).alias("no", "text"))
    d = d.select("doc_id", "no", "label", "source", F.size(X.words(F.col("text"))).cast("long").alias("words"), (F.col("doc_id") * 10000 + F.col("no")).alias("ord"), F.concat_ws("|", "label", "source").alias("queue"))
    r = corpus.interleave(d.withColumnRenamed("source", "src").withColumnRenamed("queue", "source"), F.col("src"), [F.col("ord")], F.floor(F.col("ord") / 5_000_000))
    return r


cte("chunk_rows", r"""
SELECT *, row_number() OVER (PARTITION BY label, src ORDER BY ord) AS pass_no FROM (SELECT doc_id, i // 60 AS no, label, src, least(60, n - i) AS words, doc_id * 10000 + i // 60 AS ord FROM (
 SELECT doc_id, lang AS label, source AS src, len(w) AS n, unnest(range(0, len(w), 60)) AS i FROM (SELECT *, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS w FROM documents)))
""")


@query("interleaved_chunks", "SELECT doc_id, no::BIGINT AS no, label, pass_no FROM chunk_rows", ("chunk_rows",))
def interleaved_chunks(spark, sf):
    return _chunk_rows(spark, sf).select("doc_id", F.col("no").cast("long").alias("no"), "label", "pass_no")


cte("capped", """SELECT * FROM (SELECT *, coalesce(sum(words) OVER (PARTITION BY label ORDER BY pass_no, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunk_rows) WHERE before < 20000""", "chunk_rows")


@query("word_capped_corpus", "SELECT label, doc_id, no::BIGINT AS no FROM capped", ("capped",))
def word_capped_corpus(spark, sf):
    return corpus.cap_words(_chunk_rows(spark, sf), "label", 20000, 4).select("label", "doc_id", F.col("no").cast("long").alias("no"))


@query("corpus_report", """SELECT label, count(DISTINCT doc_id) AS items, count(DISTINCT src) AS sources, sum(words)::BIGINT AS words, count(*) AS chunks, count(DISTINCT doc_id) FILTER (doc_id % 3 = 0) AS video_items FROM capped GROUP BY label""", ("capped",))
def corpus_report(spark, sf):
    d = corpus.cap_words(_chunk_rows(spark, sf), "label", 20000, 4)
    d = d.select("label", F.col("doc_id").alias("item"), F.col("src").alias("source"), "words", F.when(F.col("doc_id") % 3 == 0, "youtube").otherwise("podcast").alias("source_type"))
    return corpus.corpus_report(d, "label")


@query("sentence_packs")
def sentence_packs(spark, sf):
    """Whole documents packed into sentence chunks of 60 words and labelled by hash; a fold, so tested against a plain loop."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return corpus.chunk_posts(d, 60, 0.25).select("doc_id", "chunk_no", "id", "words", "side")


@query("duration_parse", """SELECT o_orderkey, ((o_orderkey % 5) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59)::DOUBLE AS seconds FROM orders""")
def duration_parse(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", X.duration_seconds(F.format_string("%d:%02d:%02d", k % 5, k % 60, k % 59)).alias("seconds"))


@query("slugs", r"""SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer""")
def slugs(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"))


@query("source_ids", "SELECT page_id, substr(sha1(url), 1, 16) AS id, sha256(url) AS text_hash FROM pages")
def source_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.substring(F.sha1("url"), 1, 16).alias("id"), F.sha2("url", 256).alias("text_hash"))


cte("hint_terms", r"""SELECT DISTINCT array_to_string(w[1:2], ' ') AS term FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) WHERE len(w) >= 2
UNION SELECT DISTINCT unnest(w) FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)""")


@query("term_hints", r"""
SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY length(term) DESC, term) AS rank, term FROM (
 SELECT DISTINCT message_id, term FROM (SELECT conv_id * 1000 + turn AS message_id, lower(text) AS low, unnest(list_distinct(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]))) AS run FROM (
   SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations)) m JOIN hint_terms ON term = run WHERE regexp_matches(low, '(^|[^a-z])' || term || '([^a-z]|$)')) QUALIFY rank <= 8""", ("hint_terms",))
def term_hints(spark, sf):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    b = table(spark, sf, "benchmark").select(w.alias("w"))
    t = b.select(F.explode("w").alias("term")).union(b.filter(F.size("w") >= 2).select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))))).distinct().withColumn("alias", F.col("term"))
    m = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text")
    return lexicon.hints(m, t, 8).select("message_id", F.col("rank").cast("long").alias("rank"), "term")


# ---------------------------------------------------------------- small rules over whole tables
@query("rule_steps", """
SELECT o_orderkey, CASE WHEN x >= 100 THEN 0.9 WHEN x >= 88 THEN 0.8 WHEN x >= 85 THEN 0.6 WHEN x >= 70 THEN 0.3 ELSE 0.2 END AS confidence,
 CASE WHEN k < 0.4 THEN 'unknown' WHEN x >= 70 THEN 'strong' WHEN x >= 58 THEN 'possible' WHEN x >= 45 THEN 'unlikely' ELSE 'poor' END AS fit,
 CASE WHEN x < 20 THEN 'under_20' WHEN x <= 35 THEN '20_35' ELSE 'over_35' END AS length_bucket, CASE o_orderstatus WHEN 'F' THEN 0.15 WHEN 'O' THEN 0.5 ELSE 0.3 END AS variability,
 o_orderstatus = 'P' AS is_unknown, 'Town ' || o_custkey AS city, CASE WHEN o_orderkey % 2 = 0 THEN 'https://a.org/' || o_orderkey ELSE '' END AS link, x AS points
FROM (SELECT *, floor(o_totalprice)::BIGINT % 120 AS x, (o_orderkey % 10) / 10 AS k FROM orders)""")
def rule_steps(spark, sf):
    x, k = F.floor("o_totalprice") % 120, (F.col("o_orderkey") % 10) / 10
    cell = F.when(F.col("o_orderstatus") == "F", "Low everywhere").when(F.col("o_orderstatus") == "O", "HIGH").otherwise(" N/A ")
    return table(spark, sf, "orders").select(
        "o_orderkey", R.score_confidence(x).alias("confidence"), R.fit_label(x, k).alias("fit"), R.length_bucket(x).alias("length_bucket"), R.variability(cell).alias("variability"),
        R.is_unknown_cell(cell).alias("is_unknown"), R.city_of(F.concat(F.lit("1 Main St, Town "), F.col("o_custkey").cast("string"), F.lit(", KS 67062"))).alias("city"),
        U.safe_link(F.concat(F.when(F.col("o_orderkey") % 2 == 0, " https://a.org/").otherwise("javascript:"), F.col("o_orderkey").cast("string"))).alias("link"),
        R.data_points(F.concat(F.lit("3 of "), x.cast("string"), F.lit(" seen"))).cast("long").alias("points"))


@query("ladder_preferences", """
SELECT c_custkey AS session_id, f AS feature, CASE WHEN mode IS NULL OR step IS NULL THEN '' WHEN pos <= step AND mode IN ('minimum', 'both') THEN CASE WHEN f = 'women.preach' THEN 'regularly,occasionally' ELSE 'yes' END
 WHEN pos > step AND mode IN ('maximum', 'both') THEN CASE WHEN f = 'women.preach' THEN 'never' ELSE 'no' END ELSE '' END AS want
FROM (SELECT c_custkey, CASE WHEN c_custkey % 8 < 7 THEN c_custkey % 8 END AS step, CASE c_custkey % 4 WHEN 0 THEN 'minimum' WHEN 1 THEN 'maximum' WHEN 2 THEN 'both' END AS mode FROM customer),
 (VALUES (1, 'women.deacon'), (2, 'women.teach_mixed_adults'), (3, 'women.preach'), (4, 'women.pastor_other'), (5, 'women.elder'), (6, 'women.senior_pastor')) v(pos, f)""")
def ladder_preferences(spark, sf):
    from tessera.operators import profiles
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), pick(list("abcdefg"), F.col("c_custkey") % 8).alias("rung"), pick(["minimum", "maximum", "both"], F.col("c_custkey") % 4).alias("mode"))
    return profiles.ladder_preferences(a).select("session_id", "feature", F.array_join("want", ",").alias("want"))


@query("link_rules", """
SELECT o_orderkey, CASE k WHEN 0 THEN lpad(o_orderkey::VARCHAR, 11, 'a') WHEN 1 THEN lpad(o_orderkey::VARCHAR, 11, 'b') END AS video, CASE k WHEN 0 THEN 'page' WHEN 1 THEN 'youtube' WHEN 2 THEN 'rss' WHEN 3 THEN 'page' END AS feed, k = 4 AS blocked, k <> 5 AS public
FROM (SELECT *, o_orderkey % 6 AS k FROM orders)""")
def link_rules(spark, sf):
    k, n = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    u = (F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(n, 11, "a"))).when(k == 1, F.concat(F.lit("https://youtu.be/"), F.lpad(n, 11, "b"), F.lit("?t=3")))
         .when(k == 2, F.concat(F.lit("https://a.org/"), n, F.lit("/feed"))).when(k == 3, F.concat(F.lit("https://a.org/sermons/"), n)).when(k == 4, F.concat(F.lit("https://a.org/give/"), n))
         .otherwise(F.concat(F.lit("http://192.168.0.7/"), n)))
    return table(spark, sf, "orders").select("o_orderkey", U.video_id(u).alias("video"), U.feed_kind(u, F.lit("")).alias("feed"), U.is_blocked(u).alias("blocked"), U.is_public(u).alias("public"))


@query("topic_counts", """SELECT topic, count(*) AS n FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'definition settles another feature' ELSE 'fine' END AS topic FROM lineitem) GROUP BY topic""")
def topic_counts(spark, sf):
    """The topic-scope rule over every line item: even lines quote a definition for a feature it cannot settle."""
    quote = F.when(F.col("l_linenumber") % 2 == 0, "a union of one man and one woman").otherwise("all members may serve")
    r = R.topic_scope_reason(F.lit("lgbtq.inclusion"), F.lit("full"), quote)
    return table(spark, sf, "lineitem").groupBy(F.coalesce(r, F.lit("fine")).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- screens and message rules
PLACE_ENDS = ["Baptist Church", "Kingdom Hall", "Church of Jesus Christ of Latter-day Saints", "Chapel", "Unitarian Fellowship", "Community Church", "LDS Ward", "Unity Church"]
PLACE_GROUPS = ["lds", "sbc", "jw", "umc", "pcusa", "elca"]
cte("places", f"""SELECT c_custkey AS church_id, c_name || ' ' || {PLACE_ENDS}[c_custkey % 8 + 1] AS name, CASE WHEN c_custkey % 11 < 6 THEN {PLACE_GROUPS}[c_custkey % 11 + 1] END AS group_id FROM customer""")


@query("screened_places", f"""SELECT church_id, name, group_id FROM places WHERE NOT regexp_matches(name, '{V.NON_MEMBER_NAME}') AND NOT coalesce(group_id IN {tuple(V.NON_MEMBER_IDS)}, FALSE)""", ("places",))
def screened_places(spark, sf):
    """Candidates that neither their name nor their group screens out."""
    from tessera.operators import names
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("church_id"), F.concat_ws(" ", "c_name", pick(PLACE_ENDS, k % 8)).alias("name"), F.when(k % 11 < 6, pick(PLACE_GROUPS, k % 11)).alias("group_id"))
    return names.without_non_members(p).select("church_id", "name", "group_id")


MESSAGES = ["it must be protestant", "only protestant for us", "protestant if possible", "we like hymns", "strictly Protestant please"]
cte("branch_ops", f"""SELECT event_id // 3 AS t, event_id, CASE WHEN event_id % 3 < 2 THEN 'identity.branch' ELSE 'worship.style' END AS key, event_type AS val, CASE WHEN event_id % 2 = 0 THEN 'want' ELSE 'avoid' END AS stance,
 {MESSAGES}[(event_id // 3) % 5 + 1] AS text FROM events""")


@query("branch_rule", f"""
WITH s AS (SELECT *, regexp_matches(text, '{V.EXCLUSIVE_BRANCH}') AS strict FROM branch_ops)
SELECT t, 'assert' AS op, key, val AS vals, stance, 0.5::DOUBLE AS strength FROM s WHERE NOT (strict AND key = 'identity.branch')
UNION ALL SELECT t, 'revise', 'identity.branch', v, st, 0.9::DOUBLE FROM (SELECT DISTINCT t FROM s WHERE strict), (VALUES ('{','.join(V.PROTESTANT_BRANCHES)}', 'want'), ('{','.join(V.OTHER_BRANCHES)}', 'avoid')) b(v, st)""", ("branch_ops",))
def branch_rule(spark, sf):
    """Messages that insist on one branch become one wanted and one avoided list."""
    from tessera.operators import profiles
    e, i = table(spark, sf, "events"), F.col("event_id")
    t = F.floor(i / 3)
    ops = e.select(t.alias("t"), F.lit("assert").alias("op"), F.when(i % 3 < 2, "identity.branch").otherwise("worship.style").alias("key"), F.array("event_type").alias("vals"),
                   F.when(i % 2 == 0, "want").otherwise("avoid").alias("stance"), F.lit(0.5).alias("strength"), F.lit("stated").alias("src"), F.lit("said").alias("ev"), pick(MESSAGES, t % 5).alias("text"))
    return profiles.exclusive_branch_ops(ops).select("t", "op", "key", F.array_join("vals", ",").alias("vals"), "stance", "strength")
