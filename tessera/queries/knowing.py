"""Registered queries: knowledge table, retrieval, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import rules as R
from tessera.functions import text as X
from tessera.functions.columns import rounded
from tessera.operators import evidence as E
from tessera.operators import knowledge as K
from tessera.operators import names, responses, retrieval
from tessera.queries.facts import evidence
from tessera.queries.registry import cte, query, table

LAYERS = ["identity", "history", "theology", "governance", "practice_culture", "distinguishing_metadata"]
SPECIAL = {6: "practice_culture.abortion", 7: "identity.primary_family", 8: "identity.canonical_name", 9: "theology.afterlife"}


def _field(b):
    layer = F.get(F.array(*[F.lit(x) for x in LAYERS]), (b % 6).cast("int"))
    out = F.concat(layer, F.lit(".t"), b.cast("string"))
    for k, v in SPECIAL.items():
        out = F.when(b == k, v).otherwise(out)
    return out


FIELD_SQL = "CASE b " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SPECIAL.items()) + f" ELSE {LAYERS}[b % 6 + 1] || '.t' || b END"
FIELD_IDS = [SPECIAL.get(b, f"{LAYERS[b % 6]}.t{b}") for b in range(1, 26)]
_brand = lambda: F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")


def fields(spark, sf):
    f = _field(F.col("b"))
    d = table(spark, sf, "part").select(_brand().alias("b")).distinct()
    return d.select(f.alias("field_id"), F.substring_index(f, ".", 1).alias("layer"), F.substring_index(f, ".", -1).alias("subtopic"),
                    F.concat(F.lit("Description "), "b").alias("description"))


cte("fields", f"""SELECT field_id, split_part(field_id, '.', 1) AS layer, split_part(field_id, '.', 2) AS subtopic, 'Description ' || b AS description
FROM (SELECT b, {FIELD_SQL} AS field_id FROM (SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1)::INT AS b FROM part))""")


def _lines(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), _brand().alias("b"), F.lower("p_type").alias("v"), "p_name")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).cast("int").alias("pr"))
    return table(spark, sf, "lineitem").join(p, "l_partkey").join(o, "l_orderkey").withColumn("group_id", F.concat(F.lit("s"), "l_suppkey"))


def cells(spark, sf):
    q = F.sum("l_quantity").cast("long")
    return _lines(spark, sf).groupBy("group_id", "b").agg(F.when(q % 3 == 0, "Unknown").otherwise(F.max("v")).alias("value")).select(
        "group_id", _field(F.col("b")).alias("field_id"), "value")


cte("kb_lines", """SELECT l.*, regexp_extract(p_brand, '(\\d+)', 1)::INT AS b, lower(p_type) AS v, p_name, substr(o_orderpriority, 1, 1)::INT AS pr, 's' || l_suppkey AS group_id
FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey""")
cte("cells", f"""SELECT group_id, {FIELD_SQL} AS field_id, value FROM (
 SELECT group_id, b, CASE WHEN sum(l_quantity)::BIGINT % 3 = 0 THEN 'Unknown' ELSE max(v) END AS value FROM kb_lines GROUP BY ALL)""", "kb_lines")


def proposals(spark, sf):
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i)
    d = _lines(spark, sf)
    action = F.when(F.col("l_returnflag") == "A", "fill").when(F.col("l_returnflag") == "R", "not_applicable").when(F.col("l_linestatus") == "O", "confirm").otherwise("conflict")
    verdict = F.when(F.col("l_linenumber") <= 2, "supported").when(F.col("l_linenumber") == 3, "partial").when(F.col("l_linenumber") == 4, "unsupported")
    return d.select("group_id", _field(F.col("b")).alias("field_id"), action.alias("action"), F.concat_ws(" ", "v", "p_name").alias("new_value"), F.col("p_name").alias("quote"),
                    F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("https://site"), F.col("pr").cast("string"), F.lit(".example.org/p/"), F.col("l_partkey").cast("string"))).alias("url"),
                    pick(["official", "register", "wikipedia", "wikidata", "classification"], F.col("pr") - 1).alias("source_type"), verdict.alias("verdict"),
                    F.when(verdict.isNotNull(), F.concat(F.lit("m"), F.col("pr").cast("string"))).alias("verify_model"), F.when(verdict.isNotNull(), "v1").alias("verify_version"),
                    F.when(F.col("l_discount") == 0, "accept").when(F.col("l_discount") == 0.1, "reject").otherwise("").alias("human_decision"),
                    F.lit("medium").alias("confidence"), F.col("l_shipdate").cast("timestamp").alias("checked_at"),
                    ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("seq"))


cte("proposals", f"""SELECT group_id, {FIELD_SQL} AS field_id,
 CASE WHEN l_returnflag = 'A' THEN 'fill' WHEN l_returnflag = 'R' THEN 'not_applicable' WHEN l_linestatus = 'O' THEN 'confirm' ELSE 'conflict' END AS action,
 v || ' ' || p_name AS new_value, p_name AS quote, CASE WHEN l_linenumber = 7 THEN '' ELSE 'https://site' || pr || '.example.org/p/' || l_partkey END AS url,
 ['official', 'register', 'wikipedia', 'wikidata', 'classification'][pr] AS source_type,
 CASE WHEN l_linenumber <= 2 THEN 'supported' WHEN l_linenumber = 3 THEN 'partial' WHEN l_linenumber = 4 THEN 'unsupported' END AS verdict,
 CASE WHEN l_discount = 0 THEN 'accept' WHEN l_discount = 0.1 THEN 'reject' ELSE '' END AS human_decision, 'm' || pr AS verify_model, l_shipdate AS checked_at,
 (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq FROM kb_lines""", "kb_lines")
SENS = ", ".join(f"'{x}'" for x in V.SENSITIVE_FIELDS)
APPLIED_SQL = f"""CASE WHEN human_decision = 'accept' THEN TRUE WHEN human_decision = 'reject' THEN FALSE WHEN field_id IN ({SENS}) AND action IN ('fill', 'conflict') THEN FALSE
 WHEN action NOT IN ('fill', 'confirm', 'conflict') OR source_type = 'wikidata' THEN TRUE ELSE verdict IS NULL OR verdict = 'supported' END"""
cte("applied", f"SELECT * FROM proposals WHERE {APPLIED_SQL}", "proposals")


def applied(spark, sf):
    return proposals(spark, sf).filter(K.is_applied())


def groups(spark, sf):
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("group_id"), F.col("s_name").alias("census_name"), F.col("s_name").alias("name"),
                                               F.col("s_acctbal").alias("adherents"))


@query("kb_applied", f"""SELECT field_id, action, source_type, {APPLIED_SQL} AS applied, count(*) AS n FROM proposals GROUP BY ALL""", ("proposals",))
def kb_applied(spark, sf):
    return proposals(spark, sf).groupBy("field_id", "action", "source_type", K.is_applied().alias("applied")).agg(F.count(F.lit(1)).alias("n"))


@query("kb_needs_check", """SELECT group_id, count(*) AS n FROM proposals WHERE action IN ('fill', 'confirm', 'conflict') AND source_type <> 'wikidata'
 AND (verdict IS NULL OR verify_model <> 'm1') GROUP BY group_id""", ("proposals",))
def kb_needs_check(spark, sf):
    return proposals(spark, sf).filter(K.needs_check("m1", "v1")).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


cte("merged_kb", """
SELECT c.group_id, c.field_id, coalesce(p.v, CASE WHEN c.value <> 'Unknown' THEN c.value END) AS value,
  coalesce(p.s, CASE WHEN c.value = 'Unknown' THEN 'unknown' ELSE 'unsourced' END) AS status, coalesce(p.n, 0) AS n_evidence
FROM cells c LEFT JOIN (SELECT group_id, field_id, count(*) AS n,
   arg_max(CASE WHEN action = 'fill' THEN new_value ELSE 'Not applicable' END, (checked_at, seq)) FILTER (action IN ('fill', 'not_applicable')) AS v,
   arg_max(CASE action WHEN 'fill' THEN 'model_extracted_needs_review' WHEN 'not_applicable' THEN 'not_applicable' WHEN 'confirm' THEN 'model_confirmed_needs_review' ELSE 'conflict_needs_review' END,
     (checked_at, seq)) AS s FROM applied GROUP BY ALL) p USING (group_id, field_id)
""", "cells", "applied")


@query("kb_merged", "SELECT * FROM merged_kb", ("merged_kb",))
def kb_merged(spark, sf):
    m = K.merged_table(groups(spark, sf), cells(spark, sf), applied(spark, sf))
    return m.select("group_id", "field_id", "value", "status", F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("n_evidence")).withColumn(
        "n_evidence", F.greatest("n_evidence", F.lit(0)))


@query("kb_layer_coverage", """
SELECT layer, cells, known_before, fill, not_applicable, confirm, conflict, known_before + fill + not_applicable AS known_after, round(known_before / cells, 6) AS share_before,
  round((known_before + fill + not_applicable) / cells, 6) AS share_after FROM
 (SELECT layer, count(*) AS cells, count(*) FILTER (value <> 'Unknown') AS known_before FROM cells JOIN fields USING (field_id) GROUP BY layer)
 JOIN (SELECT layer, count(*) FILTER (action = 'fill') AS fill, count(*) FILTER (action = 'not_applicable') AS not_applicable, count(*) FILTER (action = 'confirm') AS confirm,
   count(*) FILTER (action = 'conflict') AS conflict FROM applied JOIN fields USING (field_id) GROUP BY layer) USING (layer)""", ("cells", "fields", "applied"))
def kb_layer_coverage(spark, sf):
    d = K.layer_coverage(cells(spark, sf), fields(spark, sf), applied(spark, sf))
    return d.withColumn("share_before", rounded(F.col("share_before"), 6)).withColumn("share_after", rounded(F.col("share_after"), 6))


@query("kb_verification_report", f"""
SELECT action, source_type, count(verdict) AS checked, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'partial') AS partial,
 count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (action <> 'not_applicable' AND source_type <> 'wikidata' AND verdict IS NULL) AS unverified,
 count(*) FILTER (field_id IN ({SENS}) AND action IN ('fill', 'conflict') AND human_decision = '') AS held_back FROM proposals GROUP BY ALL""", ("proposals",))
def kb_verification_report(spark, sf):
    return K.verification_report(proposals(spark, sf))


@query("kb_group_status", """SELECT group_id, count(*) FILTER (action = 'fill') AS fill, count(*) FILTER (action = 'confirm') AS confirm, count(*) FILTER (action = 'conflict') AS conflict,
 count(*) FILTER (action = 'not_applicable') AS not_applicable FROM proposals GROUP BY group_id""", ("proposals",))
def kb_group_status(spark, sf):
    return K.group_status(proposals(spark, sf))


@query("kb_new_sources", """
SELECT 'dkb_' || substr(sha1(url), 1, 10) AS id, url AS title, url, CASE WHEN t IN ('official', 'register') THEN 'official_denomination' WHEN t = 'wikipedia' THEN 'encyclopedia'
 WHEN t = 'wikidata' THEN 'knowledge_graph' ELSE t END AS type FROM (SELECT url, arg_min(source_type, seq) AS t FROM proposals WHERE url LIKE 'http%' GROUP BY url)
WHERE url NOT IN (SELECT 'https://site1.example.org/p/' || p_partkey FROM part)""", ("proposals",))
def kb_new_sources(spark, sf):
    known = table(spark, sf, "part").select(F.concat(F.lit("https://site1.example.org/p/"), F.col("p_partkey").cast("string")).alias("url"))
    return K.new_sources(proposals(spark, sf), known)


@query("kb_review_applied", """
SELECT group_id, human_decision, count(*) AS n FROM (
 SELECT p.group_id, coalesce(d.d, p.human_decision) AS human_decision FROM proposals p LEFT JOIN
  (SELECT group_id, field_id, action, new_value, arg_max(CASE WHEN l = 6 THEN 'accept' ELSE 'reject' END, seq) AS d FROM (SELECT *, (seq // 10000000) % 10 AS l FROM proposals) WHERE l IN (5, 6) GROUP BY ALL) d
  USING (group_id, field_id, action, new_value)) GROUP BY ALL""", ("proposals",))
def kb_review_applied(spark, sf):
    p = proposals(spark, sf)
    l = F.floor(F.col("seq") / 10_000_000) % 10
    # the sheet has several rows for a claim; the last one decides
    sheet = p.withColumn("l", l).filter("l in (5, 6)").select("group_id", "field_id", "action", "new_value", F.when(F.col("l") == 6, " Accept ").otherwise("reject").alias("review_decision"), F.col("seq").alias("row_no"))
    return K.apply_review(p, sheet).groupBy("group_id", "human_decision").agg(F.count(F.lit(1)).alias("n"))


@query("kb_appended_evidence", """
SELECT group_id, field_id, CASE action WHEN 'fill' THEN 'model_extracted_needs_review' WHEN 'confirm' THEN 'model_confirmed_needs_review' ELSE 'model_conflict_needs_review' END AS status,
 'dkb_' || substr(sha1(url), 1, 10) AS source_ids, strftime(checked_at, '%Y-%m-%d') AS verified, 'Quote: "' || quote || '"' AS notes FROM applied WHERE action <> 'not_applicable'""", ("applied",))
def kb_appended_evidence(spark, sf):
    return K.appended_evidence(applied(spark, sf))


@query("kb_source_urls", """
SELECT DISTINCT group_id, id, 'https://src/' || id AS url FROM (SELECT group_id, unnest(['p' || (l_partkey % 50), 'p' || l_linenumber]) AS id FROM kb_lines)
WHERE id IN (SELECT 'p' || p_size FROM part)""", ("kb_lines",))
def kb_source_urls(spark, sf):
    ev = _lines(spark, sf).select("group_id", F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"), F.lit(" ; p"), F.col("l_linenumber").cast("string")).alias("source_ids"))
    src = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("id")).distinct().withColumn("url", F.concat(F.lit("https://src/"), "id"))
    return K.source_urls(ev, src)


def _spec_fields(spark, sf):
    """The fields of the parts, and one field for every subtopic with search words, dealt to the parts' brands."""
    words = spark.createDataFrame(list(enumerate(k for k, _ in V.FIELD_KEYWORDS)), "i int, subtopic string")
    f = fields(spark, sf).withColumn("b", F.regexp_extract("description", r"(\d+)", 1).cast("int"))
    more = f.join(words, F.col("i") % 25 + 1 == F.col("b")).select(F.concat("layer", F.lit("."), words["subtopic"]).alias("field_id"), "layer", words["subtopic"], F.concat(F.lit("About "), words["subtopic"]).alias("description"))
    return fields(spark, sf).unionByName(more)


_KEYWORDS = "(VALUES " + ", ".join(f"({i}, '{k}', '" + v.replace("'", "''") + "')" for i, (k, v) in enumerate(V.FIELD_KEYWORDS)) + ") k(i, subtopic, words)"
_LISTED = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query("kb_field_specs", f"""
SELECT field_id, field_id NOT IN ({_LISTED(V.FIELDS_NEVER_EXTRACTED)}) AND (layer <> 'distinguishing_metadata' OR field_id IN ({_LISTED(V.METADATA_FIELDS_EXTRACTED)})) AS extract,
 (layer = 'theology' AND field_id NOT IN ({_LISTED(V.THEOLOGY_FIELDS_FOR_ALL)})) OR field_id IN ({_LISTED(V.OTHER_RESTRICTED_FIELDS)}) AS christian_only, coalesce(k.words, lower(description)) AS keywords
FROM (SELECT field_id, layer, subtopic, description FROM fields
 UNION ALL SELECT layer || '.' || k.subtopic, layer, k.subtopic, 'About ' || k.subtopic FROM fields f JOIN {_KEYWORDS} ON k.i % 25 + 1 = regexp_extract(f.description, '(\\d+)', 1)::INT) f
LEFT JOIN {_KEYWORDS} USING (subtopic)""", ("fields",))
def kb_field_specs(spark, sf):
    return K.field_specs(_spec_fields(spark, sf)).select("field_id", "extract", "christian_only", "keywords")


@query("kb_examples", """
SELECT field_id, string_agg(value, ',' ORDER BY f, value) AS examples FROM (SELECT * FROM (SELECT field_id, value, min(group_id) AS f FROM cells WHERE value <> 'Unknown' GROUP BY field_id, value)
 QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY f, value) <= 3) GROUP BY field_id""", ("cells",))
def kb_examples(spark, sf):
    return K.field_examples(cells(spark, sf)).select("field_id", F.array_join("examples", ",").alias("examples"))


@query("kb_group_order", """SELECT 's' || s_suppkey AS group_id, s_acctbal AS adherents FROM supplier WHERE s_suppkey NOT IN (3, 5) ORDER BY s_acctbal DESC, 's' || s_suppkey""")
def kb_group_order(spark, sf):
    return K.group_order(groups(spark, sf), skip=["s3", "s5"]).select("group_id", "adherents")


cte("members", """SELECT group_id, CASE WHEN value <> 'Unknown' THEN CASE WHEN regexp_matches(value, 'promo|large') THEN 'no' ELSE 'yes' END ELSE 'unclear' END AS is_christian
FROM cells WHERE field_id = 'identity.primary_family'""", "cells")
cte("routes", """
SELECT m.group_id, s.field_id, CASE WHEN s.only AND m.is_christian = 'no' AND c.value = 'Unknown' THEN 'not_applicable' WHEN s.only AND m.is_christian = 'no' THEN NULL
  WHEN c.value = 'Unknown' THEN 'extract' ELSE 'validate' END AS route
FROM members m CROSS JOIN (SELECT field_id, layer = 'theology' AND field_id <> 'theology.afterlife' AS only FROM fields WHERE layer <> 'distinguishing_metadata' AND field_id <> 'identity.canonical_name') s
LEFT JOIN cells c ON c.group_id = m.group_id AND c.field_id = s.field_id
""", "members", "fields", "cells")


def _members(spark, sf):
    # product types that stand for another family here
    c = cells(spark, sf).withColumn("value", F.when((F.col("field_id") == "identity.primary_family") & F.col("value").rlike("promo|large"), "Buddhism").otherwise(F.col("value")))
    return K.member_flags(groups(spark, sf), c)


def work_list(spark, sf):
    return K.work_list(cells(spark, sf), K.field_specs(fields(spark, sf)), _members(spark, sf))


@query("kb_work_list", "SELECT group_id, field_id, route FROM routes WHERE route IS NOT NULL", ("routes",))
def kb_work_list(spark, sf):
    return work_list(spark, sf).select("group_id", "field_id", "route")


@query("kb_request_batches", """
SELECT group_id, route, field_id, (rn // 5)::BIGINT AS batch, (rn % 5)::BIGINT AS pos FROM (
 SELECT *, row_number() OVER (PARTITION BY group_id, route ORDER BY field_id) - 1 AS rn FROM routes WHERE route IS NOT NULL)""", ("routes",))
def kb_request_batches(spark, sf):
    d = retrieval.in_batches(work_list(spark, sf), ["group_id", "route"], [F.col("field_id")], 5, F.ascii("field_id"))
    return d.select("group_id", "route", "field_id", "batch", "pos")


@query("kb_wide_output", "PIVOT (SELECT c.group_id, c.field_id, coalesce(p.v, c.value) AS value FROM cells c LEFT JOIN (SELECT group_id, field_id, CASE WHEN action = 'fill' THEN new_value ELSE 'Not applicable' END AS v FROM applied "
       "WHERE action IN ('fill', 'not_applicable') QUALIFY row_number() OVER (PARTITION BY group_id, field_id ORDER BY checked_at DESC, new_value) = 1) p USING (group_id, field_id)) ON field_id IN ("
       + ", ".join(f"'{f}'" for f in FIELD_IDS) + ") USING max(value) GROUP BY group_id", ("cells", "applied"))
def kb_wide_output(spark, sf):
    return K.wide_output(cells(spark, sf), applied(spark, sf), FIELD_IDS)


@query("kb_long_cells", "SELECT group_id, field_id, coalesce(value, '') AS value FROM (SELECT DISTINCT group_id FROM cells) CROSS JOIN (SELECT DISTINCT field_id FROM fields) LEFT JOIN cells USING (group_id, field_id)", ("cells", "fields"))
def kb_long_cells(spark, sf):
    """The wide sheets of all six layers, whose headers are field descriptions, taken apart again."""
    c, f, out = cells(spark, sf), fields(spark, sf), None
    for layer in LAYERS:
        bs = [b for b in range(1, 26) if FIELD_IDS[b - 1].startswith(layer + ".")]
        wide = c.groupBy(F.col("group_id").alias("id")).pivot("field_id", [FIELD_IDS[b - 1] for b in bs]).agg(F.first("value"))
        wide = wide.select("id", F.lit("x").alias("census_name"), *[F.col(f"`{FIELD_IDS[b - 1]}`").alias(f" DESCRIPTION {b}") for b in bs])
        part = K.long_cells(wide, f, layer)
        out = part if out is None else out.unionByName(part)
    return out


@query("kb_claims_blocks", """
SELECT group_id, batch, string_agg('[' || (pos + 1) || '] FIELD: ' || field_id || ' (' || field_id || ')' || chr(10) || '    VALUE: ' || new_value || chr(10) || '    QUOTE: "' || quote || '"', chr(10) ORDER BY pos) AS text,
 count(*) AS claims FROM (SELECT *, (rn // 8)::BIGINT AS batch, (rn % 8)::BIGINT AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY seq) - 1 AS rn FROM proposals WHERE action <> 'not_applicable' AND source_type <> 'wikidata' AND (verdict IS NULL OR verify_model <> 'm1'))) GROUP BY ALL""", ("proposals",))
def kb_claims_blocks(spark, sf):
    todo = proposals(spark, sf).filter(K.needs_check("m1", "v1"))
    d = retrieval.in_batches(todo, ["group_id"], [F.col("seq")], 8, F.floor(F.col("seq") / 1e11)).withColumn("description", F.lit(None).cast("string"))
    return responses.claims_blocks(d)


@query("kb_validated", """
SELECT l.group_id, l.fid AS field_id, CASE WHEN l_linestatus = 'O' THEN 'confirm' ELSE 'conflict' END AS action, CASE WHEN l_linestatus = 'O' THEN c.value ELSE p_name END AS new_value,
 CASE WHEN pr <= 2 THEN 'high' ELSE 'medium' END AS confidence, count(*) AS n FROM (SELECT *, """ + FIELD_SQL + """ AS fid FROM kb_lines WHERE l_returnflag <> 'R') l
LEFT JOIN cells c ON c.group_id = l.group_id AND c.field_id = l.fid GROUP BY ALL""", ("kb_lines", "cells"))
def kb_validated(spark, sf):
    pick = F.get(F.array(*[F.lit(x) for x in ("official", "register", "wikipedia", "wikidata", "classification")]), F.col("pr") - 1)
    d = _lines(spark, sf).select("group_id", _field(F.col("b")).alias("field_id"), F.when(F.col("l_returnflag") == "R", "not_addressed").when(
        F.col("l_linestatus") == "O", "supported").otherwise("contradicted").alias("verdict"), F.col("p_name").alias("corrected_value"), F.col("p_name").alias("quote"),
        F.lit("u").alias("url"), pick.alias("source_type"))
    return K.validated_proposals(d, cells(spark, sf)).groupBy("group_id", "field_id", "action", "new_value", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("kb_redo_groups", """SELECT 's' || s_suppkey AS group_id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity)::BIGINT % 4 = 0)""")
def kb_redo_groups(spark, sf):
    done = _lines(spark, sf).groupBy("group_id").agg((F.sum("l_quantity").cast("long") % 4).alias("chunks"))
    return K.redo_groups(done, groups(spark, sf)).select("group_id")


RULES = [("a", 0, "red|blue", "bright"), ("a", 1, "small|new", "little"), ("b", 0, "^hot", "warm"), ("b", 1, "bolt|gear", "metal")]


@query("value_mapping", """
SELECT p_partkey, feature, CASE WHEN feature = 'a' THEN CASE WHEN regexp_matches(p_name, 'red|blue') THEN 'bright' WHEN regexp_matches(p_name, 'small|new') THEN 'little' END
 ELSE CASE WHEN regexp_matches(t, '^hot') THEN 'warm' WHEN regexp_matches(p_name, 'bolt|gear') AND t NOT LIKE 'varies%' THEN 'metal' END END AS value
FROM (SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' varies' END AS t, p_size, f.feature FROM part, (VALUES ('a'), ('b')) f(feature)
 ) WHERE TRUE""")
def value_mapping(spark, sf):
    """Free text to values by ordered rules; wording about variation here stands behind the signal and does not block it."""
    rules = spark.createDataFrame(RULES, "feature string, ord int, pattern string, value string")
    text = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" varies")))
    d = table(spark, sf, "part").select("p_partkey", text.alias("text"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("feature"))
    return E.map_values(d, rules).select("p_partkey", "feature", "value")


# ---------------------------------------------------------------- retrieval
def source_docs(spark, sf):
    kind = F.get(F.array(F.lit("official"), F.lit("register"), F.lit("wikipedia"), F.lit("news")), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf, "documents").select(F.col("source").alias("group_id"), F.concat(F.lit("http://kb/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("title"),
                                                kind.alias("source_type"), "text")


cte("chunks", """
SELECT group_id, url, title, source_type, row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS chunk_no, piece AS text FROM (
 SELECT group_id, url, title, source_type, i, array_to_string(w[i + 1:i + 220], ' ') AS piece FROM (
  SELECT *, unnest(range(0, greatest(len(w), 1), 180)) AS i FROM (
   SELECT source AS group_id, 'http://kb/' || doc_id AS url, lang AS title, ['official', 'register', 'wikipedia', 'news'][doc_id % 4 + 1] AS source_type,
    [x FOR x IN string_split_regex(text, '\\s+') IF x <> ''] AS w FROM documents)) WHERE i = 0 OR i - 180 + 220 < len(w)) WHERE length(piece) >= 80
""")
RSTOP = ", ".join(f"'{x}'" for x in V.RETRIEVAL_STOPWORDS)
RTOK = lambda x: f"[t FOR t IN regexp_extract_all(lower({x}), '[a-z0-9]+(?:''[a-z]+)?') IF t NOT IN ({RSTOP})]"
cte("postings", f"""
SELECT group_id, url, chunk_no, source_type, len, term, count(*) AS tf FROM (
 SELECT group_id, url, chunk_no, source_type, len(t) AS len, unnest(t) AS term FROM (SELECT *, {RTOK("text || ' ' || title")} AS t FROM chunks)) GROUP BY ALL
""", "chunks")
cte("bm25_hits", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, query_id ORDER BY score DESC, url DESC, chunk_no DESC) AS rank FROM (
 SELECT p.group_id, q.query_id, p.url, p.chunk_no, p.source_type, round(sum(q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.4 / (p.tf + 1.4 * (0.25 + 0.75 * p.len / s.avg)))
   * (1 - 0.1 * CASE WHEN p.source_type IN ('official', 'register') THEN 0 ELSE 1 END), 9) AS score
 FROM postings p JOIN (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({RTOK('text')}) AS term FROM benchmark) GROUP BY ALL) q USING (term)
 JOIN (SELECT group_id, term, count(*) AS df FROM postings GROUP BY ALL) d ON d.group_id = p.group_id AND d.term = p.term
 JOIN (SELECT group_id, count(*) AS n, avg(len({RTOK("text || ' ' || title")})) AS avg FROM chunks GROUP BY group_id) s ON s.group_id = p.group_id
 GROUP BY p.group_id, q.query_id, p.url, p.chunk_no, p.source_type) WHERE score > 0) WHERE rank <= 4
""", "postings", "chunks")


def hits(spark, sf):
    from tessera.session import stage
    ch = stage(retrieval.chunk_documents(source_docs(spark, sf)), "chunks")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(ch, q), ch


@query("chunks", "SELECT url, chunk_no::BIGINT AS chunk_no, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM chunks", ("chunks",))
def chunks(spark, sf):
    return retrieval.chunk_documents(source_docs(spark, sf)).select("url", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("bm25_topk", "SELECT group_id, query_id, rank, url, chunk_no::BIGINT AS chunk_no, round(score, 6) AS score FROM bm25_hits", ("bm25_hits",))
def bm25_topk(spark, sf):
    return hits(spark, sf)[0].select("group_id", "query_id", F.col("rank").cast("long").alias("rank"), "url", F.col("chunk_no").cast("long").alias("chunk_no"), rounded(F.col("score"), 6).alias("score"))


@query("excerpts", """
SELECT group_id, batch, excerpt, url, chunk_no::BIGINT AS chunk_no FROM (SELECT *, row_number() OVER (PARTITION BY group_id, batch ORDER BY o, url, chunk_no) AS excerpt FROM (
 SELECT group_id, query_id // 5 AS batch, url, chunk_no, min(rank * 100 + query_id % 5) AS o FROM bm25_hits GROUP BY ALL)) WHERE excerpt <= 8""", ("bm25_hits",))
def excerpts(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.floor(F.col("item_id") / 5).cast("long").alias("batch"), (F.col("item_id") % 5).alias("pos"))
    d = retrieval.excerpts(hits(spark, sf)[0], b)
    return d.select("group_id", "batch", F.col("excerpt").cast("long").alias("excerpt"), "url", F.col("chunk_no").cast("long").alias("chunk_no"))


@query("text_windows", """SELECT doc_id, o AS "offset", length(substr(text, o + 1, 2800))::BIGINT AS n_chars, md5(substr(text, o + 1, 2800)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, length(text), 2200)) AS o FROM documents)""")
def text_windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.inline(X.char_windows(F.col("text"))))
    return d.select("doc_id", F.col("offset").cast("long").alias("offset"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("extraction_windows", """SELECT doc_id, o AS "offset", md5(substr(text, o + 1, 17000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 15000)) AS o FROM documents)""")
def extraction_windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.inline(X.char_windows(F.col("text"), 15000, 17000)))
    return d.select("doc_id", F.col("offset").cast("long").alias("offset"), F.md5("text").alias("digest"))


QSTOP = ", ".join(f"'{x}'" for x in V.QUESTION_STOPWORDS)
QT = lambda x: f"list_distinct([t FOR t IN regexp_extract_all(lower({x}), '[a-z0-9]+') IF length(t) > 2 AND t NOT IN ({QSTOP})])"
cte("questions", "SELECT 'src' || (conv_id % 20) AS church_id, conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user'")


def questions(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("church_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))


@query("question_passages", f"""
SELECT church_id, question_id, rn, url, "offset", relevance, length(substr(text, 1, (18000 - used)::BIGINT))::BIGINT AS n_chars FROM (
 SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY church_id, question_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (
  SELECT *, row_number() OVER (PARTITION BY church_id, question_id ORDER BY relevance DESC, "offset", url) AS rn FROM (
   SELECT q.church_id, q.question_id, d.url, d."offset", d.text, len(list_intersect(q.t, d.body)) + len(list_intersect(q.t, d.head)) AS relevance FROM
    (SELECT church_id, question_id, {QT('question')} AS t FROM questions) q JOIN
    (SELECT church_id, url, "offset", text, {QT('text')} AS body, head FROM (SELECT church_id, url, head, o AS "offset", substr(t, o + 1, 2800) AS text FROM (
       SELECT source AS church_id, 'http://kb/' || doc_id AS url, text AS t, {QT("lang || ' page'")} AS head, unnest(range(0, length(text), 2200)) AS o FROM documents))) d USING (church_id))))
WHERE used < 18000""", ("questions",))
def question_passages(spark, sf):
    d = source_docs(spark, sf).select(F.col("group_id").alias("church_id"), "url", "title", F.lit("page").alias("kind"), "text")
    r = retrieval.question_passages(d, questions(spark, sf))
    return r.select("church_id", "question_id", "rn", "url", F.col("offset").cast("long").alias("offset"), F.col("relevance").cast("long").alias("relevance"), F.length("text").cast("long").alias("n_chars"))


@query("answer_facts", """
SELECT church_id, fact_no, feature, value FROM (SELECT *, row_number() OVER (PARTITION BY church_id ORDER BY row_id) AS fact_no FROM evidence
 WHERE checked_at >= TIMESTAMP '2001-06-01' - INTERVAL 90 DAY AND value NOT IN ('unknown', 'unstated')) WHERE fact_no <= 40""", ("evidence",))
def answer_facts(spark, sf):
    d = retrieval.answer_facts(evidence(spark, sf), F.lit("2001-06-01 00:00:00").cast("timestamp"))
    return d.select("church_id", F.col("fact_no").cast("long").alias("fact_no"), "feature", "value")


@query("viewed_whole", """
SELECT p_partkey AS url, 400 + p_size * 10 AS total, least(coalesce(g.gap, e, 0), 400 + p_size * 10)::BIGINT AS next_offset, coalesce(g.gap, e, 0) >= 400 + p_size * 10 AS covered
FROM part LEFT JOIN (SELECT url, min(reach) FILTER (s > reach) AS gap, max(e) AS e FROM (
  SELECT *, coalesce(max(e) OVER (PARTITION BY url ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM (
   SELECT l_partkey AS url, (l_linenumber - 1) * 60 + l_orderkey % 7 * 10 - 0 AS s, max((l_linenumber - 1) * 60 + l_orderkey % 7 * 10 + l_quantity::BIGINT * 8) AS e FROM lineitem GROUP BY ALL)) GROUP BY url) g ON g.url = p_partkey""")
def viewed_whole(spark, sf):
    s = (F.col("l_linenumber") - 1) * 60 + F.col("l_orderkey") % 7 * 10
    v = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("url"), s.alias("start"), (s + F.col("l_quantity").cast("long") * 8).alias("end"))
    return retrieval.viewed_whole(v, table(spark, sf, "part").select(F.col("p_partkey").alias("url"), (400 + F.col("p_size") * 10).alias("total")))


# ---------------------------------------------------------------- names
def known_groups(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("known_name")).agg(F.concat(F.lit("g"), F.min("p_partkey").cast("string")).alias("group_id"), (F.sum("p_size") * 1000).alias("adherents"))


def aliases(spark, sf):
    g = known_groups(spark, sf)
    short = F.upper(F.concat(F.substring("known_name", 1, 2), F.substring(F.substring_index("known_name", " ", -1), 1, 2)))
    return g.select(F.col("known_name").alias("alias"), "group_id").unionByName(g.select(short.alias("alias"), "group_id"))


def place_names(spark, sf):
    """A place per part: the group's name plain, inside other words, shortened, or only its family word."""
    short = F.upper(F.concat(F.substring("p_name", 1, 2), F.substring(F.substring_index("p_name", " ", -1), 1, 2)))
    b = _brand().cast("string")
    k = F.col("p_partkey") % 5
    name = (F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" House "), b)).when(k == 2, F.concat(short, F.lit(" Hall "), b))
            .when(k == 3, F.concat(F.substring_index("p_name", " ", -1), F.lit(" works "), b)).otherwise(F.concat(F.lit("Independent hall "), b)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("church_id"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("tag"))


FAMILIES = ["bolt", "gear", "ring", "plate", "widget", "anvil", "gizmo", "valve", "spring", "lever"]
SHORT_SQL = "upper(substr({c}, 1, 2) || substr(string_split({c}, ' ')[-1], 1, 2))"
cte("known_groups", "SELECT p_name AS known_name, 'g' || min(p_partkey) AS group_id, sum(p_size) * 1000 AS adherents FROM part GROUP BY 1")
cte("place_names", f"""
SELECT p_partkey AS church_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'The ' || array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') || ' House ' || b
  WHEN 2 THEN {SHORT_SQL.format(c='p_name')} || ' Hall ' || b WHEN 3 THEN string_split(p_name, ' ')[-1] || ' works ' || b ELSE 'Independent hall ' || b END AS name,
  CASE WHEN p_size % 2 = 0 THEN p_name END AS tag FROM (SELECT *, regexp_extract(p_brand, '(\\d+)', 1) AS b FROM part)
""")


def _found_sql(names_sql):
    return f"""
SELECT name, group_id, label, round(score, 1) AS score, row_number() OVER (PARTITION BY name ORDER BY score + least(5.0, log10(adherents + 1) / 1.6) DESC, group_id) AS rn FROM (
 WITH n AS ({names_sql}),
 m AS (SELECT n.name, g.group_id, max(CASE WHEN lower(n.name) = g.known_name THEN 100.0 ELSE 88 + least(10.0, length(g.known_name) / 3) END) AS score
   FROM n JOIN known_groups g ON regexp_matches(lower(n.name), '(^|[^a-z])' || g.known_name || '([^a-z]|$)') GROUP BY ALL),
 a AS (SELECT n.name, g.group_id, 100.0 AS score FROM n JOIN known_groups g ON list_contains(regexp_extract_all(n.name, '[A-Za-z&]+'), {SHORT_SQL.format(c='g.known_name')})),
 f AS (SELECT n.name, t.group_id, 70.0 AS score FROM n JOIN (SELECT unnest({FAMILIES}) AS w) w ON regexp_matches(lower(n.name), '\\b' || w.w)
   JOIN (SELECT w2.w, g.group_id FROM known_groups g JOIN (SELECT unnest({FAMILIES}) AS w) w2 ON contains(g.known_name, w2.w)
     QUALIFY row_number() OVER (PARTITION BY w2.w ORDER BY g.adherents DESC, g.group_id) <= 3) t ON t.w = w.w
   WHERE n.name NOT IN (SELECT name FROM m) AND n.name NOT IN (SELECT name FROM a))
 SELECT x.name, x.group_id, g.known_name AS label, g.adherents, max(x.score) AS score FROM (SELECT * FROM m UNION ALL SELECT * FROM a UNION ALL SELECT DISTINCT * FROM f) x JOIN known_groups g USING (group_id) GROUP BY ALL)
QUALIFY rn <= 5"""


cte("found", _found_sql("SELECT DISTINCT name FROM place_names"), "known_groups", "place_names")
cte("found_tags", _found_sql("SELECT DISTINCT tag AS name FROM place_names WHERE tag IS NOT NULL"), "known_groups", "place_names")


def _find(spark, sf, col, fuzzy=False):
    n = place_names(spark, sf).select(F.col(col).alias("name")).filter("name is not null").distinct()
    return names.find_groups(n, aliases(spark, sf), known_groups(spark, sf), 5, fuzzy, FAMILIES)


@query("entity_find", "SELECT name, rn, group_id, label, score FROM found", ("found",))
def entity_find(spark, sf):
    return _find(spark, sf, "name").withColumn("rn", F.col("rn").cast("long"))


@query("entity_find_fuzzy")
def entity_find_fuzzy(spark, sf):
    """With near spellings; checked against brute force in the tests, as SQL has no such measure."""
    return _find(spark, sf, "name", True)


@query("entity_resolve", """
SELECT church_id, CASE WHEN NOT weak THEN gid END AS group_id, CASE WHEN weak THEN 'Unknown (likely independent)' ELSE label END AS label, CASE WHEN weak THEN 0.4 ELSE conf END AS confidence,
 CASE WHEN weak THEN 'unknown' ELSE 'name' END AS method FROM (
 SELECT church_id, gid, label, conf, label IS NULL OR (gid IS NULL AND conf <= 0.3) AS weak FROM (SELECT p.church_id, g.* EXCLUDE (church_id) FROM place_names p LEFT JOIN (
  SELECT church_id, NULL AS gid, 'Non-denominational' AS label, 0.8 AS conf, 1 AS prio FROM place_names WHERE regexp_matches(name, '(?i)\\bindependent\\b')
  UNION ALL SELECT church_id, group_id, label, CASE WHEN score >= 100 THEN 0.9 WHEN score >= 88 THEN 0.8 WHEN score >= 85 THEN 0.6 WHEN score >= 70 THEN 0.3 ELSE 0.2 END, 2 FROM place_names JOIN found USING (name) WHERE rn = 1
  UNION ALL SELECT church_id, group_id, label, 0.6, 3 FROM place_names JOIN found_tags f ON f.name = tag WHERE rn = 1) g USING (church_id)
  QUALIFY row_number() OVER (PARTITION BY church_id ORDER BY CASE WHEN conf >= 0.8 THEN 0 ELSE 1 - conf END, prio) = 1))""", ("place_names", "found", "found_tags"))
def entity_resolve(spark, sf):
    return names.resolve(place_names(spark, sf), _find(spark, sf, "name"), _find(spark, sf, "tag"))


@query("article_matches", """
SELECT name, title, score FROM (SELECT *, round(len(list_intersect(string_split(name, ' '), string_split(title, ' '))) / len(list_distinct(list_concat(string_split(name, ' '), string_split(title, ' ')))) - 0.05 * rank, 9) AS score
 FROM (SELECT DISTINCT p.p_name AS name, q.p_partkey - p.p_partkey AS rank, q.p_name AS title FROM part p JOIN part q ON q.p_partkey BETWEEN p.p_partkey AND p.p_partkey + 4 WHERE p.p_partkey <> q.p_partkey))
QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, rank, title) = 1 AND score >= 0.25""")
def article_matches(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    h = p.select(F.col("p_name").alias("name"), F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 4)).alias("k"), F.col("p_partkey").alias("o")).join(
        p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title")), "k").select("name", (F.col("k") - F.col("o")).alias("rank"), "title").distinct()
    return names.article_matches(h).select("name", "title", "score")


@query("place_references", """
WITH p AS (SELECT DISTINCT o_custkey AS session_id, l_partkey AS church_id, lower(p_type) || ' ' || p_name AS name, p_name AS ref FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
SELECT r.session_id, r.ref, min(p.church_id) AS church_id FROM (SELECT DISTINCT session_id, ref FROM p) r JOIN p ON p.session_id = r.session_id AND list_has_all(string_split(p.name, ' '), string_split(r.ref, ' '))
GROUP BY ALL HAVING count(DISTINCT p.church_id) = 1""")
def place_references(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session_id"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", F.lower("p_type"), "p_name").alias("name"), F.col("p_name").alias("ref"))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey").join(p, "l_partkey").select("session_id", F.col("l_partkey").alias("church_id"), "name", "ref")
    return names.place_references(d.select("session_id", "ref"), d)
