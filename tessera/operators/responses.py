"""Request and response tables around external labelling: build, validate, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import rules as R
from tessera.functions import text as X
from tessera.functions.columns import computed_once, in_turn
from tessera.operators.ordering import first_per_group


def request_key(model: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\n", model, body), 256)


def pending_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a stored non-null response."""
    return requests.join(responses.filter("response is not null").select("key"), "key", "left_anti")


def strip_fences(c: Column) -> Column:
    """Drop a Markdown code fence around a JSON answer."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.trim(F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"```\s*$", "")).otherwise(t))


def claims_blocks(claims: DataFrame) -> DataFrame:
    """(group_id, batch, text): numbered claims of a batch. `claims`: (group_id, batch, pos, field_id, description, new_value, quote)."""
    line = F.format_string('[%d] FIELD: %s (%s)\n    VALUE: %s\n    QUOTE: "%s"', F.col("pos") + 1, F.coalesce("description", "field_id"), "field_id", "new_value", "quote")
    return claims.groupBy("group_id", "batch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda s: s["l"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("claims"))


def excerpt_blocks(ex: DataFrame) -> DataFrame:
    """(group_id, batch, text): numbered excerpts. `ex`: (group_id, batch, excerpt, source_type, title, text)."""
    line = F.format_string("[%d] (%s: %s)\n%s", "excerpt", "source_type", F.substring("title", 1, 80), "text")
    return ex.groupBy("group_id", "batch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("excerpt", line.alias("l")))), lambda s: s["l"]), "\n\n").alias("text"),
        F.count(F.lit(1)).alias("excerpts"))


def extract_checks(responses: DataFrame, excerpts: DataFrame, wanted: DataFrame, max_words: int = 30) -> DataFrame:
    """Response rows with their errors; only rows without any are used.

    `responses`: (group_id, batch, field_id, status, value, excerpt, quote); `excerpts`: (group_id, batch, excerpt,
    url, source_type, text); `wanted`: (group_id, batch, field_id).
    """
    d = responses.join(wanted.select("group_id", "batch", "field_id", F.lit(True).alias("_asked")), ["group_id", "batch", "field_id"], "left")
    d = d.join(excerpts.select("group_id", "batch", "excerpt", "url", "source_type", F.col("text").alias("_text")), ["group_id", "batch", "excerpt"], "left")
    n_words = F.size(X.words(F.coalesce("value", F.lit(""))))
    stated = F.col("status") == "stated"
    errors = F.array_compact(F.array(
        F.when(F.col("_asked").isNull(), "field not asked for"), F.when(stated & F.col("_text").isNull(), "excerpt out of range"),
        F.when(stated & F.col("_text").isNotNull() & ~X.quote_exact(F.col("quote"), F.col("_text")), "quote not in excerpt"),
        F.when(stated & ~n_words.between(1, max_words), "value length")))
    return d.withColumn("errors", errors).withColumn("usable", stated & (F.size("errors") == 0)).drop("_asked", "_text")


def complete_batches(responses: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whether each batch answers exactly the fields it was asked, once each."""
    w = wanted.groupBy("group_id", "batch").agg(F.count(F.lit(1)).alias("asked"))
    r = responses.groupBy("group_id", "batch", "field_id").agg(F.count(F.lit(1)).alias("c")).join(
        wanted.select("group_id", "batch", "field_id", F.lit(1).alias("_w")), ["group_id", "batch", "field_id"], "left")
    r = r.groupBy("group_id", "batch").agg(F.count_if(F.col("_w").isNotNull() & (F.col("c") == 1)).alias("good"), F.count(F.lit(1)).alias("got"))
    return w.join(r, ["group_id", "batch"], "left").select(
        "group_id", "batch", "asked", F.coalesce((F.col("good") == F.col("asked")) & (F.col("got") == F.col("asked")), F.lit(False)).alias("complete"))


def normalized_verdicts(responses: DataFrame) -> DataFrame:
    """(key, id, verdict, reason) from the shapes labellers answer in.

    Accepted: a list of objects, {"verdicts": list}, {"verdicts": {id: ...}}, {id: {...}}, {id: "verdict"};
    with or without a code fence. Unknown verdicts and ids that are no numbers are dropped. `responses`: (key, body).
    """
    j = F.from_json(strip_fences(F.col("body")), "map<string,string>")
    text = strip_fences(F.col("body"))
    d = responses.withColumn("_text", text).withColumn("_map", F.when(~text.startswith("["), j))
    inner = F.when(F.col("_text").startswith("["), F.col("_text")).otherwise(F.coalesce(F.try_element_at("_map", F.lit("verdicts")), F.col("_text")))
    d = d.withColumn("_inner", inner)
    item = "struct<id:string,verdict:string,reason:string>"
    as_list = F.when(F.col("_inner").startswith("["), F.from_json("_inner", f"array<{item}>"))
    as_map = F.when(~F.col("_inner").startswith("["), F.map_entries(F.from_json("_inner", "map<string,string>")))
    from_map = F.transform(as_map, lambda e: F.when(e["value"].startswith("{"), F.struct(
        e["key"].alias("id"), F.get_json_object(e["value"], "$.verdict").alias("verdict"), F.get_json_object(e["value"], "$.reason").alias("reason"))).otherwise(
        F.struct(e["key"].alias("id"), e["value"].alias("verdict"), F.lit(None).cast("string").alias("reason"))))
    rows = d.select("key", F.inline(F.coalesce(as_list, from_map)))
    verdict = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    return rows.select("key", F.regexp_replace(F.coalesce("id", F.lit("")), r"^[\[\] ]+|[\[\] ]+$", "").try_cast("int").alias("id"), verdict.alias("verdict"),
                       F.substring(F.coalesce("reason", F.lit("")), 1, 300).alias("reason")).filter(F.col("id").isNotNull() & F.col("verdict").isin(V.VERDICTS))


def attach_verdicts(claims: DataFrame, verdicts: DataFrame, model: str, version: str) -> DataFrame:
    """Verdicts onto claims by (batch key, position); a batch counts only when every claim got exactly one.

    `claims`: (key, pos from 0, ...); `verdicts`: `normalized_verdicts` output.
    """
    per = verdicts.groupBy("key", "id").agg(F.count(F.lit(1)).alias("c"), F.first("verdict").alias("verdict"), F.first("reason").alias("reason"))
    size = claims.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    good = per.join(size, "key").groupBy("key", "n").agg(F.count_if((F.col("c") == 1) & F.col("id").between(1, F.col("n"))).alias("g"),
                                                         F.count(F.lit(1)).alias("all")).filter("g = n and all = n").select("key")
    v = per.join(good, "key", "left_semi").select("key", (F.col("id") - 1).cast("long").alias("pos"), "verdict", "reason")
    d = claims.join(v, ["key", "pos"], "left")
    return d.withColumn("verify_model", F.when(F.col("verdict").isNotNull(), model)).withColumn("verify_version", F.when(F.col("verdict").isNotNull(), version))


def missing_keys(body: Column, schema: dict[str, str]) -> Column:
    """Required keys of a JSON object that are absent or of the wrong type. `schema`: key -> string, number, boolean, array or object."""
    text = strip_fences(body)
    v = F.try_parse_json(text)
    want = {"string": "STRING", "number": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}

    def bad(key, kind):
        got = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        ok = got.startswith("DECIMAL") | got.isin("BIGINT", "DOUBLE") if kind == "number" else got.startswith(want[kind])
        return F.when(~F.coalesce(ok, F.lit(False)), key)
    return F.array_compact(F.array(*[bad(k, t) for k, t in schema.items()]))


def draft_errors(known_features: DataFrame, drafts: DataFrame, max_features: int = 6) -> DataFrame:
    """Semantic errors of drafted entries as an array per row.

    `drafts`: (term, relevance, term_types, senses array<struct<gloss, features array<struct<feature,value>>>>,
    neutral_options, disambiguation_question). The vocabulary is a fixed small set, given as one array.
    """
    drafts = computed_once(drafts, _known=known_features.agg(F.collect_set("feature")).scalar())
    known = F.col("_known")
    bad_ids = F.flatten(F.transform("senses", lambda s: F.filter(F.transform(s["features"], lambda f: f["feature"]),
                                                               lambda f: ~F.array_contains(known, f) & ~f.startswith("proposed."))))
    many = F.exists("senses", lambda s: F.size(s["features"]) > max_features)
    has = lambda *t: F.arrays_overlap("term_types", F.array(*[F.lit(x) for x in t]))
    errors = F.array_compact(F.array(
        F.when(F.size(bad_ids) > 0, F.concat(F.lit("unknown feature: "), F.array_join(F.array_sort(F.array_distinct(bad_ids)), ","))),
        F.when(many, "too many features"), F.when(has("polysemous") & (F.size("senses") < 2), "one sense only"),
        F.when(has("contested") & ~F.size("neutral_options").between(2, 4), "needs 2-4 neutral options"),
        F.when(has("polysemous", "contested", "evaluative") & (F.trim(F.coalesce("disambiguation_question", F.lit(""))) == ""), "question required")))
    return drafts.withColumn("errors", F.when(F.col("relevance") == "not_relevant", F.array().cast("array<string>")).otherwise(errors)).drop("_known")


def route_drafts(ranked: DataFrame, checked: DataFrame, low_evidence: int = 5) -> DataFrame:
    """accepted, rejected or failed per ranked term, with the low-evidence flag."""
    d = ranked.select("term", "rank", "count").join(checked, "term", "left")
    route = in_turn([(F.col("relevance").isNull() | (F.size("errors") > 0), "failed"), (F.col("relevance") == "not_relevant", "rejected")], "accepted")
    return d.withColumn("route", route).withColumn("low_evidence", F.col("count") < low_evidence).withColumn("vetted", F.lit(False))


def stance_label_check(responses: DataFrame, asked: DataFrame) -> DataFrame:
    """Whether a term's labels number 1..n exactly once. `responses`: (term, i, stance); `asked`: (term, n)."""
    r = responses.groupBy("term").agg(F.count(F.lit(1)).alias("got"), F.count_distinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    ok = (F.col("got") == F.col("n")) & (F.col("d") == F.col("n")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    return asked.join(r, "term", "left").select("term", "n", F.coalesce(ok, F.lit(False)).alias("labels_ok"))


def phrases_verbatim(rows: DataFrame) -> DataFrame:
    """Add `verbatim`: the phrase stands in the request text. `rows`: (phrase, request)."""
    return rows.withColumn("verbatim", F.contains(F.lower("request"), F.lower("phrase")))


def fact_rows(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts (site, url, label, value, quote, seq) whose quote stands on the page; once per label and value of a site."""
    d = items.filter((F.coalesce("label", F.lit("")) != "") & (F.coalesce("value", F.lit("")) != "")).join(pages.select("url", "text"), "url")
    d = d.filter(X.quote_exact(F.col("quote"), F.col("text"), 0, X.blank_form)).withColumns(
        {"_l": X.blank_form(F.col("label")), "_v": X.blank_form(F.col("value"))})
    return first_per_group(d.drop("text"), ["site", "_l", "_v"], [F.col("seq")]).drop("_l", "_v")


def staff_rows(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Public staff (site, url, name, position, quote, seq): quote on the page, name and position inside the quote; once each."""
    d = items.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("position", F.lit("")) != "")).join(pages.select("url", "text"), "url")
    q = X.blank_form(F.col("quote"))
    d = d.withColumns({"_n": X.blank_form(F.col("name")), "_p": X.blank_form(F.col("position"))})
    d = d.filter(X.quote_exact(F.col("quote"), F.col("text"), 0, X.blank_form) & F.contains(q, F.col("_n")) & F.contains(q, F.col("_p")))
    return first_per_group(d.drop("text"), ["site", "_n", "_p"], [F.col("seq")]).drop("_n", "_p")


def area_reports(reports: DataFrame, fetched: DataFrame) -> DataFrame:
    """Coverage claims with `accepted`: supported ones need addresses, all of them fetched. `reports`: (session_id, area, status, urls)."""
    need = reports.select("session_id", "area", F.explode(F.array_distinct("urls")).alias("url"))
    missing = need.join(fetched.select("session_id", "url"), ["session_id", "url"], "left_anti").groupBy("session_id", "area").agg(F.count(F.lit(1)).alias("missing"))
    d = reports.join(missing, ["session_id", "area"], "left")
    ok = F.col("status").isin("supported", "partial", "not_found") & (
        (F.col("status") != "supported") | ((F.size("urls") > 0) & (F.coalesce("missing", F.lit(0)) == 0)))
    return d.select("session_id", "area", "status", F.coalesce("missing", F.lit(0)).alias("missing"), ok.alias("accepted"))


# ---------------------------------------------------------------- deterministic stand-ins
def stand_in_stance(text: Column, negated: Column) -> Column:
    """A fixed label from the hash of a text, for dry runs."""
    # md5 mod 3 from its four 32-bit words, as 2^32 mod 3 is 1
    word = lambda i: F.conv(F.substring(F.md5(text), 8 * i + 1, 8), 16, 10).cast("long") % 3
    h = (word(0) + word(1) + word(2) + word(3)) % 3
    return in_turn([(negated, "critical"), (h == 1, "neutral")], "approving")


def stand_in_verdict(value: Column, quote: Column) -> Column:
    """supported when half of the longer words of the value stand in the quote."""
    words = F.filter(F.split(X.match_form(value), " "), lambda w: F.length(w) > 3)
    q = X.match_form(quote)
    hits = F.size(F.filter(words, lambda w: F.contains(q, w)))
    return F.when((F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))), "supported").otherwise("unsupported")
