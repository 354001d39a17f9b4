"""Filling a wide knowledge table: cells, work lists, proposals, verdicts, merged table, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import rules as R
from tessera.functions.columns import in_turn, lookup
from tessera.operators.ordering import first_per_group, top_per_group


def long_cells(layer: DataFrame, fields: DataFrame, layer_name: str, id_col: str = "id", name_col: str = "census_name") -> DataFrame:
    """Wide layer sheet -> (group_id, field_id, value). Column headers are matched to field descriptions."""
    labels = [c for c in layer.columns if c not in (id_col, name_col)]
    long = layer.select(F.col(id_col).alias("group_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in labels]).unpivot(
        ["group_id"], labels, "label", "value")
    f = fields.filter(F.col("layer") == layer_name).select("field_id", F.lower(F.trim("description")).alias("_d"))
    return long.filter("group_id is not null and group_id <> ''").join(f, F.lower(F.trim("label")) == F.col("_d")).select(
        "group_id", "field_id", F.coalesce("value", F.lit("")).alias("value"))


def wide_output(cells: DataFrame, proposals: DataFrame, field_ids: list[str]) -> DataFrame:
    """Wide table with applied fills and not-applicable marks; conflicts leave the value alone. `field_ids` are the columns.

    Of proposals with one time and one text the first by `seq` counts, or where there is no `seq`, a fill.
    """
    tie = [F.col("seq")] if "seq" in proposals.columns else []
    last = first_per_group(proposals.filter(F.col("action").isin("fill", "not_applicable")).select(
        "group_id", "field_id", "action", "new_value", "checked_at", *tie), ["group_id", "field_id"],
        [-F.unix_micros(F.col("checked_at")), F.col("new_value"), *tie, F.col("action")])
    d = cells.join(last, ["group_id", "field_id"], "left").withColumn("value", in_turn(
        [(F.col("action") == "fill", F.col("new_value")), (F.col("action") == "not_applicable", "Not applicable")], F.col("value")))
    return d.groupBy("group_id").pivot("field_id", field_ids).agg(F.first("value"))


def appended_evidence(proposals: DataFrame) -> DataFrame:
    status = lookup(F.col("action"), [("fill", "model_extracted_needs_review"), ("confirm", "model_confirmed_needs_review"),
                                      ("conflict", "model_conflict_needs_review")])
    return proposals.filter(F.col("action").isin(V.CHECKED_ACTIONS)).select(
        "group_id", "field_id", status.alias("status"), source_id(F.col("url")).alias("source_ids"),
        F.date_format("checked_at", "yyyy-MM-dd").alias("verified"), F.concat(F.lit('Quote: "'), F.substring("quote", 1, 500), F.lit('"')).alias("notes"))


def source_id(url: Column) -> Column:
    return F.concat(F.lit("dkb_"), F.substring(F.sha1(url), 1, 10))


def new_sources(proposals: DataFrame, known: DataFrame) -> DataFrame:
    """Register rows for addresses not known yet, typed by the first proposal (smallest `seq`) that cites them."""
    d = proposals.filter(F.col("url").startswith("http")).groupBy("url").agg(F.min_by("source_type", "seq").alias("source_type"))
    d = d.join(known.select("url"), "url", "left_anti")
    return d.select(source_id(F.col("url")).alias("id"), F.col("url").alias("title"), "url",
                    F.coalesce(lookup(F.col("source_type"), V.SOURCE_TYPE_LABEL), F.col("source_type")).alias("type"))


def source_urls(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Registered addresses of each group from the id lists of its evidence."""
    ids = evidence.select("group_id", F.explode(F.split("source_ids", "[;,]")).alias("id")).select("group_id", F.trim("id").alias("id"))
    return ids.filter("id <> ''").distinct().join(sources.filter("url <> ''").select("id", "url"), "id").select("group_id", "id", "url")


def field_specs(dictionary: DataFrame) -> DataFrame:
    """Extraction spec per field: whether to extract, whether restricted, and search words."""
    spark = dictionary.sparkSession
    words = spark.createDataFrame(V.FIELD_KEYWORDS, "subtopic string, _words string")
    f = F.col("field_id")
    extract = ~f.isin(V.FIELDS_NEVER_EXTRACTED) & ((F.col("layer") != "distinguishing_metadata") | f.isin(V.METADATA_FIELDS_EXTRACTED))
    restricted = ((F.col("layer") == "theology") & ~f.isin(V.THEOLOGY_FIELDS_FOR_ALL)) | f.isin(V.OTHER_RESTRICTED_FIELDS)
    return dictionary.join(words, "subtopic", "left").select(
        "field_id", "layer", "description", extract.alias("extract"), restricted.alias("christian_only"),
        F.coalesce("_words", F.lower("description")).alias("keywords"))


def field_examples(cells: DataFrame, n: int = 3, max_chars: int = 90) -> DataFrame:
    """Up to `n` distinct short known values per field."""
    d = cells.filter(~R.is_unknown_cell(F.col("value")) & (F.col("value") != "Not applicable") & (F.length("value") <= max_chars))
    once = d.groupBy("field_id", "value").agg(F.min("group_id").alias("_first"))
    return top_per_group(once, ["field_id"], [F.col("_first"), F.col("value")], n, "rn").groupBy("field_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]).alias("examples"))


def group_order(groups: DataFrame, only=None, skip=None, limit: int | None = None) -> DataFrame:
    """Work order: largest groups first, with optional choice, exclusion and limit."""
    d = groups
    if only:
        d = d.filter(F.col("group_id").isin(list(only)))
    if skip:
        d = d.filter(~F.col("group_id").isin(list(skip)))
    d = d.orderBy(F.desc(F.coalesce("adherents", F.lit(0))), "group_id")
    return d.limit(limit) if limit else d


def member_flags(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(group_id, is_christian, basis) from the stated family, else from the name."""
    fam = cells.filter("field_id = 'identity.primary_family'").select("group_id", F.col("value").alias("family"))
    d = groups.join(fam, "group_id", "left")
    known = ~R.is_unknown_cell(F.col("family"))
    return d.select("group_id", in_turn([
        (known, F.when(F.col("family").rlike(V.OTHER_FAITH_FAMILY), "no").otherwise("yes")),
        (F.col("census_name").rlike(V.OTHER_FAITH_FAMILY), "no")], "unclear").alias("is_christian"),
        in_turn([(known, F.concat(F.lit("workbook family: "), "family")), (F.col("census_name").rlike(V.OTHER_FAITH_FAMILY), "group name")], "no sources").alias("basis"))


def graph_facts(claims: DataFrame) -> DataFrame:
    """Knowledge-graph claim JSON -> (group_id, qid, fact, value): site, founding year, founder and place ids.

    `claims`: (group_id, qid, body) with the entity JSON. Ids are turned into names by a label table later.
    """
    val = "struct<mainsnak:struct<datavalue:struct<value:string>>>"
    parsed = F.from_json("body", f"struct<entities:map<string,struct<claims:map<string,array<{val}>>>>>")
    c = F.element_at(F.element_at(parsed["entities"], F.col("qid"))["claims"], F.col("prop"))
    names = F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(f).alias("fact")) for p, f in
                      (("P856", "official_website"), ("P571", "founding_year"), ("P112", "founders"), ("P740", "founding_location"))])
    d = claims.withColumn("_p", F.explode(names)).select("group_id", "qid", "body", "_p.prop", "_p.fact").withColumn(
        "v", F.array_compact(F.transform(c, lambda x: x["mainsnak"]["datavalue"]["value"])))
    first = F.get("v", F.lit(0))
    ids = F.array_join(F.array_compact(F.transform("v", lambda x: F.get_json_object(x, "$.id"))), ",")
    value = in_turn([(F.col("fact") == "official_website", first),
                     (F.col("fact") == "founding_year", F.regexp_extract(F.get_json_object(first, "$.time"), r"^[+-](\d{4})", 1))], ids)
    return d.select("group_id", "qid", "fact", F.nullif(value, F.lit("")).alias("value")).filter("value is not null")


def graph_fills(facts: DataFrame, cells: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Deterministic fills of unknown cells from knowledge-graph facts. `labels`: (id, label) for entity ids."""
    field = lookup(F.col("fact"), V.GRAPH_FACTS)
    d = facts.withColumn("field_id", field)
    if labels is not None:
        ids = d.filter(F.col("fact").isin("founders", "founding_location")).select("group_id", "qid", "fact", "field_id", F.posexplode(F.split("value", ",")).alias("p", "id"))
        named = ids.join(labels, "id").groupBy("group_id", "qid", "fact", "field_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "label"))), lambda s: s["label"]), ", ").alias("value"))
        d = d.filter(~F.col("fact").isin("founders", "founding_location")).select("group_id", "qid", "fact", "field_id", "value").unionByName(named)
    known = cells.filter(~R.is_unknown_cell(F.col("value"))).select("group_id", "field_id")
    return d.join(known, ["group_id", "field_id"], "left_anti").select(
        "group_id", "field_id", F.lit("fill").alias("action"), F.col("value").alias("new_value"),
        F.concat(F.lit("Wikidata "), "qid").alias("quote"), F.lit("wikidata").alias("source_type"), F.lit("medium").alias("confidence"))


def work_list(cells: DataFrame, specs: DataFrame, groups: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Route of every (group, field): extract, validate, not_applicable. Fields filled deterministically are left out.

    `groups`: (group_id, is_christian). The field list is a fixed vocabulary, so it rides along as an array.
    """
    spec_set = specs.filter("extract").agg(F.collect_list(F.struct("field_id", "christian_only"))).scalar()
    d = groups.select("group_id", "is_christian", F.inline(spec_set)).join(cells, ["group_id", "field_id"], "left")
    if done is not None:
        d = d.join(done.select("group_id", "field_id"), ["group_id", "field_id"], "left_anti")
    unknown = R.is_unknown_cell(F.col("value"))
    shut = F.col("christian_only") & (F.col("is_christian") == "no")
    route = in_turn([(shut & unknown, "not_applicable"), (shut, F.lit(None).cast("string")), (unknown, "extract"),
                     (F.col("value") != "Not applicable", "validate")], F.lit(None).cast("string"))
    return d.withColumn("route", route).filter("route is not null").select("group_id", "field_id", "value", "route")


def proposal_confidence(source_type: Column) -> Column:
    return F.when(source_type.isin("official", "register"), "high").otherwise("medium")


def extracted_proposals(found: DataFrame) -> DataFrame:
    """Validated extraction rows -> fill proposals."""
    return found.select("group_id", "field_id", F.lit("fill").alias("action"), F.col("value").alias("new_value"), "quote", "url",
                        "source_type", proposal_confidence(F.col("source_type")).alias("confidence"))


def validated_proposals(checked: DataFrame, cells: DataFrame) -> DataFrame:
    """Validation verdicts -> confirm (value kept) or conflict (value proposed)."""
    d = checked.filter("verdict <> 'not_addressed'").join(cells, ["group_id", "field_id"], "left")
    ok = F.col("verdict") == "supported"
    return d.select("group_id", "field_id", F.when(ok, "confirm").otherwise("conflict").alias("action"),
                    F.when(ok, F.col("value")).otherwise(F.col("corrected_value")).alias("new_value"), "quote", "url", "source_type",
                    proposal_confidence(F.col("source_type")).alias("confidence"))


# ---------------------------------------------------------------- verdicts and application
def is_applied(sensitive_fields=None) -> Column:
    """Whether a proposal changes the table: a person's word, then the hold on sensitive fields, then the verdict.

    Needs human_decision, field_id, action, source_type, verdict.
    """
    decided = F.coalesce("human_decision", F.lit(""))
    held = F.col("field_id").isin(sensitive_fields or V.SENSITIVE_FIELDS) & F.col("action").isin("fill", "conflict")
    unchecked = ~F.col("action").isin(V.CHECKED_ACTIONS) | (F.col("source_type") == "wikidata")
    return in_turn([(decided == "accept", True), (decided == "reject", False), (held, False), (unchecked, True)],
                   F.col("verdict").isNull() | (F.col("verdict") == "supported"))


def needs_check(model: str, version: str) -> Column:
    """Whether a claim still wants a verdict by this model and version."""
    checkable = F.col("action").isin(V.CHECKED_ACTIONS) & (F.col("source_type") != "wikidata")
    return checkable & (F.col("verdict").isNull() | ~F.col("verify_model").eqNullSafe(F.lit(model)) | ~F.col("verify_version").eqNullSafe(F.lit(version)))


def apply_review(proposals: DataFrame, sheet: DataFrame) -> DataFrame:
    """Reviewed decisions onto proposals, by group, field, action and value. Of several rows the last (largest `row_no`) counts."""
    d = F.lower(F.trim("review_decision"))
    key = ["group_id", "field_id", "action", "new_value"]
    s = sheet.withColumn("_d", d).filter(F.col("_d").isin("accept", "reject")).groupBy(*key).agg(F.max_by("_d", "row_no").alias("_d"))
    j = proposals.join(s, key, "left")
    return j.withColumn("human_decision", F.coalesce("_d", F.col("human_decision"))).drop("_d")


def merged_table(groups: DataFrame, cells: DataFrame, proposals: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Per (group, field) the value and status after all applied proposals, with the evidence list in order.

    The last action decides the status; the last fill or mark decides the value. Proposals of one cell are few.
    """
    status = lookup(F.col("action"), [("fill", "model_extracted_needs_review"), ("not_applicable", "not_applicable"),
                                      ("confirm", "model_confirmed_needs_review"), ("conflict", "conflict_needs_review")])
    order = F.struct("checked_at", "seq")
    setting = F.col("action").isin("fill", "not_applicable")
    new = F.when(F.col("action") == "fill", F.col("new_value")).otherwise("Not applicable")
    agg = proposals.groupBy("group_id", "field_id").agg(
        F.max_by(F.when(setting, new), F.when(setting, order)).alias("_v"), F.max_by(status, order).alias("_s"),
        F.array_sort(F.collect_list(F.struct("checked_at", "seq", "action", "quote", "url", "source_type", "confidence",
                                             F.when(F.col("action") == "conflict", F.col("new_value")).alias("proposed_value")))).alias("evidence"))
    d = cells.join(groups.select("group_id"), "group_id", "left_semi").join(agg, ["group_id", "field_id"], "left")
    if statuses is not None:
        d = d.join(statuses.select("group_id", "field_id", F.col("status").alias("_old")), ["group_id", "field_id"], "left")
    else:
        d = d.withColumn("_old", F.lit(None).cast("string"))
    unknown = R.is_unknown_cell(F.col("value"))
    return d.select("group_id", "field_id", F.coalesce("_v", F.when(~unknown, F.col("value"))).alias("value"),
                    F.coalesce("_s", F.nullif("_old", F.lit("")), F.when(unknown, "unknown").otherwise("unsourced")).alias("status"), "evidence")


def layer_coverage(cells: DataFrame, fields: DataFrame, proposals: DataFrame) -> DataFrame:
    """Known cells per layer before and after, with action counts."""
    layer = fields.select("field_id", "layer")
    before = cells.join(layer, "field_id").groupBy("layer").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~R.is_unknown_cell(F.col("value"))).alias("known_before"))
    acts = proposals.join(layer, "field_id").groupBy("layer").agg(*[
        F.count_if(F.col("action") == a).alias(a) for a in ("fill", "not_applicable", "confirm", "conflict")])
    d = before.join(acts, "layer", "left").na.fill(0)
    after = F.col("known_before") + F.col("fill") + F.col("not_applicable")
    return d.withColumn("known_after", after).withColumn("share_before", F.col("known_before") / F.col("cells")).withColumn("share_after", after / F.col("cells"))


def verification_report(proposals: DataFrame) -> DataFrame:
    """Verdict counts per action and source, with claims still unverified and sensitive ones held back."""
    held = F.col("field_id").isin(V.SENSITIVE_FIELDS) & F.col("action").isin("fill", "conflict") & (F.coalesce("human_decision", F.lit("")) == "")
    open_ = F.col("action").isin(V.CHECKED_ACTIONS) & (F.col("source_type") != "wikidata") & F.col("verdict").isNull()
    return proposals.groupBy("action", "source_type").agg(
        F.count("verdict").alias("checked"), *[F.count_if(F.col("verdict") == v).alias(v) for v in V.VERDICTS],
        F.count_if(open_).alias("unverified"), F.count_if(held).alias("held_back"))


def group_status(proposals: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Action counts per group, with skipped request batches. `batches`: (group_id, batch, ok)."""
    d = proposals.groupBy("group_id").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("fill", "confirm", "conflict", "not_applicable")])
    if batches is not None:
        d = d.join(batches.groupBy("group_id").agg(F.count_if(~F.col("ok")).alias("skipped_batches")), "group_id", "left").na.fill(0)
    return d


def redo_groups(done: DataFrame, groups: DataFrame) -> DataFrame:
    """Finished groups that had no passages at all, to be processed again."""
    return groups.join(done.filter("chunks = 0").select("group_id"), "group_id", "left_semi")
