"""Evidence rows: best per feature, settled or open, validation, stated against observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import rules as R
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.functions.columns import in_turn, lookup, strip
from tessera.operators.ordering import first_per_group


def best_evidence(evidence: DataFrame, key: str = "church_id", tie=("row_id",)) -> DataFrame:
    """Best row per (key, feature): tier first, then the newest check, then `tie`. Map-side combined."""
    rank = F.coalesce(lookup(F.col("tier"), V.TIER_RANK), F.lit(0))
    return first_per_group(evidence, [key, "feature"], [-rank, -F.unix_micros(F.col("checked_at")), *[F.col(t) for t in tie]])


def settled_features(evidence: DataFrame, key="church_id", min_points: int = 5) -> DataFrame:
    """(key, feature, settled): a quoted tier-A row, two tier-B sites, or an observed tier-D row with enough points.

    `key`: a column or several. Two sites are two 64-bit hashes of host names, so one aggregate of fixed width tells.
    """
    keys = [key] if isinstance(key, str) else list(key)
    site = F.when((F.col("tier") == "B") & (F.coalesce("url", F.lit("")) != ""), F.xxhash64(U.host(F.col("url"))))
    return evidence.filter("value <> 'unknown'").select(
        *keys, "feature", site.alias("site"), ((F.col("tier") == "A") & (F.coalesce("quote", F.lit("")) != "")).alias("a"),
        ((F.col("tier") == "D") & (F.col("how") == "observed") & (R.data_points(F.col("note")) >= min_points)).alias("d")).groupBy(*keys, "feature").agg(
        (F.bool_or("a") | F.coalesce(F.min("site") < F.max("site"), F.lit(False)) | F.bool_or("d")).alias("settled"))


def settled_open(wanted: DataFrame, settled: DataFrame, key: str = "church_id") -> DataFrame:
    """Each wanted (key, feature) with its state; features without evidence are open."""
    return wanted.join(settled, [key, "feature"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))


def value_check(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add `value_ok`. Listed features take listed values; free-form ones any short text but the placeholder itself.

    `vocabulary`: (feature, values array).
    """
    d = rows.join(vocabulary.select("feature", "values"), "feature", "left")
    v = strip(F.col("value"))
    free = F.arrays_overlap("values", F.array(*[F.lit(p) for p in V.PLACEHOLDER_VALUES]))
    ok = F.when(free, (v != "") & ~v.isin(V.PLACEHOLDER_VALUES) & (F.length(v) <= 300)).otherwise(
        F.array_contains("values", v) | v.isin(V.ALWAYS_ALLOWED_VALUES))
    return d.withColumn("value_ok", F.coalesce(F.col("values").isNotNull() & ok, F.lit(False))).drop("values")


def submitted_evidence(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Evidence offered by a researcher: adds `error`, null when accepted. Tiers D and prior cannot be offered."""
    known = vocabulary.select("feature", F.lit(True).alias("_known"))
    d = value_check(rows.join(known, "feature", "left"), vocabulary)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    error = in_turn([
        (F.col("_known").isNull(), "unknown feature"), (~F.col("value_ok"), "invalid value"),
        (F.col("tier").isin("D", "prior"), "tier cannot be recorded"), (~has("url"), "url required"),
        (~has("quote") & ~F.col("value").isin(V.ALWAYS_ALLOWED_VALUES), "quote required")], F.lit(None).cast("string"))
    return d.withColumn("error", error).drop("_known", "value_ok")


def verified_quotes(rows: DataFrame, pages: DataFrame, min_chars: int = 12, fuzzy: float | None = None) -> DataFrame:
    """Add `quote_ok`: the quote stands on the page of the same url.

    Exact first. With `fuzzy`, only rows that fail the exact test go to the Arrow
    function for partial similarity.
    """
    d = rows.join(pages.select("url", F.col("text").alias("_page")), "url", "left")
    form = X.match_form if fuzzy is not None else X.blank_form
    exact = X.quote_exact(F.col("quote"), F.col("_page"), min_chars, form)
    d = d.withColumn("quote_ok", F.coalesce(exact, F.lit(False)))
    if fuzzy is not None:
        from tessera.functions.fuzzy import partial_match
        todo = ~F.col("quote_ok") & F.col("_page").isNotNull() & (F.length(form(F.col("quote"))) >= min_chars)
        near = partial_match(fuzzy)(F.when(todo, form(F.col("quote"))), F.when(todo, form(F.col("_page"))))
        d = d.withColumn("quote_ok", F.col("quote_ok") | F.coalesce(near, F.lit(False)))
    return d.drop("_page")


def page_evidence(items: DataFrame, pages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stated items from a page whose quote stands there, whose value is allowed and whose topic fits, as tier-A rows.

    `items`: (url, page_kind, feature, value, status, quote); `pages`: (url, text).
    """
    d = verified_quotes(items.filter("status = 'stated'"), pages).filter("quote_ok")
    d = value_check(d, vocabulary).filter("value_ok")
    d = d.filter(R.topic_scope_reason(F.col("feature"), F.col("value"), F.col("quote")).isNull())
    return d.select("url", "page_kind", "feature", "value", F.lit("A").alias("tier"), F.lit("stated").alias("how"),
                    F.substring("quote", 1, 300).alias("quote"),
                    F.coalesce(lookup(F.col("page_kind"), V.PAGE_SOURCE_KIND), F.lit("website")).alias("source_kind"))


def quote_quality(quote: Column) -> Column:
    """Longer is better; whole sentences gain, shouting loses."""
    q = strip(quote)
    first = F.substring(q, 1, 1)
    upper = (first == F.upper(first)) & (first != F.lower(first))
    whole = upper & q.rlike(r"[.!?]$")
    shout = (q == F.upper(q)) & (q != F.lower(q))
    return F.length(q) + F.when(whole, 40).otherwise(0) - F.when(shout, 60).otherwise(0)


def better_page_evidence(rows: DataFrame, key: str = "church_id", tie=("row_id",)) -> DataFrame:
    """One row per (key, feature): the most fitting page kind, then the fullest quote."""
    rank = F.coalesce(lookup(F.col("page_kind"), V.PAGE_KIND_RANK), F.lit(9))
    return first_per_group(rows, [key, "feature"], [rank, -quote_quality(F.col("quote")), *[F.col(t) for t in tie]])


def stated_vs_observed(evidence: DataFrame, key: str = "church_id", tie: str = "row_id") -> DataFrame:
    """Newest stated and newest observed value of each feature, where both exist."""
    newest = first_per_group(evidence.filter(F.col("how").isin("stated", "observed")).select(key, "feature", "how", "value", "checked_at", tie),
                             [key, "feature", "how"], [-F.unix_micros(F.col("checked_at")), F.col(tie)])
    both = newest.groupBy(key, "feature").pivot("how", ["stated", "observed"]).agg(F.first("value"))
    return both.filter("stated is not null and observed is not null").withColumn("agrees", F.col("stated") == F.col("observed"))


def identity_priors(groups: DataFrame, fields: DataFrame, features: DataFrame, curated: DataFrame | None = None,
                    rules: DataFrame | None = None) -> DataFrame:
    """(group_id, feature, value, note): what a group typically holds, from free-text cells by ordered rules.

    `fields`: (group_id, field_id, value, evidence array<struct<action, human_decision, ...>>); `features`:
    (feature, denom_field, sensitive). Sensitive cells filled by a model count only after a person accepted them.
    `curated`: (group_id, feature, value) takes precedence for branch and tradition.
    """
    f = features.filter("denom_field is not null").select("feature", F.col("denom_field").alias("field_id"),
                                                          F.coalesce("sensitive", F.lit(False)).alias("sensitive"))
    held = F.exists("evidence", lambda e: e["action"].isin("fill", "conflict")
                    & (F.coalesce(e["human_decision"], F.lit("")) != "accept"))
    cells = (fields.filter(F.coalesce("value", F.lit("")) != "").join(f, "field_id")
             .filter(~(F.col("sensitive") & F.coalesce(held, F.lit(False)))))
    mapped = map_values(cells.select("group_id", "feature", F.col("value").alias("text")), rules)
    named = groups.select("group_id", F.lit("identity.denomination").alias("feature"), F.col("group_id").alias("value"),
                          F.lit("denomination id").alias("text"))
    out = mapped.filter("value is not null and feature <> 'identity.denomination'").select("group_id", "feature", "value", "text").unionByName(named)
    if curated is not None:
        c = curated.select("group_id", "feature", "value", F.lit("curated").alias("text"))
        out = out.join(c.select("group_id", "feature"), ["group_id", "feature"], "left_anti").unionByName(c)
    return out.join(groups.select("group_id", "name"), "group_id").select(
        "group_id", "feature", "value", F.substring(F.concat(F.lit("typical for "), "name", F.lit(": "), "text"), 1, 300).alias("note"))


def rule_table(spark) -> DataFrame:
    """The fixed value rules as a table (feature, ord, pattern, value)."""
    return spark.createDataFrame([(f, i, p, v) for i, (f, p, v) in enumerate(V.VALUE_RULES)],
                                 "feature string, ord int, pattern string, value string")


def map_values(cells: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Free text -> allowed value: the first rule of the feature that matches. Null when wording about variation comes first.

    The rules of a feature travel as one short array, so a cell stays one row.
    """
    r = rules if rules is not None else rule_table(cells.sparkSession)
    lists = r.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("ord", "pattern", "value"))).alias("_rules"))
    d = cells.join(lists, "feature", "left")
    text = F.col("text")
    at = lambda p: F.regexp_instr(text, F.concat(F.lit("(?i)"), p))
    hit = F.get(F.filter("_rules", lambda x: at(x["pattern"]) > 0), F.lit(0))
    varies = F.regexp_instr(text, F.lit(V.VARIES))
    blocked = (varies > 0) & (at(hit["pattern"]) > varies)
    value = F.when(~text.rlike(V.NOT_APPLICABLE) & (text != "") & ~F.coalesce(blocked, F.lit(False)), hit["value"])
    return d.withColumn("value", value).drop("_rules")


def with_variability(priors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds `variability`: how much congregations of the group differ on the feature's subject. `metadata`: (group_id, field_id, value)."""
    kind = F.coalesce(lookup(F.substring_index("feature", ".", 1), V.VARIABILITY_KIND), F.lit("cultural"))
    m = metadata.select(F.col("group_id").alias("_g"), F.col("field_id").alias("_f"), F.col("value").alias("_text"))
    field = F.concat(F.lit("distinguishing_metadata."), kind, F.lit("_variability"))
    d = priors.join(m, (F.col("group_id") == F.col("_g")) & (F.col("_f") == field), "left")
    return d.withColumn("variability", R.variability(F.col("_text"))).drop("_g", "_f", "_text")


def priors_available(priors: DataFrame) -> DataFrame:
    return priors.groupBy("feature").agg(F.count(F.lit(1)).alias("n_groups"))


def compare_groups(priors: DataFrame, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Two groups side by side on the wanted features. `pairs`: (a, b); `same` only where both have a value."""
    p = priors.select("group_id", "feature", "value")
    side = lambda c: pairs.join(p.withColumnRenamed("group_id", c), c).join(wanted.select("feature"), "feature", "left_semi")
    a, b = side("a").withColumnRenamed("value", "value_a"), side("b").withColumnRenamed("value", "value_b")
    d = a.join(b, ["a", "b", "feature"], "full")
    return d.withColumn("same", F.when(F.col("value_a").isNotNull() & F.col("value_b").isNotNull(), F.col("value_a") == F.col("value_b")))
