"""Rule expressions over names, values, notes and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions.columns import in_turn, lookup, steps, strip


def clean_group_name(name: Column) -> Column:
    """Organisation suffixes removed until none is left."""
    return F.regexp_replace(F.regexp_replace(name, V.NAME_SUFFIX, ""), r"^[ ,]+|[ ,]+$", "")


def name_tokens(name: Column) -> Column:
    found = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(V.NAME_STOPWORDS)))


def name_core(name: Column) -> Column:
    found = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0))
    return F.array_join(F.filter(found, lambda t: ~t.isin(V.GENERIC_NAME_WORDS)), " ")


def same_name(title: Column, name: Column) -> Column:
    form = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("the "), F.lit(" ")), "[^a-z0-9]+", " "))
    return form(title).isin(form(name), form(clean_group_name(name)))


def name_overlap(a: Column, b: Column) -> Column:
    """Shared share of the name words of two names."""
    x, y = name_tokens(a), name_tokens(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def is_member(group_id: Column, name: Column) -> Column:
    """Not screened out by id, by name, or as another faith."""
    return ~group_id.isin(V.NON_MEMBER_IDS) & ~name.rlike(V.NON_MEMBER_NAME) & ~name.rlike(V.OTHER_FAITH_NAME)


def is_unknown_cell(v: Column) -> Column:
    return v.isNull() | F.lower(strip(v)).isin(V.UNKNOWN_CELL)


def is_unknown_evidence(v: Column) -> Column:
    return v.isNull() | F.lower(strip(v)).isin(V.UNKNOWN_EVIDENCE)


def data_points(note: Column) -> Column:
    """n of a `k of n` note, else 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(note, F.lit("")), V.K_OF_N, 2).try_cast("int"), F.lit(0))


def variability(text: Column) -> Column:
    low = F.lower(text)
    return in_turn([(text.isNull() | (text == ""), 0.3), (low.contains("low"), 0.15), (low.contains("high"), 0.5)], 0.3)


def score_confidence(score: Column) -> Column:
    return steps(score, [(100, 0.9), (88, 0.8), (85, 0.6), (70, 0.3)], 0.2)


def fit_label(score: Column, known_share: Column) -> Column:
    return F.when(known_share < 0.4, "unknown").otherwise(
        steps(score, [(70, "strong"), (58, "possible"), (45, "unlikely")], "poor"))


def length_bucket(minutes: Column) -> Column:
    return F.when(minutes < 20, "under_20").when(minutes <= 35, "20_35").otherwise("over_35")


def preference_step(strength: Column, conf: Column, sensitive: Column, src: Column) -> Column:
    """0-3: how much a belief counts. Doubt lowers it by one, unconfirmed sensitive guesses stop at one."""
    base = F.when(strength >= 0.8, 3).when(strength >= 0.5, 2).when(strength > 0.15, 1).otherwise(0)
    sure = F.when(conf < 0.5, F.greatest(F.lit(0), base - 1)).otherwise(base)
    return F.when(F.coalesce(sensitive, F.lit(False)) & src.isin("inferred", "lexicon"), F.least(sure, F.lit(1))).otherwise(sure)


def weight_name(step: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in V.WEIGHT_STEPS]), step)


def topic_scope_reason(feature: Column, value: Column, quote: Column) -> Column:
    """Why a quote cannot settle the feature, or null."""
    q = F.coalesce(quote, F.lit(""))
    defines = q.rlike(V.MARRIAGE_DEFINITION)
    return (F.when((feature == "lgbtq.inclusion") & ~value.isin(V.ALWAYS_ALLOWED_VALUES) & defines
                   & ~q.rlike(V.INCLUSION_WORDS), "definition settles another feature")
            .when((feature == "lgbtq.marriage") & (value == "traditional") & (q != "") & ~defines, "quote defines nothing"))


def evidence_phrase(tier: Column, source_kind: Column, note: Column, feature: Column, label: Column) -> Column:
    """Plain words for where a value comes from."""
    kind = F.coalesce(lookup(source_kind, V.KIND_PHRASES), F.replace(source_kind, F.lit("_"), F.lit(" ")))
    note = F.coalesce(note, F.lit(""))
    return in_turn([
        (tier == "A", F.concat(F.lit("their "), kind, F.lit(" says so"))),
        (tier == "B", F.concat(kind, F.lit(" reports it"))),
        (tier == "C", F.lit("a third-party listing suggests it")),
        (tier == "D", F.when(note != "", F.concat(F.lit("inferred: "), note)).otherwise("inferred")),
        (feature.startswith("identity."), F.concat(F.lit("from its denomination ("), label, F.lit(")"))),
    ], F.concat(F.lit("typical for "), label, F.lit("; may differ locally")))


def city_of(address: Column) -> Column:
    parts = F.transform(F.split(address, ",", -1), lambda p: F.trim(p))
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise("")


def clean_origin(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, V.ORIGIN_DISTANCE, ""), r"^[ ,;]+|[ ,;]+$", "")


def needs_care(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(V.SAFETY_WORDS)


def fresh_within(ts: Column, now: Column, days) -> Column:
    """Whether a time lies within `days` before `now`; unreadable times never do."""
    d = days if not isinstance(days, int) else F.lit(days)
    return F.coalesce(F.try_to_timestamp(ts.cast("string")) >= now - F.make_dt_interval(d.cast("int")), F.lit(False))


def call_cost(prompt_tokens: Column, completion_tokens: Column, price_in: Column, price_out: Column) -> Column:
    return (prompt_tokens * price_in + completion_tokens * price_out) / F.lit(1_000_000)
