"""Names to known groups: abbreviations, aliases inside text, near spellings, family words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import rules as R
from tessera.functions import text as X
from tessera.functions.columns import computed_once, in_turn, let
from tessera.functions.fuzzy import token_sort_ratio
from tessera.operators.matching import size_boost
from tessera.operators.ordering import first_per_group, top_per_group

WORD = "[a-z]+"


def _letter_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def alias_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, group_id, score) by exact name, abbreviation token, or alias standing as whole words inside the name.

    An alias of w words can only stand where its w letter-words stand in a row, so
    runs of words are the join key; the exact test runs on those few pairs.
    `names`: (name); `aliases`: (alias, group_id).
    """
    a = aliases.filter("alias <> ''").withColumn("_bare", F.regexp_replace("alias", "[&()]", ""))
    a = a.withColumn("_abbr", (F.length("_bare") <= 6) & (F.upper("_bare") == F.col("_bare")) & (F.lower("_bare") != F.col("_bare")))
    n = names.select("name").distinct().filter("name <> ''")

    lengths = X.run_lengths(a.filter("not _abbr"), _letter_words(F.col("alias")))

    def runs(c):
        return let(_letter_words(c), lambda w: X.runs_of(w, lengths))
    exact = n.withColumn("_low", F.lower("name")).join(a.filter("not _abbr").withColumn("_low", F.lower("alias")), "_low").select(
        "name", "group_id", F.lit(100.0).alias("score"))
    inside = (n.select("name", F.explode(runs(F.col("name"))).alias("_run"))
              .join(a.filter("not _abbr").withColumn("_run", F.array_join(_letter_words(F.col("alias")), " ")).filter("_run <> ''"), "_run"))
    whole = F.concat(F.lit(r"(?<![A-Za-z])\Q"), F.lower("alias"), F.lit(r"\E(?![A-Za-z])"))
    inside = inside.filter(F.regexp_like(F.lower("name"), whole) & (F.lower("name") != F.lower("alias"))).select(
        "name", "group_id", (88 + F.least(F.lit(10.0), F.length("alias") / 3)).alias("score"))
    tokens = F.array_union(F.regexp_extract_all("name", F.lit("[A-Za-z&]+"), F.lit(0)), F.array(F.col("name")))
    abbr = n.select("name", F.explode(tokens).alias("alias")).join(a.filter("_abbr").select("alias", "group_id"), "alias").select(
        "name", "group_id", F.lit(100.0).alias("score"))
    # an abbreviation with a bracket may stand anywhere: joined on what follows the bracket, up to its end
    opened = F.regexp_extract_all("name", F.lit(r"\(([A-Za-z&]*)"), F.lit(1))
    starts = F.flatten(F.transform(opened, lambda c: F.transform(F.sequence(F.lit(0), F.least(F.length(c), F.lit(6))), lambda i: F.substring(c, F.lit(1), i))))
    inner = a.filter("_abbr and instr(alias, '(') > 0").select("alias", "group_id", F.regexp_extract("alias", r"\(([A-Za-z&]*)", 1).alias("_in"))
    abbr = abbr.unionByName(n.select("name", F.explode(F.array_distinct(starts)).alias("_in")).join(inner, "_in").filter(F.contains("name", F.col("alias"))).select(
        "name", "group_id", F.lit(100.0).alias("score")))
    return exact.unionByName(inside).unionByName(abbr).groupBy("name", "group_id").agg(F.max("score").alias("score"))


def near_pairs(left: DataFrame, right: DataFrame, min_ratio: float = 85.0) -> DataFrame:
    """All (a, b) whose word-sorted similarity can reach `min_ratio`, found without comparing all pairs.

    At ratio r, strings of lengths L and M differ by at most (1-r)(L+M) insertions and
    deletions. Cut b into one more piece than that: some piece must stand unchanged in a,
    shifted by no more than the allowance. Pieces are the join key, so no pair above the
    ratio is missed and none is tried without a shared piece. `left`: (a); `right`: (b).
    """
    r = min_ratio / 100.0
    tau = lambda n: F.floor(F.lit(1 - r) * (n + n * F.lit((2 - r) / r)) + 1e-9).cast("int")
    sort = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    b = right.select("b").distinct().withColumn("_s", sort(F.col("b"))).withColumn("_L", F.length("_s")).filter("_L > 0")
    size_at = lambda L, k, i: F.floor(L / k).cast("int") + F.when(i >= k - L % k, 1).otherwise(0)
    start_at = lambda L, k, i: i * F.floor(L / k).cast("int") + F.greatest(i - (k - L % k), F.lit(0))

    def pieces(k):
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(
            i.alias("i"), F.substring(F.col("_s"), start_at(F.col("_L"), k, i) + 1, size_at(F.col("_L"), k, i)).alias("piece")))
    bk = b.select("b", "_L", F.inline(let(F.least(tau(F.col("_L")) + 1, F.col("_L")), pieces)))
    lengths = right.agg(F.struct(F.min(F.length("b")).alias("lo"), F.max(F.length("b")).alias("hi"))).scalar()
    a = left.select("a").distinct().withColumn("_s", sort(F.col("a"))).withColumn("_M", F.length("_s")).filter("_M > 0")
    q = r / (2 - r)
    lo = F.greatest(F.ceil(F.col("_M") * q - 1e-9).cast("int"), F.coalesce(lengths["lo"], F.lit(1)), F.lit(1))
    hi = F.least(F.floor(F.col("_M") / q + 1e-9).cast("int"), F.coalesce(lengths["hi"], F.lit(0)))

    def probes(L):
        k = F.least(tau(L) + 1, L)
        t = tau(L)

        def at(i):
            n, p = size_at(L, k, i), start_at(L, k, i)
            first, last = F.greatest(p - t, F.lit(0)), F.least(p + t, F.col("_M") - n)
            return F.when(last >= first, F.transform(F.sequence(first, F.greatest(last, first)), lambda x: F.struct(
                L.alias("_L"), i.alias("i"), F.substring(F.col("_s"), x + 1, n).alias("piece")))).otherwise(
                F.array().cast("array<struct<_L:int,i:int,piece:string>>"))
        return F.flatten(F.transform(F.sequence(F.lit(0), k - 1), at))
    a = computed_once(a, _lo=lo, _hi=hi).filter("_lo <= _hi")
    ak = a.select("a", F.inline(F.array_distinct(F.flatten(F.transform(F.sequence("_lo", F.greatest("_lo", "_hi")), probes)))))
    return ak.join(bk, ["_L", "i", "piece"]).select("a", "b").distinct()


def fuzzy_matches(names: DataFrame, known: DataFrame, min_ratio: float = 85.0, limit: int = 5) -> DataFrame:
    """(name, group_id, score) for near spellings: generic words dropped, two words or more on both sides, score x 0.9."""
    multi = lambda d, c: d.filter(F.size(F.split(c, " ")) >= 2)
    left = multi(names.select("name", R.name_core(F.col("name")).alias("a")), "a")
    right = multi(known.select("group_id", R.name_core(F.col("known_name")).alias("b")), "b")
    pairs = near_pairs(left, right, min_ratio).withColumn("ratio", token_sort_ratio("a", "b")).filter(F.col("ratio") >= min_ratio)
    d = left.join(pairs, "a").join(right, "b")
    best = top_per_group(d, ["name"], [F.desc("ratio"), F.col("group_id")], limit)
    return best.groupBy("name", "group_id").agg((F.max("ratio") * 0.9).alias("score"))


def family_matches(names: DataFrame, groups: DataFrame, per_family: int = 3, words=None) -> DataFrame:
    """The largest groups of each family word that opens a word of the name, at score 70. `groups`: (group_id, known_name, adherents)."""
    fam = F.array(*[F.lit(w) for w in (words or V.FAMILY_WORDS)])
    g = groups.select("group_id", "adherents", F.explode(F.filter(fam, lambda w: F.contains(F.lower("known_name"), w))).alias("family"))
    largest = top_per_group(g, ["family"], [F.desc(F.coalesce("adherents", F.lit(0))), F.col("group_id")], per_family)
    n = names.select("name", F.explode(F.filter(fam, lambda w: F.regexp_like(F.lower("name"), F.concat(F.lit(r"\b"), w)))).alias("family"))
    return n.join(largest, "family").select("name", "group_id", F.lit(70.0).alias("score")).distinct()


def find_groups(names: DataFrame, aliases: DataFrame, groups: DataFrame, k: int = 5, fuzzy: bool = True, family_words=None,
                banned=None) -> DataFrame:
    """The `k` best groups for each name, with score. Family words serve only names nothing else matched."""
    n = names.select("name").distinct()
    hits = alias_matches(n, aliases)
    if fuzzy:
        hits = hits.unionByName(fuzzy_matches(n, groups))
    scores = hits.groupBy("name", "group_id").agg(F.max("score").alias("score"))
    scores = scores.unionByName(family_matches(n.join(scores, "name", "left_anti"), groups, words=family_words))
    known = groups.select("group_id", F.col("known_name").alias("label"), "adherents")
    known = known.filter(~F.col("group_id").isin(banned) if banned else R.is_member(F.col("group_id"), F.col("label")))
    d = scores.join(known, "group_id")
    return top_per_group(d, ["name"], [F.desc(F.col("score") + size_boost(F.col("adherents"))), F.col("group_id")], k, "rn").select(
        "name", "rn", "group_id", "label", F.round("score", 1).alias("score"))


def without_non_members(places: DataFrame, name: str = "name", group_id: str = "group_id") -> DataFrame:
    """Candidates whose own name or resolved group is not screened out; other faiths are recognised by the group only."""
    return places.filter(~F.coalesce(F.col(name).rlike(V.NON_MEMBER_NAME), F.lit(False)) & ~F.coalesce(F.col(group_id).isin(V.NON_MEMBER_IDS), F.lit(False)))


def resolve(places: DataFrame, found: DataFrame, found_tags: DataFrame | None = None, site: DataFrame | None = None) -> DataFrame:
    """Affiliation guess per place: name rule, known name, map tag, own website; the first sure one, else the surest.

    `places`: (church_id, name, tag); `found`/`found_tags`: `find_groups` output for names and tags;
    `site`: (church_id, group_id, label, confidence) from `site_affiliation`.
    """
    base = places.select("church_id", "name", *(["tag"] if "tag" in places.columns else []))
    none = F.lit(None).cast("string")
    guess = lambda d, prio, gid, label, conf, method: d.select(
        "church_id", F.lit(prio).alias("prio"), gid.alias("group_id"), label.alias("label"), conf.cast("double").alias("confidence"),
        F.lit(method).alias("method"))
    rule = guess(base.filter(F.col("name").rlike(V.NO_AFFILIATION_NAME)), 1, none, F.lit("Non-denominational"), F.lit(0.8), "name")
    top = found.filter("rn = 1")
    named = guess(base.join(top, "name"), 2, F.col("group_id"), F.col("label"), R.score_confidence(F.col("score")), "name")
    parts = [rule, named]
    if found_tags is not None:
        t = found_tags.filter("rn = 1").withColumnRenamed("name", "tag")
        parts.append(guess(base.select("church_id", "tag").join(t, "tag"), 3, F.col("group_id"), F.col("label"), F.lit(0.6), "name"))
    if site is not None:
        parts.append(guess(site, 4, F.col("group_id"), F.col("label"), F.col("confidence"), "website"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # sure guesses compete by priority, the rest by confidence (then priority)
    pick = F.struct(F.when(F.col("confidence") >= 0.8, F.struct(F.lit(0.0).alias("x"), F.col("prio").alias("p"))).otherwise(
        F.struct((1 - F.col("confidence")).alias("x"), F.col("prio").alias("p"))).alias("o"))
    best = every.groupBy("church_id").agg(F.min_by(F.struct("group_id", "label", "confidence", "method"), pick).alias("r"))
    d = base.select("church_id").join(best, "church_id", "left")
    weak = F.col("r").isNull() | (F.col("r.group_id").isNull() & (F.col("r.confidence") <= 0.3))
    return d.select("church_id", F.when(~weak, F.col("r.group_id")).alias("group_id"),
                    F.when(weak, "Unknown (likely independent)").otherwise(F.col("r.label")).alias("label"),
                    F.when(weak, 0.4).otherwise(F.col("r.confidence")).alias("confidence"),
                    F.when(weak, "unknown").otherwise(F.col("r.method")).alias("method"))


def site_affiliation(pages: DataFrame, around: int = 80) -> DataFrame:
    """Own-website wording that rules out an affiliation, with the words around it. `pages`: (church_id, url, text)."""
    at = F.regexp_instr("text", F.lit(V.NO_AFFILIATION_TEXT))
    hit = F.regexp_extract("text", V.NO_AFFILIATION_TEXT, 0)
    d = pages.withColumn("_at", at).filter("_at > 0")
    first = F.greatest(F.col("_at") - around, F.lit(1))
    return d.select("church_id", F.lit(None).cast("string").alias("group_id"), F.lit("Non-denominational").alias("label"),
                    F.lit(0.85).alias("confidence"), "url",
                    F.trim(F.substring(F.col("text"), first, F.col("_at") - first + F.length(hit) + around)).alias("quote"))


def labelled_site_guess(answers: DataFrame, pages: DataFrame, groups: DataFrame) -> DataFrame:
    """A labeller's answer about a website: confident only with a quote that stands on the page.

    `answers`: (church_id, url, group_id, label, confidence, independent, quote).
    """
    from tessera.operators.evidence import verified_quotes
    d = verified_quotes(answers, pages, 1, 90.0).join(groups.select("group_id", F.col("known_name")), "group_id", "left")
    conf = F.when(F.col("quote_ok"), F.coalesce("confidence", F.lit(0.0))).otherwise(F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.5)))
    known = F.col("known_name").isNotNull()
    return d.select("church_id", F.when(known, F.col("group_id")).alias("group_id"),
                    in_turn([(known, F.col("known_name")), (F.col("independent"), F.lit("Non-denominational"))], F.coalesce("label", F.lit("Unknown"))).alias("label"),
                    in_turn([(known, F.least(conf, F.lit(0.9))), (F.col("independent"), F.greatest(F.least(conf, F.lit(0.85)), F.lit(0.6)))],
                            F.least(conf, F.lit(0.7))).alias("confidence"), "quote_ok")


def article_matches(hits: DataFrame, min_score: float = 0.25) -> DataFrame:
    """Best article per name: shared name words, less a little for each search rank. `hits`: (name, rank, title)."""
    d = hits.withColumn("score", F.round(R.name_overlap(R.clean_group_name(F.col("name")), F.col("title")) - 0.05 * F.col("rank"), 9))
    best = first_per_group(d.select("name", "rank", "title", "score"), ["name"], [-F.col("score"), F.col("rank"), F.col("title")]).filter(F.col("score") >= min_score)
    return best.select("name", "title", "score", R.same_name(F.col("title"), F.col("name")).alias("same_name"))


def place_references(refs: DataFrame, places: DataFrame) -> DataFrame:
    """A spoken reference -> the one place of the session whose name has all its words.

    `refs`: (session_id, ref); `places`: (session_id, church_id, name). They meet by one word of the reference,
    its longest, and the names' words decide; so no reference is compared with every place.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.regexp_replace(
        F.lower(c), r"\bpres\b", "presbyterian"), r"(?U)[^\w ]+", " "), " +"), lambda w: w != ""))
    longest = F.array_max(F.transform("_w", lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    r = refs.select("session_id", "ref").distinct().select("session_id", "ref", words(F.col("ref")).alias("_w")).withColumn("word", longest)
    p = computed_once(places.select("session_id", "church_id", "name"), _in=words(F.col("name"))).select("session_id", "church_id", "_in", F.explode("_in").alias("word"))
    full = r.join(p, ["session_id", "word"]).filter(F.size(F.array_except("_w", "_in")) == 0)
    one = full.groupBy("session_id", "ref").agg(F.min("church_id").alias("church_id"), F.max("church_id").alias("_last"))
    return one.filter("church_id = _last").select("session_id", "ref", "church_id")
