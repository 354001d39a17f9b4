"""Corpus building: cleaning, de-duplication, hold-out, balancing, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import text as X
from tessera.functions.columns import computed_once, in_turn, stable_fraction
from tessera.operators.ordering import first_per_group, ordered_rank, running_before, top_per_group
from tessera.session import stage

SIDES = ("seeker", "church")


def label_posts(posts: DataFrame, min_tokens: int = 5, scrub: dict | None = None) -> DataFrame:
    """Scrub, tokenise and give each row its fate: bad_row, short or kept. `toks` is computed once."""
    side = F.lower(F.trim(F.coalesce("side", F.lit(""))))
    body = F.trim(F.coalesce("text", F.lit("")))
    valid = side.isin(*SIDES) & (body != "")
    d = computed_once(posts.withColumn("side", side), text=F.when(valid, X.scrub(body, **(scrub or {}))))
    d = computed_once(d, toks=X.tokens(F.col("text")))
    return (d.withColumn("fate", in_turn([(F.col("text").isNull(), "bad_row"),
                                          (F.size("toks") < min_tokens, "short")], "kept"))
            .withColumn("hash", F.when(F.col("fate") == "kept", F.sha1(F.array_join("toks", " "))))
            .withColumn("tradition", F.nullif(F.lower(F.trim("tradition")), F.lit(""))))


def labelled_rows(posts: DataFrame, min_tokens: int = 5, scrub: dict | None = None, text: bool = True) -> DataFrame:
    """`label_posts` as a stage table with a key for each row: text work is done once for all that follows. Without `text` only tokens are kept."""
    d = label_posts(posts, min_tokens, scrub).withColumn("_row", F.monotonically_increasing_id())
    return stage(d if text else d.drop("text"), "labelled")


def documents_of(labelled: DataFrame, holdout_fraction: float = 0.2, order=("ord",)) -> DataFrame:
    """First of each token-identical set of kept rows, with the hold-out.

    Only hashes, order and row keys are compared; texts stay where they are unless very many rows are copies.
    """
    kept = labelled.filter(F.col("fate") == "kept")
    keys = kept.select("hash", F.struct(*order, "_row").alias("_o"))
    first = keys.groupBy("hash").agg(F.min("_o").alias("_first"))
    copies = stage(keys.join(first, "hash").filter("_o <> _first").select("_o._row"), "copies")
    share = F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return (kept.join(copies, "_row", "left_anti").drop("fate", "_row")
            .withColumn("holdout", (F.col("side") == "seeker") & (share < holdout_fraction))
            .withColumn("id", F.coalesce(F.col("id").cast("string"), F.substring("hash", 1, 16))))


def clean_posts(posts: DataFrame, holdout_fraction: float = 0.2, min_tokens: int = 5, scrub: dict | None = None,
                order=("ord",)) -> DataFrame:
    """Documents: valid rows only, first of each token-identical set, seeker hold-out by stable hash.

    Needs id, side, tradition, source, date, text and the arrival-order columns.
    """
    return documents_of(labelled_rows(posts, min_tokens, scrub), holdout_fraction, order)


def ingest_stats(posts: DataFrame, holdout_fraction: float = 0.2, min_tokens: int = 5) -> DataFrame:
    """Counters of the cleaning step as (stat, n)."""
    labelled = labelled_rows(posts, min_tokens)
    rows = labelled.agg(
        F.count(F.lit(1)).alias("read"), F.count_if(F.col("fate") == "bad_row").alias("dropped_bad_row"),
        F.count_if(F.col("fate") == "short").alias("dropped_short"),
        F.count_if(F.col("fate") == "kept").alias("_valid"))
    docs = documents_of(labelled, holdout_fraction)
    kept = docs.agg(
        F.count(F.lit(1)).alias("_kept"), F.count_if(F.col("side") == "seeker").alias("kept_seeker"),
        F.count_if(F.col("side") == "church").alias("kept_church"), F.count_if("holdout").alias("seeker_holdout"),
        F.count_if(F.col("source") == "synthetic").alias("synthetic_docs"))
    by_label = (docs.filter(F.col("tradition").isNotNull()).groupBy("tradition").count()
                .select(F.concat(F.lit("tradition:"), "tradition").alias("stat"), F.col("count").alias("n")))
    long = lambda d: d.unpivot([], d.columns, "stat", "n")
    flat = long(rows).unionByName(long(kept))
    duplicates = (flat.filter(F.col("stat").isin("_valid", "_kept"))
                  .agg(F.sum(F.when(F.col("stat") == "_valid", F.col("n")).otherwise(-F.col("n"))).alias("n"))
                  .select(F.lit("dropped_duplicate").alias("stat"), "n"))
    return flat.filter(~F.col("stat").startswith("_")).unionByName(duplicates).unionByName(by_label)


# ---------------------------------------------------------------- episodes
def eligible_episodes(eps: DataFrame, min_minutes: float = 8.0) -> DataFrame:
    """Full episodes of fitting length, with something to read or hear, and no rerun or concert title."""
    length_ok = F.col("duration").isNull() | F.col("duration").between(min_minutes * 60, 4 * 3600)
    return eps.filter(~F.coalesce("type", F.lit("full")).isin("trailer", "bonus") & length_ok & F.col("has_media")
                      & ~F.col("title").rlike(V.EPISODE_TITLE_STOP))


def pick_episodes(eps: DataFrame, quota: Column, block: Column, mode: str = "spread") -> DataFrame:
    """`quota` episodes per source, newest first.

    'latest' takes the newest ones. 'spread' takes evenly spaced ones from the year before the newest; when
    that year is too short, from the newest `quota`. Needs source, date (ISO text or null), ord (newest first);
    `block` must grow with ord.
    """
    stats = eps.groupBy("source").agg(F.count(F.lit(1)).alias("_n"), F.max("date").alias("_newest"))
    cutoff = F.date_format(F.date_sub(F.to_date("_newest"), 365), "yyyy-MM-dd")
    d = eps.join(stats, "source").withColumn("_quota", quota)
    if mode == "latest":
        ranked = ordered_rank(d, ["source"], [F.col("ord")], block, "rn")
        return ranked.filter(F.col("rn") <= F.col("_quota")).drop("_n", "_newest", "_quota", "rn")
    d = d.withColumn("_recent", F.col("_newest").isNull() | (F.coalesce("date", F.lit("9999")) >= cutoff))
    counts = d.groupBy("source").agg(F.count_if("_recent").alias("_year"))
    d = d.join(counts, "source")
    enough = F.col("_year") >= F.col("_quota")
    few = F.col("_n") <= F.col("_quota")
    d = ordered_rank(d, ["source"], [F.col("ord")], block, "_all")
    d = d.filter(few | F.when(enough, F.col("_recent")).otherwise(F.col("_all") <= F.greatest("_quota", "_year")))
    d = ordered_rank(d, ["source"], [F.col("ord")], block, "_pos")
    pool = F.when(few, F.col("_n")).when(enough, F.col("_year")).otherwise(F.least(F.col("_n"), F.greatest("_quota", "_year")))
    grid = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_quota") - 1, F.lit(0)).cast("int")),
                       lambda i: F.bround(i * (pool - 1) / F.greatest(F.col("_quota") - 1, F.lit(1))).cast("long"))
    keep = few | ((F.col("_quota") == 1) & (F.col("_pos") == 1)) | (
        (F.col("_quota") > 1) & F.array_contains(grid, F.col("_pos") - 1))
    return d.filter(keep).drop("_n", "_newest", "_quota", "_recent", "_year", "_all", "_pos")


def source_labels(sources: DataFrame, label: str) -> DataFrame:
    """Enabled sources with the label they count under: the chosen column, else their tradition."""
    return sources.filter(F.coalesce("enabled", F.lit(True))).withColumn("label", F.coalesce(F.nullif(label, F.lit("")), "tradition"))


def source_quota(sources: DataFrame, label: str, total: int, least: int, most: int) -> DataFrame:
    """Episodes each source of a label may give: an even share of `total`, kept within bounds."""
    n = sources.groupBy(label).agg(F.count(F.lit(1)).alias("n_sources"))
    share = F.ceil(F.lit(total) / F.col("n_sources")).cast("long")
    return sources.join(n, label).withColumn("quota", F.greatest(F.lit(least), F.least(F.lit(most), share)))


def window_start(duration: Column, skip: float, longest: float) -> Column:
    """Where to begin in a recording: the middle of very long ones, after the intro of long ones."""
    return in_turn([
        (duration.isNull() | (duration == 0), F.lit(float(skip))),
        (duration > 2 * longest + skip, F.greatest(F.lit(float(skip)), (duration - longest) / 2)),
        (duration > longest + skip, F.lit(float(skip))),
    ], F.lit(0.0))


def interleave(items: DataFrame, source_order: Column, item_order, block: Column) -> DataFrame:
    """One item per source and pass: adds (`pass_no`, `turn`); sorting by both gives the mixed order."""
    return ordered_rank(items, ["source"], item_order, block, "pass_no").withColumn("turn", source_order)


def cap_words(chunks: DataFrame, label: str, cap: int, block_passes: int = 64) -> DataFrame:
    """Round-robin rows of each label until its word total has reached `cap` (tested before each row)."""
    d = running_before(chunks, [label], [F.col("pass_no"), F.col("turn")],
                       F.floor(F.col("pass_no") / block_passes), F.col("words"), "words_before")
    return d.filter(F.col("words_before") < cap)


def chunk_posts(docs: DataFrame, target_words: int, seeker_fraction: float) -> DataFrame:
    """Sentence-packed chunks, each labelled with a side by the stable hash of its text."""
    d = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(X.sentence_packs(F.col("text"), target_words))
                    .alias("chunk_no", "text"))
    return (d.withColumn("id", F.substring(F.sha1("text"), 1, 16))
            .withColumn("words", F.size(X.words(F.col("text"))))
            .withColumn("side", F.when(stable_fraction(F.col("text")) < seeker_fraction, "seeker").otherwise("church")))


def corpus_report(chunks: DataFrame, label: str) -> DataFrame:
    return chunks.groupBy(label).agg(
        F.count_distinct("item").alias("items"), F.count_distinct("source").alias("sources"),
        F.sum("words").cast("long").alias("words"), F.count(F.lit(1)).alias("chunks"),
        F.count_distinct(F.when(F.col("source_type") == "youtube", F.col("item"))).alias("video_items"))


def best_transcript(transcripts: DataFrame, min_words: int = 200) -> DataFrame:
    """Per episode the published transcript of the most wanted type that has more than `min_words` words."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in V.TRANSCRIPT_TYPES]), F.col("type")), F.lit(0)),
                      F.lit(len(V.TRANSCRIPT_TYPES) + 1))
    good = transcripts.filter(F.size(X.words(F.col("text"))) > min_words).withColumn("_rank", rank)
    return first_per_group(good, ["episode"], [F.col("_rank"), F.col("ord")]).drop("_rank")


def caption_window(segments: DataFrame, start: Column, longest: float) -> DataFrame:
    """Caption segments of a recording inside [start, start + longest), joined in order, with its length in minutes."""
    inside = F.col("start").between(start, start + longest) & (F.col("start") < start + longest)
    return segments.groupBy("video").agg(
        X.caption_text(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(inside, F.struct("start", "text")))), lambda s: s["text"]), " ")).alias("text"),
        (F.max(F.col("start") + F.col("duration")) / 60).alias("minutes"))
