"""n-gram counts, source spread, cohesion and candidate terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import gram_blocks as B
from tessera.session import is_small, stage

PART = 1_200_000        # tokens of the corpus for each part of the gram tables
SMALL = 16 * 1024 * 1024        # bytes of a table that is sent to all tasks


def totals(docs: DataFrame, max_n: int = 3) -> DataFrame:
    """Token and document totals overall, by side and by church tradition, as (scope, tokens, docs)."""
    n = F.size("toks").cast("long")
    base = docs.filter(~F.col("holdout"))
    scopes = F.array(F.lit("all"), F.col("side"),
                     F.when((F.col("side") == "church") & F.col("tradition").isNotNull(),
                            F.concat(F.lit("t:"), "tradition")))
    return (base.select(F.explode(F.array_compact(scopes)).alias("scope"), n.alias("n"))
            .groupBy("scope").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")))


def order_totals(docs: DataFrame, max_n: int = 3) -> DataFrame:
    """How many n-grams of each order the corpus holds: one row, n1..nk."""
    base = docs.filter(~F.col("holdout"))
    return base.agg(*[F.coalesce(F.sum(F.greatest(F.size("toks") - (n - 1), F.lit(0)).cast("long")), F.lit(0)).alias(f"n{n}")
                      for n in range(1, max_n + 1)])


def source_grams(docs: DataFrame, max_n: int = 3, content_only: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Counts per (gram, source, side, tradition) without the hold-out.

    Equal grams of some documents are added up before rows move, and they move once, in blocks (`gram_blocks`), to the part of
    their gram: all totals per gram that follow (`gram_counts`, `tradition_counts`) are made there, from the blocks themselves. With
    `content_only` multi-word grams that could never become a term are dropped
    before the shuffle; single words stay, cohesion needs them all. With `only` (term) no other grams are counted: hashes of
    the terms leave out others before the shuffle, a semi-join decides.
    """
    tokens = docs.filter(~F.col("holdout")).agg(F.sum(F.size("toks").cast("long"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, tokens // PART)      # tasks stay of one size
    wanted = None if only is None else _hashes(only.select(F.col("term").alias("gram")))

    def blocks(source_tradition: DataFrame | None = None):
        base = docs.filter(~F.col("holdout")).select(F.coalesce("source", F.lit("unknown")).alias("source"), "side", "tradition", "toks")
        width = 3
        if source_tradition is not None:
            base, width = base.join(source_tradition, "source", "left").select("source", "side", "tradition", "source_tradition", "toks"), 4
        packed = base.mapInArrow(B.pack(max_n, content_only, parts, wanted, width), B.BLOCKS)
        return packed.repartition(parts, "gram_part").sortWithinPartitions("gram_part")
    rows = blocks().mapInArrow(B.unpack(B.rows, B.ROWS), B.ROWS)
    if only is not None:
        return rows.join(only.select(F.col("term").alias("gram")), "gram", "left_semi")
    rows._blocks = blocks
    return rows


def _hashes(terms: DataFrame, most: int = 20_000_000) -> np.ndarray | None:
    """Sorted hashes of all terms, eight bytes each; none where there are too many for one task."""
    if terms.count() > most:
        return None
    found = b"".join(r[0] for r in terms.mapInArrow(B.gram_hashes, "hashes binary").toLocalIterator())
    return np.unique(np.frombuffer(found, dtype=np.uint64))


def source_traditions(docs: DataFrame, order: str = "ord") -> DataFrame:
    """The first tradition seen for each source."""
    d = docs.filter(~F.col("holdout") & F.col("tradition").isNotNull())
    return d.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.min_by("tradition", order).alias("source_tradition"))


def gram_counts(by_source: DataFrame) -> DataFrame:
    """Totals per gram: overall, by side, documents, sources and the share of the biggest source.

    `by_source` comes from `source_grams`; a source is summed over its sides first. Right from there totals are made from the blocks.
    """
    if hasattr(by_source, "_blocks"):
        return by_source._blocks().mapInArrow(B.unpack(B.totals, B.TOTALS), B.TOTALS)
    per_source = by_source.groupBy("gram", "source").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs"),
        F.sum(F.when(F.col("side") == "seeker", F.col("count")).otherwise(0)).alias("seeker"),
        F.sum(F.when(F.col("side") == "church", F.col("count")).otherwise(0)).alias("church"))
    return per_source.groupBy("gram").agg(
        F.sum("count").alias("count"), F.sum("seeker").alias("seeker"), F.sum("church").alias("church"),
        F.sum("docs").alias("doc_freq"), F.count(F.lit(1)).alias("n_sources"),
        (F.max("count") / F.sum("count")).alias("top_source_share"))


def possible_terms(counts: DataFrame, seeds: DataFrame | None = None, min_count: int = 5) -> DataFrame:
    """The gram counts that candidates are made of: single words, grams that are frequent enough, seeds.

    All others are most of the table and never read again.
    """
    few = (F.instr("gram", " ") == 0) | (F.col("count") >= min_count)
    if seeds is None:
        return counts.filter(few)
    known = stage(seed_grams(seeds).withColumn("_seed", F.lit(True)), "seeds")      # read once, of known size: the counts stay where they are
    return counts.join(F.broadcast(known) if is_small(known, SMALL) else known, "gram", "left").filter(few | F.col("_seed")).drop("_seed")


def seed_grams(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.array_join(X.tokens(F.col("term")), " ").alias("gram")).distinct()


def tradition_counts(by_source: DataFrame, source_tradition: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """Per (gram, tradition): church-side uses, sources of that tradition using it, share of its biggest source.

    Uses count under the tradition of the document; sources count under the tradition of the source. With `cands`
    (term) only these terms are counted: a semi-join before the aggregation (`only` of `source_grams` has it before the shuffle).
    """
    if hasattr(by_source, "_blocks") and cands is None:
        return by_source._blocks(source_tradition).mapInArrow(B.unpack(B.traditions, B.TRADITIONS), B.TRADITIONS)
    if cands is not None:
        by_source = by_source.join(cands.select(F.col("term").alias("gram")), "gram", "left_semi")
    church = F.when((F.col("side") == "church") & F.col("tradition").isNotNull(), F.col("tradition"))
    none = F.lit(None).cast("string")
    # each count goes to the tradition of its document and to the one of its source, so that one grouping serves both
    both = by_source.join(source_tradition, "source", "left").select("gram", "count", F.inline(F.array(
        F.struct(church.alias("tradition"), none.alias("source")), F.struct(F.col("source_tradition").alias("tradition"), F.col("source").alias("source")))))
    c = both.filter(F.col("tradition").isNotNull()).groupBy("gram", "tradition", "source").agg(F.sum("count").alias("c"))
    of_source = F.when(F.col("source").isNotNull(), F.col("c"))
    return c.groupBy("gram", "tradition").agg(
        F.coalesce(F.sum(F.when(F.col("source").isNull(), F.col("c"))), F.lit(0)).alias("count"), F.count("source").alias("n_sources"),
        F.coalesce(F.max(of_source) / F.sum(of_source), F.lit(0.0)).alias("top_share"))


def with_npmi(counts: DataFrame, all_counts: DataFrame, order_total: DataFrame, max_n: int = 3) -> DataFrame:
    """Add `n` and `npmi`. Each word's own count is looked up in `all_counts` by an equi-join."""
    n_of = F.size(F.split("gram", " "))
    tot = order_total.select(F.struct(*order_total.columns).alias("t")).scalar()
    d = counts.withColumn("n", n_of).withColumn("_t", tot)
    single = d.filter("n = 1").withColumn("npmi", F.lit(1.0))
    words = d.filter("n > 1").select("gram", F.explode(F.split("gram", " ")).alias("word"))
    uni = all_counts.filter(F.instr("gram", " ") == 0).select(F.col("gram").alias("word"), F.col("count").alias("wc"))
    parts = words.join(uni, "word").groupBy("gram").agg(F.sum(F.log("wc")).alias("log_words"))
    multi = d.filter("n > 1").join(parts, "gram")
    by_n = F.get(F.array(*[F.col("_t")[f"n{i}"] for i in range(1, max_n + 1)]), F.col("n") - 1)
    log_g = F.log(F.col("count") / by_n)
    npmi = F.when(log_g >= 0, F.lit(-1.0)).otherwise(
        (log_g - (F.col("log_words") - F.col("n") * F.log(F.col("_t")["n1"]))) / (-log_g))
    return single.unionByName(multi.withColumn("npmi", npmi).drop("log_words")).drop("_t")


def candidates(docs: DataFrame, seeds: DataFrame | None = None, max_n: int = 3, min_count: int = 5,
               min_npmi: float = 0.25, min_sources: int = 0, counts: DataFrame | None = None) -> DataFrame:
    """Candidate terms: frequent, content-bearing, spread over sources, cohesive. Seeds pass, even when absent.

    `seeds` has one column `term`. `counts` is `gram_counts` output, all of it or its `possible_terms`; it is read several times, so it
    should be a stage table (made here when not given).
    """
    if counts is None:
        counts = stage(possible_terms(gram_counts(source_grams(docs, max_n, content_only=seeds is None)), seeds, min_count), "counts")
    if seeds is None:
        kept = counts.withColumn("seed", F.lit(False))
    else:
        toks = seed_grams(seeds)
        kept = counts.join(toks.withColumn("seed", F.lit(True)), "gram", "left").withColumn(
            "seed", F.coalesce("seed", F.lit(False)))
    kept = kept.filter(F.col("seed") | ((F.col("count") >= min_count) & X.is_content(F.col("gram"))
                                        & (F.col("n_sources") >= min_sources)))
    scored = with_npmi(kept, counts, order_totals(docs, max_n), max_n)
    out = scored.filter(F.col("seed") | (F.col("n") == 1) | (F.col("npmi") >= min_npmi)).withColumnRenamed("gram", "term")
    if seeds is None:
        return out
    absent = toks.join(counts.select("gram"), "gram", "left_anti").select(
        F.col("gram").alias("term"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("seeker"),
        F.lit(0).cast("long").alias("church"), F.lit(0).cast("long").alias("doc_freq"),
        F.lit(0).cast("long").alias("n_sources"), F.lit(0.0).alias("top_source_share"), F.lit(True).alias("seed"),
        F.size(F.split("gram", " ")).alias("n"), F.lit(0.0).alias("npmi"))
    return out.unionByName(absent)
