"""Passage retrieval: chunks, BM25 within groups, excerpts, question retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import rules as R
from tessera.functions import text as X
from tessera.functions.columns import computed_once, lookup, no_strings
from tessera.operators.ordering import ordered_rank, top_per_group
from tessera.session import stage


def chunk_documents(docs: DataFrame, words: int = 220, overlap: int = 40, min_chars: int = 80) -> DataFrame:
    """(group_id, url, title, source_type, chunk_no, text): sliding word windows of every whole document."""
    return docs.select("group_id", "url", "title", "source_type",
                       F.posexplode(X.word_windows(F.col("text"), words, overlap, min_chars)).alias("chunk_no", "text"))


def tokenised(chunks: DataFrame) -> DataFrame:
    """Chunk keys with token count and per-term counts (`tf` array): made inside the row, no shuffle."""
    d = computed_once(chunks.select("group_id", "url", "chunk_no", "source_type", "text", "title"),
                      _t=X.retrieval_tokens(F.concat_ws(" ", "text", "title")))
    return d.select("group_id", "url", "chunk_no", "source_type", F.size("_t").cast("long").alias("len"), X.term_counts(F.col("_t")).alias("tf"))


def postings(toks: DataFrame) -> DataFrame:
    """(group_id, url, chunk_no, source_type, len, term, tf) from `tokenised`."""
    return toks.select("group_id", "url", "chunk_no", "source_type", "len", F.inline("tf")).withColumnRenamed("gram", "term")


def collection_stats(toks: DataFrame) -> DataFrame:
    """Per group: number of chunks and their mean length."""
    return toks.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("len").alias("avg_len"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("group_id", "term").agg(F.count(F.lit(1)).alias("df"))


CHUNKS = 20_000          # scored in one task, as expected


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 4, k1: float = 1.4, b: float = 0.75) -> DataFrame:
    """Top `k` chunks of a group for each query of the group, trusted sources ahead on near ties.

    `queries`: (group_id, query_id, query), or without group_id to ask every group the same
    queries. Only postings of query terms are scored; each gets its weight before it
    meets the queries. Repeated query words count again. Chunks are tokenised once,
    into a stage table that statistics, frequencies and scores all read.
    """
    toks = stage(tokenised(chunks), "chunk_terms")
    q = computed_once(queries, _q=X.term_counts(X.retrieval_tokens(F.col("query"))))
    q = q.select(*[c for c in queries.columns if c != "query"], F.inline("_q")).withColumnsRenamed({"gram": "term", "tf": "qtf"})
    q = stage(q, "query_terms")          # its size is known then: Spark sends a small query set to the postings, and splits hot words of a large one
    on = ["group_id", "term"] if "group_id" in queries.columns else ["term"]
    used = postings(toks).join(q.select(*on).distinct(), on, "left_semi")
    stats = stage(document_frequency(used).join(collection_stats(toks), "group_id"), "term_stats")
    # a chunk's postings stay together from here on, in parts that follow the chunks: no task holds more the larger the table is
    parts = max(1, -(-toks.count() // CHUNKS), int(toks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = used.repartition(parts, "group_id", "url", "chunk_no").join(stats, ["group_id", "term"])
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    trust = 1 - 0.1 * F.coalesce(lookup(F.col("source_type"), V.SOURCE_RANK), F.lit(1))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) * trust
    d = d.select("group_id", "url", "chunk_no", "source_type", "term", part.alias("part"))
    s = d.join(q, on).groupBy("group_id", "query_id", "url", "chunk_no", "source_type").agg(
        F.round(F.sum(F.col("part") * F.col("qtf")), 9).alias("score")).filter("score > 0")
    return top_per_group(s, ["group_id", "query_id"], [F.desc("score"), F.desc("url"), F.desc("chunk_no")], k, "rank").select(
        "group_id", "query_id", "rank", "url", "chunk_no", "source_type", "score")


def excerpts(hits: DataFrame, batches: DataFrame, cap: int = 8) -> DataFrame:
    """Merge the hit lists of a batch of queries round-robin: best of each query first, each chunk once, at most `cap`.

    `batches`: (query_id, batch, pos).
    """
    d = hits.join(batches, "query_id").groupBy("group_id", "batch", "url", "chunk_no").agg(
        F.min(F.struct("rank", "pos")).alias("o"), F.min("source_type").alias("source_type"))
    return top_per_group(d, ["group_id", "batch"], [F.col("o"), F.col("url"), F.col("chunk_no")], cap, "excerpt").drop("o")


def in_batches(rows: DataFrame, keys, order, size: int, block: Column) -> DataFrame:
    """Number rows within a group and cut them into batches of `size`: adds batch and pos (both from 0)."""
    d = ordered_rank(rows, keys, order, block, "_rn")
    return (d.withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("long"))
            .withColumn("pos", ((F.col("_rn") - 1) % size).cast("long")).drop("_rn"))


PASSAGES, QUESTIONS = 4_096, 16_384      # of an entity that meet in one cell, as expected


def _first_passages(max_chars: int):
    """Passages of a cell that its questions can pick: of each question those with less than `max_chars` before them in the cell."""
    def run(passages: pa.Table, questions: pa.Table) -> pa.Table:
        names = ["church_id", "question_id", "_id", "relevance"]
        p = passages.take(pc.sort_indices(passages, [("offset", "ascending"), ("url", "ascending"), ("_id", "ascending")]))
        n, ids, lens = p.num_rows, p["_id"].to_numpy(), p["_len"].to_numpy().astype(np.int64)
        terms = p["_terms"].combine_chunks()
        codes = pc.list_flatten(terms).dictionary_encode()
        own, at = pc.list_parent_indices(terms).to_numpy(), codes.indices.to_numpy()
        own = own[np.argsort(at, kind="stable")]                                 # passages by word
        ends = np.cumsum(np.bincount(at, minlength=len(codes.dictionary)))
        asked = questions["_q"].combine_chunks()
        word = pc.index_in(pc.list_flatten(asked), value_set=codes.dictionary).fill_null(-1).to_numpy()
        last = np.cumsum(pc.list_value_length(asked).to_numpy())
        picked, scores, counts, first = [], [], [], 0
        for end in last.tolist():
            held = [own[ends[c - 1] if c else 0:ends[c]] for c in word[first:end].tolist() if c >= 0]
            first, used, taken = end, 0, 0
            score = np.bincount(np.concatenate(held), minlength=n) if held else np.zeros(n, np.int64)
            for level in range(int(score.max(initial=0)), -1, -1):
                i = np.flatnonzero(score == level)
                before = used + np.cumsum(lens[i]) - lens[i]
                i = i[before < max_chars]
                picked.append(ids[i])
                scores.append(np.full(len(i), level, np.int32))
                used, taken = used + int(lens[i].sum()), taken + len(i)
                if used >= max_chars:
                    break
            counts.append(taken)
        asks = np.repeat(np.arange(questions.num_rows), counts)
        joined = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        return pa.table([*[questions[k].take(pa.array(asks)) for k in names[:2]], pa.array(joined(picked, np.int64)), pa.array(joined(scores, np.int32))], names=names)
    return run


def question_passages(docs: DataFrame, questions: DataFrame, max_chars: int = 18000, step: int = 2200, width: int = 2800) -> DataFrame:
    """Passages for each question about an entity: most shared words first, up to a total of `max_chars`, the last one cut to fit.

    `docs`: (church_id, url, title, kind, text); `questions`: (church_id, question_id, question). Every question meets every
    passage of its entity, in cells of some thousands of each: a cell counts shared words through an inverted index of
    its own and gives on only what can still be picked, so pairs are never written. Texts are fetched for the chosen ones only.
    """
    d = docs.filter("church_id is not null").select(
        "church_id", "url", X.question_terms(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("kind", F.lit("")))).alias("_head"),
        F.inline(X.char_windows(F.col("text"), step, width)))
    d = stage(d.withColumn("_terms", F.concat(X.question_terms(F.col("text")), "_head")).withColumn("_id", F.monotonically_increasing_id()).drop("_head"), "passages")
    none = no_strings()
    q = stage(computed_once(questions.filter("church_id is not null"), _q=F.coalesce(X.question_terms(F.col("question")), none)).select("church_id", "question_id", "_q"), "questions")
    cuts = lambda rows, size, name: rows.groupBy("church_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cells = cuts(d, PASSAGES, "_np").join(cuts(q, QUESTIONS, "_nq"), "church_id")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    p = d.select("church_id", "_id", "url", "offset", F.length("text").alias("_len"), "_terms").join(cells, "church_id")
    p = p.withColumn("_p", part("_np", "_id")).withColumn("_q", upto("_nq")).drop("_np", "_nq")
    asked = q.join(cells, "church_id").select("church_id", "question_id", F.col("_q").alias("_words"), part("_nq", "question_id", "_q").alias("_b"), "_np")
    asked = asked.select("church_id", upto("_np").alias("_p"), F.col("_b").alias("_q"), "question_id", "_words")
    keys = ["church_id", "_p", "_cell"]
    p, asked = p.withColumnRenamed("_q", "_cell"), asked.withColumnRenamed("_q", "_cell").withColumnRenamed("_words", "_q")
    kinds = {f.name: f.dataType.simpleString() for f in q.schema}
    tasks = max(1, min(cells.agg(F.sum(F.col("_np") * F.col("_nq"))).first()[0] or 0, 10_000))      # cells are small in bytes and long in work
    found = p.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(
        _first_passages(max_chars), f"church_id {kinds['church_id']}, question_id {kinds['question_id']}, _id long, relevance int")
    found = found.join(d.select("_id", "url", "offset", F.length("text").alias("_len")), "_id")
    w = W.partitionBy("church_id", "question_id").orderBy(F.desc("relevance"), F.col("offset"), F.col("url"))
    used = F.coalesce(F.sum("_len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    picked = found.withColumn("rn", F.row_number().over(w)).withColumn("_used", used).filter(F.col("_used") < max_chars)
    return picked.join(d.select("_id", "text"), "_id").select(
        "church_id", "question_id", F.col("rn").cast("long").alias("rn"), "url", "offset", "relevance",
        F.substring(F.col("text"), F.lit(1), (F.lit(max_chars) - F.col("_used")).cast("int")).alias("text"))


def resource_candidates(resources: DataFrame, questions: DataFrame, limit: int = 3) -> DataFrame:
    """Up to `limit` distinct public pages per question, by shared words of kind, label and address."""
    terms = X.question_terms(F.col("question"))
    when = lambda xs, add: F.when(F.arrays_overlap("_t", F.array(*[F.lit(x) for x in xs])), F.array(*[F.lit(a) for a in add])).otherwise(
        F.array().cast("array<string>"))
    q = questions.withColumn("_t", terms)
    q = q.withColumn("_t", F.array_union("_t", when(["upcoming", "event", "events", "schedule", "calendar"], ["calendar", "events"])))
    q = q.withColumn("_t", F.array_union("_t", when(["groups", "group", "small"], ["groups", "ministries"])))
    r = resources.filter(F.col("url").rlike("^https?://")).withColumn(
        "_w", X.question_terms(F.concat_ws(" ", F.coalesce("kind", F.lit("")), F.coalesce("label", F.lit("")), "url")))
    d = q.join(r, "church_id").withColumn("overlap", F.size(F.array_intersect("_t", "_w")))
    once = d.groupBy("church_id", "question_id", "url").agg(F.max("overlap").alias("overlap"))
    return top_per_group(once, ["church_id", "question_id"], [F.desc("overlap"), F.col("url")], limit, "rank")


def answer_facts(evidence: DataFrame, now: Column, limit: int = 40) -> DataFrame:
    """Unexpired, known evidence per entity, at most `limit` rows, newest last as stored."""
    long_kept = F.col("source_kind").isin("sermon_transcript", "sermon_feed", "livestream")
    d = evidence.filter(R.fresh_within(F.col("checked_at"), now, F.when(long_kept, 365).otherwise(90)) & ~F.col("value").isin(V.ALWAYS_ALLOWED_VALUES))
    return top_per_group(d, ["church_id"], [F.col("row_id")], limit, "fact_no")


def viewed_whole(views: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether viewed [start, end) ranges cover a text from its beginning, and where the first gap starts.

    `views`: (url, start, end); `texts`: (url, total). Ranges with one start are merged
    first, map-side, so a much-viewed page has at most one row per start when ordered.
    """
    slim = views.groupBy("url", "start").agg(F.max("end").alias("end"))
    w = W.partitionBy("url").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    d = slim.withColumn("_reach", F.coalesce(F.max("end").over(w), F.lit(0)))
    gap = d.groupBy("url").agg(F.min(F.when(F.col("start") > F.col("_reach"), F.col("_reach"))).alias("_gap"), F.max("end").alias("_end"))
    return texts.join(gap, "url", "left").select(
        "url", "total", F.least(F.coalesce("_gap", "_end", F.lit(0)), F.col("total")).alias("next_offset"),
        (F.coalesce("_gap", "_end", F.lit(0)) >= F.col("total")).alias("covered"))
