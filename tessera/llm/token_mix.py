"""Mixing sources to target weights: Efraimidis-Spirakis order, prefix sums, whole epochs first.

DataFrame functions only. A document gets the key -ln(u) / weight with u from a
digest of its id, so reruns agree. Documents of a source are ordered by key and
taken until the words of its last, fractional epoch are reached; whole epochs come
before. A source may hold a third of all rows: its order is cut into blocks of
keys, summed in parallel, and only block totals are summed per source.

The last document of the fractional epoch is taken if that brings the source
nearer to its target. Documents are never cut.

Edge cases: a null text has no words; a null source is a source, the last one;
rows of one source with one id are one document and are taken together, also rows
without id; documents without words are taken only with whole epochs; an empty
table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD
from tessera.session import stage

SOURCE_WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2.0
BLOCK_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number above 0 and below 1 from the md5 digest of the id."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id and weight: 2 where labelled good, a half where labelled bad; the best label of an id counts."""
    best = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_q"))
    return best.select("doc_id", F.when(F.col("_q") >= 1, 2.0).otherwise(0.5).alias("weight"))


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds `target` to one row per source (source, source_size, n_docs).

    The excess above a cap goes to the others by weight until none is above. Ordered
    by cap per weight, the capped sources are the first ones; the level of the rest is
    found at the first source whose cap isn't below it.
    """
    by_name, all_rows = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    by_cap = W.orderBy("_ratio", "_n")
    s = (sources.withColumn("_n", F.row_number().over(by_name))
         .withColumn("_w", F.element_at(F.array(*map(F.lit, SOURCE_WEIGHTS)), (F.col("_n") - 1) % len(SOURCE_WEIGHTS) + 1).cast("double"))
         .withColumn("_cap", MOST_EPOCHS * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
         .withColumn("_left", TOTAL_SHARE * F.sum("source_size").over(all_rows)
                     - F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("_level", F.col("_left") / F.sum("_w").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_n", "_level"))).over(all_rows)["_level"]))
    return s.select("source", "source_size", "n_docs", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def _same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def epochs(rows: DataFrame) -> DataFrame:
    """source, doc_id, source_size, target and epochs from rows of doc_id, source, size, weight."""
    docs = rows.groupBy("source", "doc_id").agg(F.sum("size").alias("size"), F.max("weight").alias("weight"))
    targets = source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    targets = stage(targets.withColumnRenamed("source", "_source"), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    d = (docs.join(targets, docs["source"].eqNullSafe(targets["_source"])).drop("_source")
         .withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
         .withColumn("_key", -F.ln(uniform(F.col("doc_id"))) / F.col("weight"))
         .withColumn("_block", F.floor((1 - F.exp(-F.col("_key"))) * F.ceil(F.col("n_docs") / BLOCK_ROWS))))
    totals = d.groupBy("source", "_block").agg(F.sum("size").alias("_total"))
    earlier = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = W.partitionBy("source", "_block").orderBy("_key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    d = (d.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
         .withColumn("_before", F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0))))
    taken = (F.col("size") > 0) & (F.col("_rest") > 0) & (F.col("_before") + F.col("size") / 2 <= F.col("_rest"))
    return d.select("source", "doc_id", "source_size", "target", (F.col("_whole") + taken.cast("long")).cast("long").alias("epochs"))


def _rows(docs: DataFrame, weights: DataFrame | None) -> DataFrame:
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    if weights is None:
        return rows.withColumn("weight", F.lit(1.0))
    w = weights.select(F.col("doc_id").alias("_id"), "weight")
    return rows.join(w, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "source", "size", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def mix_words(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, taken."""
    rows = stage(_rows(docs, weights), "mix-rows")
    e = epochs(rows)
    e = e.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), "source_size", "target", "epochs")
    return (rows.join(e, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken")))


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The documents of the mix with all their columns, and size, source_size, target, taken. Others go."""
    e = epochs(stage(_rows(docs, weights), "mix-rows"))
    e = e.filter("epochs > 0").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("source_size").alias("_z"), F.col("target").alias("_t"), F.col("epochs").alias("_e"))
    own = [docs[c] for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    size = word_count(docs["text"])
    return (docs.join(e, docs["source"].cast("string").eqNullSafe(e["_s"]) & docs["doc_id"].eqNullSafe(e["_d"]))
            .select(*own, size.alias("size"), e["_z"].alias("source_size"), e["_t"].alias("target"), (size * e["_e"]).alias("taken")))


ORACLE = r"""
WITH w AS (SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
r AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(w.weight, 1.0::DOUBLE) AS weight
      FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id),
u AS (SELECT source, doc_id, sum(size)::BIGINT AS size, max(weight) AS weight FROM r GROUP BY source, doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM u GROUP BY source),
p AS (SELECT *, ([3, 1, 2])[((n - 1) % 3 + 1)::INT]::DOUBLE AS sw, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / sw AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / sw, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(sw) OVER (ORDER BY cap / sw, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM p),
t AS (SELECT source, source_size, least(cap, sw * (SELECT arg_min(lev, (ratio, n)) FROM l WHERE lev <= ratio)) AS target FROM l),
k AS (SELECT u.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
      -ln((('0x' || substr(md5(coalesce(u.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / u.weight AS key
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
e AS (SELECT source, doc_id, source_size, target, whole + CASE WHEN size > 0 AND target - whole * source_size > 0 AND before + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END AS epochs FROM b)
SELECT r.doc_id, r.size, e.source_size, e.target, (r.size * e.epochs)::BIGINT AS taken
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source AND r.doc_id IS NOT DISTINCT FROM e.doc_id
"""
