"""Quality classifier by importance resampling with hashed n-gram models.

Two generative models over hashed n-grams are counted: the target from documents
labelled good, the raw one from all documents. Their log ratio, summed over the
n-grams of a document, is its log importance weight. Documents are resampled
without replacement by Gumbel top-k: the k largest of weight plus Gumbel noise,
which is drawn from the id, so reruns agree. k is the number of documents whose
weight reaches a bound fitted on labelled documents; the rest is rejected.

N-grams are of two orders: runs of four bytes, and pairs of words, in which a word
followed by itself is one n-gram whatever the word. At most `SAMPLE` labelled
documents, drawn by a hash of the id, make the target model and the bound; the raw
model, weights and the selection cover all documents.

Edge cases: a null or empty text has no n-grams and weight 0; an id without
label is unlabelled, of an id with several labels the best counts; with no good or
no bad label nothing can be rejected; rows of one id and text have one key and stay
or go together, as do all ties at the last place; a null id has noise of its own;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import as_bytes, free_name, nth_largest
from tessera.session import stage

BITS = 15
RUN = 4
SAMPLE = 20_000
SMOOTH = 10.0
KEY_SHIFT, KEY_SCALE = 1 << 38, 1 << 20

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, 0xD6E8FEB86659FD93, np.uint64))


def buckets(text: bytes, bits: int = BITS) -> np.ndarray:
    """Buckets of all n-grams of a text: byte runs below 2^bits, word pairs above."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    out = []
    if len(b) >= RUN:
        x = b.astype(np.uint32)
        runs = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
        out.append((runs * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.int64))
    inside = ~_GAP[b]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    if len(starts) > 1:
        where = np.flatnonzero(inside)
        first = np.searchsorted(where, starts)
        place = where - np.repeat(starts, np.diff(np.append(first, len(where))))
        words = np.add.reduceat((b[where].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 0xFFFF], first)
        pair = (words[:-1] * _MULT + (words[1:] ^ words[1:] >> np.uint64(29))) * _MULT >> np.uint64(64 - bits)
        pair[words[:-1] == words[1:]] = 0
        out.append(pair.astype(np.int64) + (1 << bits))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def labelled_sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id and good (0 or 1) of at most `most` labelled ids."""
    best = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_q"))
    return (best.select("doc_id", (F.col("_q") >= 1).cast("int").alias("good"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray | None:
    """Log of target over raw probability per bucket, each order a distribution of its own. Nothing without a good document.

    Target counts are smoothed towards what the raw model expects, so that a bucket with little evidence says little.
    """
    size = 2 << BITS

    def run(batches):
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            for t, good in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                k = buckets(t)
                if len(k) > 4096:
                    c = np.bincount(k, minlength=size)
                    raw += c
                    if good:
                        target += c
                else:
                    np.add.at(raw, k, 1)
                    if good:
                        np.add.at(target, k, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])
    marked = docs.select("doc_id", "text").join(F.broadcast(sample.select(F.col("doc_id").alias("_id"), "good")), F.col("doc_id") == F.col("_id"), "left")
    rows = (marked.select("text", "good").mapInArrow(run, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(size), np.zeros(size)
    raw[rows.bucket], target[rows.bucket] = rows.raw, rows.target
    if not target.sum():
        return None
    out = np.zeros(size)
    for part in (slice(0, size // 2), slice(size // 2, size)):
        expected = raw[part] * (target[part].sum() / max(raw[part].sum(), 1))
        out[part] = np.log((target[part] + SMOOTH) / (expected + SMOOTH))
    return out


def weighed(docs: DataFrame, ratios: np.ndarray, name: str) -> DataFrame:
    """All columns and `name`, the log importance weight of `text`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratios)      # 2 x 2^BITS numbers
    i = docs.columns.index("text")

    def run(batches):
        r = shared.value
        for b in batches:
            w = [float(r[buckets(t)].sum()) for t in as_bytes(b.column(i))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64())], names=[*b.schema.names, name])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def fitted_bound(weights: DataFrame, sample: DataFrame) -> float:
    """The weight that best divides good from bad labels: the middle of the gap with the best mean of both rates."""
    rows = weights.join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("_weight", "good").toPandas()
    rows = rows.sort_values("_weight", kind="stable")
    good, w = rows.good.to_numpy(bool), rows._weight.to_numpy()
    if not good.any() or good.all():
        return float("-inf")
    below_bad = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    above_good = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    edges = np.concatenate([[True], w[1:] != w[:-1], [True]])
    score = np.where(edges, below_bad + above_good, -1)
    i = int(score.argmax())
    return float("-inf") if i == 0 else float("inf") if i == len(w) else float((w[i - 1] + w[i]) / 2)


def gumbel_key(weight: Column, doc_id: Column) -> Column:
    """Weight plus Gumbel noise from the id, as a non-negative long that sorts alike."""
    from tessera.llm.token_mix import uniform
    noise = -F.ln(-F.ln(uniform(F.concat(F.lit("gumbel "), F.coalesce(doc_id.cast("string"), F.lit(""))))))
    return ((weight + noise + KEY_SHIFT) * KEY_SCALE).cast("long")


def selection(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, int]:
    """Log ratios and the least key of the documents that stay."""
    sample = stage(labelled_sample(labels), "importance-sample")
    ratios = log_ratios(docs, sample)
    if ratios is None:
        return np.zeros(2 << BITS), 0
    weights = stage(weighed(docs.select("doc_id", "text"), ratios, "_weight").select("doc_id", "_weight"), "importance-weights")
    bound = fitted_bound(weights, sample)
    k = weights.filter(F.col("_weight") >= bound).count()
    keys = weights.select(gumbel_key(F.col("_weight"), F.col("doc_id")).alias("key"))
    least = nth_largest(keys, "key", k)
    return ratios, least if least is not None else (1 << 62) if k == 0 else 0


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, kept of every row."""
    ratios, least = selection(docs, labels)
    w = weighed(docs.select("doc_id", "text"), ratios, "log_weight")
    return w.select("doc_id", "log_weight", (gumbel_key(F.col("log_weight"), F.col("doc_id")) >= least).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the selection keeps, all columns."""
    ratios, least = selection(docs, labels)
    name = free_name("_weight", docs.columns)
    d = weighed(docs, ratios, name)
    return d.filter(gumbel_key(d[name], d["doc_id"]) >= least).drop(name)
