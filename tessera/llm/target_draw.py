"""Importance resampling towards a target text: array-scored weights, then a distributed quickselect.

Runs of 1 to `orders` consecutive words are hashed into buckets. Counts over all documents and
over the target give one array of gains, and the weight of a document is the mean gain of its
features. Weight plus Gumbel noise of the id is its score; the k best scores are drawn.

The k-th place is found without a sort. The order is one composite key: score descending, id,
number of features. Every round takes a few random rows of the open range as
pivots and counts, in one pass, the rows below, at and between them: the slot that holds the k-th place
is the next open range, or, if it is a pivot itself, the answer. Pivots leave the range, so it
shrinks in every round, and by about `PIVOTS` times as a rule. Only the winners are sorted and ranked,
each score by itself; the ranks before a score are sums of counts.

Edge cases: a null or empty text has no features and weight 0; a null id has the noise of
an empty one and comes after all ids; rows of one id are documents of their own, and if they agree in
all columns, any of them takes the last place; an empty target or table has no features, which
makes all gains equal; if k is 0, nothing is drawn; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, pieces
from tessera.session import stage

BUCKETS = 10_000
ORDERS = 1
SEED = 2024
LEAST_WORDS = 20
SHARE = (10, 100)
PIVOTS = 24
REMEMBERED = 600_000

# ASCII letters to lower case; all other ASCII but digits to spaces; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """Buckets of features, each computed once."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.n
        return b


def features(text: bytes, known: _Buckets, orders: int = ORDERS) -> tuple[np.ndarray, int]:
    """Buckets of all features of a text, and its number of words."""
    words = text.translate(_FOLD).split()
    out = list(map(known.__getitem__, words))
    for n in range(2, orders + 1):
        out += [known[b" ".join(words[i:i + n])] for i in range(len(words) - n + 1)]
    return np.array(out, np.int64), len(words)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """Features per bucket over all rows of `text`."""
    def run(batches):
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for b in pieces(batch, "text"):
                for t in as_bytes(b.column(0)):
                    f = features(t, known, orders)[0]
                    if len(f) < 64:
                        np.add.at(total, f, 1)
                    else:
                        total += np.bincount(f, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the log ratio of both smoothed shares, floored."""
    n, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of the id in thousandths, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and words of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)       # one number per bucket

    def run(batches):
        array, known = shared.value, _Buckets(len(shared.value))
        for batch in batches:
            for b in pieces(batch, "text"):
                rows = []
                for t in as_bytes(b.column(1)):
                    f, words = features(t, known, orders)
                    rows.append((len(f), int(array[f].sum()) // len(f) if len(f) else 0, words))
                n, weight, words = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.int64()), pa.array(words, pa.int64())],
                                                 names=["doc_id", "n_features", "weight", "words"])
    out = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
           .mapInArrow(run, "doc_id long, n_features long, weight long, words long"))
    return out.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), "words")


def key_parts() -> list[Column]:
    """The composite key, ascending and without nulls."""
    return [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), F.col("n_features")]


def _key() -> Column:
    return F.struct(*[c.cast("long").alias(f"k{i}") for i, c in enumerate(key_parts())])


def _literal(key: tuple[int, ...]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(key)])


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[int, ...] | None:
    """The composite key of the k-th row (from 1) by quickselect with random pivots; None where there are fewer rows.

    A slot is 2 i for rows between pivots i - 1 and i, and 2 i + 1 for rows equal to pivot i. The pass that
    counts the slots also draws the pivots of the next round from each.
    """
    if k <= 0:
        return None
    chosen, low, high, at = [], None, None, 0
    keyed = rows.select(_key().alias("key"), "score")
    while True:
        part = keyed
        if low is not None:
            part = part.filter((F.col("key") > _literal(low)) & (F.col("score") <= -low[0]))        # the second test reaches the scan
        if high is not None:
            part = part.filter((F.col("key") < _literal(high)) & (F.col("score") >= -high[0]))
        slot = F.lit(0)
        for p in chosen:
            slot = slot + (F.col("key") > _literal(p)).cast("int") + (F.col("key") >= _literal(p)).cast("int")
        drawn = [F.min_by("key", F.xxhash64("key", F.lit(at * pivots + i))).alias(f"p{i}") for i in range(pivots)]
        for r in part.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), *drawn).orderBy("slot").collect():
            if k <= r.n:
                break
            k -= r.n
        else:
            return None
        i = r.slot // 2
        if r.slot % 2:
            return chosen[i]
        low, high = chosen[i - 1] if i else low, chosen[i] if i < len(chosen) else high
        chosen, at = sorted({tuple(r[f"p{i}"]) for i in range(pivots)}), at + 1


def ranked(winners: DataFrame, k: int) -> DataFrame:
    """The winners with their rank along the key; null beyond k, where rows equal to the last one are left over."""
    before = winners.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(F.col("score").alias("_score"), F.coalesce(F.sum("_n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("score").orderBy(*key_parts())) + F.col("_before")
    out = winners.join(before, F.col("score") == F.col("_score")).withColumn("rank", place.cast("long"))
    return out.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("_score", "_before")


def draw(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, orders: int = ORDERS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where the row isn't drawn."""
    gain = gains(bucket_counts(docs, buckets, orders), bucket_counts(target, buckets, orders))
    rows = stage(scored(docs, gain, orders, seed), "draw-scores")
    fit = F.col("words") >= least_words
    k = share[0] * rows.filter(fit).count() // share[1]
    last = kth_key(rows.filter(fit), k)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    won = fit & (_key() <= _literal(last))
    rest = rows.filter(~won).select(*columns, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranked(rows.filter(won).select(*columns), k))


ORACLE = r"""
WITH RECURSIVE bits AS (SELECT b, b::UBIGINT AS v, 0 AS i FROM range(256) t(b)
      UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE i = 8),
texts AS (SELECT 'd' AS kind, row_number() OVER () AS nr, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT kind, nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
each AS (SELECT kind, nr, unnest(w) AS word FROM words),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM each)),
bucketed AS (SELECT word, (xor(list_reduce(list_transform(range(0, len(h)::BIGINT, 2), lambda i: ('0x' || substr(h, i + 1, 2))::UBIGINT),
      lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket FROM spelt, crc),
counts AS (SELECT kind, bucket, count(*) AS n FROM each JOIN bucketed USING (word) GROUP BY ALL),
both_counts AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counts GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM both_counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM both_counts) + 10000))))::BIGINT AS g FROM both_counts),
sums AS (SELECT nr, sum(g)::BIGINT AS g FROM each JOIN bucketed USING (word) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY nr),
weighed AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_features, CASE WHEN len(w.w) = 0 THEN 0 ELSE (s.g - ((s.g % len(w.w)) + len(w.w)) % len(w.w)) // len(w.w) END::BIGINT AS weight
      FROM words w LEFT JOIN sums s ON s.nr = w.nr WHERE w.kind = 'd'),
scores AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
places AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scores WHERE n_features >= 20) THEN place END::BIGINT AS rank FROM places
"""
