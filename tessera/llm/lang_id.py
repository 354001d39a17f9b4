"""Language identification by nearest centroids of hashed n-gram TF-IDF vectors.

A text becomes a vector of hashed byte trigrams of its letters: lower case, with
runs of everything else as one space; counts are damped by a square root, weighted by inverse document
frequency and set to length one. Document frequencies come from all training rows.
Each language has several centroids, found by spherical k-means over a sample of
its training rows, bounded by `SAMPLE` rows and drawn by a hash of the id. A text
gets the language of the centroid with the largest cosine; the score is that
cosine. Farther than nearly all training rows of its centroid (the centroid's own
bound) it is marked as rejected; the nearest language is still named.

Edge cases: a null text, or one without a letter, is `und` with score 0, as is
every text where nothing could be learned; ties go to the smaller language, then
centroid; a null id counts as held out; repeated rows are predicted each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import pieces
from tessera.session import stage

BITS = 13
SAMPLE = 400
CENTROIDS = 3
ROUNDS = 12
REJECT_SHARE = 0.005
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def gram_counts(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """Hashed trigram counts, or nothing for a text without a letter."""
    if not text or not _LETTER.search(text):
        return None
    b = np.frombuffer(b"  " + text.lower().encode("utf-8", "surrogatepass").translate(_KEEP) + b"  ", np.uint8)
    b = np.concatenate([b[:1], b[1:][(b[1:] != 32) | (b[:-1] != 32)]])
    x = b.astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    n = np.sqrt(v @ v)
    return v / n if n else v


def document_frequencies(train: DataFrame, bits: int = BITS) -> tuple[int, np.ndarray]:
    """Rows with letters, and in how many of them each bucket occurs; two numbers per bucket reach the driver."""
    def run(batches):
        n, df = 0, np.zeros(1 << bits, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                c = gram_counts(t, bits)
                if c is not None:
                    n += 1
                    df += c > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << bits)), pa.array(np.concatenate([[n], df]))], names=["bucket", "n"])
    rows = train.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << bits) + 1, np.int64)
    for r in rows:
        out[r.bucket + 1] = r.n
    return int(out[0]), out[1:]


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts are the first row and then always the row farthest from all."""
    c = [x[0]]
    while len(c) < min(k, len(x)):
        near = (x @ np.array(c).T).max(axis=1)
        if near.min() >= 1 - 1e-9:
            break
        c.append(x[near.argmin()])
    c = np.array(c)
    for _ in range(ROUNDS):
        of = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (of == i).any():
                m = x[of == i].mean(axis=0)
                c[i] = m / max(np.sqrt(m @ m), 1e-12)
    return c


def centroids(train: DataFrame, idf: np.ndarray, sample: int = SAMPLE, k: int = CENTROIDS) -> list[tuple[str, np.ndarray, float]]:
    """(language, centroid, least cosine of nearly all of its rows); at most `k` for a language."""
    ids = train.select("doc_id", "lang").withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)))
    # twice the sample is let through by its hash, so that a rank over a language never sees more than that
    share = ids.groupBy(F.col("lang").alias("_l")).agg((F.lit(2.0 * sample * (1 << 31)) / F.count(F.lit(1))).alias("_most"))
    share = stage(share, "lang-share")                  # a row per language
    few = ids.join(share, F.col("lang") == F.col("_l")).filter(F.col("_h") < F.col("_most"))
    few = few.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("_h", "doc_id"))).filter(F.col("_n") <= sample)
    keys = stage(few.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct(), "lang-sample")      # its size is known then, so Spark decides how to join
    rows = train.join(keys, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi").select("doc_id", "lang", "text")
    size = len(idf)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text"])
        x = [_vector(c, idf) for c in map(lambda t: gram_counts(t, size.bit_length() - 1), part.text) if c is not None]
        if not x:
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        x = np.array(x)
        c = _k_means(x, k)
        cos = x @ c.T
        of = cos.argmax(axis=1)
        return pd.DataFrame({"lang": part.lang.iloc[0], "centroid": [v.tolist() for v in c],
                             "least": [float(np.quantile(cos[of == i, i], REJECT_SHARE)) if (of == i).any() else 1.0 for i in range(len(c))]})
    found = rows.groupBy("lang").applyInPandas(fit, "lang string, centroid array<double>, least double").collect()
    return sorted(((r.lang, np.array(r.centroid), r.least) for r in found), key=lambda x: (x[0], x[1].tolist()))


def predict(docs: DataFrame, n: int, df: np.ndarray, model: list[tuple[str, np.ndarray, float]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    idf = _idf(n, df)
    c = np.array([v for _, v, _ in model]) if model else np.zeros((0, len(idf)))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((idf, c, [x[0] for x in model], [x[2] for x in model]))     # languages x centroids x buckets

    def run(batches):
        idf, c, names, least = shared.value
        bits = len(idf).bit_length() - 1
        for whole in batches:
            for b in pieces(whole, "text"):
                out = []
                for t in b.column(2).to_pylist():
                    counts = gram_counts(t, bits) if names else None
                    if counts is None:
                        out.append((UNKNOWN, 0.0, False))
                        continue
                    cos = c @ _vector(counts, idf)
                    i = int(cos.argmax())
                    out.append((names[i], min(1.0, max(0.0, float(cos[i]))), bool(cos[i] < least[i])))
                lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                                 names=["doc_id", "held_out", "lang_pred", "score", "rejected"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((n + 1) / (df + 1)) + 0.01


def identify(docs: DataFrame) -> DataFrame:
    train = docs.filter("lang IS NOT NULL").filter(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    n, df = document_frequencies(train)
    return predict(docs, n, df, centroids(train, _idf(n, df)) if n else [])
