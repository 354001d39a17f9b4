import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import importance as I
from tessera.llm.common import nth_largest


def plain_buckets(t):
    out = [(int.from_bytes(t[i:i + 4], "little") * 0x9E3779B1 % 2**32) >> (32 - I.BITS) for i in range(len(t) - 3)]
    m, p = 2**64, [pow(0xD6E8FEB86659FD93, i + 1, 2**64) for i in range(60)]
    words = [sum((b + 1) * p[i] for i, b in enumerate(w)) % m for w in t.split()]
    for a, b in zip(words, words[1:]):
        h = (a * 0x9E3779B97F4A7C15 + (b ^ b >> 29)) * 0x9E3779B97F4A7C15 % m >> (64 - I.BITS)
        out.append((0 if a == b else h) + 2**I.BITS)
    return out


def test_buckets_equal_plain_code():
    for t in [b"", b"a", b" a  bc\n\tde fgh fgh fgh ", "été ñ ß été".encode(), b"  ", b"x" * 50 + b" y"]:
        assert I.buckets(t).tolist() == plain_buckets(t)
    assert len(I.buckets(b"z" * 200_000)) == 200_000 - 3


def test_nth_largest(spark):
    v = np.random.default_rng(1).integers(0, 2**61, 500).tolist() + [5] * 20 + [2**62]
    df = spark.createDataFrame([(int(x),) for x in v], "k long")
    s = sorted(v, reverse=True)
    for n in (1, 2, 250, 505, 515, 521):
        assert nth_largest(df, "k", n) == s[n - 1]
    assert nth_largest(df, "k", 522) is None and nth_largest(df, "k", 0) is None


def test_unseen_labels(spark):
    """Fitted on even ids, judged on odd ones."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = I.resampled(docs, labels.filter("doc_id % 2 = 0")).toPandas().set_index("doc_id")
    assert len(got) == docs.count()
    test = labels.filter("doc_id % 2 = 1").toPandas()
    kept = got.kept.reindex(test.doc_id).to_numpy()
    assert kept[test.quality == 1].mean() > 0.98 and kept[test.quality == 0].mean() < 0.05


def test_selection_is_top_k_of_plain_keys(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in I.resampled(docs, labels).collect()}
    good = {r.doc_id: r.quality for r in labels.collect()}
    raw, target = np.zeros(2 << I.BITS), np.zeros(2 << I.BITS)
    grams = {r.doc_id: plain_buckets(r.text.encode()) for r in docs.collect()}
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if good.get(i) == 1:
            np.add.at(target, g, 1)
    half = 1 << I.BITS
    scale = np.repeat([target[:half].sum() / raw[:half].sum(), target[half:].sum() / raw[half:].sum()], half)
    ratio = np.log((target + I.SMOOTH) / (raw * scale + I.SMOOTH))
    weight = {i: ratio[g].sum() for i, g in grams.items()}
    for i in weight:
        assert math.isclose(got[i].log_weight, weight[i], abs_tol=1e-6)
    key = {i: w - math.log(-math.log((int(hashlib.md5(f"gumbel {i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)) for i, w in weight.items()}
    n = sum(r.kept for r in got.values())
    assert {i for i, r in got.items() if r.kept} == set(sorted(key, key=key.get)[-n:])


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (2, "good words here and there", 1), (2, "good words here and there", 1), (3, "### ### ### ###", 1), (4, "x " * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = I.resampled(df, labels).collect()
    assert len(got) == 6 and len({r.kept for r in got if r.doc_id == 2}) == 1 and [r.log_weight for r in got if r.doc_id in (None, 1)] == [0.0, 0.0]
    assert not [r for r in got if r.doc_id == 3 and r.kept]
    assert I.kept_documents(df, labels).columns == ["doc_id", "text", "kept"]
    assert all(r.kept for r in I.resampled(df, labels.limit(0)).collect())
    assert all(r.kept for r in I.resampled(df, labels.filter(F.col("quality") == 1)).collect())
    assert I.resampled(df.limit(0), labels).collect() == []


def test_column_named_like_our_own(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    named = docs.withColumn("_weight", docs["doc_id"] * 2).withColumn("kept", docs["doc_id"])
    got = I.kept_documents(named, labels)
    assert got.columns == named.columns and {(r.doc_id, r._weight) for r in got.collect()} == {(r.doc_id, r.doc_id * 2) for r in I.kept_documents(docs, labels).collect()}
