import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import cover_search as C
from tessera.llm.queries import QUERIES


def plain(rows, step, k=5):
    q = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))}
    out = {}
    for i, a in sorted(q):
        if i % step == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i and len(a) == len(b)))
            out.setdefault(i, set()).update(s)
    return {(i, r + 1, j, -s) for i, c in out.items() for r, (s, j) in enumerate(sorted(c)[:k])}


def test_given_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op9_top_k"](spark, sf).collect()
    assert {tuple(r) for r in got} == plain(rows, 50) and len(got) == len({r.query_id for r in got}) * 5


def test_trees_equal_all_pairs():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(1500, 8)) * 200 + rng.integers(0, 5, (1500, 1)) * 300)
    x[100:400] = x[7]
    q = x[::20]
    best = C.Best(np.arange(0, 1500, 20), q, np.full(len(q), -np.inf), 5)
    C.dual_search(C.cover_tree(q, leaf=4), C.cover_tree(x, leaf=8), best, np.arange(1500), x)
    s = q @ x.T
    s[np.arange(len(q)), np.arange(0, 1500, 20)] = -np.inf
    for i in range(len(q)):
        o = np.lexsort((np.arange(1500), -s[i]))[:5]
        assert best.found[i][1].tolist() == o.tolist()


def test_small_blocks(spark, monkeypatch):
    for name, n in (("PIVOTS", 4), ("DATA_BLOCK", 20), ("QUERY_BLOCK", 3), ("LEAF", 4)):
        monkeypatch.setattr(C, name, n)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) + (i % 3) * 2).tolist()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert {tuple(r) for r in C.top_k(df, F.col("vec_id") % 7 == 0).collect()} == plain(rows, 7)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [1e30, 0.0], 1), (None, [1.0, 1.0], 1), (5, [3.0], 1), (50, [], 1),
            (6, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (100, [-1.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {tuple(r) for r in C.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == plain([r[:2] for r in rows if r[0] != 4], 50)
    assert C.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_large_components_keep_their_place(spark):
    """Beyond 32 bits, beyond 53 bits of a score, and ties that floating-point scores would not tell apart."""
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 1.0, 0.0]), (1, [1e8, 1.0, 0.0]), (2, [1e8, 1.0 + 1 / 256, 0.0]), (3, [-1e8, 5.0, 1.0]), (50, [3e5, 7.0, 2e5])]
    rows += [(i, [float(2**26), float(i % 3) / 256, 1.0]) for i in range(60, 75)] + [(100, [float(2**14) + 1 / 256, 1.0, 0.0])]
    rows += [(200 + i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 5)).tolist()) for i in range(101)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in C.top_k(df, F.col("vec_id") % 50 == 0).collect()} == plain(rows, 50)
    assert C._products(np.array([[2**62, 2**62]]), np.array([[4, 4], [-4, -4]])).tolist() == [[2**63 - 1, -2**63]]
