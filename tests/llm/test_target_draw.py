import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries as Q
from tessera.llm import target_draw as T


def plain_features(text, orders=1):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i:i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)], len(words)


def plain_draw(docs, target, share=(10, 100), least=20, buckets=10000, orders=1, seed=2024):
    spot = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    own = [(i, *plain_features(x, orders)) for i, x in docs]
    for _, f, _ in own:
        s.update(map(spot, f))
    for x in target:
        t.update(map(spot, plain_features(x, orders)[0]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, f, words in own:
        weight = sum(gain[spot(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = share[0] * len(fit) // share[1]
    return [(*r[:4], n + 1 if n < k else None) for n, r in enumerate(fit)] + [(*r[:4], None) for r in rows if r[4] < least]


def same(got, want):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_query_equals_the_plain_draw(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = plain_draw(docs, target)
    assert sum(r[4] is not None for r in want) > 50
    same(Q.QUERIES["op13_target_draw"](spark, d).collect(), want)


@pytest.mark.parametrize(("share", "orders", "pivots"), [((30, 100), 2, 3), ((100, 100), 1, 24), ((0, 100), 1, 24), ((77, 100), 3, 1)])
def test_shares_orders_ties_and_repeated_rows(spark, monkeypatch, share, orders, pivots):
    monkeypatch.setattr(T.kth_key, "__defaults__", (pivots,))
    rng = np.random.default_rng(3)
    docs = [(int(rng.integers(0, 40)) if i % 9 else None, " ".join(f"W{x}" for x in rng.integers(0, 3, rng.integers(0, 6)))) for i in range(300)] * 2
    df = spark.createDataFrame([(i, x, 1) for i, x in docs], "doc_id long, text string, rank int")
    target = spark.createDataFrame([("w1 w2",), (None,)], "text string")
    same(T.draw(df, target, share, 2, 50, orders).collect(), plain_draw(docs, ["w1 w2", None], share, 2, 50, orders))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 2)), min_size=1, max_size=60), st.randoms())
def test_the_kth_key(spark, rows, random):
    df = spark.createDataFrame(rows, "score long, doc_id long, n_features long")
    keys = sorted((-s, int(i is None), i or 0, n) for s, i, n in rows)
    k = random.randint(1, len(rows))
    assert T.kth_key(df, k, 2) == keys[k - 1] and T.kth_key(df, len(rows) + 1, 4) is None


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a " * 100000), (4, "É é É 9z_Z"), (4, "É é É 9z_Z")], "doc_id long, text string")
    empty = spark.createDataFrame([], "text string")
    same(T.draw(df, empty, (100, 100)).collect(), plain_draw([tuple(r) for r in df.collect()], [], (100, 100)))
    assert T.draw(df.limit(0), empty).collect() == []
