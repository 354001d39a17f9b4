import re

import numpy as np
import xxhash

from tessera.llm import sim_hash as S
from tessera.llm.queries import QUERIES


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    label = {i: i for i in prints}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(prints)
    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 4:
                a, b = sorted((find(x), find(y)))
                label[b] = a
    return {i: find(i) for i in ids}


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    heads = rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(rng.choice(heads))
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(b)
        out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


def test_documents(spark, sf):
    want = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups = plain_components(want)
    got = QUERIES["op8_simhash"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.fingerprint == f"{want[r.doc_id]:016x}" and r.component_id == groups[r.doc_id]


def test_trees_equal_all_pairs():
    f = clustered(3000)
    want = plain_components({i: int(x) for i, x in enumerate(f[:1500])})
    assert S.shard_roots(f[:1500], leaf=16).tolist() == [want[i] for i in range(1500)]
    ball = np.unique(np.array([1 << a | 1 << b for a in range(60) for b in range(60)], dtype=np.uint64))
    assert set(S.shard_roots(ball, leaf=8)) == {0}


def test_cut_shards_lose_no_pair(spark):
    f = clustered(600, 3)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    want = plain_components({int(x): int(x) for x in f})
    for most in (4, 1000):
        got = {r.node: r.label for r in S.components(S.links(df, most=most)).collect()}
        root = {x: got.get(int(np.uint64(x).view(np.int64)), int(np.uint64(x).view(np.int64))) for x in want}
        for a, b in zip(want, list(want)[1:]):
            assert (want[a] == want[b]) == (root[a] == root[b])
        assert len(set(root.values())) == len(set(want.values()))


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)], "fp long, head long")
    assert {r.label for r in S.components(e).collect()} == {0}


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, None, 1), (3, "", 1), (7, "a b", 1), (2, "A  b", 1), (2, "A  b", 1), (None, "x " * 50000, 1)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect())
    two = f"{plain_fingerprint('a b'):016x}"
    assert got[1:] == [(2, two, 2), (2, two, 2), (3, "0" * 16, 3), (5, "0" * 16, 3), (7, two, 2)] and got[0][2] is None
    assert sorted((r.doc_id or 0) for r in S.first_of_groups(df).collect()) == [0, 2, 2, 3]
    assert S.near_duplicates(df.limit(0)).collect() == []


def test_column_named_like_our_own(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, "a b", 6)], "doc_id long, text string, _gone int")
    assert [tuple(r) for r in S.first_of_groups(df).collect()] == [(1, "a b", 5)]
