import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S
from tessera.llm.queries import QUERIES


def plain(rows, length=50):
    first = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            k = t[p:p + length]
            if i is not None and i < first.get(k, i + 1):
                first[k] = i
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if i is not None and first[t[p:p + length]] < i:
                gone[p:p + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=lambda x: (x[0] is None, x))


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (x[0] is None, x))


def test_names_are_equal_for_equal_strings_only():
    b = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=4000)), np.uint8)
    for n in (1, 2, 3, 25, 50, 75):
        name, at = S.names(b, n), range(len(b) - n + 1)
        assert len({name[i] for i in at}) == len({b[i:i + n].tobytes() for i in at}) == len({(name[i], b[i:i + n].tobytes()) for i in at})


def test_every_string_holds_an_anchor():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"abc ", k=n)) for n in (0, 10, 49, 50, 51, 300)] + [b"a" * 200, b"ab" * 90]
    j = S.Joined(texts, 50)
    at = set(S.anchors(j)[0].tolist())
    for s, t in zip(j.starts.tolist(), texts):
        for p in range(len(t) - 49):
            assert any(s + p + o in at for o in range(26))
        if len(t) < 50:
            assert not at & set(range(s, s + len(t)))


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain(rows)
    assert got(QUERIES["op7_suffix_dedup"](spark, sf)) == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("chunk", [200, 1_000_000])
def test_random_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(chunk)
    stock = ["".join(rng.choices("abcdé ", k=rng.randint(30, 160))) for _ in range(12)]
    rows = []
    for i in rng.sample(range(1000), 120):
        t = "".join(rng.choice([rng.choice(stock), rng.choice(stock)[rng.randint(0, 40):], "".join(rng.choices("xyz", k=rng.randint(0, 70)))]) for _ in range(rng.randint(0, 6)))
        rows.append((i, t))
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], rows[2][1]), (5000, "q" * 120), (5001, "q" * 60), (5002, "q" * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(S.without_repeats(df)) == plain([(i, t.encode()) for i, t in rows])


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 9000
    rows = [(None, long, 1), (1, None, 1), (2, "", 1), (3, long, 1), (3, long, 1), (9, "x" + long + "y", 1), (None, long, 1), (4, "short", 1), (5, "short", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    out = {r.doc_id: r for r in S.without_repeats(df).collect()}
    assert len(S.without_repeats(df).collect()) == len(rows)
    assert out[None].n_removed == out[3].n_removed == out[5].n_removed == out[1].n_bytes == 0
    assert (out[9].n_removed, out[9].n_spans, out[9].kept_sha256) == (len(long), 1, hashlib.sha256(b"xy").hexdigest())
    assert S.without_repeats(df.limit(0)).collect() == []
