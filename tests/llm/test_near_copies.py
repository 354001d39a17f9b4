import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as P
from tessera.llm import near_copies as N
from tessera.session import batches_of


def plain_set(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([" ".join(words[i:i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else []))


def plain_groups(texts):
    """The smallest id of each document's group, by exact Jaccard of all pairs that share a shingle."""
    own, label, holders = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}, {}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for y in sorted(own):
        shared = {}
        for g in own[y] or [None]:
            for x in holders.setdefault(g, []):
                shared[x] = shared.get(x, 0) + 1
            holders[g].append(y)
        for x, n in shared.items():
            if 5 * n >= 4 * (max(1, len(own[x])) + max(1, len(own[y])) - n):
                a, b = sorted((find(x), find(y)))
                label[b] = a
    return {i: find(i) for i in own}


def test_stage_keeps_one_of_each_group(spark):
    """Pairs such as 1/255 and 709/944 have a similarity over 0.8 and fingerprints 7 to 10 bits apart."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    groups = plain_groups({r.doc_id: r.text for r in docs.collect()})
    assert groups[255] == groups[1] and groups[944] == groups[709] and groups[770] == groups[643] and groups[875] == groups[582]
    stage = P.STAGES[1][1]
    assert {r.doc_id for r in stage(spark, docs, d).collect()} == set(groups.values())


@pytest.mark.parametrize("sample", [0, 4000])
def test_edges_of_the_similarity(spark, monkeypatch, sample):
    """Texts of many lengths with words exchanged, so that similarities lie on both sides of 0.8; a common line in most; with and without common shingles."""
    monkeypatch.setattr(N, "SAMPLE_ROWS", sample)
    rng, texts = np.random.default_rng(5), []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(1, 90))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.integers(0, 3)):
                own[rng.integers(0, len(own))] = f"v{rng.integers(0, 9999)}"
            texts.append(" ".join(own[:len(own) - rng.integers(0, 3)] + ["one line that stands in very many of the texts"] * (k % 3 > 0)))
    groups = plain_groups(dict(enumerate(texts)))
    got = N.first_of_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(groups.values()) and 70 < len(set(groups.values())) < 330


def test_long_runs_are_cut_into_bands(spark, monkeypatch):
    """Runs of a few documents count as long, and a line in all texts makes one run of them all."""
    monkeypatch.setattr(N, "RUN", 7)
    monkeypatch.setattr(N, "SAMPLE_ROWS", 0)
    rng, texts = np.random.default_rng(6), []
    for _ in range(150):
        base = [f"w{x}" for x in rng.integers(0, 30, rng.integers(8, 40))]
        texts.append(" ".join(["one", "line", "in", "all", "texts", *base]))
    texts += [t + " end" for t in texts[::3]] + [t[:-1] for t in texts[::4]]
    groups = plain_groups(dict(enumerate(texts)))
    got = N.first_of_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(groups.values()) and len(set(groups.values())) > 100


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 900), st.floats(0, 0.3), st.integers(0, 1 << 30))
def test_shapes_never_part_alike_sets(n, share, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[int(len(a) * share * rng.random()):], rng.integers(0, 1 << 64, int(n * share * rng.random()), dtype=np.uint64)]))
    a, b = sorted((a, b), key=len)
    if not len(a):
        return
    both = len(np.intersect1d(a, b))
    one, other = (np.frombuffer(N.shapes(x, np.zeros(1, np.int64), np.array([len(x)]))[0], np.uint8) for x in (a, b))
    if 5 * both >= 4 * (len(a) + len(b) - both):
        assert N.may_be_alike(one, len(a), other[None], np.array([len(b)]))[0]


def test_column_named_like_our_own(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, "a b", 6)], "doc_id long, text string, _gone int")
    assert [tuple(r) for r in N.first_of_groups(df).collect()] == [(1, "a b", 5)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, None, 1), (3, "", 1), (7, "a b", 1), (2, "A  b", 1), (2, "A  b", 1), (None, "x " * 50000, 1), (9, "x " * 70, 1), (None, None, 1)], "doc_id long, text string, row int")
    got = N.first_of_groups(df)
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 2, 2, 3, 9] and got.columns == df.columns
    assert N.first_of_groups(df.limit(0)).collect() == []


def pairs_of_texts(n=40, seed=8):
    """Texts, each with one copy with some words exchanged."""
    rng, texts = np.random.default_rng(seed), []
    for _ in range(n):
        base = [f"w{x}" for x in rng.integers(0, 9000, rng.integers(60, 200))]
        own = list(base)
        for at in rng.integers(0, len(own), rng.integers(1, 5)):
            own[at] = f"v{rng.integers(0, 9999)}"
        texts += [" ".join(base), " ".join(own)]
    return dict(enumerate(texts))


def test_fingerprints_find_close_copies_without_the_prefix_filter(spark, monkeypatch):
    """The search by fingerprints finds each pair within its radius, and only sets that are alike are linked."""
    texts = pairs_of_texts()
    kind, meet = "run long, nodes array<long>, sizes array<long>", N.runs
    monkeypatch.setattr(N, "runs", lambda blobs: spark.createDataFrame([], kind))
    got = {r.doc_id for r in N.first_of_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    bits = {i: N.majority(N.shingles([t.encode()])[0]) for i, t in texts.items()}
    whole = set(plain_groups(texts).values())
    close = {i for i in texts if i % 2 and (bits[i] ^ bits[i - 1]).bit_count() <= N.BITS}
    assert got == set(texts) - (close - whole) and len(close - whole) > 10 and got > whole
    monkeypatch.setattr(N, "runs", meet)
    got = {r.doc_id for r in N.first_of_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == whole


def test_fingerprints_alone_never_link(spark, monkeypatch):
    """All fingerprints equal: whole sets decide, and the prefix filter finds the pairs that the search has not given."""
    texts = pairs_of_texts(seed=9)
    run = N.prints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).drop("bits")
    monkeypatch.setattr(N, "prints", lambda docs: run.selectExpr("*", "5L as bits"))
    got = {r.doc_id for r in N.first_of_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == set(plain_groups(texts).values())


class Task:
    """In place of a table: gives the function that runs in its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, kind):
        return run


@pytest.mark.parametrize("step", ["prints", "sets", "prefixes"])
def test_memory_of_a_task_does_not_follow_the_batch(monkeypatch, step):
    """A batch of 12 MB of text, which took about 200 MB at once."""
    monkeypatch.setattr(N, "_rows", lambda docs: docs)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20_000, 500)) for _ in range(4_000)]
    row = pa.array(range(len(texts)))
    columns = {"prints": {"doc_id": row, "row": row, "text": texts}, "sets": {"row": row, "text": texts}, "prefixes": {"text": texts}}[step]
    batch = pa.RecordBatch.from_pydict(columns)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = N.prefixes(Task(), none, 40) if step == "prefixes" else getattr(N, step)(Task())
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == (40 if step == "prefixes" else len(texts)) and most < 80


def test_long_words_are_not_remembered():
    known = N._Words()
    texts = [b" ".join(b"%d" % i + b"x" * 10_000 for i in range(200))]
    assert np.array_equal(N.shingles(texts, known)[0], N.shingles(texts)[0]) and sum(map(len, known)) < 10_000


def test_small_pieces_and_packs_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 700)
    monkeypatch.setattr(N, "PACK", 90)
    monkeypatch.setattr(N, "BATCH_ROWS", 7)
    texts = pairs_of_texts(seed=10)
    texts |= {1000 + i: t for i, t in texts.items() if i % 3 == 0} | {2000: "", 2001: None, 2002: "a b"}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = N.first_of_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1))
    assert {r.doc_id for r in got.collect()} == set(plain_groups(texts).values()) and spark.conf.get(key) == before


def test_batches_are_as_small_as_asked(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])
    for asked, most in ((300, 300), (50_000, 10_000)):
        with batches_of(spark, asked):
            assert max(r.n for r in spark.range(0, 30_000, 1, 1).mapInArrow(run, "n long").collect()) == most
