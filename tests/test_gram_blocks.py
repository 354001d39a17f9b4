import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import gram_blocks as B
from tessera.operators import grams
from tessera.session import stage

WORDS = "grace hope the altar call of choir é 1980 7 don't well-known".split()


def some_docs(n=60, seed=3):
    r = random.Random(seed)
    return [(r.choice(["a", "b", "unknown"]), r.choice(["seeker", "church"]), r.choice(["x", "y", None]), [r.choice(WORDS) for _ in range(r.randrange(0, 30))]) for _ in range(n)]


def batches_of(docs, size):
    schema = pa.schema([("source", pa.string()), ("side", pa.string()), ("tradition", pa.string()), ("toks", pa.list_(pa.string()))])
    for i in range(0, len(docs), size):
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in docs[i:i + size]], schema)


def through_blocks(docs, made, schema, parts, content_only=False, wanted=None, size=7):
    moved = defaultdict(list)
    for b in B.pack(3, content_only, parts, wanted, 3)(batches_of(docs, size)):
        for p, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            moved[p].append(block)
    out = []
    for p, blocks in sorted(moved.items()):
        moved_rows = [pa.RecordBatch.from_arrays([pa.array([p] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["gram_part", "block"])]
        out += [tuple(r.values()) for b in B.unpack(made, schema)(moved_rows) for r in b.to_pylist()]
    return out


def plainly(docs, keep=lambda g: True):
    uses, seen = Counter(), Counter()
    for source, side, tradition, t in docs:
        own = Counter(" ".join(t[i:i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))
        for g, c in own.items():
            if keep(g):
                uses[g, source, side, tradition] += c
                seen[g, source, side, tradition] += 1
    return sorted(((*k, c, seen[k]) for k, c in uses.items()), key=str)


@pytest.mark.parametrize("slice_tokens, parts", [(1, 1), (40, 5), (10 ** 6, 3)])
def test_blocks_give_every_gram_back(monkeypatch, slice_tokens, parts):
    monkeypatch.setattr(B, "SLICE", slice_tokens)
    docs = some_docs()
    got = through_blocks(docs, B.rows, B.ROWS, parts)
    assert sorted(got, key=str) == plainly(docs)


def test_a_gram_meets_in_one_part(monkeypatch):
    monkeypatch.setattr(B, "SLICE", 50)
    docs = some_docs(200)
    got = through_blocks(docs, B.totals, B.TOTALS, 7)
    assert len({r[0] for r in got}) == len(got)
    uses = Counter()
    for g, *_, c, _ in plainly(docs):
        uses[g] += c
    assert {r[0]: r[1] for r in got} == uses


def test_only_wanted_grams_travel():
    docs, terms = some_docs(), ["altar call", "grace", "of choir the", "nowhere"]
    wanted = np.unique(np.concatenate([np.frombuffer(r["hashes"], np.uint64) for b in B.gram_hashes([pa.RecordBatch.from_pydict({"gram": terms})]) for r in b.to_pylist()]))
    assert sorted(through_blocks(docs, B.rows, B.ROWS, 4, wanted=wanted), key=str) == plainly(docs, lambda g: g in terms)
    assert through_blocks(docs, B.rows, B.ROWS, 4, wanted=wanted[:0]) == []


def test_content_grams_are_those_of_the_column_rule(spark):
    docs = some_docs()
    every = sorted({r[0] for r in plainly(docs)})
    rule = spark.createDataFrame([(g,) for g in every], "gram string").filter((F.instr("gram", " ") == 0) | X.is_content(F.col("gram"))).toPandas()["gram"]
    assert sorted({r[0] for r in through_blocks(docs, B.rows, B.ROWS, 3, content_only=True)}) == sorted(rule)


def test_keys_of_many_words_keep_their_order():
    size = 1 << 31
    r = np.random.default_rng(1)
    numbers = [r.integers(size - 4, size, 300) for _ in range(3)]
    key = B._key(numbers, size)
    assert np.array_equal(np.lexsort(numbers[::-1]), np.argsort(key, kind="stable"))


def test_grams_move_in_blocks(spark):
    r = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    rows = [(str(i), "church", "x", r.choice("ab"), False, [r.choice(words) for _ in range(300)]) for i in range(100)]
    docs = stage(spark.createDataFrame(rows, "hash string, side string, tradition string, source string, holdout boolean, toks array<string>"), "docs")
    for made in (grams.gram_counts(grams.source_grams(docs)), grams.tradition_counts(grams.source_grams(docs), spark.createDataFrame([("a", "x")], "source string, source_tradition string"))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "gram_part" in plan and "HashAggregate" not in plan.split("Exchange hashpartitioning(gram")[0]
        assert made.count() == made.select("gram").distinct().count() > 50_000
