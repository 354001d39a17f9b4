import numpy as np
import pytest

from tessera.operators import retrieval


def plain(docs, questions, max_chars, step, width):
    """All pairs of an entity, in order, until the room is full."""
    out = []
    for church, question, asked in questions:
        rows = []
        for own, url, title, text in docs:
            for o in range(0, len(text), step) if own == church else ():
                part = text[o:o + width]
                score = len(set(asked.split()) & set(part.split())) + len(set(asked.split()) & {title, "page"})
                rows.append((-score, o, url, part))
        used = 0
        for rn, (score, o, url, part) in enumerate(sorted(rows), 1):
            if used >= max_chars:
                break
            out.append((church, question, rn, url, o, -score, part[:max_chars - used]))
            used += len(part)
    return sorted(out)


@pytest.mark.parametrize("cells", [(3, 2), (4096, 16384)])
def test_question_passages_in_cells(spark, monkeypatch, cells):
    """Passages and questions of an entity lie in many cells or in one; the picks are those of all pairs."""
    monkeypatch.setattr(retrieval, "PASSAGES", cells[0])
    monkeypatch.setattr(retrieval, "QUESTIONS", cells[1])
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x:03d}" for x in rng.integers(0, 60, n))
    docs = [(f"c{i % 3}", f"http://u/{i}", "w001" if i % 4 else "zzzz", text(int(rng.integers(1, 40)))) for i in range(40)]
    questions = [(f"c{i % 4}", i, text(int(rng.integers(1, 9))) if i % 7 else "nothing known") for i in range(30)]
    d = spark.createDataFrame([(*x[:3], "page", x[3]) for x in docs], "church_id string, url string, title string, kind string, text string")
    got = retrieval.question_passages(d, spark.createDataFrame(questions, "church_id string, question_id long, question string"), 300, 50, 70)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, questions, 300, 50, 70)


def test_question_passages_of_empty_tables(spark):
    d = spark.createDataFrame([], "church_id string, url string, title string, kind string, text string")
    q = spark.createDataFrame([(None, 1, "a word"), ("c", 2, None)], "church_id string, question_id long, question string")
    assert retrieval.question_passages(d, q).collect() == []
    one = spark.createDataFrame([("c", "u", None, "page", "a word"), (None, "v", None, "page", "a word")], d.schema)
    assert [tuple(r) for r in retrieval.question_passages(one, q).collect()] == [("c", 2, 1, "u", 0, 0, "a word")]


def test_bm25_parts_follow_the_chunks(spark, monkeypatch):
    """Scores are made where a chunk's postings lie, in more parts the more chunks there are; the hits are the same."""
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{x:03d}" for x in rng.integers(0, 80, n))
    c = spark.createDataFrame([(f"g{i % 2}", f"u{i}", "t", "official", 0, text(30)) for i in range(60)],
                              "group_id string, url string, title string, source_type string, chunk_no int, text string")
    q = spark.createDataFrame([(i, text(4)) for i in range(12)], "query_id long, query string")
    want = sorted(map(tuple, retrieval.bm25(c, q).collect()))
    monkeypatch.setattr(retrieval, "CHUNKS", 7)
    d = retrieval.bm25(c, q)
    assert sorted(map(tuple, d.collect())) == want and len(want) > 60
    assert "hashpartitioning(group_id" in (plan := d._jdf.queryExecution().executedPlan().toString()) and ", 9), REPARTITION_BY_NUM" in plan
