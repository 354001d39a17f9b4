import random

import pytest

from tessera.llm import decontaminate as D
from tessera.llm.queries import QUERIES


def index_of(items):
    units = [u for _, t in items for u in D.units_of(t)]
    df = {}
    for u in units:
        for w in set(u):
            df[w] = df.get(w, 0) + 1
    return D.Index(items, df, len(units), sum(map(len, units)) / max(len(units), 1))


def exhaustive(index, terms, threshold):
    score = {}
    for t in terms:
        for u, s in zip(index.units[t], index.impacts[t]):
            score[u] = score.get(u, 0.0) + s
    return {u for u, s in score.items() if s >= threshold}


def test_wand_equals_exhaustive_scores():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(5, 40)))) for i in range(150)]
    index = index_of(items)
    for _ in range(300):
        terms = sorted(rng.sample(range(len(index.word)), rng.randint(1, 30)))
        t = rng.choice([0.05, 0.2, 0.4, 0.6, 0.9])
        got = index.above(terms, t)
        assert {u for u, _ in got} == exhaustive(index, terms, t) and len(got) == len({u for u, _ in got})


def plain_leaks(docs, items):
    """Documents that hold an item word for word."""
    norm = lambda t: b" " + b" ".join(D.words_of(t)) + b" "
    return {(i, j) for i, t in docs for j, q in items if D.words_of(q) and norm(q) in norm(t)}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_documents(spark, folder):
    d = f"/root/testdata/{folder}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, d).collect()}
    want = plain_leaks(docs, items)
    assert want and got == want


def test_changed_passages_are_found_and_others_left_alone():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(40)]
    items.append((99, " ".join(word() for _ in range(500)) + "."))
    index = index_of(items)
    filler = [word() for _ in range(3000)]
    for i, t in items:
        w = t.upper().split()
        w[3], w[17] = "changed", "words,"
        at = rng.randrange(2900)
        assert [x[0] for x in index.search([" ".join(filler[:at] + w + filler[at:])])[0]] == [i]
    assert index.search([" ".join(filler), None, "", " ".join(items[0][1].split()[:30])]) == [[], [], [], []]          # the last is a question alone
    for n in (63, 64, 65, 127, 128, 129, 200):
        assert [x[0] for x in index.search(["", " ".join(filler[:n]) + " " + items[5][1], "x"])[1]] == [5]


def test_parts_change_nothing(spark, sf, monkeypatch):
    rows = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in QUERIES["op1_decontaminate"](spark, sf).collect())
    one = rows()
    monkeypatch.setattr(D, "PART_BYTES", 3000)
    assert rows() == one


@pytest.mark.parametrize("item, text", [
    ("中国最长的河流是哪一条河它流经哪些省份最后流入哪一片海洋呢?答案是长江它流入东海。", "前面有一些别的话。中国最长的河流是哪一条河它流经哪些省份最后流入哪一片海洋呢?答案是长江它流入东海。后面还有一些别的话。"),
    ("ประเทศไทยมีเมืองหลวงชื่ออะไรและอยู่ริมแม่น้ำสายใด\nกรุงเทพมหานครอยู่ริมแม่น้ำเจ้าพระยา", "เริ่ม ประเทศไทยมีเมืองหลวงชื่ออะไรและอยู่ริมแม่น้ำสายใด\nกรุงเทพมหานครอยู่ริมแม่น้ำเจ้าพระยา จบ"),
    ("Who wrote the long book about the white whale? Herman Melville wrote it.", "“Who wrote the long book about the ‘white whale’? Herman\u00a0Melville wrote it.”"),
    ("naïve café crème brûlée façade. élan vital déjà vu", "x «naïve café crème brûlée façade». élan\u2014vital déjà vu y"),
])
def test_scripts_and_separators(item, text):
    index = index_of([(7, item)])
    assert [x[0] for x in index.search([text])[0]] == [7]
    assert index.search([text[:len(text) // 3], "other text " * 50]) == [[], []]


def test_short_items_by_their_run(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "One"), (3, "?!"), (4, "北京"), (5, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha, BETA y"), (2, "alpha x beta one"), (3, "?! alone"), (4, "他在北京住"), (5, "alpha beta gamma delta")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()} == {(1, 1), (2, 2), (4, 4), (5, 1), (5, 5)}
    assert [r.doc_id for r in D.clean_documents(docs, items).collect()] == [3]


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta. eta theta iota"
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "x " * 9000 + item.upper(), 1), (2, "x " * 9000 + item.upper(), 1), (3, "alpha beta", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (7, item), (8, "too short"), (9, None), (None, "kappa lambda mu nu xi omicron")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()] == [(2, 7), (2, 7)]
    assert sorted(r.doc_id or 0 for r in D.clean_documents(docs, items).collect()) == [0, 1, 3]
    assert D.leaks(docs, items.limit(0)).collect() == [] and D.leaks(docs.limit(0), items).collect() == []
    assert D.clean_documents(docs, items.limit(0)).count() == 5
