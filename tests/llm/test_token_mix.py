import duckdb
import pytest

from tessera.llm import token_mix as T
from tessera.llm.queries import QUERIES, SQL
from tools.compare import rows


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_agrees_with_sql(spark, folder):
    d = f"/root/testdata/{folder}"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = QUERIES["op10_mix"](spark, d).toPandas(), con.execute(SQL["op10_mix"]).df()
    assert rows(got) == rows(want)
    by = got.assign(source_=spark.read.parquet(f"{d}/documents.parquet").toPandas().set_index("doc_id").source.reindex(got.doc_id).values)
    for _, g in by.groupby("source_", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and g["size"].sum() == g.source_size.iloc[0]
    assert (got.taken <= 2 * got["size"]).all()
    assert got.drop_duplicates("source_size").target.sum() == pytest.approx(1.5 * got["size"].sum())


def test_blocks_change_nothing(spark, sf, monkeypatch):
    a = QUERIES["op10_mix"](spark, sf).toPandas()
    monkeypatch.setattr(T, "BLOCK_ROWS", 3)
    assert rows(a) == rows(QUERIES["op10_mix"](spark, sf).toPandas())


def test_targets_fill_up(spark):
    s = spark.createDataFrame([("a", 100, 1), ("b", 1000, 1), ("c", 10, 1), (None, 500, 1), ("d", 0, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in T.source_targets(s).collect()}
    sizes, weights = {"a": 100, "b": 1000, "c": 10, "d": 0, None: 500}, dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    left, free, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while over := [k for k in free if left * weights[k] / sum(weights[x] for x in free) > 2 * sizes[k]]:
        for k in over:
            want[k] = 2.0 * sizes[k]
        free -= set(over)
        left = 1.5 * sum(sizes.values()) - sum(want.values())
    want |= {k: left * weights[k] / sum(weights[x] for x in free) for k in free}
    assert got == pytest.approx(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "a b\tc", "s", 2), (1, "a b\tc", "s", 2), (2, "", "s", 3), (3, "x" * 9 + " y", None, 4)], "doc_id long, text string, source string, size int")
    got = T.mix_words(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 0), (1, 3), (1, 3), (2, 0), (3, 2)]
    assert len({r.taken for r in got if r.doc_id == 1}) == 1
    kept = T.mixed_documents(df)
    assert kept.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert {r.doc_id: r.taken for r in kept.collect() if r.taken} == {r.doc_id: r.taken for r in got if r.taken}
    assert T.mix_words(df.limit(0)).collect() == []


def test_columns_named_like_our_own(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = docs
    for c in ("_t", "_e", "_s", "_d", "_z", "_source", "epochs"):
        named = named.withColumn(c, docs["doc_id"])
    got, plain = T.mixed_documents(named), T.mixed_documents(docs)
    assert got.columns == [*named.columns, "size", "source_size", "target", "taken"]
    assert {(r.doc_id, r.taken, r._t, r._z) for r in got.collect()} == {(r.doc_id, r.taken, r.doc_id, r.doc_id) for r in plain.collect()}
