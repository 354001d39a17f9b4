import zlib

import pytest

from tessera.llm import lang_id as L
from tessera.llm.queries import QUERIES


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_held_out_accuracy(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").collect()}
    got = QUERIES["op6_lang_id"](spark, f"/root/testdata/{folder}").collect()
    assert len(got) == len(docs)
    test = [r for r in got if r.held_out]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in test) / len(test)
    assert right >= 0.97, right
    assert sum(r.rejected for r in got) < 0.05 * len(got)


def test_inputs_of_prediction(spark, sf):
    """A changed lang or source of held-out rows changes nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = docs.withColumn("lang", L.F.when(L.held_out(docs.doc_id), L.F.lit("xx")).otherwise(docs.lang)).withColumn("source", L.F.lit("s"))
    assert sorted(map(tuple, L.identify(docs).collect())) == sorted(map(tuple, L.identify(other).collect()))


def test_odd_rows(spark):
    rows = [(i, "der die das und nicht " * 3, "de", 1.0) for i in range(1, 9)] + [(i, "the and of with not " * 3, "en", 1.0) for i in range(11, 19)]
    rows += [(20, None, "de", 0.0), (21, "", None, 0.0), (22, "123 !?", "en", 0.0), (None, "the and", None, 0.0), (23, "да", None, 0.0), (24, "und die " * 40000, None, 0.0), (24, "und die " * 40000, None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred, r.held_out) for r in L.identify(df).collect()]
    by = dict((i, p) for i, p, _ in got)
    assert [by[i] for i in (20, 21, 22)] == ["und"] * 3 and by[None] == "en" and by[24] == "de" and by[23] in ("de", "en") and len(got) == len(rows)
    assert L.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", L.F.lit(None).cast("string"))).collect()} == {"und"}
