import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import rows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry_has_rows(spark):
    assert entry(spark).count() == 50


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, sf, con, name):
    got = queries()[name](spark, sf).toPandas()
    if name not in oracle_sql():
        assert len(got) > 0
        return
    want = con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
