"""Every query that SQL can express, against DuckDB on the smallest tables; and on shuffled rows."""

import math
from decimal import Decimal

import duckdb
import pytest
from corpusloom.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def ordered(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ordered(got.collect(), got.columns), ordered(want.fetchall(), want.columns)
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["hybrid_search", "precedence_majority", "source_merge", "calib_sweep", "session_ttl"])
def test_order_of_rows_does_not_matter(spark, tmp_path, name):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    a, b = QUERIES[name](spark, SF), QUERIES[name](spark, str(tmp_path))
    assert ordered(a.collect(), a.columns) == ordered(b.collect(), b.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
