"""Every query with SQL against DuckDB, on the smallest tables; and the contract of the entry module."""

import math
import os
from pathlib import Path

import pytest

import attesta.plans.catalogue  # noqa: F401
import attesta.plans.inventory  # noqa: F401
import attesta.plans.matching  # noqa: F401
from attesta.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if isinstance(v, int) or type(v).__name__ == "Decimal" else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    answer = duck.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, answer.fetchall())


def same_as_sql(spark, name, folder, table, rows_):
    import duckdb

    spark.createDataFrame(*rows_).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        answer = c.execute(SQL[name])
        columns, found = [x[0] for x in answer.description], answer.fetchall()
    df = QUERIES[name](spark, str(folder))
    assert rows(df.columns, df.collect()) == rows(columns, found)
    return df


def test_long_keys_of_parts(spark, tmp_path):
    keys = [1, 999, 1000, 999_999, 1_000_000, 1_234_567]
    df = same_as_sql(spark, "padded_keys", tmp_path, "part", ([(k,) for k in keys], "p_partkey long"))
    assert df.count() == len(keys)


def test_long_numbers_of_samples(spark, tmp_path):
    numbers = [4, 5, 999_994, 1_000_004, 1_234_564]
    df = same_as_sql(spark, "sample_targets", tmp_path, "events", ([(k,) for k in numbers], "event_id long"))
    assert df.count() == 4


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_of_the_library_does_not_know_the_corpus_operators():
    import attesta

    for f in Path(attesta.__file__).parent.rglob("*.py"):
        if "llm" not in f.parts:
            assert "attesta.llm" not in f.read_text()
