"""Every registered query against its SQL on the smallest tables."""

import math

import pytest

from kelvara.plans import catalogue


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(data):
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "rank", "parsed_id", "chunk_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_general_problem_queries_run(spark, data):
    q = catalogue.queries()
    assert q["p1_found"](spark, data).columns == ["tbl", "rec_id", "row_no", "col_no"]
    assert q["p1_found"](spark, data).count() > 0
    assert q["p2_found"](spark, data).columns == ["table_id", "row_no", "reason"]
