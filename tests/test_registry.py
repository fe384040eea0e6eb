"""Every registered query runs on sf0.001 and agrees with its DuckDB oracle."""

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "rank" in df.columns


SQL = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(SQL[name])
    cols = [d[0] for d in res.description]
    want = _rows(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_schema_forms_are_not_queries_and_match_sql(spark, duck):
    from tallyscope.plans.queries_more import METADATA
    assert set(METADATA) == {"infer_roles", "infer_domain"} and not set(METADATA) & set(E.queries())
    for fn, sql in METADATA.values():
        df, res = fn(spark, SF), duck.execute(sql)
        cols = [d[0] for d in res.description]
        assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, res.fetchall())


def test_amount_column_reads_its_tables_in_one_plan(spark):
    df = E.queries()["infer_amount_column"](spark, SF)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("Aggregate") == len(TABLES) and "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert df.count() == len(TABLES)
