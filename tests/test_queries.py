"""Registered queries against their DuckDB text, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from moundlake.workload import catalogue
from tools.check import TABLES, canonical

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# those of the language-model subpackage are tested beside it
LOCAL = [n for n in ORACLES if n in catalogue.queries()]


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", LOCAL)
def test_query_equals_sql(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    got = [r.asDict(recursive=True) for r in df.collect()]
    rel = tables.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    want = [dict(zip(cols, row, strict=True)) for row in rel.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    assert canonical(got) == canonical(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_finds_the_heaps_of_both_surveys(spark):
    rows = entry.entry(spark).collect()
    assert {r["survey_id"] for r in rows} == {1, 2} and len(rows) >= 7
