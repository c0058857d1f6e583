"""Every registered query beside its SQL on the smallest tables, and the entry point."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quantweave import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def shown(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.5g}".replace("-0", "0") if float(v) == 0 else f"{float(v):.5g}"
    except (TypeError, ValueError):
        return str(v)[:19].replace(" 00:00:00", "")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(shown, r)) for r in df.astype(object).itertuples(index=False))


#: Of the catalogue's queries, which are long to plan, a few stand for all.
CATALOGUE = ("Z_academic", "Z_fundamental", "Z_qlib158_w10", "Z_alpha101_001", "Z_gtja191_01", "Z_gtja191_apart_1")


def named(queries) -> list[str]:
    return sorted(n for n in queries if not n.startswith("Z_") or n in CATALOGUE)


@pytest.mark.parametrize("name", named(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", named(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
