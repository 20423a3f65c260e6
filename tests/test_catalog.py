"""Every query of the library against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from skyloom.plans import catalog, maps, regional

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else round(float(x), 5) if isinstance(x, float) else x.isoformat() if hasattr(x, "isoformat") else float(x) if hasattr(x, "__float__") and not isinstance(x, (str, bool)) else x
    return sorted(([plain(x) for x in r] for r in df.itertuples(index=False)), key=str)


assert maps.QUERIES is regional.QUERIES is catalog.QUERIES


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_twin(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_pushdown(spark):
    plan = catalog.QUERIES["zonal_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderkey" not in plan.split("ReadSchema")[1].split(">")[0]
