"""Every registered query against its SQL, and those without SQL against properties."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quakeloom import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Without neighbourhoods of five events on the smallest tables.
SPARSE = {"a3_monte_carlo_planes", "c18_grid_search"}
SLOW = {"workload_database", "workload_single_sequence", "c13_orientation_count"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "~"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v):.7g}"
        return str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, sf_dir, name):
    got, want = rows(registry.QUERIES[name](spark, sf_dir).toPandas()), rows(duck.execute(registry.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    far = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not far, far[:3]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - SLOW))
def test_runs(spark, sf_dir, name):
    least = 0 if name in SPARSE else 1
    assert registry.QUERIES[name](spark, sf_dir).count() >= least
