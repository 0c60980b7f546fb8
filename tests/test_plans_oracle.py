"""Every registered query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    return v


def _rows(recs):
    out = [tuple(_norm(x) for x in r) for r in recs]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, sf_small, duck, name):
    sdf = E.queries()[name](spark, sf_small)
    cols = sorted(sdf.columns)
    got = _rows([tuple(r[c] for c in cols) for r in sdf.collect()])
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    assert got == _rows([tuple(r[i] for i in idx) for r in res.fetchall()])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"bucket", "packets", "bytes", "mean_size", "distinct_sources"}
