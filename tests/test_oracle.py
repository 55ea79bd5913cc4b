"""Every query of the engine against its oracle SQL on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    res = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert got == want


def test_catalog_is_wide():
    assert len(QUERIES) >= 80
    assert set(ORACLE_SQL) <= set(QUERIES)
