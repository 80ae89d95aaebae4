"""Every query of the catalog against its SQL in DuckDB."""

import decimal
import math
import os

import duckdb
import pytest

from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.9g}") if math.isfinite(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    said = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, said.fetchall())
    assert len(got) == len(want)
    assert got == want
