"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tessera.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    said = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(said(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLES[name])
    assert rows_of(found.columns, found.collect()) == rows_of([c[0] for c in want.description], want.fetchall())
