"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from worldlog import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def ordered(rows):
    plain = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = ordered([tuple(r[c] for c in names) for r in df.collect()])
    if name not in plans.ORACLE_SQL:
        assert got
        return
    want = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    place = [want.columns.index(c) for c in names]
    rows = ordered([tuple(r[i] for i in place) for r in want.fetchall()])
    assert len(got) == len(rows)
    for a, b in zip(got, rows, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-5)) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_sql_has_a_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)
    assert plans.FLAGSHIP in plans.QUERIES
