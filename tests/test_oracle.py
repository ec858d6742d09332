"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from wardframe.plans.oracle import ORACLE
from wardframe.plans import flagmodels, stored  # noqa: F401
from wardframe.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are missing")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool) or not hasattr(value, "__float__"):
        return str(value)
    return f"{float(value) + 0.0:.5f}"


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = db.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(map(tuple, df.collect()), df.columns) == table(cursor.fetchall(), columns)
