"""Registered queries of the subpackage against their SQL."""

import os
from pathlib import Path

import duckdb
import pytest

from wardframe.llm.oracle import ORACLE
from wardframe.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are missing")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = db.execute(ORACLE[name])
    columns = sorted(c[0] for c in cursor.description)
    assert columns == sorted(df.columns)
    want = [dict(zip([c[0] for c in cursor.description], row, strict=True)) for row in cursor.fetchall()]
    got = [row.asDict() for row in df.collect()]
    assert sorted(repr([r[c] for c in columns]) for r in got) == sorted(repr([r[c] for c in columns]) for r in want)
