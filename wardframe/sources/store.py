"""Tables bucketed by stay, so that joins and windows per stay need no shuffle.

Rows are hashed by their keys once, when the table is written; every later
aggregate, join or window whose keys include them reads its buckets in place.
Buckets of two tables match if their keys and numbers of buckets do.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.session import pin, shared_dir

#: Columns by which the rows of a bucket are sorted after the keys.
TIMES = ("charttime", "intime", "transfertime", "admittime")


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int, sort: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """``df`` written as the table ``name`` (one of its own by default), one
    sorted file per bucket.  Types of the keys count for matching buckets."""
    spark = df.sparkSession
    name = name or f"wardframe_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    # the same hash as the bucket's, so a task writes one file
    spread = df.repartition(buckets, *keys)
    spread.write.bucketBy(buckets, *keys).sortBy(*keys, *sort).option("path", path).saveAsTable(name)
    return spark.table(name)


def event_store(tables: Mapping[str, DataFrame], keys: Sequence[str], buckets: int) -> dict[str, DataFrame]:
    """The tables, those with all ``keys`` bucketed by them and sorted by their
    time; other tables are written as they are."""
    out = {}
    for name, df in tables.items():
        if set(keys) <= set(df.columns):
            typed = df.withColumns({k: F.col(k).cast("long") for k in keys})
            out[name] = bucketed(typed, keys, buckets, [c for c in TIMES if c in df.columns][:1])
        else:
            out[name] = pin(df)
    return out
