"""Stored views that depend on each other, built in order and refreshed by key.

A view is a function of tables and other views.  The order follows from what
each one reads, whatever order they are declared in.  All rows of a view belong
to a key (a patient, an admission), and depend only on rows of that key in what
it reads; so new events change only the rows of the keys that they touch.

A view is stored in buckets of its key.  A refresh makes the rows of the touched
keys anew, joins them with the untouched rows of their buckets and writes those
buckets as a new version; the other buckets stay where they are.  Nothing is
overwritten: a reader of the old version keeps it, and a refresh that fails
leaves the view as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.session import shared_dir

BUCKET = "_bucket"


@dataclass(frozen=True)
class View:
    """``make`` gets the named inputs as a mapping."""

    inputs: Sequence[str]
    make: Callable[[Mapping[str, DataFrame]], DataFrame]


class ViewGraph:
    def __init__(self, views: Mapping[str, View], key: Sequence[str], buckets: int = 32, folder: str | None = None):
        self.views, self.key, self.buckets, self.folder = dict(views), list(key), buckets, folder
        self.order = self._ordered()
        # per view: its columns, and per version the buckets that are current there
        self.schemas: dict = {}
        self.current: dict[str, dict[str, set[int]]] = {}

    def _ordered(self) -> list[str]:
        """Views after everything they read."""
        out: list[str] = []
        waiting = dict(self.views)
        while waiting:
            ready = [n for n, v in waiting.items() if not any(i in waiting for i in v.inputs)]
            if not ready:
                raise ValueError(f"views that read each other: {', '.join(waiting)}")
            out += ready
            for n in ready:
                del waiting[n]
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, owned: Iterable[int]) -> None:
        version = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        # files of a hot bucket are split, those of small ones merged
        spread = rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET)
        spread.write.partitionBy(BUCKET).parquet(version)
        owned = set(owned)
        left = {v: held - owned for v, held in self.current.get(name, {}).items()}
        self.current[name] = {v: held for v, held in left.items() if held} | {version: owned}

    def read(self, name: str, spark, buckets: Iterable[int] | None = None) -> DataFrame:
        """The current rows of a view, of some buckets or of all."""
        wanted = set(range(self.buckets)) if buckets is None else set(buckets)
        schema = self.schemas[name]
        parts = [
            spark.read.schema(f"{schema}, {BUCKET} int").parquet(version).where(F.col(BUCKET).isin(sorted(held & wanted)))
            for version, held in self.current[name].items() if held & wanted
        ]
        rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, {BUCKET} int")
        return rows.drop(BUCKET)

    def build(self, tables: Mapping[str, DataFrame]) -> None:
        """Make and store all views."""
        spark = next(iter(tables.values())).sparkSession
        self.folder = self.folder or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        for name in self.order:
            rows = self.views[name].make(self._inputs(name, tables, spark))
            self.schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            self.current.pop(name, None)
            self._write(name, rows, range(self.buckets))

    def _inputs(self, name: str, tables: Mapping[str, DataFrame], spark, touched: DataFrame | None = None) -> dict[str, DataFrame]:
        out = {}
        for i in self.views[name].inputs:
            rows = tables[i] if i not in self.views else self.read(i, spark, self._numbers(touched))
            if touched is not None and set(self.key) <= set(rows.columns):
                rows = rows.join(touched, self.key, "left_semi")
            out[i] = rows
        return out

    def _numbers(self, touched: DataFrame | None) -> list[int] | None:
        if touched is None:
            return None
        # at most one number per bucket
        return [r[0] for r in touched.select(self._bucket()).distinct().collect()]

    def readers_of(self, changed: Iterable[str]) -> list[str]:
        """The views that read one of ``changed``, at first or second hand."""
        seen = set(changed)
        out = []
        for name in self.order:
            if seen & set(self.views[name].inputs):
                seen.add(name)
                out.append(name)
        return out

    def refresh(self, tables: Mapping[str, DataFrame], changed: Iterable[str], touched: DataFrame) -> list[str]:
        """Bring the views up to date after ``changed`` tables got or lost rows
        of the keys ``touched``; ``tables`` are as they are now.  Inputs without
        the key are read whole.  Returns the refreshed views."""
        spark = touched.sparkSession
        touched = touched.select(*self.key).distinct()
        numbers = self._numbers(touched)
        done = self.readers_of(changed)
        for name in done if numbers else []:
            new = self.views[name].make(self._inputs(name, tables, spark, touched))
            rest = self.read(name, spark, numbers).join(touched, self.key, "left_anti")
            self._write(name, rest.unionByName(new.select(*rest.columns)), numbers)
        return done
