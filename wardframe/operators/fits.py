"""Many fits over the same rows, side by side.

The fits of repeated or cross-validated validation differ only in the rows they
leave out.  Here the rows are stored once, in chunks of bounded size, each row
with the folds it belongs to; a fit is a number of a fold to leave out, so its
rows are never copied.  Model code (:mod:`boosting`, :mod:`penalised`) works
through the chunks with all fits at once, and what it sums over chunks does not
grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.session import pin

#: Rows of a chunk; tables up to this size are one chunk.
CHUNK_ROWS = 8192
#: Partial sums that one task adds up.
FAN_IN = 64
PARTIAL = "fit int, part long, sums binary"


@dataclass(frozen=True)
class Fit:
    """One model: it learns from the rows whose fold in assignment ``slot`` is
    not ``held`` and scores the rows whose fold is, or all of them."""

    held: int = -1
    slot: int = 0
    tags: dict = field(default_factory=dict)
    score_all: bool = False


class Chunk:
    """The rows of a chunk as arrays."""

    def __init__(self, row: dict, n_features: int):
        self.number = row["chunk"]
        self.x = np.frombuffer(row["x"], np.float64).reshape(-1, n_features)
        self.y = np.frombuffer(row["y"], np.float64)
        self.folds = np.frombuffer(row["folds"], np.int16).reshape(len(self.y), -1)
        self.tie = np.frombuffer(row["tie"], np.int64).view(np.uint64)

    def learns(self, fits: Sequence[Fit]) -> np.ndarray:
        """Rows by fits: does the fit learn from the row?"""
        return self.folds[:, [f.slot for f in fits]] != np.array([f.held for f in fits], np.int16)

    def scores(self, fits: Sequence[Fit]) -> np.ndarray:
        return ~self.learns(fits) | np.array([f.score_all for f in fits], bool)


def chunked(
    rows: DataFrame, features: Sequence[str], key: str, label: str, folds: Column | None = None, whole: int = 1
) -> DataFrame:
    """(chunk, keys, x, y, folds, tie): the written rows, CHUNK_ROWS together, or
    all of them if they are no more than ``whole`` chunks.  ``folds`` is an array
    of fold numbers, one per assignment; missing feature values are kept as such."""
    kind = rows.schema[key].dataType.simpleString()
    plain = rows.select(
        F.col(key).alias("key"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(key)).alias("tie"),
        (F.array(F.lit(0)) if folds is None else folds).cast("array<int>").alias("folds"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
    )
    plain = pin(plain)
    n = plain.count()
    parts = 1 if n <= whole * CHUNK_ROWS else -(-n // CHUNK_ROWS)
    most = max(2, whole) * CHUNK_ROWS if parts == 1 else 2 * CHUNK_ROWS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size, n = TaskContext.get().partitionId(), [], 0, 0

        def chunk() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            x = rows.column("x").combine_chunks().flatten()
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 20) + n]), pa.ListArray.from_arrays([0, rows.num_rows], rows.column("key").combine_chunks()),
                pa.array([x.to_numpy(zero_copy_only=False).astype(np.float64).tobytes()]),
                pa.array([rows.column("y").to_numpy().tobytes()]),
                pa.array([rows.column("folds").combine_chunks().flatten().to_numpy().astype(np.int16).tobytes()]),
                pa.array([rows.column("tie").to_numpy().tobytes()]),
            ], names=["chunk", "keys", "x", "y", "folds", "tie"])

        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, most - size)
                batch = batch.slice(taken.num_rows)
                held.append(taken)
                size += taken.num_rows
                if size == most:
                    yield chunk()
                    held, size, n = [], 0, n + 1
        if size:
            yield chunk()

    return pin(plain.repartition(parts).mapInArrow(
        packed, f"chunk long, keys array<{kind}>, x binary, y binary, folds binary, tie binary"))


def spread(spark: SparkSession, chunks: int, fits: int, most: int) -> list[list[int]]:
    """The fits in groups of at most ``most``, small enough that all cores work."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    size = max(1, min(most, -(-fits * chunks // cores)))
    return [[*range(i, min(i + size, fits))] for i in range(0, fits, size)]


def partial_rows(part: int, held: dict[int, np.ndarray]) -> pa.RecordBatch:
    """PARTIAL rows of the sums that a task holds by fit."""
    return pa.RecordBatch.from_arrays(
        [pa.array([*held], pa.int32()), pa.array([part] * len(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
        names=["fit", "part", "sums"])


def added(sums: DataFrame, parts: int, finish: Callable[[np.ndarray], bytes]) -> list[bytes]:
    """Per fit, in order, ``finish`` of the sum of its PARTIAL rows.  They come
    from ``parts`` tasks and are added FAN_IN at a time; what ``finish`` makes
    is all that reaches the driver."""

    def total(rows: pa.Table) -> np.ndarray:
        out = np.zeros(len(rows.column("sums")[0].as_buffer()) // 8)
        for data in rows.column("sums"):
            out += np.frombuffer(data.as_buffer(), np.float64)
        return out

    def merge(rows: pa.Table) -> pa.Table:
        return pa.table({"fit": rows.column("fit").slice(0, 1), "part": pa.array([rows.column("part")[0].as_py() // FAN_IN]),
                         "sums": pa.array([total(rows).tobytes()], pa.binary())})

    def last(rows: pa.Table) -> pa.Table:
        return pa.table({"fit": rows.column("fit").slice(0, 1), "done": pa.array([finish(total(rows))], pa.binary())})

    while parts > FAN_IN:
        sums = sums.groupBy("fit", F.expr(f"part div {FAN_IN}")).applyInArrow(merge, PARTIAL)
        parts = -(-parts // FAN_IN)
    return [r.done for r in sorted(sums.groupBy("fit").applyInArrow(last, "fit int, done binary").collect())]


def tagged(scores: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """The scores with their fits' tags in place of the fit's number."""
    names = [*fits[0].tags] if fits else []
    if not names:
        return scores.drop("fit")
    # one row per fit of the call
    rows = scores.sparkSession.createDataFrame([(i, *[f.tags[n] for n in names]) for i, f in enumerate(fits)], ["fit", *names])
    return scores.join(F.broadcast(rows), "fit").select(*names, *[c for c in scores.columns if c != "fit"])
