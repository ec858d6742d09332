"""Words, hashes and small helpers that several operators share."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id sorts before every other id.
NULL_ID = -(2**63)
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are limited by bytes on their way to the
    workers; a smaller limit of the session stays."""
    now = spark.conf.get(BATCH_BYTES)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= TEXT_BATCH:
        spark.conf.set(BATCH_BYTES, str(TEXT_BATCH))


def id_or_least(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def id_back(column: Column) -> Column:
    return F.when(column != NULL_ID, column)


def plain_columns(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of ``df`` not named like one that is made."""
    return [c for c in df.columns if c.lower() not in made]


def _release() -> None:
    """Give memory that is no longer used back to the system.  Idle Python
    workers stay with their executor, and so would what they have cached."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # another C library: it keeps its cache
        return


def tidy(function: Callable) -> Callable:
    """A function for mapInArrow that releases its memory after its last batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _release()

    return rows


def tidy_group(function: Callable) -> Callable:
    """A function for applyInArrow that releases its memory after each group."""
    if len(inspect.signature(function).parameters) == 1:

        def one(rows: pa.Table) -> pa.Table:
            out = function(rows)
            _release()
            return out

        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = function(left, right)
        _release()
        return out

    return two


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``most`` bytes of text each; a
    longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def row_blocks(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``most`` bytes of text together; a longer
    text is a block of its own.  Only the rows and their order decide where a
    block ends, not the batches they come in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin = 0
        for i, own in enumerate(sizes):
            if size + own > most and (held or i > begin):
                held.append(batch.slice(begin, i - begin))
                yield pa.concat_batches(held)
                held, size, begin = [], 0, i
            size += own
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.concat_batches(held)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in one array, and the
    offsets at which each text's words begin (one more than texts).  A null
    text has no words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), before[ends]


def raw(array: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string array without nulls, and their offsets."""
    if array.offset or pa.types.is_large_string(array.type):
        array = pa.concat_arrays([array.cast(pa.string()), pa.array([], pa.string())])
    _, offsets, data = array.buffers()
    where = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1] if offsets else np.zeros(1, np.int32)
    return memoryview(data or b""), where.astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
