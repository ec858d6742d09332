"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased.
Documents are taken in batches, largest ids first.  A batch's keys are
merge-anti-joined with the runs: a key that a run already holds often enough
is settled, because every later batch has smaller ids only, and is not stored
again.  What remains becomes the batch's own sorted run.  When a level holds
``fanout`` runs they are compacted into one run of the next level.  At the end
the runs say, for every key, whether it is frequent and which document keeps it.

Defined results: a null or empty text is one empty line; a null id is the
smallest id; rows that share an id are documents of their own, and if that id
is the largest both keep the line; keys shorter than ``min_chars`` code points
never count; an input column named like a result column gives way to it.
Hashes have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.llm.common import NULL_ID, bounded_batches, id_or_least, plain_columns, tidy
from wardframe.session import pin

KEY = ["hi", "lo"]


def long_keys(text: bytes, min_chars: int) -> Iterator[tuple[int, bytes | None]]:
    """(position, 16-byte key hash) of every line; None for a short key."""
    for i, line in enumerate(text.lower().split(b"\n")):
        key = line.strip()
        if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
            yield i, None
        else:
            yield i, xxhash.xxh3_128_digest(key)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, hi, lo): the distinct long keys of every document row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                own = {h for _, h in long_keys(text, min_chars) if h}
                ids += [doc] * len(own)
                found += own
            pairs = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())],
                names=["id", "hi", "lo"],
            )

    return docs.select(id_or_least(F.col(id_col)).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(keys), "id long, hi long, lo long"
    )


class SortedRuns:
    """Runs of (hi, lo, n_docs, last_id), sorted by key, in levels."""

    def __init__(self, spark: SparkSession, need: int, fanout: int = 3):
        self.spark, self.need, self.fanout = spark, need, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """Lines whose key no run holds ``need`` times yet, by merge anti join."""
        for run in self.runs():
            settled = run.where(F.col("n_docs") >= self.need).select(*KEY)
            lines = lines.join(settled.hint("merge"), KEY, "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Store a batch as a run of its own; compact full levels."""
        # counted first, so a very frequent key reaches the join as one row a task
        own = lines.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id"))
        own = self.unsettled(own)
        level, run = 0, pin(own.sortWithinPartitions(*KEY))
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = pin(self._merged(self.levels[level]).sortWithinPartitions(*KEY))
            self.levels[level] = []
            level += 1

    def totals(self) -> DataFrame:
        """One row per key over all runs; counts stop at the settled batch."""
        return self._merged(self.runs())

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = reduce(DataFrame.unionByName, runs)
        return both.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))


def _descending_batches(lines: DataFrame, batches: int) -> Iterator[DataFrame]:
    """Equal id ranges, the largest ids first; missing ids join the last one."""
    known = F.when(F.col("id") != NULL_ID, F.col("id"))
    low, high, rows = lines.agg(F.min(known), F.max(known), F.count("*")).first()
    if not rows:
        return
    if low is None:
        low = high = NULL_ID + 1
    step = -(-(high - low + 1) // batches)
    for top in range(high, low - 1, -step):
        above = lines.where(F.col("id") <= top) if top < high else lines
        yield above.where(F.col("id") > top - step) if top - step >= low else above


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
) -> DataFrame:
    """``docs`` with frequent lines dropped from ``text_col``, plus ``n_lines``
    (before dropping) and ``n_dropped``.

    A key of ``min_chars`` code points found in ``min_docs`` documents keeps
    its lines only in the document with the largest id.
    """
    bounded_batches(docs.sparkSession)
    lines = pin(line_keys(docs, id_col, text_col, min_chars))
    runs = SortedRuns(docs.sparkSession, min_docs)
    for batch in _descending_batches(lines, batches):
        runs.add(batch)
    row = F.struct(*[F.col(c) for c in docs.columns])
    keyed = docs.select(id_or_least(F.col(id_col)).alias("id"), row.alias("row"))
    if runs.runs():
        # a table of its own, so that the join shuffles both sides and can split a hot key
        frequent = pin(runs.totals().where(F.col("n_docs") >= min_docs).select(*KEY, "last_id"))
        drops = (
            lines.join(frequent, KEY).where("id < last_id").groupBy("id")
            .agg(F.collect_set(F.struct(*KEY)).alias("drop"))
        )
        keyed = keyed.join(drops, "id", "left")
    else:
        keyed = keyed.withColumn("drop", F.lit(None).cast("array<struct<hi:long,lo:long>>"))
    return _without(keyed, docs, text_col, min_chars)


def _without(keyed: DataFrame, docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """Drop the lines whose key hash is in ``drop``."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drop = _texts(batch.column(0)), batch.column(1)
            ends = drop.offsets.to_numpy()
            values = drop.values
            pairs = np.stack([values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1).astype(np.int64)
            packed, has = pairs.tobytes(), drop.is_valid().to_pylist()
            out, n_lines, n_dropped = [], [], []
            for i, text in enumerate(texts):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if has[i]:
                    gone = {packed[16 * k : 16 * k + 16] for k in range(ends[i], ends[i + 1])}
                    stays = [lines[k] for k, h in long_keys(text, min_chars) if h not in gone]
                    n_dropped.append(len(lines) - len(stays))
                    text = b"\n".join(stays)
                else:
                    n_dropped.append(0)
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(out, pa.binary()).cast(pa.string()),
                 pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=["rest", "kept", "n_lines", "n_dropped"],
            )

    others = [c for c in plain_columns(docs, ["n_lines", "n_dropped"]) if c != text_col]
    rest = F.struct(F.lit(0).alias("c"), *[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(others)])
    sent = keyed.select(F.col("row")[text_col].alias("text"), "drop", rest.alias("rest"))
    kind = sent.schema["rest"].dataType.simpleString()
    done = sent.mapInArrow(tidy(kept), f"rest {kind}, kept string, n_lines long, n_dropped long")
    back: list[Column] = [
        F.col("kept").alias(c) if c == text_col else F.col("rest")[f"c{others.index(c)}"].alias(c)
        for c in docs.columns if c == text_col or c in others
    ]
    return done.select(*back, "n_lines", "n_dropped")
