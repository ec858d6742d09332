"""Cells of time whose width follows the data.

Rows of a key are shared out over cells of a fixed width.  Where one key holds
so many rows in such a cell that a task would be left with them, the cell is
divided at quantiles of its own times.  Which cells these are is found with a
histogram that is summed on the map side: rows are counted by a hash of key and
cell first, and only buckets above the limit are counted by the cell itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the histogram.
BUCKETS = 1 << 16
#: Rows that a cell may hold, at least.
CELL_ROWS = 200_000
#: Parts that one cell is divided into, at most.
PARTS = 1024
#: The cell of rows without a time, before all others.
NO_CELL = -(2**62)

CUTS = "_cuts"
_ORIGIN = "timestamp_ntz '1970-01-01 00:00:00'"


def micros(time: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_ORIGIN), time)


def even_cell(time: Column, width: int | None) -> Column:
    """Start of the cell of ``width`` microseconds that holds ``time``; without
    a width one cell holds all time."""
    if width is None:
        return F.lit(NO_CELL)
    at = micros(time)
    return F.coalesce(at - F.pmod(at, F.lit(width)), F.lit(NO_CELL))


def dense_cells(
    rows: DataFrame, keys: Sequence[str], time: str, width: int | None, cell_rows: int | None = None
) -> DataFrame | None:
    """(``keys``, ``_start``, ``_cuts``): cells above the limit with the times,
    in microseconds and ascending, at which they are divided; None if no cell is.

    The limit is ``cell_rows`` (:data:`CELL_ROWS` unless given), or twice the
    mean of a bucket where that is more, so there are never more than
    BUCKETS / 2 dense cells and BUCKETS cuts in all, whatever the rows: a frame
    that may be broadcast.  A cell whose
    rows share one time has no cut.
    """
    return counted_cells(rows, keys, time, width, cell_rows)[0]


def counted_cells(
    rows: DataFrame, keys: Sequence[str], time: str, width: int | None, cell_rows: int | None = None
) -> tuple[DataFrame | None, int]:
    """:func:`dense_cells` and the number of rows."""
    keys = list(keys)
    slot = F.pmod(F.xxhash64(*keys, "_start"), F.lit(BUCKETS)).cast("int")
    light = rows.select(*keys, F.col(time).alias("_t")).select(
        *keys, even_cell(F.col("_t"), width).alias("_start"), micros(F.col("_t")).alias("_m")
    ).withColumn("_slot", slot)
    histogram = light.groupBy("_slot").agg(F.count("*").alias("_n"))
    total, most = histogram.agg(F.sum("_n"), F.max("_n")).first()
    total = total or 0
    limit = max(cell_rows or CELL_ROWS, 2 * total // BUCKETS)
    if (most or 0) <= limit:
        return None, total
    slots = histogram.where(F.col("_n") > limit).select("_slot")  # less than BUCKETS rows
    inside = light.join(F.broadcast(slots), "_slot", "left_semi")
    sizes = inside.groupBy(*keys, "_start").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    found = sizes.collect()  # at most BUCKETS / 2 rows
    if not found:
        return None, total
    sizes = F.broadcast(rows.sparkSession.createDataFrame(found, sizes.schema))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, "_start")]
    wanted = inside.alias("l").join(sizes.alias("s"), on).select("l.*", "s._n")
    quantiles = [i / PARTS for i in range(1, PARTS)]
    spread = wanted.groupBy(*keys, "_start", "_n").agg(F.percentile_approx("_m", quantiles).alias("_q"))
    # every step-th quantile, so that the parts hold about the limit
    step = F.greatest(F.lit(1), F.floor(F.lit(float(PARTS * limit)) / F.col("_n"))).cast("int")
    cuts = spread.withColumn("_step", step).select(
        *keys, "_start", F.expr(f"array_distinct(filter(coalesce(_q, array()), (q, i) -> (i + 1) % _step = 0 AND q > _start)) AS {CUTS}")
    )
    return rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema), total


def with_cell(rows: DataFrame, keys: Sequence[str], time: str, width: int | None, dense: DataFrame | None, name: str) -> DataFrame:
    """``rows`` with the start of their cell as ``name`` and, as ``_cuts``, the
    cuts of the dense cell they came from (NULL elsewhere)."""
    if dense is None:
        none = F.lit(None).cast("array<bigint>")
        return rows.withColumns({name: even_cell(F.col(time), width), CUTS: none})
    marked = _marked(rows.withColumn(name, even_cell(F.col(time), width)), keys, name, dense)
    # the last cut that is not after the time; cuts ascend
    at = F.expr(f"filter({CUTS}, c -> c <= _m)")
    inner = F.coalesce(F.try_element_at(at, F.lit(-1)), F.col(name))
    return marked.withColumn("_m", micros(F.col(time))).withColumn(name, inner).drop("_m")


def covered_cells(rows: DataFrame, keys: Sequence[str], low: str, high: str, width: int, dense: DataFrame | None, name: str) -> DataFrame:
    """``rows`` once per cell that their closed range [``low``, ``high``] meets,
    with the cell's start as ``name``."""
    first, last = even_cell(F.col(low), width), even_cell(F.col(high), width)
    known = F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) <= F.col(high))
    even = rows.withColumn(name, F.explode(F.when(known, F.sequence(first, last, F.lit(width)))))
    if dense is None:
        return even
    marked = _marked(even, keys, name, dense).withColumns({"_l": micros(F.col(low)), "_h": micros(F.col(high))})
    # a part begins at its start and ends before the next one's
    starts = f"concat(array({name}), coalesce({CUTS}, array()))"
    parts = F.expr(f"filter({starts}, (c, i) -> c <= _h AND coalesce(try_element_at({starts}, i + 2) > _l, true))")
    return marked.withColumn(name, F.explode(parts)).drop("_l", "_h", CUTS)


def _marked(rows: DataFrame, keys: Sequence[str], name: str, dense: DataFrame) -> DataFrame:
    """``rows`` with ``_cuts``; ``dense`` has at most BUCKETS / 2 rows."""
    right = dense.select(*[F.col(k).alias(f"_d_{k}") for k in keys], F.col("_start").alias("_d_start"), CUTS)
    on = [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys] + [F.col(name) == F.col("_d_start")]
    return rows.join(F.broadcast(right), on, "left").select(*rows.columns, CUTS)
