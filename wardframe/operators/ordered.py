"""Ordered computations that stay balanced whatever the key distribution.

A Spark window puts a whole partition-by group into one task.  The functions
here cut the sorted rows into range slices instead, work inside each slice and
carry one small summary row per slice across, so that neither a global order
nor one key holding a third of the rows ends up in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardframe.session import pin

SLICE = "_slice"


#: Rows of a slice, about.
SLICE_ROWS = 500_000


def _in_slices(df: DataFrame, order: Sequence[Column | str]) -> tuple[DataFrame, int]:
    """Written rows in as many range slices as their number asks for, whatever
    the session's number of shuffle partitions, and that number of rows."""
    rows = pin(df)
    n = rows.count()
    return rows.repartitionByRange(max(1, -(-n // SLICE_ROWS)), *order), n


def sliced(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` in range slices of ``order``, numbered in ``_slice``.

    The result is pinned: the range bounds come from a sample, and every later
    step has to see the same ones.
    """
    return pin(_in_slices(df, order)[0].withColumn(SLICE, F.spark_partition_id()))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the right keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    measures: Mapping[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """For every row, the sum of each measure over the rows of the same
    ``keys`` that sort before it, as column ``name``.

    ``order`` has to be unique within ``keys``; aggregate ties first.
    """
    keys = list(keys)
    return _running(sliced(df, [*keys, *order]), df.columns, order, measures, keys)


def _running(
    parts: DataFrame, columns: Sequence[str], order: Sequence[Column], measures: Mapping[str, Column], keys: list[str]
) -> DataFrame:
    group = [SLICE, *keys]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_in_{n}") for n, m in measures.items()]
    )
    # one row per slice and key it touches; a key spans at most all slices
    per_slice = parts.groupBy(*group).agg(*[F.sum(m).alias(f"_sum_{n}") for n, m in measures.items()])
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_slice.select(
        *group,
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in measures],
    )
    joined = null_safe_join(local, offsets, group, "inner")
    return joined.select(
        *columns, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in measures]
    )


def numbered_rows(df: DataFrame, order: Sequence[Column], name: str) -> tuple[DataFrame, int]:
    """:func:`row_index` and the number of rows.

    A row's place is its place in its sorted slice and the sizes of the slices
    before, which are a small table; the rows are not shuffled again.
    """
    ranged, n = _in_slices(df, order)
    # the number of a row within its partition follows the sort
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = pin(ranged.sortWithinPartitions(*order).select("*", F.spark_partition_id().alias(SLICE), at.alias("_at")))
    sizes = parts.groupBy(SLICE).agg(F.count("*").alias("_n"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # one row per SLICE_ROWS rows
    offsets = F.broadcast(sizes.select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    return parts.join(offsets, SLICE).select(*df.columns, (F.col("_at") + F.col("_off")).alias(name)), n


def row_index(df: DataFrame, order: Sequence[Column], name: str = "row_idx") -> DataFrame:
    """Zero-based position of every row in the global order."""
    return numbered_rows(df, order, name)[0]


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    dense: bool = False,
    descending: bool = False,
) -> DataFrame:
    """RANK or DENSE_RANK of ``order`` within ``keys`` (NULLs last when
    ascending, first when descending).

    Ties collapse to one counted row first, and the rank is a running total
    over those, so a group of any size is shared out among tasks.
    """
    by = F.col(order).desc_nulls_first() if descending else F.col(order).asc_nulls_last()
    step = F.lit(1).cast("long") if dense else F.col("_n")
    distinct = df.groupBy(*keys, order).agg(F.count("*").alias("_n"))
    totals = running_totals(distinct, [by], {"_before": step}, keys)
    ranks = totals.select(*keys, order, (F.col("_before") + 1).alias(name))
    return null_safe_join(df, ranks, [*keys, order], "inner")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """ROW_NUMBER() = 1 per ``keys``: the row with the smallest ``order``, NULLs
    last.

    A min over structs combines on the map side, where a window would ship
    every row of a group to one task.
    """
    sort = [x for c in order for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))]
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*sort, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def quantile_rows(
    counts: DataFrame, keys: Sequence[str], value: str, n: str, before: str, probs: Sequence[float]
) -> DataFrame:
    """Linear-interpolated quantiles from running counts.

    ``counts`` has one row per (keys, value) with its multiplicity ``n`` and
    the number of smaller rows ``before``.  Returns ``keys`` and one column
    ``q0``, ``q1``, … per probability.
    """
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("_total"))
    # one row per variable and level named in the call, so safe to broadcast
    rows = null_safe_join(counts.where(F.col(n) > 0), F.broadcast(totals), keys, "inner")
    first, last = F.col(before), F.col(before) + F.col(n) - 1
    picked = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        picked.append(F.max(F.when((first <= low) & (low <= last), F.col(value))).alias(f"_lo{i}"))
        picked.append(F.max(F.when((first <= high) & (high <= last), F.col(value))).alias(f"_hi{i}"))
        picked.append(F.max(at - low).alias(f"_fr{i}"))
    ends = rows.groupBy(*keys).agg(*picked)
    return ends.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, variable, value) for numeric ``columns``; NULLs are dropped."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    long = df.select(*keep, pairs.alias("_p")).select(*keep, "_p.variable", "_p.value")
    return long.where(F.col("value").isNotNull())


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of every column: one row per variable.

    ``percentile`` would hold every distinct value of a column in one task.
    Here the values are counted and range-sliced, the slices holding a wanted
    position follow from the slice totals, and only those are sorted.
    """
    counts = long_values(df, columns).groupBy("variable", "value").agg(F.count("*").alias("n"))
    parts = sliced(counts, ["variable", "value"])
    group = ["variable", SLICE]
    per_slice = parts.groupBy(*group).agg(F.sum("n").alias("size"))
    by_slice = Window.partitionBy("variable").orderBy(SLICE)
    ends = per_slice.select(
        *group, "size",
        (F.sum("size").over(by_slice) - F.col("size")).alias("start"),
        F.sum("size").over(Window.partitionBy("variable")).alias("total"),
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    )
    at = ends.select("*", wanted.alias("w")).selectExpr("*", "w.i AS i", "w.p * (total - 1) AS pos")
    # at most two positions per variable and probability
    targets = at.select("*", F.explode(F.expr("array(floor(pos), ceil(pos))")).alias("k")).where(
        "k >= start AND k < start + size"
    ).select(*group, "i", "k", (F.col("k") - F.col("start")).alias("offset"), (F.col("pos") - F.floor("pos")).alias("share"))
    targets = F.broadcast(targets.distinct())
    inside = Window.partitionBy(*group).orderBy("value")
    running = (
        parts.join(F.broadcast(targets.select(*group).distinct()), group, "left_semi")
        .withColumn("last", F.sum("n").over(inside))
        .join(targets, group)
        .where("offset < last AND offset >= last - n")
    )
    picked = running.groupBy("variable", "i").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.max("share").alias("share")
    ).withColumn("q", F.expr("low + (high - low) * share"))
    return picked.groupBy("variable").agg(
        *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))]
    )


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column, one number per column on the driver."""
    rows = exact_quantiles(df, columns, [0.5]).collect()
    return {r["variable"]: r["q0"] for r in rows}
