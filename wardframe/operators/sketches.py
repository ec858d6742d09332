"""Mergeable sketches of columns: quantiles and distinct counts.

A sketch is a few kilobytes, whatever the rows, and two sketches merge to the
sketch of both row sets.  So sketches of days, sites or files can be kept and
merged later, and one pass serves all groups.  Exact quantiles and counts stay
in :mod:`ordered` and :mod:`profile`; these are for where a stated error will
do.  Quantiles come from KLL sketches, distinct counts from HyperLogLog.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch, and the share of rows by which a rank is then
#: off in 99 of 100 cases.
KLL_K, KLL_ERROR = 800, 0.004
#: Base-2 logarithm of the buckets of a distinct sketch, and two relative
#: standard errors of its count.
HLL_BITS, HLL_ERROR = 14, 0.0163


def column_sketches(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, variable, quantiles, distincts, n): the sketches of every column
    per group; missing and NaN values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(*keys, pairs.alias("p")).select(*keys, "p.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(*keys, "variable").agg(
        F.kll_sketch_agg_double("value", F.lit(KLL_K)).alias("quantiles"),
        F.hll_sketch_agg(F.col("value").cast("string"), HLL_BITS).alias("distincts"),
        F.count("*").alias("n"),
    )


def merged_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*keys, "variable").agg(
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distincts").alias("distincts"), F.sum("n").alias("n")
    )


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The sketches' columns and one column ``q0``, ``q1``, … per probability."""
    return sketches.withColumns({f"q{i}": F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))) for i, p in enumerate(probs)})


def sketched_distincts(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("distincts"))
