"""Profile checks of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.functions.codemap import flag


def _by_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One aggregate pass, then one row per column."""
    exprs = [m(F.col(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, m in measures.items()]
    rows = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{i}").alias(n) for n in measures])
        for i, c in enumerate(columns)
    ]
    return df.agg(*exprs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _by_column(df, columns, {"non_null": F.count})


def distinct_with_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column, NULL counting as one."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    return values.groupBy("feature").agg(F.count("*").alias("n_distinct"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n_rows"))


def missing_pct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column and their share of the rows, for columns that
    miss any."""
    table = _by_column(
        df,
        columns,
        {
            "missing": lambda c: F.sum(flag(c.isNull())).cast("long"),
            "missing_pct": lambda c: F.sum(flag(c.isNull())).cast("double") * 100.0 / F.count("*"),
        },
    )
    return table.where(F.col("missing") > 0)
