"""CSV reports and feature tables with an explicit row index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardframe.operators.ordered import row_index

INDEX = "row_idx"


def write_csv(df: DataFrame, path: str, order: Sequence[Column] | None = None) -> None:
    """Write with a leading ``row_idx``; ``order`` numbers the rows when the
    frame has no index yet."""
    if INDEX not in df.columns:
        df = row_index(df, order, INDEX)
    df.select(INDEX, *[c for c in df.columns if c != INDEX]).write.mode("overwrite").option(
        "header", True
    ).option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header and first column as index; ``schema`` lists the other columns."""
    columns = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([StructField(INDEX, LongType()), *columns.fields])
    return spark.read.schema(full).option("header", True).option("nullValue", "").csv(path)


def read_named_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Columns named by the caller, all as text; the file's header is not data."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def number(column: str) -> Column:
    """A dirty text cell as a number, NULL when it is not one."""
    return F.expr(f"try_cast(`{column}` as double)")


def reindex(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Column subset in the given order; a missing column is all NULL unless
    ``strict``."""
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns]
    )
