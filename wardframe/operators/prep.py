"""Preparation of the feature table for modelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.functions.codemap import flag
from wardframe.operators.ordered import column_medians

# The two vocabularies of the gender column.
GENDER_CODES = {"M": 1, "Male": 1, "F": 0, "Female": 0}


def convert_units(df: DataFrame, units: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Linear conversions, new = (old + offset) * scale, of the listed columns."""
    return df.withColumns({c: (F.col(c) + offset) * scale for c, (scale, offset) in units.items()})


def convert_units_by_site(
    df: DataFrame, units: Mapping[str, Mapping[str, tuple[float, float]]], site: str = "site"
) -> DataFrame:
    """A unit map per site: sites report some columns in different units."""
    changed = {}
    for name, per_column in units.items():
        for column, (scale, offset) in per_column.items():
            old = changed.get(column, F.col(column))
            new = (F.col(column) + offset) * scale
            changed[column] = F.when(F.col(site) == name, new).otherwise(old)
    return df.withColumns(changed)


def recode(df: DataFrame, column: str, codes: Mapping[str, int]) -> DataFrame:
    """Text values to integers; a value outside the map becomes NULL."""
    new = None
    for text, code in codes.items():
        hit = F.col(column) == text
        new = F.when(hit, code) if new is None else new.when(hit, code)
    return df.withColumn(column, new)


def one_hot(df: DataFrame, column: str, levels: Mapping[str, str]) -> DataFrame:
    """An indicator per level; a NULL category gives 0 everywhere."""
    return df.withColumns({name: flag(F.col(column) == level) for name, level in levels.items()})


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0, list(columns))


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs to the exact column median; a column without values stays NULL."""
    return df.na.fill(column_medians(df, columns))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def with_missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A 0/1 column ``<name>_missing`` per column, for learners that cannot
    take a missing value themselves."""
    return df.withColumns({f"{c}_missing": flag(F.col(c).isNull()) for c in columns})


def pool_sites(sites: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all sites by column name, with a ``site`` column."""
    frames = [df.withColumn("site", F.lit(name)) for name, df in sites.items()]
    pooled = frames[0]
    for frame in frames[1:]:
        pooled = pooled.unionByName(frame, allowMissingColumns=True)
    return pooled
