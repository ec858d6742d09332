"""Exact cross-validation folds and holdout splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.operators.ordered import numbered_rows


def shuffle_key(key: str, seed: int) -> list[Column]:
    """Sort order that shuffles rows by a digest of their key and a seed."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))).asc(), F.col(key).asc()]


def fold_of(index: Column, n: int, k: int) -> Column:
    """Contiguous blocks; the first ``n mod k`` hold one row more."""
    size, extra = divmod(n, k)
    edge = extra * (size + 1)
    tail = F.floor((index - edge) / max(size, 1)) + extra
    return F.when(index < edge, F.floor(index / (size + 1))).otherwise(tail).cast("long")


def contiguous_folds(df: DataFrame, order: Sequence[Column], k: int, name: str = "fold") -> DataFrame:
    """Folds as blocks of the given unique row order."""
    indexed, n = numbered_rows(df, order, "_idx")
    return indexed.withColumn(name, fold_of(F.col("_idx"), n, k)).drop("_idx")


def shuffled_folds(df: DataFrame, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    return contiguous_folds(df, shuffle_key(key, seed), k, name)


def shuffled_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A seeded global order of the rows."""
    return df.orderBy(*shuffle_key(key, seed))


def exact_holdout(df: DataFrame, key: str, share: float, seed: int, name: str = "is_test") -> DataFrame:
    """Exactly ceil(share * n) rows marked 1, chosen by the shuffled order."""
    indexed, n = numbered_rows(df, shuffle_key(key, seed), "_idx")
    n_test = math.ceil(share * n)
    return indexed.withColumn(name, F.when(F.col("_idx") < n_test, 1).otherwise(0)).drop("_idx")
