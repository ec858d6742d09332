"""Exact classification metrics from (score, label) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.operators.ordered import null_safe_join, running_totals


def _score_counts(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    positive = F.col(label) == 1
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(~positive, 1)).alias("neg")
    )


def class_totals(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    positive = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count(F.when(positive, 1)).alias("n_pos"), F.count(F.when(~positive, 1)).alias("n_neg")
    )


def roc_points(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, highest first, and the
    origin with a NULL threshold.  The rate of an absent class is NULL."""
    by = list(by)
    counts = _score_counts(df, score, label, by)
    above = running_totals(
        counts, [F.col("score").desc()], {"pos_above": F.col("pos"), "neg_above": F.col("neg")}, by
    )
    totals = class_totals(df, label, by)
    joined = _with_totals(above, totals, by)
    points = joined.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_above") + F.col("neg"), F.col("n_neg").cast("double")).alias("fpr"),
        F.try_divide(F.col("pos_above") + F.col("pos"), F.col("n_pos").cast("double")).alias("tpr"),
    )
    origin = totals.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def _with_totals(df: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return null_safe_join(df, totals, by, "inner")
    # a global total is one row
    single = F.broadcast(totals.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(single, "_one").drop("_one")


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with half credit for ties, per group of
    ``by``; NULL where a class is absent."""
    by = list(by)
    below = running_totals(
        _score_counts(df, score, label, by), [F.col("score").asc()], {"neg_below": F.col("neg")}, by
    )
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return below.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"))


def auc_of_labels(df: DataFrame, prediction: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC of hard labels: the mean of sensitivity and specificity."""
    hit = F.col(prediction) == F.col(label)
    positive = F.col(label) == 1

    def rate(rows: Column) -> Column:
        return F.avg(F.when(rows, hit.cast("double")))

    return df.groupBy(*by).agg(((rate(positive) + rate(~positive)) / 2).alias("auc"))


def accuracy(df: DataFrame, prediction: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(prediction) == F.col(label)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def score_summary(scores: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation, the band of one deviation, and the largest."""
    mean, std = F.avg(column), F.stddev_pop(column)
    return scores.agg(
        F.count(column).alias("n"),
        mean.alias("mean"),
        std.alias("std"),
        (mean - std).alias("low"),
        (mean + std).alias("high"),
        F.max(column).alias("best"),
    )
