"""Outcome models: L1 logistic regression and boosted trees."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.operators import boosting
from wardframe.session import shared_dir

FEATURES, LABEL, WEIGHT = "features", "label", "weight"


@dataclass(frozen=True)
class BoostParams:
    """Settings of a boosted classifier.  L1/L2 leaf penalties have no
    counterpart; column sampling is per node."""

    learning_rate: float = 0.1
    trees: int = 100
    depth: int = 3
    min_rows: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    min_gain: float = 0.0
    positive_weight: float = 1.0
    seed: int = 0


# The model configurations of the three studies, and of the
# repeated runs on site B.
SITE_A = BoostParams(0.1, 430, 3, 4, 0.9, 0.7, 0.0, 1.0, 27)
SITE_B = BoostParams(0.1, 140, 5, 3, 0.7, 0.8, 0.1)
SITE_B_REPEATED = BoostParams(0.1, 140, 7, 3, 0.8, 0.8, 0.0)
POOLED = BoostParams(0.005, 300, 4, 1, 0.8, 1.0, 0.0, 3.0, 0)
SWEEP = BoostParams(0.1, 450, 3, 5, 0.9, 0.7, 0.0, 1.0, 27)


def assemble(
    df: DataFrame, features: Sequence[str], label: str = LABEL, keep: Sequence[str] = (), positive_weight: float = 1.0
) -> DataFrame:
    """Feature vector, numeric label and row weight; features have to be
    complete."""
    numeric = df.select(
        *keep,
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col(label).cast("double").alias("_label"),
    )
    vectors = VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="error").transform(numeric)
    return vectors.select(
        *keep,
        FEATURES,
        F.col("_label").alias(LABEL),
        F.when(F.col("_label") == 1, positive_weight).otherwise(1.0).alias(WEIGHT),
    )


def l1_logistic(n_rows: int, c: float = 1.0, tol: float = 1e-6, max_iter: int = 500) -> LogisticRegression:
    """L1-penalised logistic regression with inverse strength ``c`` summed
    over rows, on unscaled features; the intercept is not penalised."""
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, elasticNetParam=1.0, regParam=1.0 / (c * n_rows),
        standardization=False, tol=tol, maxIter=max_iter,
    )


def boosted_trees(params: BoostParams, spark: SparkSession) -> GBTClassifier:
    # the learner cuts its lineage where the session has a checkpoint folder
    return GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT,
        stepSize=params.learning_rate, maxIter=params.trees, maxDepth=params.depth,
        minInstancesPerNode=params.min_rows, subsamplingRate=params.row_share,
        featureSubsetStrategy="all" if params.column_share >= 1 else str(params.column_share),
        minInfoGain=params.min_gain, seed=params.seed,
    )


def scored(model, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Label, hard prediction and linear score of every row."""
    return model.transform(rows).select(
        *keep, LABEL, "prediction", vector_to_array("rawPrediction")[1].alias("score")
    )


def odds_ratios(model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """exp(coefficient) per feature, in feature order."""
    rows = [(i, f, float(b)) for i, (f, b) in enumerate(zip(features, model.coefficients.toArray()))]
    return spark.createDataFrame(rows, "row_idx long, feature string, coefficient double").withColumn(
        "odds_ratio", F.exp("coefficient")
    )


def tree_nodes(model: GBTClassificationModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(tree, node, feature, cut, gain, cover, value): the nodes of a fitted
    model, read from its saved data; ``feature`` is null for leaves."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    model.write().save(path)
    # saved in the layout of the installed version of MLlib
    found = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    names = F.array(*[F.lit(f) for f in features])
    return found.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(inner, F.get(names, "split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("cut"), F.when(inner, F.col("gain")).alias("gain"),
        F.col("rawCount").cast("double").alias("cover"), F.when(~inner, F.col("prediction")).alias("value"),
    )


def split_counts(model: GBTClassificationModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Number of splits per feature over all trees, and the gain share."""
    counts = boosting.split_counts(tree_nodes(model, features, spark), features).drop("gain")
    shares = [(f, float(g)) for f, g in zip(features, model.featureImportances.toArray(), strict=True)]
    gain = spark.createDataFrame(shares, "feature string, gain double")
    return counts.join(F.broadcast(gain), "feature").orderBy("n_splits", "feature")


def odds_report(odds: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Odds ratio and the p-value of each site's descriptive table, joined by
    feature name and kept in feature order."""
    report = odds.select("row_idx", "feature", "odds_ratio")
    for site, table in tables.items():
        name = F.regexp_extract("features", r"^(.*) \((median \[IQR\]|n \(%\))\)$", 1)
        pvals = table.where(F.col("pval").isNotNull()).select(name.alias("feature"), F.col("pval").alias(f"pval_{site}"))
        report = report.join(F.broadcast(pvals), "feature", "left")
    return report.orderBy("row_idx").drop("row_idx")
