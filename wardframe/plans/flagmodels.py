"""Model queries on a few 0/1 columns, where SQL can follow the fit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardframe.operators import boosting, folds, metrics, models, tableone, validate
from wardframe.operators.fits import Fit
from wardframe.operators.models import LABEL
from wardframe.operators.penalised import L1Logistic
from wardframe.plans import standins as st
from wardframe.plans.queries import query, rounded
from wardframe.session import pin

FLAG = "loud"
FOLDS = 10
SEEDS = range(1, 100)
HOLDOUT = 0.2
TREES = models.BoostParams(learning_rate=0.1, trees=20, depth=1)


def _rows(spark, sf):
    table = st.model_table(spark, sf).withColumn(FLAG, F.coalesce((F.col("upper_share") > 0.1).cast("int"), F.lit(0)))
    return models.assemble(table, [FLAG], keep=("doc_id", "site"))


def _logistic(train):
    return models.l1_logistic(train.count(), tol=1e-9)


@query
def l1_flag_odds(spark, sf):
    rows = pin(_rows(spark, sf))
    model = _logistic(rows).fit(rows)
    odds = models.odds_ratios(model, [FLAG], spark).withColumn("intercept", F.lit(float(model.intercept)))
    return odds.select("feature", *[F.round(c, 3).alias(c) for c in ("intercept", "coefficient", "odds_ratio")])


@query
def l1_flag_cv_accuracy(spark, sf):
    rows = folds.contiguous_folds(_rows(spark, sf), [F.col("doc_id").asc()], FOLDS)
    scores = validate.cross_validate(rows, FOLDS, _logistic)
    return rounded(validate.accuracy_report(scores, ["fold"]), "mean", "two_std")


def _external(spark, sf):
    rows = pin(_rows(spark, sf))
    return (rows.where(F.col("site") == s) for s in "AB")


@query
def l1_flag_external(spark, sf):
    """Fit on site A, AUC on site B."""
    a, b = _external(spark, sf)
    return rounded(metrics.auc(validate.external_validation(a, b, _logistic), "score", LABEL), "auc")


@query
def l1_flag_repeated_external(spark, sf):
    """The 99 random fifths of site B."""
    a, b = _external(spark, sf)
    scores = validate.repeated_external(a, b, "doc_id", SEEDS, HOLDOUT, _logistic)
    return rounded(validate.auc_report(scores, ["seed"]), "mean", "std", "low", "high", "best")


@query
def holdout_sizes(spark, sf):
    """Rows and positives of the test part of every repeated holdout."""
    rows = pin(_rows(spark, sf).select("doc_id", LABEL))
    tagged = validate.holdout_rows(rows, "doc_id", SEEDS, 0.3)
    return tagged.groupBy("seed").agg(
        F.count("*").alias("n"), F.sum(F.col(LABEL).cast("long")).alias("positive")
    )


@query
def fold_sizes(spark, sf):
    """Rows and positives per fold of repeated shuffled validation."""
    rows = pin(_rows(spark, sf).select("doc_id", LABEL))
    found = validate.fold_columns(rows, "doc_id", (300, 301, 302), FOLDS)
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("seed"), f.cast("long").alias("fold")) for s, f in found.items()]))
    return rows.select(LABEL, each.alias("f")).groupBy("f.seed", "f.fold").agg(
        F.count("*").alias("n"), F.sum(F.col(LABEL).cast("long")).alias("positive")
    )


@query
def gbt_flag_scores(spark, sf):
    """Score of boosted trees for either value of the flag."""
    rows = pin(_rows(spark, sf))
    model = models.boosted_trees(TREES, spark).fit(rows)
    both = models.scored(model, rows, ["features"]).select("features", "score").distinct()
    flag = models.vector_to_array("features")[0]
    return both.select(flag.cast("int").alias(FLAG), F.round("score", 5).alias("score"))


@query
def gbt_flag_splits(spark, sf):
    rows = pin(_rows(spark, sf))
    model = models.boosted_trees(TREES, spark).fit(rows)
    return models.split_counts(model, [FLAG], spark)


@query
def gbt_flag_external(spark, sf):
    """Boosted trees fitted on site A, AUC of the scores on site B."""
    a, b = _external(spark, sf)
    estimator = lambda train: models.boosted_trees(TREES, train.sparkSession)
    return rounded(metrics.auc(validate.external_validation(a, b, estimator), "score", LABEL), "auc")


# --- second-order trees and the penalised intercept ------------------------------------

FLAG_BOOST = boosting.Boost(learning_rate=0.1, trees=20, depth=1, min_child_weight=4, reg_alpha=0.01)
POOLED_FLAG = boosting.Boost(learning_rate=0.1, trees=20, depth=1, min_child_weight=1, positive_weight=3.0)
#: One of them has missing values, so a split has to choose a side for them.
FLAGS = ["filled", "taxed", "many"]
TWO_LEVELS = boosting.Boost(learning_rate=0.3, trees=1, depth=2, min_child_weight=1, gamma=0.0)
PRUNED = boosting.Boost(learning_rate=0.3, trees=1, depth=2, min_child_weight=1, gamma=1.0, reg_alpha=0.01)


def _flagged(spark, sf):
    """Labelled documents with one complete flag."""
    table = st.model_table(spark, sf).withColumn(FLAG, F.coalesce((F.col("upper_share") > 0.1).cast("int"), F.lit(0)))
    return pin(table.select("doc_id", "site", "label", FLAG))


def _three_flags(spark, sf):
    """Line items: were they returned?"""
    return pin(st.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_linestatus") == "F").cast("int").alias("filled"),
        F.when(F.col("l_discount") > 0, (F.col("l_tax") > 0.04).cast("int")).alias("taxed"),
        (F.col("l_quantity") > 25).cast("int").alias("many"),
    ))


@query
def boost_flag_holdout(spark, sf):
    """The 99 random holdouts, grown together: AUC of the hard labels."""
    rows = _flagged(spark, sf)
    fold, fits = validate.repeated_holdouts(rows, "doc_id", SEEDS, 0.3)
    scores = boosting.boosted(rows, [FLAG], "doc_id", "label", fits, FLAG_BOOST, fold).scores()
    return rounded(validate.auc_report(scores, ["seed"], hard=True), "mean", "std", "low", "high", "best")


@query
def boost_flag_repeated_cv(spark, sf):
    """Ten shuffled folds under each of 100 seeds: the mean of the fold means."""
    rows = _flagged(spark, sf)
    fold, fits = validate.repeated_folds(rows, "doc_id", range(100, 200), FOLDS)
    scores = boosting.boosted(rows, [FLAG], "doc_id", "label", fits, FLAG_BOOST, fold).scores()
    return rounded(validate.repeated_report(scores, hard=False), "mean", "std", "low", "high", "best")


@query
def boost_flag_sweep(spark, sf):
    """Ten shuffled folds under each of 200 seeds, all 2 000 fits together."""
    rows = _flagged(spark, sf)
    fold, fits = validate.repeated_folds(rows, "doc_id", range(300, 500), FOLDS)
    scores = boosting.boosted(rows, [FLAG], "doc_id", "label", fits, FLAG_BOOST, fold).scores()
    return rounded(validate.sweep_report(scores, hard=False), "mean", "std", "lower")


@query
def pooled_flag_cv(spark, sf):
    """Contiguous folds over both sites, positives with weight 3."""
    rows = pin(folds.contiguous_folds(_flagged(spark, sf), [F.col("doc_id").asc()], FOLDS))
    fits = [Fit(f, tags={"fold": f}) for f in range(FOLDS)]
    scores = boosting.boosted(rows, [FLAG], "doc_id", "label", fits, POOLED_FLAG, F.array("fold")).scores()
    per_fold = metrics.auc(scores, "score", LABEL, ["fold"]).join(
        scores.groupBy("fold").agg(F.avg("score").alias("score")), "fold")
    return rounded(per_fold, "auc", "score")


def _tree_nodes(spark, sf, params):
    model = boosting.boosted(_three_flags(spark, sf), FLAGS, "line_id", "label", [Fit()], params)
    return rounded(model.nodes().drop("tree", "cut"), "gain", "cover", "value")


@query
def boost_two_level_nodes(spark, sf):
    """The node table of a tree of two levels, with the side of missing values."""
    return _tree_nodes(spark, sf, TWO_LEVELS)


@query
def boost_pruned_nodes(spark, sf):
    """The same under leaf penalties, with splits of small gain pruned."""
    return _tree_nodes(spark, sf, PRUNED)


@query
def boost_two_level_importance(spark, sf):
    """Splits and share of gain per feature, least used first."""
    model = boosting.boosted(_three_flags(spark, sf), FLAGS, "line_id", "label", [Fit()], TWO_LEVELS)
    counts = boosting.split_counts(model.nodes(), FLAGS)
    place = F.row_number().over(Window.orderBy("n_splits", "feature"))
    return rounded(counts.withColumn("place", place), "gain")


@query
def boost_two_level_scores(spark, sf):
    rows = _three_flags(spark, sf).withColumn("row", F.to_json(F.struct(*FLAGS)))
    scores = boosting.boosted(rows, FLAGS, "row", "label", [Fit(score_all=True)], TWO_LEVELS).scores()
    flags = F.from_json("key", ", ".join(f"{f} int" for f in FLAGS))
    return rounded(scores.select(flags.alias("f"), "score").select("f.*", "score"), "score").distinct()


@query
def l1_bias_flag_odds(spark, sf):
    """L1 logistic regression whose intercept is penalised like the rest."""
    model = L1Logistic(_flagged(spark, sf), [FLAG], "doc_id", "label", [Fit()])
    return rounded(model.odds().drop("row_idx"), "intercept", "coefficient", "odds_ratio")


@query
def l1_bias_flag_folds(spark, sf):
    """The coefficients of all folds, fitted in the same passes."""
    rows = pin(folds.contiguous_folds(_flagged(spark, sf), [F.col("doc_id").asc()], FOLDS))
    model = L1Logistic(rows, [FLAG], "doc_id", "label", [Fit(f, tags={"fold": f}) for f in range(FOLDS)], F.array("fold"))
    accuracy = metrics.accuracy(model.scores(), "prediction", LABEL, ["fold"])
    return rounded(model.odds().select("fold", "intercept", "coefficient").join(accuracy, "fold"), "intercept", "coefficient", "accuracy")


@query
def odds_pvalue_flag(spark, sf):
    """The odds ratio beside the p-values of both sites' descriptive tables."""
    rows = _flagged(spark, sf)
    odds = L1Logistic(rows, [FLAG], "doc_id", "label", [Fit()]).odds()
    tables = {s.lower(): tableone.table_one(rows.where(F.col("site") == s), [FLAG], [FLAG], "label") for s in "AB"}
    return rounded(models.odds_report(odds, tables), "odds_ratio", "pval_a", "pval_b")
