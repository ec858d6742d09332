"""Metrics, descriptive tables, preparation and sources."""

import math
import random
import statistics

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wardframe.functions.codes import UNITS_TO_SI
from wardframe.functions.pvalues import chi2_tail, fisher_two_sided
from wardframe.operators import metrics, models, prep, tableone, validate
from wardframe.operators.profile import missing_pct
from wardframe.sources.csv import number, read_csv, read_named_csv, reindex, write_csv
from wardframe.sources.registry import materialize, read_tables


def test_auc_halves_ties(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert metrics.auc(df, "score", "label").first().auc == pytest.approx(0.875)


def test_auc_equals_the_evaluator_and_the_trapezoid(spark):
    df = spark.range(500).select(
        ((F.col("id") * 37) % 100 / 10.0).alias("score"), ((F.col("id") * 53) % 97 > 40).cast("int").alias("label")
    )
    area = metrics.auc(df, "score", "label").first().auc
    vector = VectorAssembler(inputCols=["score"], outputCol="v")
    raw = vector.transform(df)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert area == pytest.approx(evaluator.evaluate(raw))
    points = sorted((r.fpr, r.tpr) for r in metrics.roc_points(df, "score", "label").collect())
    trapezoid = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(points, points[1:]))
    assert area == pytest.approx(trapezoid)


def test_auc_of_hard_labels(spark):
    rows = [(1, 1)] * 8 + [(0, 1)] * 2 + [(0, 0)] * 6 + [(1, 0)] * 4
    df = spark.createDataFrame(rows, "prediction int, label int")
    assert metrics.auc_of_labels(df, "prediction", "label").first().auc == pytest.approx(0.7)
    assert metrics.auc(df, "prediction", "label").first().auc == pytest.approx(0.7)


def test_tail_probabilities():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert chi2_tail(None, 1) is None
    # the tea-tasting table
    assert fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70)


def kruskal_by_hand(groups):
    pooled = sorted(v for g in groups for v in g)
    n = len(pooled)
    rank = {v: pooled.index(v) + (pooled.count(v) + 1) / 2 for v in set(pooled)}
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in g) ** 2 / len(g) for g in groups) - 3 * (n + 1)
    ties = sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))
    return h / (1 - ties / (n**3 - n))


def test_table_one(spark):
    a, b = [1.0, 2.0, 4.0, 9.0], [3.0, 4.0, 8.0, 9.0, 9.0]
    rows = [(0, x, "M") for x in a] + [(1, x, "F" if i < 3 else "M") for i, x in enumerate(b)] + [(1, None, None)]
    df = spark.createDataFrame(rows, "mort int, x double, gender string")
    report = {(r.features, r.level): r for r in tableone.table_one(df, ["gender", "x"], ["gender"], "mort").collect()}
    assert report["n", ""].group_0 == "4" and report["n", ""].group_1 == "6"
    head = report["x (median [IQR])", ""]
    assert (head.group_0, head.group_1) == ("3.00 [1.75,5.25]", "8.00 [4.00,9.00]")
    assert (head.missing, head.test) == (1, "Kruskal-Wallis")
    assert head.pval == pytest.approx(math.erfc(math.sqrt(kruskal_by_hand([a, b]) / 2)))
    gender = report["gender (n (%))", ""]
    assert (gender.missing, gender.test) == (1, "Fisher's exact")
    assert gender.pval == pytest.approx(fisher_two_sided(0, 3, 4, 2))
    assert report["gender (n (%))", "F"].group_1 == "3 (60.00)"
    assert report["gender (n (%))", "M"].group_0 == "4 (100.00)"
    assert [k[0].split()[0] for k in report] == ["n", "x", "gender", "gender", "gender"]
    assert [r.row_idx for r in report.values()] == [0, 1, 2, 3, 4]
    picked = tableone.pick_rows(tableone.table_one(df, ["x"], [], "mort"), ["x (median [IQR])"])
    assert [r.row_idx for r in picked.collect()] == [1]


def test_many_outcomes_stay_rows(spark):
    """Outcomes are rows of the tests, however many; only a report has them as columns."""
    r = random.Random(21)
    rows = [(r.choice("stuvwxyz"), r.choice(["m", "n", "o"]), float(r.randrange(12)) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, c string, x double")
    groups = {}
    for g, _, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    got = tableone.kruskal_wallis(df, ["x"], "g").first()
    assert got.df == len(groups) - 1 and got.statistic == pytest.approx(kruskal_by_hand(list(groups.values())))
    cells, lines, columns = {}, {}, {}
    for g, c, _ in rows:
        cells[g, c] = cells.get((g, c), 0) + 1
        lines[c] = lines.get(c, 0) + 1
        columns[g] = columns.get(g, 0) + 1
    expected = {(g, c): columns[g] * lines[c] / len(rows) for g in columns for c in lines}
    chi = tableone.chi_squared(tableone.level_counts(df, ["c"], "g"), "g").first()
    assert chi.statistic == pytest.approx(sum((cells.get(k, 0) - e) ** 2 / e for k, e in expected.items()))
    assert chi.df == (len(columns) - 1) * (len(lines) - 1) and chi.min_expected == pytest.approx(min(expected.values()))
    middle = {q.g: q.median for q in tableone.continuous_quartiles(df, ["x"], "g").collect()}
    assert middle == {g: statistics.median(xs) for g, xs in groups.items()}
    spark.conf.set(tableone.MAX_GROUPS, 5)
    try:
        with pytest.raises(ValueError):
            tableone.table_one(df, ["x"], [], "g")
    finally:
        spark.conf.unset(tableone.MAX_GROUPS)


def test_chi_squared_correction(spark):
    rows = [("v", level, g, n) for level, g, n in (("a", 0, 30), ("a", 1, 10), ("b", 0, 20), ("b", 1, 40))]
    counts = spark.createDataFrame(rows, "variable string, level string, g int, n long")
    plain = tableone.chi_squared(counts, "g", [0, 1], correct=False).first()
    corrected = tableone.chi_squared(counts, "g", [0, 1]).first()
    assert plain.statistic == pytest.approx(100 * (30 * 40 - 10 * 20) ** 2 / (40 * 60 * 50 * 50))
    assert corrected.statistic == pytest.approx(100 * (30 * 40 - 10 * 20 - 50) ** 2 / (40 * 60 * 50 * 50))


def test_preparation(spark):
    rows = [("M", 98.6, 1.0, "leukemia", None), ("Female", 212.0, None, None, 1), ("x", None, 3.0, "myeloma", 1)]
    df = spark.createDataFrame(rows, "gender string, temperature double, urea double, d_type string, rbc int")
    df = prep.convert_units(df, {k: UNITS_TO_SI[k] for k in ("temperature",)})
    df = prep.recode(prep.fill_zero(prep.one_hot(df, "d_type", {"leukemia": "leukemia"}), ["rbc"]), "gender", prep.GENDER_CODES)
    df = prep.fill_median(df, ["temperature", "urea"])
    got = df.collect()
    assert [r.gender for r in got] == [1, 0, None]
    assert [round(r.temperature, 6) for r in got] == [37.0, 100.0, 68.5]
    assert [r.urea for r in got] == [1.0, 2.0, 3.0]
    assert [(r.leukemia, r.rbc) for r in got] == [(1, 0), (0, 1), (0, 1)]


def test_missing_share(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 4), (5, 6)], "a int, b int")
    assert [tuple(r) for r in missing_pct(df, ["a", "b"]).collect()] == [("b", 2, 50.0)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.5), ("a", None)], "name string, v double")
    path = str(tmp_path / "report")
    write_csv(df, path, [F.col("name").asc()])
    back = read_csv(spark, path, "name string, v double").orderBy("row_idx").collect()
    assert [tuple(r) for r in back] == [(0, "a", None), (1, "b", 2.5)]
    named = read_named_csv(spark, path, ["i", "Features", "pval"]).withColumn("x", number("pval"))
    assert sorted((r.Features, r.x) for r in named.collect()) == [("a", None), ("b", 2.5)]


def test_reindex(spark):
    df = spark.range(1).withColumn("x", F.lit(1.0))
    assert reindex(df, ["x", "y"]).collect()[0].asDict() == {"x": 1.0, "y": None}
    with pytest.raises(ValueError):
        reindex(df, ["y"], strict=True)


def test_tables_and_views(spark, tmp_path):
    path = str(tmp_path / "sofa")
    df = spark.createDataFrame([(1, 2, 3, 4)], "subject_id long, hadm_id long, icustay_id long, sofa int")
    materialize(df, "sofa_view", path)
    materialize(df, "sofa_view", path)
    assert spark.table("sofa_view").count() == 1
    assert read_tables(spark, {"sofa": path})["sofa"].first().sofa == 4


@pytest.fixture(scope="module")
def planted(spark):
    """A planted signal: the outcome follows x, z is noise."""
    df = spark.range(400).select(
        "id",
        ((F.col("id") * 31) % 100 / 100.0).alias("x"),
        ((F.col("id") * 17) % 53 / 53.0).alias("z"),
        F.when((F.col("id") * 31) % 100 + (F.col("id") * 7) % 30 > 65, 1).otherwise(0).alias("label"),
    )
    return models.assemble(df, ["x", "z"], keep=["id"], positive_weight=3.0)


def logistic(train):
    return models.l1_logistic(train.count(), max_iter=50)


QUICK = models.BoostParams(trees=3, depth=2)


def boosted(train):
    return models.boosted_trees(QUICK, train.sparkSession)


def test_logistic_validation(spark, planted):
    model = logistic(planted).fit(planted)
    odds = {r.feature: r.odds_ratio for r in models.odds_ratios(model, ["x", "z"], spark).collect()}
    assert odds["x"] > 5 and abs(math.log(odds["z"])) < 2
    scores = validate.external_validation(planted.where("id % 2 = 0"), planted.where("id % 2 = 1"), logistic, ["id"])
    assert metrics.auc(scores, "score", "label").first().auc > 0.9
    report = validate.auc_report(
        validate.repeated_external(planted.where("id % 2 = 0"), planted.where("id % 2 = 1"), "id", [1, 2, 3], 0.2, logistic),
        ["seed"],
    ).first()
    assert report.n == 3 and report["mean"] > 0.8


def test_boosted_validation(spark, planted):
    model = boosted(planted).fit(planted)
    splits = {r.feature: r.n_splits for r in models.split_counts(model, ["x", "z"], spark).collect()}
    assert splits["x"] > 0
    scores = validate.repeated_holdout(planted, "id", [1, 2], 0.3, boosted)
    assert scores.groupBy("seed").count().collect() and all(r["count"] == 120 for r in scores.groupBy("seed").count().collect())
    sweep = validate.repeated_cross_validation(planted, "id", [5], 3, boosted)
    assert sweep.count() == 400
    best = validate.sweep_report(sweep).first()
    assert best.seed == 5 and 0.8 < best["mean"] <= 1
    assert best.lower == pytest.approx(best["mean"] - best["std"])


def test_roc_of_a_group_with_one_class(spark):
    df = spark.createDataFrame([("x", 0.3, 1), ("x", 0.7, 1), ("y", 0.2, 0), ("y", 0.6, 1)], "g string, s double, l int")
    points = {(r.g, r.threshold): (r.fpr, r.tpr) for r in metrics.roc_points(df, "s", "l", ["g"]).collect()}
    assert points["x", 0.7] == (None, 0.5) and points["y", 0.2] == (1.0, 1.0)


@pytest.mark.parametrize(("name", "seeds", "fits", "trees", "depth"), [
    ("gbt_cv_auc", None, 10, 430, 3), ("pooled_cv", None, 10, 300, 4), ("repeated_holdout", range(1, 100), 99, 430, 3),
    ("repeated_cv", range(100, 200), 1000, 140, 5), ("seed_sweep", range(300, 500), 2000, 450, 3),
])
def test_registered_validations_run_the_studies_settings(spark, monkeypatch, name, seeds, fits, trees, depth):
    from wardframe.operators import boosting
    from wardframe.plans.queries import QUERIES

    class Seen(Exception):
        pass

    def stop(rows, features, key, label, fits, params, folds=None):
        raise Seen(fits, params)

    monkeypatch.setattr(boosting, "boosted", stop)
    with pytest.raises(Seen) as seen:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    asked, params = seen.value.args
    assert (len(asked), params.trees, params.depth) == (fits, trees, depth)
    assert seeds is None or {f.tags["seed"] for f in asked} == set(seeds)
    assert len({(f.slot, f.held) for f in asked}) == fits
