"""Cross-validated, repeated and cross-site validation.

Repeats and folds become one array column and a list of fits
(:func:`repeated_folds`, :func:`repeated_holdouts`), which
:mod:`boosting` and :mod:`penalised` run side by side.  Estimators of MLlib are
fitted one by one from a bounded pool of driver threads.  Either way the scores
of all folds and repeats are measured in one job, grouped by fold or repeat.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardframe.operators import metrics
from wardframe.operators.fits import Fit
from wardframe.operators.models import LABEL, scored
from wardframe.session import pin, shared_dir

Estimator = Callable[[DataFrame], object]
PARALLEL_FITS = 4


def _fit_all(jobs: Sequence[tuple[dict, DataFrame, DataFrame]], estimator: Estimator, parallel: int) -> DataFrame:
    """Fit on each training frame and write the scores of its test frame; the
    result is one scan of all scores, whatever the number of fits."""
    spark = jobs[0][1].sparkSession
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def run(numbered) -> tuple[str, StructType]:
        i, (tags, train, test) = numbered
        out = scored(estimator(train).fit(train), test)
        out = out.select(*[F.lit(v).alias(k) for k, v in tags.items()], *out.columns)
        out.write.parquet(f"{base}/{i}")
        return f"{base}/{i}", out.schema

    with ThreadPool(min(parallel, len(jobs))) as pool:
        written = pool.map(inheritable_thread_target(spark)(run), list(enumerate(jobs)))
    return spark.read.schema(written[0][1]).parquet(*[path for path, _ in written])


def cross_validate(
    rows: DataFrame, k: int, estimator: Estimator, fold: str = "fold", parallel: int = PARALLEL_FITS
) -> DataFrame:
    """Scores of every row from the model that did not see its fold."""
    rows = pin(rows)
    jobs = [
        ({fold: f}, rows.where(F.col(fold) != f).drop(fold), rows.where(F.col(fold) == f).drop(fold))
        for f in range(k)
    ]
    return _fit_all(jobs, estimator, parallel)


def _digest(key: str, seed: Column) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), seed.cast("string")))


#: Rows of one seed and digest prefix that are sorted together, about.
PREFIX_ROWS = 100_000


def seed_cuts(
    rows: DataFrame, key: str, seeds: Sequence[int], positions: Sequence[int], n: int
) -> dict[int, list[tuple]]:
    """Per seed, the (digest, key) at each position of that seed's shuffled
    order of the ``n`` rows.

    Rows are counted per seed and digest prefix, which combines on the map
    side, and only the prefixes that hold a position are sorted; nothing is
    written.  With the cuts at hand a row's side of a split is a plain
    predicate.
    """
    digits = max(2, math.ceil(math.log(max(1, n / PREFIX_ROWS), 16)))
    tagged = rows.select(key, F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("seed"))
    tagged = tagged.withColumn("_digest", _digest(key, F.col("seed")))
    tagged = tagged.withColumn("_prefix", F.substring("_digest", 1, digits))
    per_prefix = tagged.groupBy("seed", "_prefix").agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy("seed").orderBy("_prefix"))
    at = F.explode(F.array(*[F.lit(p).cast("long") for p in positions]))
    held = per_prefix.select("seed", "_prefix", "_n", up_to.alias("_end")).select("*", at.alias("_at"))
    # a row per seed and position
    held = F.broadcast(held.where("_at < _end AND _at >= _end - _n").selectExpr("seed", "_prefix", "_at", "_at - (_end - _n) AS _row"))
    inside = F.row_number().over(Window.partitionBy("seed", "_prefix").orderBy("_digest", key)) - 1
    wanted = tagged.join(held.select("seed", "_prefix").distinct(), ["seed", "_prefix"], "left_semi")
    found = wanted.withColumn("_i", inside).join(held, ["seed", "_prefix"]).where("_i = _row")
    cuts: dict[int, list[tuple]] = {s: [] for s in seeds}
    for r in found.orderBy("seed", "_at").collect():
        cuts[r["seed"]].append((r["_digest"], r[key]))
    return cuts


def _before(key: str, seed: int, cut: tuple) -> Column:
    digest = _digest(key, F.lit(seed).cast("long"))
    return (digest < cut[0]) | ((digest == cut[0]) & (F.col(key) < cut[1]))


def holdout_filters(rows: DataFrame, key: str, seeds: Sequence[int], share: float) -> dict[int, Column]:
    """Per seed, a predicate that holds for exactly ceil(share * n) rows."""
    n = rows.count()
    cuts = seed_cuts(rows, key, seeds, [math.ceil(share * n)], n)
    return {s: _before(key, s, c[0]) if c else F.lit(True) for s, c in cuts.items()}


def holdout_rows(rows: DataFrame, key: str, seeds: Sequence[int], share: float) -> DataFrame:
    """The test rows of every seed's holdout, with a column ``seed``."""
    n = rows.count()
    cuts = seed_cuts(rows, key, seeds, [math.ceil(share * n)], n)
    # a literal per seed; without a cut all rows are test rows
    ends = [
        F.struct(F.lit(s).cast("long").alias("seed"), F.lit(c[0][0] if c else None).cast("string").alias("digest"),
                 F.lit(c[0][1] if c else None).cast(rows.schema[key].dataType).alias("key"))
        for s, c in cuts.items()
    ]
    tagged = rows.select("*", F.explode(F.array(*ends)).alias("_cut"))
    digest, cut = _digest(key, F.col("_cut.seed")), F.col("_cut.digest")
    before = cut.isNull() | (digest < cut) | ((digest == cut) & (F.col(key) < F.col("_cut.key")))
    return tagged.where(before).withColumn("seed", F.col("_cut.seed")).drop("_cut")


def fold_columns(rows: DataFrame, key: str, seeds: Sequence[int], k: int) -> dict[int, Column]:
    """Per seed, the fold of a row in shuffled k-fold validation."""
    n = rows.count()
    size, extra = divmod(n, k)
    starts = [f * size + min(f, extra) for f in range(1, k)]
    cuts = seed_cuts(rows, key, seeds, starts, n)
    return {
        s: sum((F.when(_before(key, s, c), 0).otherwise(1) for c in found), F.lit(0)) for s, found in cuts.items()
    }


def fold_array(key: str, kind: str, cuts: dict[int, list[tuple]]) -> Column:
    """Per seed of ``cuts``, in order, how many of its cuts a row has passed."""
    seeds = [{"seed": s, "cuts": [{"digest": d, "key": k} for d, k in found]} for s, found in cuts.items()]
    given = F.from_json(F.lit(json.dumps(seeds, default=str)), f"array<struct<seed:bigint,cuts:array<struct<digest:string,key:{kind}>>>>")
    hashed = F.transform(given, lambda s: F.struct(_digest(key, s["seed"]).alias("digest"), s["cuts"].alias("cuts")))
    own = F.col(key)
    return F.transform(hashed, lambda h: F.size(F.filter(
        h["cuts"], lambda c: (c["digest"] < h["digest"]) | ((c["digest"] == h["digest"]) & (c["key"] <= own)))))


def repeated_folds(rows: DataFrame, key: str, seeds: Sequence[int], k: int) -> tuple[Column, list[Fit]]:
    """The folds of every seed as one array column, and the fits that leave
    one of them out."""
    n = rows.count()
    size, extra = divmod(n, k)
    cuts = seed_cuts(rows, key, seeds, [f * size + min(f, extra) for f in range(1, k)], n)
    fits = [Fit(f, i, {"seed": s, "fold": f}) for i, s in enumerate(seeds) for f in range(min(k, n))]
    return fold_array(key, rows.schema[key].dataType.simpleString(), cuts), fits


def repeated_holdouts(rows: DataFrame, key: str, seeds: Sequence[int], share: float) -> tuple[Column, list[Fit]]:
    """Every seed's holdout of ceil(share * n) rows as fold 0 of its assignment,
    and the fits that leave it out."""
    n = rows.count()
    cuts = seed_cuts(rows, key, seeds, [math.ceil(share * n)], n)
    return fold_array(key, rows.schema[key].dataType.simpleString(), cuts), [Fit(0, i, {"seed": s}) for i, s in enumerate(seeds)]


def repeated_holdout(
    rows: DataFrame, key: str, seeds: Sequence[int], share: float, estimator: Estimator,
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Scores of the test rows of an exact random holdout per seed."""
    rows = pin(rows)
    tests = holdout_filters(rows, key, seeds, share)
    jobs = [({"seed": s}, rows.where(~test), rows.where(test)) for s, test in tests.items()]
    return _fit_all(jobs, estimator, parallel)


def repeated_cross_validation(
    rows: DataFrame, key: str, seeds: Sequence[int], k: int, estimator: Estimator,
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Scores of shuffled k-fold validation, one run per seed."""
    rows = pin(rows)
    jobs = [
        ({"seed": s, "fold": f}, rows.where(fold != f), rows.where(fold == f))
        for s, fold in fold_columns(rows, key, seeds, k).items()
        for f in range(k)
    ]
    return _fit_all(jobs, estimator, parallel)


def external_validation(train: DataFrame, test: DataFrame, estimator: Estimator, keep: Sequence[str] = ()) -> DataFrame:
    """Fit on one site, score the other."""
    return scored(estimator(train).fit(train), test, keep)


def repeated_external(
    train: DataFrame, test: DataFrame, key: str, seeds: Sequence[int], share: float, estimator: Estimator
) -> DataFrame:
    """Scores of a random share of the other site per seed.  The training
    rows are the same each time, so the model is fitted once."""
    scores = pin(external_validation(train, test, estimator, [key]))
    return holdout_rows(scores, key, seeds, share)


def auc_report(scores: DataFrame, by: Sequence[str], hard: bool = False) -> DataFrame:
    """Mean, deviation and band of the AUC over folds or repeats; ``hard``
    measures the hard labels instead of the scores."""
    per_group = (
        metrics.auc_of_labels(scores, "prediction", LABEL, by)
        if hard
        else metrics.auc(scores, "score", LABEL, by)
    )
    return metrics.score_summary(per_group, "auc")


def accuracy_report(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean accuracy and twice its deviation."""
    per_group = metrics.accuracy(scores, "prediction", LABEL, by)
    return per_group.agg(
        F.avg("accuracy").alias("mean"), (F.stddev_pop("accuracy") * 2).alias("two_std")
    )


def repeated_report(scores: DataFrame, hard: bool = True) -> DataFrame:
    """Mean and deviation over seeds of each seed's mean fold AUC."""
    measure = metrics.auc_of_labels if hard else metrics.auc
    per_fold = measure(scores, "prediction" if hard else "score", LABEL, ["seed", "fold"])
    per_seed = per_fold.groupBy("seed").agg(F.avg("auc").alias("auc"))
    return metrics.score_summary(per_seed, "auc")


def sweep_report(scores: DataFrame, hard: bool = True) -> DataFrame:
    """Per seed, mean minus deviation of the fold AUCs, best seed first."""
    measure = metrics.auc_of_labels if hard else metrics.auc
    per_fold = measure(scores, "prediction" if hard else "score", LABEL, ["seed", "fold"])
    return (
        per_fold.groupBy("seed")
        .agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"))
        .withColumn("lower", F.col("mean") - F.col("std"))
        .orderBy(F.col("lower").desc(), "seed")
    )

