"""Lock-step boosting and penalised logistic fits against plain versions."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardframe.operators import boosting, fits, validate
from wardframe.operators.boosting import Boost, boosted
from wardframe.operators.fits import Fit
from wardframe.operators.penalised import L1Logistic

COLUMNS = ["a", "b", "c"]


def made_rows(n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = float(rng.integers(6)), round(float(rng.normal()), 2), float(rng.integers(2))
        y = int(a + 2 * b - c + rng.normal() > 2)
        if rng.random() < 0.2:
            y, b = 1, None
        rows.append((i, a, b, None if rng.random() < 0.1 else c, y))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made_rows(), "id long, a double, b double, c double, y int").cache()


def fold():
    return F.array(F.pmod("id", F.lit(4)).cast("int"))


FOUR = [Fit(i, tags={"fold": i}) for i in range(4)]


def plain_scores(rows, train, p):
    """Exact greedy second-order trees, row by row."""

    def shrunk(g):
        return math.copysign(max(abs(g) - p.reg_alpha, 0), g)

    def score(g, h):
        return shrunk(g) ** 2 / (h + p.reg_lambda)

    values = [sorted({r[f] for r in rows if r[f] is not None}) for f in (1, 2, 3)]
    margin = [0.0] * len(rows)

    def build(own, depth, gh):
        g, h = (sum(gh[i][k] for i in own) for k in (0, 1))
        best = None
        if depth < p.depth:
            for f, ends in zip((1, 2, 3), values, strict=True):
                for left in (True, False):
                    for cut in ends:
                        low = [i for i in own if (rows[i][f] is None and left) or (rows[i][f] is not None and rows[i][f] <= cut)]
                        gl, hl = (sum(gh[i][k] for i in low) for k in (0, 1))
                        if hl < p.min_child_weight or h - hl < max(p.min_child_weight, 1e-9):
                            continue
                        gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, f, left, cut, low)
        if best is None or best[0] <= 1e-6:
            return ("leaf", -p.learning_rate * shrunk(g) / (h + p.reg_lambda))
        inside = set(best[4])
        low, high = build(best[4], depth + 1, gh), build([i for i in own if i not in inside], depth + 1, gh)
        if low[0] == high[0] == "leaf" and best[0] < p.gamma:
            return ("leaf", -p.learning_rate * shrunk(g) / (h + p.reg_lambda))
        return ("split", *best[1:4], low, high)

    def value(tree, row):
        while tree[0] == "split":
            _, f, left, cut, low, high = tree
            tree = low if (left if row[f] is None else row[f] <= cut) else high
        return tree[1]

    for _ in range(p.trees):
        gh = {}
        for i in train:
            chance = 1 / (1 + math.exp(-margin[i]))
            w = p.positive_weight if rows[i][4] else 1.0
            gh[i] = ((chance - rows[i][4]) * w, chance * (1 - chance) * w)
        tree = build(train, 0, gh)
        margin = [m + value(tree, row) for m, row in zip(margin, rows, strict=True)]
    return margin


@pytest.mark.parametrize("p", [
    Boost(0.3, 3, 2, 1.0), Boost(0.1, 2, 3, 2.0, reg_alpha=0.4, reg_lambda=0.5), Boost(0.3, 3, 3, 0.5, gamma=1.5, positive_weight=3.0),
])
@pytest.mark.parametrize("chunk", [8192, 25])
def test_trees_equal_exact_greedy_ones(table, monkeypatch, p, chunk):
    monkeypatch.setattr(fits, "CHUNK_ROWS", chunk)
    rows = made_rows()
    got = {(r.fold, r.key): r.score for r in boosted(table, COLUMNS, "id", "y", FOUR, p, fold()).scores().collect()}
    assert len(got) == len(rows)
    for held in range(4):
        want = plain_scores(rows, [i for i in range(len(rows)) if i % 4 != held], p)
        for i in range(held, len(rows), 4):
            assert got[held, i] == pytest.approx(want[i], abs=1e-9)


def test_fits_together_equal_fits_alone(table, monkeypatch):
    p = Boost(0.2, 12, 3, 1.0, 0.8, 0.7, 0.1, 1.0, 0.01, 1.0, 5)
    together = {(r.fold, r.key): r.score for r in boosted(table, COLUMNS, "id", "y", FOUR, p, fold()).scores().collect()}
    monkeypatch.setattr(fits, "CHUNK_ROWS", 16)
    monkeypatch.setattr(fits, "FAN_IN", 2)
    monkeypatch.setattr(boosting, "SETTLE_TREES", 5)
    alone = boosted(table, COLUMNS, "id", "y", [Fit(2, tags={"fold": 2})], p, fold())
    assert alone.n_chunks > 4
    for r in alone.scores().collect():
        assert together[2, r.key] == pytest.approx(r.score, abs=1e-9)
    nodes = alone.nodes().collect()
    assert {r.tree for r in nodes} == set(range(12)) and all((r.feature is None) == (r.cut is None) for r in nodes)
    # two columns of three are drawn for a tree
    assert all(len({r.feature for r in nodes if r.tree == t and r.feature}) <= 2 for t in range(12))


def test_a_task_holds_the_folds_of_its_own_fits_and_packed_margins(spark, monkeypatch):
    monkeypatch.setattr(fits, "CHUNK_ROWS", 500)
    monkeypatch.setattr(boosting, "GROUP_FITS", 20)
    rows = spark.range(2400).selectExpr("id", "cast(id % 2 as double) x", "cast(id % 3 = 0 as int) y")
    seeds = range(8)
    folds = F.array(*[F.pmod(F.col("id") + s, F.lit(10)).cast("int") for s in seeds])
    every = [Fit(f, s, {"seed": s, "fold": f}) for s in seeds for f in range(10)]
    p = Boost(0.3, 3, 1)
    model = boosted(rows, ["x"], "id", "y", every, p, folds)
    work = model.work.selectExpr("size(keys) n", "length(folds) folds", "length(bins) bins").collect()
    assert len(work) == model.n_chunks * 4 and all(r.folds == 2 * 2 * r.n and r.bins == r.n for r in work)
    state = model.states[-1].where("kind = 'margin'").selectExpr("size(keys) n", "length(data) size").collect()
    assert all(r.size < 8 * 20 * r.n / 4 for r in state)
    together = {(r.seed, r.fold, r.key): r.score for r in model.scores().collect()}
    assert len(together) == 8 * 2400
    # blocks of fits inside a task change nothing
    monkeypatch.setattr(boosting, "CELLS", 1)
    monkeypatch.setattr(boosting, "HELD_BYTES", 1)
    alone = boosted(rows, ["x"], "id", "y", every, p, folds).scores()
    assert {(r.seed, r.fold, r.key): pytest.approx(r.score, abs=1e-9) for r in alone.collect()} == together


def test_a_table_of_a_few_chunks_grows_without_a_job_per_level(table, monkeypatch):
    p = Boost(0.2, 12, 3, 1.0, 0.8, 0.7, 0.1, 1.0, 0.01, 1.0, 5)
    monkeypatch.setattr(fits, "CHUNK_ROWS", 40)

    def level(*_):
        raise AssertionError("a job per level")

    monkeypatch.setattr(boosting.Booster, "_level", level)
    whole = boosted(table, COLUMNS, "id", "y", FOUR, p, fold())
    assert whole.n_chunks == 1 and len(whole.states) == 1 and whole.scores().count() == 120
    monkeypatch.setattr(fits, "CHUNK_ROWS", 29)
    with pytest.raises(AssertionError, match="job per level"):
        boosted(table, COLUMNS, "id", "y", FOUR, p, fold())


def test_levels_read_stored_bin_numbers(table, monkeypatch):
    monkeypatch.setattr(fits, "CHUNK_ROWS", 16)
    p = Boost(0.2, 2, 3, 1.0)
    model = boosted(table, COLUMNS, "id", "y", FOUR, p, fold())
    # a byte per row and feature is all that a level reads of the features
    assert "x" not in model.work.columns and model.n_chunks > 4
    values = {r[0]: [math.nan if v is None else v for v in r[1:4]] for r in made_rows()}
    for r in model.work.collect():
        x = np.array([values[k] for k in r["keys"]])
        assert r.bins == boosting.binned(x, model.cuts).tobytes()
    # a level's splits reach the driver as plain numbers, a row per fit
    parts = model.work.withColumn("data", F.lit(None).cast("binary"))
    found = model._level(parts, parts.rdd.getNumPartitions(), [boosting.Trees(4, 3)], 0, 0)
    assert set(found) == set(boosting.SPLIT) and all(v.shape == (4, 1) for v in found.values())


@pytest.mark.parametrize("kept,sent", [(1 << 27, 1 << 24), (1 << 27, 0), (0, 1 << 24), (0, 0)])
def test_a_level_moves_margins_by_one_tree_and_adds_up_either_way(spark, table, monkeypatch, kept, sent):
    p = Boost(0.2, 7, 3, 1.0, 0.8, 0.7, 0.1, 1.0, 0.01, 1.0, 5)
    whole = {(r.fold, r.key): r.score for r in boosted(table, COLUMNS, "id", "y", FOUR, p, fold()).scores().collect()}
    monkeypatch.setattr(fits, "CHUNK_ROWS", 16)
    monkeypatch.setattr(boosting, "KEPT_TREES", 5)
    monkeypatch.setattr(boosting, "SETTLE_TREES", 3)
    monkeypatch.setattr(boosting, "KEPT_BYTES", kept)
    monkeypatch.setattr(boosting, "SENT_BYTES", sent)
    level, applied = boosting.Booster._level, []

    def seen(self, rows, parts, trees, tree, depth):
        applied.append(len(trees) - 1)
        return level(self, rows, parts, trees, tree, depth)

    monkeypatch.setattr(boosting.Booster, "_level", seen)
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    model = boosted(table, COLUMNS, "id", "y", FOUR, p, fold())
    assert model.n_chunks > 4 and len(applied) == 7 * 3
    # trees since the last written margins are applied again only where margins are not persisted
    assert max(applied) == (0 if kept else 2) and len(model.states) == (2 if kept else 3)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before
    assert {(r.fold, r.key): pytest.approx(r.score, abs=1e-9) for r in model.scores().collect()} == whole


def plain_trees(bins, y, tie, learns, widths, p):
    """Every level's sums made of all rows, and rows moved node by node."""
    margin, done = np.zeros(learns.shape), []

    class Rows:
        pass

    rows = Rows()
    rows.bins, rows.y, rows.tie = bins, y, tie
    for tree in range(p.trees):
        columns, now = boosting.drawn_columns(len(widths), p, tree), boosting.Trees(len(margin), p.depth)
        g, h = boosting.gradients(margin, rows, learns, p, tree)
        at = np.zeros(margin.shape, np.int64)
        for depth in range(p.depth):
            at = now.step(bins, at) if depth else at
            now.put(depth, boosting.best_splits(boosting.histograms(rows, at, depth, g, h, widths, columns), columns, p))
        now.finish(p)
        margin += now.margins(bins)
        done.append(now)
    return margin, done


@pytest.mark.parametrize("p", [
    Boost(0.3, 20, 3, 1.0, 0.9, 0.7, 0.0, 1.0, 0.01, 1.0, 27), Boost(0.1, 18, 5, 3.0, 0.7, 0.8, seed=2),
    Boost(0.5, 4, 4, 0.2, gamma=2.0, positive_weight=3.0), Boost(0.4, 3, 1), Boost(300.0, 5, 2, 0.5),
])
@pytest.mark.parametrize("tile,held", [(1 << 18, 1 << 26), (700, 1 << 26), (150, 1)])
def test_a_split_is_summed_by_its_smaller_child(monkeypatch, p, tile, held):
    monkeypatch.setattr(boosting, "TILE_CELLS", tile)
    monkeypatch.setattr(boosting, "HELD_BYTES", held)
    rng = np.random.default_rng(8)
    n, fits = 400, 6
    x = np.stack([rng.integers(0, 9, n), rng.normal(size=n), rng.random(n) < 0.1, np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)),
                  np.where(rng.random(n) < 0.1, np.nan, rng.exponential(size=n)), np.zeros(n)], axis=1).astype(float)
    x = np.concatenate([x, x[:60]])
    y = (np.nan_to_num(x[:, 1]) + x[:, 0] / 4 + 2 * x[:, 2] + rng.normal(size=len(x)) > 1.2).astype(float)
    cuts = [np.unique(v[~np.isnan(v)])[:-1][-250:] for v in x.T]
    bins, tie = boosting.binned(x, cuts), rng.integers(0, 2**62, len(x)).astype(np.uint64)
    widths, learns = [len(c) + 1 for c in cuts], rng.random((fits, len(x))) < 0.8
    want, trees = plain_trees(bins, y, tie, learns, widths, p)
    summed, count = [], np.bincount

    def counted(values, weights=None, minlength=0):
        summed.append(len(values) if weights is not None else 0)
        return count(values, weights, minlength)

    grower, got, margin = boosting.Grower(bins, y, tie, widths, p), [], np.zeros(learns.shape)
    monkeypatch.setattr(boosting.np, "bincount", counted)
    size = grower.block()
    for i in range(0, fits, size):
        got.append(grower.grow(margin[i : i + size], learns[i : i + size], range(p.trees)))
    monkeypatch.setattr(boosting.np, "bincount", count)
    assert np.allclose(margin, want, rtol=1e-9, atol=1e-9)
    for tree, own in enumerate(trees):
        now = boosting._joined([block[tree] for block in got])
        assert all(np.array_equal(getattr(now, k), getattr(own, k)) for k in ("feature", "cut", "left", "alive"))
        assert np.allclose(now.value, own.value, rtol=1e-9, atol=1e-9) and np.allclose(now.gain, own.gain, rtol=1e-9, atol=1e-9)
    # the root and less than the half of each level, of each drawn column, g and h
    most = len(x) * fits * p.trees * len(boosting.drawn_columns(len(widths), p, 0)) * 2
    assert sum(summed) < most * (1 + 0.6 * (p.depth - 1))


def test_trees_that_end_early_keep_their_rows():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, 2)).astype(float)
    y = (x[:, 0] + rng.random(300) > 0.8).astype(float)
    bins, tie = boosting.binned(x, [np.array([0.0])] * 2), rng.integers(0, 2**62, 300).astype(np.uint64)
    learns, p = rng.random((5, 300)) < 0.8, Boost(0.3, 12, 5, 1.0, 0.8, 0.5, 0.0, 1.0, 0.01, 1.0, 5)
    want, trees = plain_trees(bins, y, tie, learns, [2, 2], p)
    margin = np.zeros(learns.shape)
    got = boosting.Grower(bins, y, tie, [2, 2], p).grow(margin, learns, range(p.trees))
    # a tree of one column with two values has one split
    assert all((t.feature[:, 1:] < 0).all() for t in trees) and any((t.feature[:, 0] >= 0).all() for t in trees)
    assert np.allclose(margin, want, rtol=1e-9, atol=1e-9)
    assert all(np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value) for a, b in zip(got, trees, strict=True))


def sixteen(table):
    seeds = range(4)
    column, every = validate.repeated_folds(table, "id", seeds, 4)
    return column, every


def test_many_fits_over_several_chunks_take_no_job_per_level(table, monkeypatch):
    p = Boost(0.2, 12, 3, 1.0, 0.8, 0.7, 0.1, 1.0, 0.01, 1.0, 5)
    column, every = sixteen(table)
    monkeypatch.setattr(fits, "CHUNK_ROWS", 16)
    monkeypatch.setattr(boosting, "MANY_FITS", 5)
    stepped = boosting.Booster(table, COLUMNS, "id", "y", every, p, column)
    assert not stepped.whole and stepped.n_chunks > 4
    stepped.grow()
    monkeypatch.setattr(boosting, "MANY_FITS", 4)

    def level(*_):
        raise AssertionError("a job per level")

    monkeypatch.setattr(boosting.Booster, "_level", level)
    whole = boosted(table, COLUMNS, "id", "y", every, p, column)
    # margins stay with their chunks
    assert whole.n_chunks > 4 and len(whole.states) == 1
    assert whole.states[0].where("kind = 'margin'").count() == whole.n_chunks * len(whole.groups)
    want = {(r.seed, r.fold, r.key): r.score for r in stepped.scores().collect()}
    assert {(r.seed, r.fold, r.key): pytest.approx(r.score, abs=1e-9) for r in whole.scores().collect()} == want and len(want) == 4 * 120
    keys = ["seed", "fold", "tree", "node", "feature", "cut"]
    assert sorted(map(str, whole.nodes().select(keys).collect())) == sorted(map(str, stepped.nodes().select(keys).collect()))
    # more rows than a task may have go on in lock step
    monkeypatch.setattr(boosting, "WHOLE_ROWS", 119)
    with pytest.raises(AssertionError, match="job per level"):
        boosted(table, COLUMNS, "id", "y", every, p, column)


def test_holdouts_of_many_rows_are_shared_out_evenly_in_bounded_tasks(table, monkeypatch):
    p = Boost(0.2, 9, 3, 1.0, 0.8, 0.7, 0.1, 1.0, 0.01, 1.0, 5)
    column, every = validate.repeated_holdouts(table, "id", range(1, 20), 0.3)
    together = {(r.seed, r.key): r.score for r in boosted(table, COLUMNS, "id", "y", every, p, column).scores().collect()}
    assert len(together) == 19 * 36
    monkeypatch.setattr(fits, "CHUNK_ROWS", 16)
    monkeypatch.setattr(boosting, "TASK_CELLS", 4 * 120)
    monkeypatch.setattr(boosting, "BATCH_CELLS", 3 * 120 * 4)
    model = boosted(table, COLUMNS, "id", "y", every, p, column)
    # 19 fits on 4 cores: 5 turns of one fit each, where groups of four would take 8
    assert model.whole and [stop - start for start, stop in model.groups] == [1] * 19 and len(model.states) == 1
    assert {(r.seed, r.key): pytest.approx(r.score, abs=1e-9) for r in model.scores().collect()} == together
    monkeypatch.setattr(boosting, "BATCH_CELLS", 4 * 120)
    again = boosted(table, COLUMNS, "id", "y", every, p, column)
    assert len(again.states) == 3
    assert {(r.seed, r.key): pytest.approx(r.score, abs=1e-9) for r in again.scores().collect()} == together


def test_row_and_column_draws():
    p = Boost(row_share=0.7, column_share=0.5, seed=9)
    ties = np.random.default_rng(0).integers(0, 2**63, 20000).astype(np.uint64)
    one, two = boosting.drawn_rows(ties, p, 1), boosting.drawn_rows(ties, p, 2)
    assert abs(one.mean() - 0.7) < 0.02 and abs((one & two).mean() - 0.49) < 0.02
    assert [len(boosting.drawn_columns(7, p, t)) for t in range(3)] == [3, 3, 3]
    assert boosting.drawn_rows(ties, dataclasses.replace(p, row_share=1.0), 1).all()


def test_empty_and_one_class_tables(spark, table):
    p = Boost(trees=3)
    assert boosted(table.where("false"), COLUMNS, "id", "y", FOUR, p, fold()).scores().count() == 0
    one = boosted(table.where("y = 1"), COLUMNS, "id", "y", FOUR, p, fold()).scores().collect()
    assert len(one) == table.where("y = 1").count() and all(r.score > 0 for r in one)
    assert L1Logistic(table.where("false"), ["a"], "id", "y", FOUR, fold()).scores().count() == 0


def test_many_values_are_cut_at_quantiles(spark):
    rows = spark.range(4000).selectExpr("id", "cast(id as double) x", "if(id < 1000, null, 1.0) g", "cast(id >= 2000 as int) y")
    cuts = boosting.bin_cuts(rows, ["x", "g"])
    assert len(cuts[0]) == 254 and len(cuts[1]) == 0 and abs(cuts[0][127] - 2000) < 50
    model = boosted(rows, ["x", "g"], "id", "y", [Fit(score_all=True)], Boost(0.5, 4, 2))
    assert model.scores().where("prediction = label").count() > 3950


def optimum_gap(x, y, w, c=1.0):
    x = np.hstack([x, np.ones((len(x), 1))])
    g = c * x.T @ (1 / (1 + np.exp(-(x @ w))) - y)
    return np.where(w != 0, np.abs(g + np.sign(w)), np.maximum(np.abs(g) - 1, 0)).max()


@pytest.mark.parametrize("chunk", [8192, 25])
@pytest.mark.parametrize("c", [0.05, 1.0, 30.0])
def test_l1_fits_meet_the_conditions_of_the_optimum(table, monkeypatch, chunk, c):
    monkeypatch.setattr(fits, "CHUNK_ROWS", chunk)
    model = L1Logistic(table.na.fill(0.0), COLUMNS, "id", "y", FOUR, fold(), c=c)
    rows = [(r[0], *[v or 0.0 for v in r[1:4]], r[4]) for r in made_rows()]
    for f, w in zip(FOUR, model.coefficients, strict=True):
        own = np.array([r for r in rows if r[0] % 4 != f.held])
        assert optimum_gap(own[:, 1:4], own[:, 4], w, c) < 1e-6
    alone = L1Logistic(table.na.fill(0.0).where("id % 4 <> 1"), COLUMNS, "id", "y", [Fit()], c=c)
    assert np.allclose(alone.coefficients[0], model.coefficients[1], atol=1e-6)
    # a pass over the rows serves all fits
    assert model.scans <= alone.scans + 10


def test_l1_needs_complete_features(table):
    with pytest.raises(ValueError, match="complete"):
        L1Logistic(table, COLUMNS, "id", "y", [Fit()])


def test_fold_arrays_agree_with_predicates(table):
    seeds = [5, 6]
    column, listed = validate.repeated_folds(table, "id", seeds, 7)
    columns = validate.fold_columns(table, "id", seeds, 7)
    rows = table.select(column.alias("f"), *[columns[s].alias(f"s{s}") for s in seeds]).collect()
    assert all(r.f == [r.s5, r.s6] for r in rows) and len(listed) == 14
    assert listed[8] == Fit(1, 1, {"seed": 6, "fold": 1})
    column, listed = validate.repeated_holdouts(table, "id", seeds, 0.3)
    tests = validate.holdout_filters(table, "id", seeds, 0.3)
    rows = table.select(column.alias("f"), *[tests[s].alias(f"s{s}") for s in seeds]).collect()
    assert all([x == 0 for x in r.f] == [r.s5, r.s6] for r in rows)
    assert sum(r.s5 for r in rows) == math.ceil(0.3 * len(rows)) and listed[1] == Fit(0, 1, {"seed": 6})
