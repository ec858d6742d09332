"""L1-penalised logistic regression whose intercept is penalised too, for many
fits at once.

The objective is the sum of all absolute coefficients, the intercept's
included, plus ``c`` times the summed logistic loss.  Each step is a proximal
Newton step: one pass over the rows sums loss, gradient and second derivatives
of all fits at their trial points, and losses at shorter steps as well; the
small quadratic problem with its absolute values is then solved by coordinate
descent for every fit.  So k folds cost one scan a step, however many rows
there are, and only sums of the size of a model leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.operators.fits import PARTIAL, Chunk, Fit, added, chunked, partial_rows, tagged

#: Lengths of a step that one pass tries.
STEPS = 0.5 ** np.arange(12)
ARMIJO = 0.01


def _with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, np.where(y[:, None] == 1, -margin, margin))


def chunk_sums(chunk: Chunk, learns: np.ndarray, w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Per fit: the losses at every step length, then gradient and second
    derivatives at the full step."""
    x = _with_bias(chunk.x)
    base, step = x @ w.T, x @ d.T
    losses = np.stack([(_losses(base + b * step, chunk.y) * learns).sum(axis=0) for b in STEPS], axis=1)
    chance = 1 / (1 + np.exp(-(base + step)))
    first = ((chance - chunk.y[:, None]) * learns).T @ x
    bend = chance * (1 - chance) * learns
    second = np.stack([(x * bend[:, k : k + 1]).T @ x for k in range(len(w))])
    return np.hstack([losses, first, second.reshape(len(w), -1)])


def newton_step(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """argmin over d of g d + d h d / 2 + |w + d|, by coordinate descent."""
    d, slope = np.zeros(len(w)), g.copy()
    for _ in range(1000):
        most = 0.0
        for j in range(len(w)):
            bend = h[j, j] + 1e-12
            u = w[j] + d[j] - slope[j] / bend
            new = np.sign(u) * max(abs(u) - 1 / bend, 0) - w[j]
            change = new - d[j]
            if change:
                slope += change * h[j]
                d[j] = new
                most = max(most, abs(change))
        if most <= 1e-12 * (1 + np.abs(w + d).max()):
            break
    return d


def _rest(w: np.ndarray, g: np.ndarray) -> float:
    """How far a point is from the conditions of the optimum."""
    return float(np.where(w != 0, np.abs(g + np.sign(w)), np.maximum(np.abs(g) - 1, 0)).max())


class L1Logistic:
    """The fitted models of one call; ``coefficients`` has a row per fit, the
    intercept last."""

    def __init__(
        self, rows: DataFrame, features: Sequence[str], key: str, label: str, fits: Sequence[Fit], folds=None,
        c: float = 1.0, tol: float = 1e-9, max_steps: int = 200,
    ):
        self.features, self.fits = list(features), list(fits)
        self.chunks = chunked(rows, features, key, label, folds)
        self.scans = 0
        size = len(features) + 1
        w, d = np.zeros((len(fits), size)), np.zeros((len(fits), size))
        value, promised = np.full(len(fits), np.inf), np.zeros(len(fits))
        open_fits, first = np.ones(len(fits), bool), None
        if self.chunks.isEmpty():
            open_fits[:] = False
        while open_fits.any() and self.scans < max_steps:
            at = np.flatnonzero(open_fits)
            sums = self._sums([self.fits[i] for i in at], w[at], d[at])
            losses, g, h = np.split(sums, [len(STEPS), len(STEPS) + size], axis=1)
            g, h = c * g, c * h.reshape(-1, size, size)
            if first is None:
                first = max(1.0, *(_rest(w[i], g[n]) for n, i in enumerate(at)))
            for n, i in enumerate(at):
                tried = c * losses[n] + np.abs(w[i] + STEPS[:, None] * d[i]).sum(axis=1)
                good = tried <= value[i] + ARMIJO * STEPS * promised[i] + 1e-12 * np.abs(tried)
                if not good.any():
                    # no shorter step helps: the point is as good as the numbers allow
                    open_fits[i] = False
                    continue
                k = int(good.argmax())
                w[i], value[i] = w[i] + STEPS[k] * d[i], tried[k]
                if k:
                    # sums at the shorter step come with the next pass
                    d[i], promised[i] = 0, 0
                    continue
                if _rest(w[i], g[n]) <= tol * first:
                    open_fits[i] = False
                    continue
                d[i] = newton_step(w[i], g[n], h[n])
                promised[i] = g[n] @ d[i] + np.abs(w[i] + d[i]).sum() - np.abs(w[i]).sum()
        self.coefficients = w

    def _sums(self, fits: Sequence[Fit], w: np.ndarray, d: np.ndarray) -> np.ndarray:
        n_features = len(self.features)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = None
            for batch in batches:
                for row in batch.to_pylist():
                    chunk = Chunk(row, n_features)
                    own = chunk_sums(chunk, chunk.learns(fits), w, d)
                    total = own if total is None else total + own
            if total is not None:
                yield partial_rows(TaskContext.get().partitionId(), dict(enumerate(total)))

        self.scans += 1
        slim = self.chunks.select("chunk", "x", "y", "folds", "tie")
        out = np.stack([np.frombuffer(b) for b in added(slim.mapInArrow(partial, PARTIAL), slim.rdd.getNumPartitions(), np.ndarray.tobytes)])
        if not np.isfinite(out).all():
            raise ValueError("features have to be complete and finite")
        return out

    def scores(self) -> DataFrame:
        """(tags, key, label, prediction, score) of the rows that a fit scores."""
        fits, w, n_features = self.fits, self.coefficients, len(self.features)
        kind = self.chunks.schema["keys"].dataType.elementType.simpleString()

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in ("chunk", "x", "y", "folds", "tie")}
                    chunk = Chunk(row, n_features)
                    at, fit = np.nonzero(chunk.scores(fits))
                    margin = (_with_bias(chunk.x) @ w.T)[at, fit]
                    keys = batch.slice(i, 1).column("keys").flatten().take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(fit.astype(np.int32)), keys, pa.array(chunk.y[at]), pa.array(margin)],
                                                     names=["fit", "key", "label", "score"])

        rows = self.chunks.mapInArrow(scored, f"fit int, key {kind}, label double, score double")
        rows = rows.withColumn("prediction", F.when(F.col("score") > 0, 1.0).otherwise(0.0))
        return tagged(rows.select("fit", "key", "label", "prediction", "score"), self.fits)

    def odds(self) -> DataFrame:
        """(tags, row_idx, feature, coefficient, odds_ratio, intercept), a row per
        feature and fit of the call."""
        rows = [
            (n, i, f, float(w[i]), float(w[-1])) for n, w in enumerate(self.coefficients) for i, f in enumerate(self.features)
        ]
        made = self.chunks.sparkSession.createDataFrame(rows, "fit int, row_idx long, feature string, coefficient double, intercept double")
        made = made.withColumn("odds_ratio", F.exp("coefficient"))
        return tagged(made.select("fit", "row_idx", "feature", "coefficient", "odds_ratio", "intercept"), self.fits)
