"""Many multinomial ridge regressions in one job: rows carry the numbers of their training sets, and each pass gives the gradients of all models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes at most (as many as the protocol's solver may take), and the largest entry of a gradient, as a share of the summed weights, at which a model is done.
PASSES, TOLERANCE = 5000, 1e-7
#: Earlier steps that the next one is bent by, and rows that a task holds at once.
MEMORY, HELD_ROWS = 12, 1024


def _rows(b: pa.RecordBatch, n_sets: int, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with a 1 behind, class numbers, and which sets each row is in."""
    x = b["x"].flatten().to_numpy().reshape(b.num_rows, -1)
    sets = b[column]
    member = np.zeros((b.num_rows, n_sets), bool)
    member[np.repeat(np.arange(b.num_rows), np.diff(sets.offsets.to_numpy())), sets.flatten().to_numpy()] = True
    return np.column_stack((x, np.ones(len(x)))), b["y"].to_numpy(), member


def _probabilities(x: np.ndarray, models: np.ndarray) -> np.ndarray:
    """(row, model, class) of models (model, class, feature)."""
    m, c, d = models.shape
    z = (x @ models.reshape(m * c, d).T).reshape(len(x), m, c)
    z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=2, keepdims=True)
    return z


class Stacked:
    """Models of all pairs of training sets and costs. ``rows`` is (id, x: features, y: class number, ins: sets that the row trains, outs: sets that
    it is held out of), stored; sets are numbered from 0.

    A model has least cost * sum(w * loss) + |coefficients|^2 / 2, intercepts free, on features standardized within its set (population deviation; a
    feature without one stays 0), w giving all
    classes of the set the same sum. What tasks and driver hold is bounded by models, classes and features, never by rows: a task sends one gradient a model.
    """

    def __init__(self, rows: DataFrame, n_sets: int, n_classes: int, costs: tuple[float, ...]) -> None:
        self.rows, self.n_sets, self.n_classes = rows, n_sets, n_classes
        self.sets = np.repeat(np.arange(n_sets), len(costs))
        self.costs = np.tile(np.array(costs), n_sets)
        first = rows.select(F.size("x")).first()
        self.dim = first[0] if first else 0
        self._scale()

    def _summed(self, run, width: int, keys: int) -> np.ndarray:
        """The sums over all tasks of arrays (keys, width) that ``run`` makes of batches."""

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((keys, width))
            for b in batches:
                for at in range(0, b.num_rows, HELD_ROWS):
                    total += run(b.slice(at, HELD_ROWS))
            used = np.flatnonzero(total.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(total[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), lists], ["key", "v"])

        def add(table: pa.Table) -> pa.Table:
            v = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
            return pa.table({"key": table["key"].slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})

        parts = self.rows.mapInArrow(local, "key int, v array<double>")
        found = parts.groupBy("key").applyInArrow(add, "key int, v array<double>").toArrow()  # a row for each model or set
        out = np.zeros((keys, width))
        if found.num_rows:
            out[found["key"].to_numpy()] = found["v"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, width)
        return out

    def _scale(self) -> None:
        """Counts by class, means, deviations and a whitening transform for each set, in one pass."""
        n_sets, c, d = self.n_sets, self.n_classes, self.dim

        def run(b: pa.RecordBatch) -> np.ndarray:
            x, y, member = _rows(b, n_sets, "ins")
            pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            return np.column_stack((member.T.astype(float) @ np.eye(c)[y], member.T.astype(float) @ pairs))

        got = self._summed(run, c + (d + 1) ** 2, n_sets)
        counts, gram = got[:, :c], got[:, c:].reshape(n_sets, d + 1, d + 1)
        n = np.maximum(counts.sum(axis=1), 1)
        present = (counts > 0).sum(axis=1)
        self.weights = np.divide(n[:, None], present[:, None] * counts, out=np.zeros_like(counts), where=counts > 0)
        self.totals = np.maximum((self.weights * counts).sum(axis=1), 1e-9)
        self.mean = gram[:, :d, d] / n[:, None]
        cov = gram[:, :d, :d] / n[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        var = np.diagonal(cov, axis1=1, axis2=2).copy()
        dead = var <= 1e-12 * (1 + self.mean**2)
        self.scale = np.where(dead, 0.0, 1 / np.sqrt(np.where(dead, 1.0, var)))
        cor = cov * self.scale[:, :, None] * self.scale[:, None, :]
        # steps are taken where the penalized curvature is about the same in all directions
        self.root = np.stack([np.linalg.inv(np.linalg.cholesky(cor[s] * self.totals[s] / (2 * c) + np.eye(d) / k)) for s, k in zip(self.sets, self.costs, strict=True)]).transpose(0, 2, 1)

    def _raw(self, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Models on features as they are, of steps (model, class, feature + 1)."""
        s = self.sets[which]
        w = np.einsum("mcd,med->mce", v[:, :, :-1], self.root[which]) * self.scale[s][:, None, :]
        return np.concatenate((w, (v[:, :, -1] / np.sqrt(self.totals[s] / (2 * self.n_classes))[:, None] - np.einsum("mcd,md->mc", w, self.mean[s]))[:, :, None]), axis=2)

    def _pass(self, v: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and gradients of some models (values divided by cost, so that all weigh alike)."""
        sets, (m, c, d1) = self.sets[which], v.shape
        raw, n_sets, weights = self._raw(v, which), self.n_sets, self.weights

        def run(b: pa.RecordBatch) -> np.ndarray:
            x, y, member = _rows(b, n_sets, "ins")
            p = _probabilities(x, raw)
            w = member[:, sets] * weights[sets][:, y].T
            loss = -(w * np.log(np.maximum(p[np.arange(len(x)), :, y], 1e-300))).sum(axis=0)
            p[np.arange(len(x)), :, y] -= 1
            p *= w[:, :, None]
            return np.column_stack((loss, (p.reshape(len(x), m * c).T @ x).reshape(m, c * d1)))

        got = self._summed(run, 1 + c * d1, m)
        g = got[:, 1:].reshape(m, c, d1)
        coef = np.einsum("mcd,med->mce", v[:, :, :-1], self.root[which])
        value = got[:, 0] + (coef**2).sum(axis=(1, 2)) / 2 / self.costs[which]
        inner = (g[:, :, :-1] - g[:, :, -1:] * self.mean[sets][:, None, :]) * self.scale[sets][:, None, :] + coef / self.costs[which][:, None, None]
        steps = np.einsum("mce,med->mcd", inner, self.root[which])
        return value, np.concatenate((steps, g[:, :, -1:] / np.sqrt(self.totals[sets] / (2 * self.n_classes))[:, None, None]), axis=2)

    def fit(self) -> np.ndarray:
        """All models, on features as they are: (model, class, feature + 1), and ``passes``, how many passes that took.

        Each model takes its own quasi-Newton steps with backtracking; a pass evaluates the next trial of all that are not done.
        """
        n, shape = len(self.sets), (self.n_classes, self.dim + 1)
        v = np.zeros((n, *shape))
        every = np.arange(n)
        value, grad = self._pass(v, every)
        past: list[list[tuple]] = [[] for _ in range(n)]
        length = np.ones(n)
        step = -grad.copy()
        open_ = np.abs(grad).max(axis=(1, 2)) > TOLERANCE * np.sqrt(self.totals[self.sets])
        self.passes = 1
        while open_.any() and self.passes < PASSES:
            at = np.flatnonzero(open_)
            trial = v[at] + length[at][:, None, None] * step[at]
            new, slope = self._pass(trial, at)
            self.passes += 1
            for i, k in enumerate(at):
                along = (grad[k] * step[k]).sum()
                if new[i] <= value[k] + 1e-4 * length[k] * along:
                    s, y = trial[i] - v[k], slope[i] - grad[k]
                    if (s * y).sum() > 1e-14 * (y * y).sum():
                        past[k] = [*past[k], (s, y, 1 / (s * y).sum())][-MEMORY:]
                    v[k], value[k], grad[k], length[k] = trial[i], new[i], slope[i], 1.0
                    step[k] = _bent(grad[k], past[k])
                    open_[k] = np.abs(grad[k]).max() > TOLERANCE * np.sqrt(self.totals[self.sets[k]])
                elif length[k] * np.abs(step[k]).max() < 1e-12:  # no closer in doubles
                    open_[k] = False
                else:
                    length[k] /= 2
        return self._raw(v, every)

    def held_out(self, models: np.ndarray) -> DataFrame:
        """(id, model, y, probs): of each row all models of the sets that it is held out of."""
        sets, n_sets = self.sets, self.n_sets
        kind = self.rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, HELD_ROWS):
                    b = whole.slice(at, HELD_ROWS)
                    x, y, member = _rows(b, n_sets, "outs")
                    row, model = np.nonzero(member[:, sets])
                    p = _probabilities(x, models)[row, model]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(row)), pa.array(model, pa.int32()), pa.array(y[row], pa.int32()), lists], ["id", "model", "y", "probs"])

        return self.rows.mapInArrow(run, f"id {kind}, model int, y int, probs array<double>")


def _bent(grad: np.ndarray, past: list[tuple]) -> np.ndarray:
    """The quasi-Newton step of a gradient and earlier changes (two-loop recursion)."""
    q, back = grad.copy(), []
    for s, y, rho in reversed(past):
        back.append(rho * (s * q).sum())
        q -= back[-1] * y
    if past:
        s, y, rho = past[-1]
        q /= rho * (y * y).sum()
    for (s, y, rho), a in zip(past, reversed(back), strict=True):
        q += (a - rho * (y * q).sum()) * s
    return -q
