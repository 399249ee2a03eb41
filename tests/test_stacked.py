"""Stacked regressions: each model is the optimum of its own objective, agrees with a single fit, and costs are chosen as by a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelark.operators import evaluation as E
from curvelark.operators import models as M
from curvelark.operators.stacked import Stacked


def data(rng, n=90, d=5, classes=3):
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, d)) * np.array([1, 10, 0.1, 3, 1])[:d] + 5
    x[:, 0] += y
    x[:, d - 1] = 7.0  # without a deviation
    return x, y


def frame(spark, x, y, ins, outs):
    rows = [(i, [float(v) for v in x[i]], int(y[i]), ins[i], outs[i]) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int, ins array<int>, outs array<int>")


def scaled(x, of):
    mean, dev = of.mean(axis=0), of.std(axis=0)
    return (x - mean) * np.divide(1, dev, out=np.zeros_like(dev), where=dev > 1e-9)


def class_weights(y):
    kinds, counts = np.unique(y, return_counts=True)
    return {int(k): len(y) / (len(kinds) * n) for k, n in zip(kinds, counts, strict=True)}


def slope(model, x, y, cost):
    """The gradient, on standardized features, of cost * sum(w * loss) + |coefficients|^2 / 2, of a model on features as they are."""
    z, c = scaled(x, x), len(model)
    dev = x.std(axis=0)
    coef = np.where(dev > 1e-9, model[:, :-1] * dev, 0)
    logits = x @ model[:, :-1].T + model[:, -1]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    w = class_weights(y)
    p *= np.array([w[int(k)] for k in y])[:, None]
    return np.column_stack((cost * p.T @ z + coef, cost * p.sum(axis=0)[:c]))


def test_each_model_is_an_optimum(spark):
    rng = np.random.default_rng(1)
    x, y = data(rng)
    fold = rng.integers(0, 3, len(x))
    fold[:3] = [0, 1, 2]
    rows = frame(spark, x, y, [[s for s in range(3) if s != f] + [3] for f in fold], [[int(f)] for f in fold]).repartition(4)
    costs = (0.01, 1.0, 10.0)
    stacked = Stacked(rows, 4, 3, costs)
    models = stacked.fit()
    assert models.shape == (12, 3, 6) and 5 < stacked.passes < 200
    for k, model in enumerate(models):
        own = fold != k // 3
        assert np.abs(slope(model, x[own], y[own], costs[k % 3])).max() < 1e-4 * costs[k % 3] * own.sum()
    said = stacked.held_out(models).collect()
    assert sorted((r.id, r.model) for r in said) == sorted((i, 3 * int(fold[i]) + c) for i in range(len(x)) for c in range(3))
    for r in said:
        z = models[r.model][:, :-1] @ x[r.id] + models[r.model][:, -1]
        assert np.allclose(r.probs, np.exp(z - z.max()) / np.exp(z - z.max()).sum()) and r.y == y[r.id]


def test_as_single_fits(spark):
    rng = np.random.default_rng(2)
    x, y = data(rng, 120, 4)
    x = x[:, :3]
    stacked = Stacked(frame(spark, x, y, [[0]] * len(x), [[0]] * len(x)), 1, 3, (1.0,))
    ours = {r.id: r.probs for r in stacked.held_out(stacked.fit()).collect()}
    items = spark.createDataFrame([(i, f"c{y[i]}", *map(float, x[i])) for i in range(len(x))], "id long, label string, a double, b double, c double")
    for r in M.probabilities(M.fit_logistic(items, ["a", "b", "c"]), items).collect():  # its deviation is that of a sample
        assert abs(ours[r.id][int(r["class"][1])] - r.prob) < 5e-3


def test_sets_without_a_class_and_without_rows(spark):
    x, y = np.array([[1.0, 2], [2, 1], [3, 3], [4, 0]]), np.array([0, 0, 1, 1])
    rows = frame(spark, x, y, [[0], [0], [1], [1]], [[1], [1], [0], [0]])
    stacked = Stacked(rows, 3, 3, (1.0,))
    models = stacked.fit()
    assert np.isfinite(models).all()
    best = {r.id: int(np.argmax(r.probs)) for r in stacked.held_out(models).collect()}
    assert best == {0: 1, 1: 1, 2: 0, 3: 0}


def test_costs_are_chosen_as_by_a_loop(spark):
    rng = np.random.default_rng(3)
    x, y = data(rng, 60, 4)
    items = spark.createDataFrame([(i, f"g{i // 2}", f"c{y[i]}", *map(float, x[i, :3])) for i in range(len(x))], "id long, grp string, label string, a double, b double, c double")
    cols, costs, seeds = ["a", "b", "c"], (0.01, 1.0), (7, 8)
    got = M.nested_logistic(items, cols, 3, 42, seeds, 2, costs).toPandas()
    assert len(got) == 180 and np.allclose(got.groupby("id").prob.sum(), 1)
    outer = E.grouped_folds(items, 3, F.lit(42)).toPandas()

    def solve(train, cost):
        own = Stacked(frame(spark, train[cols].to_numpy(), np.array([int(c[1]) for c in train.label]), [[0]] * len(train), [[]] * len(train)), 1, 3, (cost,))
        return own.fit()[0]

    k = 1
    train, test = outer[outer.fold != k].drop(columns="fold"), outer[outer.fold == k]
    scores = {}
    for cost in costs:
        each = []
        for seed in seeds:
            dealt = E.grouped_folds(spark.createDataFrame(train), 2, F.lit(seed)).toPandas()
            for f in range(2):
                model = solve(dealt[dealt.fold != f], cost)
                held = dealt[dealt.fold == f]
                pred = (held[cols].to_numpy() @ model[:, :-1].T + model[:, -1]).argmax(axis=1)
                truth = np.array([int(c[1]) for c in held.label])
                each.append(np.mean([(pred[truth == c] == c).mean() for c in np.unique(truth)]))
        scores[cost] = round(float(np.mean(each)), 12)
    cost = max(costs, key=lambda c: (scores[c], -c))
    model = solve(train, cost)
    z = test[cols].to_numpy() @ model[:, :-1].T + model[:, -1]
    want = dict(zip(test.id, np.exp(z) / np.exp(z).sum(axis=1, keepdims=True), strict=True))
    own = got[got.fold == k]
    assert set(own.id) == set(want)
    for r in own.itertuples():
        assert r.prob == pytest.approx(want[r.id][int(getattr(r, "_3")[1])], abs=1e-4)
