"""Vectors against all others, block against block: equal to brute force, and no pairs leave a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelark.operators import inference as I
from curvelark.operators import vector_pairs as VP
from curvelark.operators import vectors as V
from curvelark.plans import bases as B
from curvelark.plans import catalog


def table(spark, rows, schemes):
    df = spark.createDataFrame(rows, "id long, v array<float>, p array<int>")
    return df.select("id", "v", V.part_code([F.get("p", F.lit(s)) for s in range(schemes)]).alias("parts"))


def brute(rows, k, divisor, schemes):
    good = [(i, np.float32(v).astype(float), p) for i, v, p in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for s in range(schemes):
        for i, v, p in good:
            near = sorted((round(float(np.sqrt(((w - v) ** 2).sum())) / divisor, 9), j) for j, w, q in good if j != i and None not in (p[s], q[s]) and q[s] != p[s])
            out += [(s, i, r, j) for r, (_, j) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [32768, 70])
def test_neighbours_of_all_schemes(spark, monkeypatch, most):
    monkeypatch.setattr(V, "BLOCK_MOST", most)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], [int(rng.integers(0, 3)), int(rng.integers(0, 2)) if i % 4 else None]) for i in range(260)]
    rows += [(1000 + i, rows[0][1], [i % 3, 0]) for i in range(80)]  # more equal ones than products can tell apart
    rows += [(2000, None, [0, 0]), (2001, [None] * 6, [0, 0]), (2002, [float("nan")] * 6, [0, 0]), (2003, [float("inf")] * 6, [1, 1])]
    got = V.neighbours_by_scheme(table(spark, rows, 2), 4, 2, 2.0)
    assert sorted(tuple(r) for r in got.select("scheme", "id", "rank", "neighbour").collect()) == brute(rows, 4, 2.0, 2)


def test_few_candidates(spark):
    assert V.neighbours_by_scheme(table(spark, [], 1), 3, 1).count() == 0
    got = V.neighbours_by_scheme(table(spark, [(1, [0.0], [0]), (2, [3.0], [1]), (3, [0.0], [0])], 1), 3, 1)
    assert sorted(tuple(r) for r in got.select("id", "rank", "neighbour").collect()) == [(1, 1, 2), (2, 1, 1), (2, 2, 3), (3, 1, 2)]


KNN = ["knn_probabilities", "knn_predictions", "confusion", "fold_metrics", "run_summary", "paired_differences", "paired_bootstrap", "ablation_summary", "run_signature", "choose_k"]


@pytest.mark.parametrize("name", KNN)
def test_votes_need_no_pairs(spark, sf, monkeypatch, name):
    def none(*a, **kw):
        raise AssertionError("all pairs are formed")

    monkeypatch.setattr(B, "pairs", none)
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_statistics_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(VP, "RANGES", 40)
    monkeypatch.setattr(V, "BLOCK_MOST", 60)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)], None if i % 29 == 0 else f"c{i % 3}") for i in range(150)]
    rows += [(500 + i, rows[0][1], "c0") for i in range(9)] + [(600, None, "c1")]
    items = spark.createDataFrame(rows, "id long, v array<float>, label string")
    good = [r for r in rows if r[1] is not None]
    flat = [(a[0], b[0], round(float(np.sqrt(((np.array(a[1]) - b[1]) ** 2).sum())) / 2, 9), a[2], b[2]) for n, a in enumerate(good) for b in good[n + 1 :]]
    pairs = spark.createDataFrame(flat, "i long, j long, dist double, label_i string, label_j string").withColumn("same", (F.col("label_i") == F.col("label_j")).cast("int"))
    found = VP.Pairs(items, 2.0)
    for got, want in ((found.statistics(), I.distance_statistics(pairs)), (found.label_means(), I.label_mean_matrix(pairs)), (found.histogram(20), I.distance_histogram(pairs.where("same IS NOT NULL"), 20))):
        got, want = (sorted((tuple(r[c] for c in sorted(want.columns)) for r in df.collect()), key=str) for df in (got, want))
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a == pytest.approx(b, abs=1e-8)
    c = VP.pair_checks(items.drop("label"), 2.0).first()
    assert (c["cells"], c["items"], c.diagonal, c.skew, c.bad) == (160**2, 160, 0, 2 * 159, 2 * 159)
    assert c.distinct == pytest.approx(1 - 90 / (159 * 158))


@pytest.mark.parametrize("name", ["distance_statistics", "distance_histogram", "distance_checks", "label_mean_distance", "mds_points"])
def test_statistics_form_no_pairs(spark, sf, monkeypatch, name):
    def none(*a, **kw):
        raise AssertionError("all pairs are formed")

    monkeypatch.setattr(B, "pairs", none)
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_permutations_of_vectors(spark, sf, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)], f"g{i % 9:02d}", f"c{i % 9 % 3}") for i in range(90)]
    items = spark.createDataFrame(rows, "id long, v array<double>, grp string, label string")
    flat = [(a[0], b[0], round(float(np.sqrt(((np.array(a[1]) - b[1]) ** 2).sum())), 9)) for a in rows for b in rows if a[0] < b[0]]
    monkeypatch.setattr(I, "PERMUTED", 40)
    got, want = (I.permutation_test(spark, p, items, 40).first() for p in (items.select("id", "v"), spark.createDataFrame(flat, "i long, j long, dist double")))
    assert got.observed == pytest.approx(want.observed) and got.p == want.p

    def none(*a, **kw):
        raise AssertionError("all pairs are formed")

    monkeypatch.setattr(B, "pairs", none)
    test = I.permutation_test
    monkeypatch.setattr(I, "permutation_test", lambda s, v, items: test(s, v, items, 9))
    assert catalog.QUERIES["permutation_test"](spark, sf).count() == 1


def test_tuned_evaluation_needs_no_pairs(spark, sf, monkeypatch):
    """The same choices and predictions as from a table of all pairs; the query forms none."""
    from curvelark.operators import evaluation as E
    from curvelark.operators.distance import symmetric

    items, few = B.items(spark, sf), dict(seeds=(2026,))
    want, chosen = E.tuned_evaluation(symmetric(B.pairs(spark, sf), "dist"), items, **few)
    got, picked = E.tuned_evaluation_of_vectors(B.vectors(spark, sf), items, 8.0, **few)
    key = lambda df: sorted((r.id, r.label, r.fold, r.k, r.pred, round(r.prob, 9)) for r in df.collect())
    assert sorted(map(tuple, picked.select("outer", "k", "score").collect())) == sorted(map(tuple, chosen.select("outer", "k", "score").collect()))
    assert key(got) == key(want) and len(key(got)) == items.count()

    def none(*a, **kw):
        raise AssertionError("all pairs are formed")

    monkeypatch.setattr(B, "pairs", none)
    assert catalog.QUERIES["tuned_evaluation"](spark, sf).count() == 1


def test_auc_without_pairs(spark, sf, monkeypatch):
    """Many ties, unknown labels, several ranges and lots: the share of plain counting, and the query forms no pairs."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(VP, "DEALT_LEAST", 500)
    monkeypatch.setattr(VP, "SORTED", 900)
    monkeypatch.setattr(VP, "SORTED_ROWS", 90)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3)], None if i % 31 == 0 else f"c{i % 3}") for i in range(200)] + [(300, None, "c1")]
    flat = [(round(float(np.sqrt(((np.array(a[1]) - b[1]) ** 2).sum())) / 2, 9), a[2] == b[2]) for n, a in enumerate(rows[:200]) for b in rows[n + 1 : 200] if a[2] and b[2]]
    w, b = (np.array([d for d, same in flat if same == kind]) for kind in (True, False))
    want = ((w[:, None] < b).sum() + (w[:, None] == b).sum() / 2) / (len(w) * len(b))
    items = spark.createDataFrame(rows, "id long, v array<float>, label string")
    assert VP.Pairs(items, 2.0).auc().first().auc == pytest.approx(want, abs=1e-12)
    assert VP.Pairs(items.where("label = 'c1'"), 2.0).auc().first().auc is None and VP.Pairs(items.where("false"), 2.0).auc().first().auc is None
    for step in (3, 300, 70_000, 5 << 30):
        own = np.sort(rng.integers(0, 9 * step, 5000))
        size, data = VP.packed(own)
        assert (VP.unpacked(size, 5000, data) == own).all()

    def none(*a, **kw):
        raise AssertionError("all pairs are formed")

    monkeypatch.setattr(B, "pairs", none)
    assert catalog.QUERIES["pair_auc"](spark, sf).count() == 1
