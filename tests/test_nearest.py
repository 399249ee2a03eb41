"""Exact neighbours by pivots: equal to brute force, and few distances where items lie in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelark.operators.nearest import nearest_neighbours


def brute(rows, k, divisor):
    good = [(i, np.array(v, float), -1 if p is None else p) for i, v, p in rows if i is not None and v is not None and None not in v]
    out = []
    for i, v, p in good:
        near = sorted((round(float(np.sqrt(((w - v) ** 2).sum())) / divisor, 9), j) for j, w, q in good if j != i and (q != p or p < 0))
        out += [(i, r, j, d) for r, (d, j) in enumerate(near[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>, part int")


@pytest.mark.parametrize("block", [512, 40])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5)) * 4
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=5)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(500 + i, rows[0][1], i % 3) for i in range(60)] + [(600 + i, [1.0, 2.0, 3.0, 4.0, 5.0], None) for i in range(4)]  # equal ones, and such of no part
    rows += [(700, None, 1), (701, [None] * 5, 1), (None, rows[0][1], 1)]
    got = nearest_neighbours(frame(spark, rows).withColumn("at", F.lit(1)), 7, 2.0, pivots=6, block_rows=block).collect()
    want = brute(rows, 7, 2.0)
    assert [r[:3] for r in sorted(tuple(r)[:4] for r in got)] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in sorted(tuple(r)[:4] for r in got)], [r[3] for r in want], atol=1.1e-9)


def test_few_candidates_and_none(spark):
    assert nearest_neighbours(frame(spark, []), 3).count() == 0
    assert nearest_neighbours(frame(spark, [(1, [0.0], 0)]), 3).count() == 0
    assert [tuple(r)[:4] for r in nearest_neighbours(frame(spark, [(1, [0.0], 0), (2, [3.0], 1), (3, [0.0], 0)]), 3).orderBy("id", "rank").collect()] == [(1, 1, 2, 3.0), (2, 1, 1, 3.0), (2, 2, 3, 3.0), (3, 1, 2, 3.0)]


def test_under_half_of_the_pairs_of_clustered_items(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 10
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8)], None) for i in range(1500)]
    got = nearest_neighbours(frame(spark, rows), 5, block_rows=100)
    computed = got.where("rank = 1").agg(F.sum("computed")).first()[0]
    assert computed < 0.25 * len(rows) * (len(rows) - 1)
    first = {r.id: r.neighbour for r in got.where("rank = 1").collect()}
    x = np.array([v for _, v, _ in rows])
    for i in range(0, 1500, 50):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert first[i] == d.argmin()


def test_a_large_table_has_few_blocks(spark, monkeypatch):
    """An item was once a row for each block of 512 others that it was sent to, in a table small enough on disk to be broadcast: now there are few blocks, and no such table."""
    from curvelark.operators import nearest

    stored, staged = {}, nearest.staged
    monkeypatch.setattr(nearest, "staged", lambda df, name: stored.setdefault(name, staged(df, name)))
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 4)
    monkeypatch.setattr(nearest, "BLOCKS", 6)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i % 3) for i in range(600)] + [(1000 + i, [0.5] * 6, i % 2) for i in range(90)]
    got = nearest_neighbours(frame(spark, rows), 3).collect()
    assert [r[:3] for r in sorted(tuple(r)[:4] for r in got)] == [r[:3] for r in brute(rows, 3, 1.0)]
    assert stored["near-index"].select("block").distinct().count() <= 12 and "near-met" not in stored
    assert all(len(df.columns) < 8 and df.count() <= 4 * 690 for df in stored.values())
