"""Hard negatives against brute force, brackets of the pivot table, and the cases that tables may hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelark.llm import pivots


def brute(rows, step, n_positives=5, n_negatives=3, low=50, high=95):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or None in v:
            continue
        key = (v, label)
        best[i] = min(best[i], key) if i in best else key
    dim = max((len(v) for v, _ in best.values()), default=0)
    ids = sorted(best)
    x = {i: np.array(list(best[i][0]) + [0] * (dim - len(best[i][0])), dtype=object) for i in ids}
    out = []
    for a in ids:
        if a % step:
            continue
        score = {i: int((x[a] * x[i]).sum()) for i in ids if i != a}
        near = sorted(score, key=lambda i: (-score[i], i))
        same = [i for i in near if best[i][1] == best[a][1]][:n_positives]
        for p in same:
            fit = [i for i in near if best[i][1] != best[a][1] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r, n, score[p], score[n]) for r, n in enumerate(fit[:n_negatives], 1)]
    return sorted(out)


def clustered(rng, n, dim=8):
    centres = rng.integers(-200, 200, (6, dim))
    return [(i, f"l{int(rng.integers(0, 4))}", [int(v) for v in centres[i % 6] + rng.integers(-40, 40, dim)]) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    rows = clustered(rng, 700)
    hot = rows[3][2]
    rows += [(1000 + i, "l1", hot) for i in range(300)] + [(2000 + i, "l2", hot) for i in range(60)]  # equal vectors in two labels
    rows += [(3000 + i, "l3", [5, 6, 7, 8]) for i in range(10)]  # shorter ones
    rows += [(3010, "alone", hot), (3020, "l0", [0] * 8), (3030, "l0", []), (3040, None, hot), (3050, "l0", None), (3060, "l0", [None] * 8), (None, "l0", hot)]
    return rows + [(10, "l2", rows[10][2]), (10, rows[10][1], rows[11][2])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label string, v array<long>").selectExpr("*", "1 AS cell", "2 AS at", "'x' AS chunk", "3 AS w", "4 AS bucket")


@pytest.mark.parametrize("blocks", [(4096, 2048), (60, 16)])
def test_against_brute_force(spark, rows, blocks):
    got = pivots.hard_negatives(frame(spark, rows), F.col("id") % 10 == 0, block_rows=blocks[0], chunk_rows=blocks[1]).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)


def test_other_numbers(spark):
    rows = clustered(np.random.default_rng(3), 200)
    got = pivots.hard_negatives(frame(spark, rows), F.col("id") % 7 == 0, 2, 6, 20, 100, block_rows=40, pivots=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7, 2, 6, 20, 100)


def test_empty_and_single(spark):
    assert pivots.hard_negatives(frame(spark, []), F.lit(True)).count() == 0
    assert pivots.hard_negatives(frame(spark, [(1, "a", [1, 2])]), F.lit(True)).count() == 0
    assert pivots.hard_negatives(frame(spark, [(1, "a", [0, 0]), (2, "a", [0, 0]), (3, "b", [0, 0])]), F.col("id") == 1).collect() == [(1, 2, 1, 3, 0, 0)]


def test_large_components(spark):
    """Scores beyond the whole numbers of doubles are exact; those beyond 2**56 are refused."""
    rows = [(i, "ab"[i % 2], [(1 << 27) - 1 - i, 5 - i, i]) for i in range(8)] + [(8, "a", [1 << 26, 1, 1]), (9, "b", [(1 << 26) + 3, 1, 1])]
    got = pivots.hard_negatives(frame(spark, rows), F.lit(True)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 1) and max(r.positive_score for r in got) > 1 << 53
    with pytest.raises(ValueError):
        pivots.hard_negatives(frame(spark, [(1, "a", [1 << 30])]), F.lit(True))


def test_distances_bracket_scores():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (400, 12)).astype(float)
    q = x[:30]
    p = pivots.Pivots.choose(x[:200], float((x * x).sum(axis=1).max()), 16)
    assert len(np.unique(p.points, axis=0)) == 16
    at, q_at = p.distances(x, p.extra(x)), p.distances(q, np.zeros(len(q)))
    lengths = (q * q).sum(axis=1)[:, None]
    most = p.score(lengths, np.abs(q_at[:, None] - at[None]).max(axis=2)) + p.slack
    least = p.score(lengths, (q_at[:, None] + at[None]).min(axis=2)) - p.slack
    assert (least <= q @ x.T).all() and (q @ x.T <= most).all()


def test_brackets_spare_products():
    """Of rows far from what an anchor wants no products are formed."""
    rng = np.random.default_rng(6)
    x = np.concatenate([c + rng.integers(-20, 20, (300, 8)) for c in rng.integers(-2000, 2000, (8, 8))]).astype(float)
    p = pivots.Pivots.choose(x, float((x * x).sum(axis=1).max()), 16)
    q, at = x[:1], p.distances(x, p.extra(x))
    low = np.abs(p.distances(q, np.zeros(1)) - at).max(axis=1)
    kth = np.sort(x @ q[0])[-20]
    reached = p.score((q * q).sum(), low) + p.slack >= kth
    assert reached.sum() < len(x) / 3 and reached[(x @ q[0]) >= kth].all()


def test_query_follows_its_contract(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r.vec_id, str((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label), np.floor(256 * np.array(r.embedding, float)).astype(int).tolist()) for r in table]
    assert sorted(map(tuple, pivots.op11_pivot_negatives(spark, sf).collect())) == brute(rows, 50)
