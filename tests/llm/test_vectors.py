import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelark.llm import ann, hamming


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS code", "3 AS leaf")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    out = [(i, [float(v) for v in (centres[i % 12] + rng.normal(size=16) * 0.5).astype(np.float32)]) for i in range(1500)]
    out += [(2000 + i, out[0][1]) for i in range(60)]
    out += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (3080, [float("inf")] * 16), (out[5][0], out[5][1])]
    return out


def test_tree_search(spark, rows):
    got = ann.tree_search(ann.usable_vectors(frame(spark, rows), "vec_id", "embedding"), F.col("id") % 20 == 0, 20, leaf_rows=150, block_rows=100).toPandas()
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    hits = 0
    queries = [i for i in ids if i % 20 == 0]
    assert set(got.query_id) == set(queries) and len(got) == 20 * len(queries)
    for q in queries:
        s = (x * good[q]).sum(axis=1)
        keep = ids != q
        best = np.lexsort((ids[keep], -s[keep]))[:20]
        g = got[got.query_id == q].sort_values("rank")
        hits += len(set(g.vec_id) & set(ids[keep][best]))
        assert list(g["rank"]) == list(range(1, 21))
        assert g.score.tolist() == [float((good[v] * good[q]).sum()) for v in g.vec_id]
        assert [(-a, b) for a, b in zip(g.score, g.vec_id, strict=True)] == sorted((-a, b) for a, b in zip(g.score, g.vec_id, strict=True))
    assert hits / (20 * len(queries)) >= 0.9


def test_recall_and_rows_met_on_a_whole_table(spark):
    """The table's vectors have no clusters at all, the worst case for any tree: bins must still spare most rows."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.tree_search(ann.usable_vectors(table, "vec_id", "embedding"), F.col("id") % 20 == 0, 20).toPandas()
    frame_ = table.toPandas().sort_values("vec_id")
    ids, x = frame_.vec_id.to_numpy(), np.stack(frame_.embedding).astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len(set(g.vec_id) & set(ids[np.lexsort((ids, -s))[:20]]))
    assert len(got) == 20 * (ids % 20 == 0).sum()
    assert hits / len(got) >= 0.93
    assert got.groupby("query_id").met.first().mean() < len(ids) / 3


def test_lonely_leaves_do_not_shorten_answers(spark):
    """Queries whose best leaf holds nothing but themselves."""
    rng = np.random.default_rng(3)
    far = [(20 * i, [float(100 * (i + 1)) if j == i else 0.0 for j in range(16)]) for i in range(12)]
    near = [(1001 + 2 * i, [float(v) for v in rng.normal(size=16) * 0.01]) for i in range(300)]
    odd = [(5000 + i, [1.0] * 5) for i in range(3)]
    got = ann.tree_search(ann.usable_vectors(frame(spark, far + near + odd), "vec_id", "embedding"), F.col("id") % 20 == 0, 20, leaf_rows=8).toPandas()
    assert (got[got.query_id < 1000].groupby("query_id").size() == 20).all() and got[got.query_id < 1000].query_id.nunique() == 12


def test_few_and_no_vectors(spark):
    few = ann.tree_search(ann.usable_vectors(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])]), "vec_id", "embedding"), F.col("id") == 0, 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(2, 1.0), (1, 0.5)]
    assert ann.tree_search(ann.usable_vectors(frame(spark, []), "vec_id", "embedding"), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("segment", [None, 5, 16])
def test_hamming_is_exact(spark, rows, segment):
    codes = hamming.sign_codes(frame(spark, rows), "vec_id", "embedding")
    got = hamming.exact_hamming_topk(codes.selectExpr("*", "1 AS q", "2 AS seg", "3 AS len"), F.col("id") % 50 == 0, 20, segment).toPandas()
    own = {i: np.array(v) > 0 for i, v in rows if v is not None and None not in v and not np.isnan(v).any()}
    ids = np.array(sorted(own))
    x = np.stack([own[i] for i in ids])
    for q in ids[ids % 50 == 0]:
        d = (x != own[q]).sum(axis=1)
        keep = ids != q
        best = np.lexsort((ids[keep], d[keep]))[:20]
        g = got[got.query_id == q].sort_values("rank")
        assert g.vec_id.tolist() == ids[keep][best].tolist() and g.distance.tolist() == d[keep][best].tolist()
    assert set(got.query_id) == set(ids[ids % 50 == 0])


def test_hamming_of_copies_and_far_codes(spark):
    """Many copies of one code, a query without any near code, codes of several lengths, and fewer candidates than asked for."""
    rng = np.random.default_rng(7)
    rows = [(i, b"\x0f\xf0\x55") for i in range(300)] + [(1000, b"\xf0\x0f\xaa"), (1050, b"\x00"), (1051, b"\x01"), (1100, b"ab" * 4)]
    rows += [(2000 + i, rng.bytes(3)) for i in range(40)] + [(None, b"abc"), (3000, None)]
    codes = spark.createDataFrame(rows, "id long, code binary")
    got = hamming.exact_hamming_topk(codes, F.col("id") % 50 == 0, 20).toPandas()
    known = [(i, c) for i, c in rows if i is not None and c is not None]
    for q, code in known:
        if q % 50:
            continue
        want = sorted((sum((x ^ y).bit_count() for x, y in zip(code, c, strict=True)), i) for i, c in known if i != q and len(c) == len(code))[:20]
        g = got[got.query_id == q].sort_values("rank")
        assert list(zip(g.distance, g.vec_id, strict=True)) == want


def test_hamming_of_wide_codes_and_of_none(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=100)]) for i in range(200)]
    codes = hamming.sign_codes(frame(spark, rows), "vec_id", "embedding")
    got = hamming.exact_hamming_topk(codes, F.col("id") == 0, 5).orderBy("rank").collect()
    x = np.array([v for _, v in rows]) > 0
    d = (x != x[0]).sum(axis=1)
    assert [r.vec_id for r in got] == [i for i in np.lexsort((np.arange(200), d)) if i][:5]
    assert hamming.exact_hamming_topk(codes.where("false"), F.col("id") == 0).count() == 0
