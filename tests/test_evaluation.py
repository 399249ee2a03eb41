import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelark.operators import dedup
from curvelark.operators import evaluation as E
from curvelark.operators import inference as I
from curvelark.operators import models as M
from curvelark.operators.graph import connected_components
from curvelark.operators.staging import staged
from curvelark.sources.index import cache_path, frame_of, get_text, json_ready, read_csv, write_csv, write_json, write_matrix_csv


@pytest.fixture(scope="module")
def line(spark):
    """25 pieces of 5 classes on a line."""
    items = spark.createDataFrame([(i, f"g{i:02d}", f"c{i // 5}") for i in range(25)], "id long, grp string, label string")
    dist = spark.createDataFrame([(i, j, float(abs(i - j))) for i in range(25) for j in range(25) if i != j], "i long, j long, dist double")
    return items, dist


def dealt_one_by_one(rows, folds, seed):
    """Group to fold, by the plain rule: every group in turn against the sums of squared shares."""
    counts, totals = defaultdict(Counter), Counter()
    for grp, label in rows:
        counts[grp][label] += 1
        totals[label] += 1
    names = sorted(totals, key=lambda n: (n is not None, n))
    number = {n: i if None in totals else i + 1 for i, n in enumerate(names)}
    kinds = defaultdict(list)
    for grp, c in counts.items():
        kinds[",".join(f"{number[n]}:{c[n]}" for n in names if n in c)].append(grp)
    out, state = {}, [Counter() for _ in range(folds)]
    for kind, own in kinds.items():
        own.sort(key=lambda g: (hashlib.md5(f"{seed}|{'' if g is None else g}".encode()).hexdigest(), g))
        kinds[kind] = own
    for kind, own in sorted(kinds.items(), key=lambda k: (-sum(counts[k[1][0]].values()), k[0])):
        for place, grp in enumerate(own):
            if place < len(own) - len(own) % folds:
                out[grp] = place % folds
                continue
            spread = lambda f: round(sum(state[f][n] * counts[grp][n] / totals[n] ** 2 for n in names), 12)  # noqa: B023,E731
            f = min(range(folds), key=lambda f: (spread(f), sum(state[f].values()), f))
            state[f].update(counts[grp])
            out[grp] = f
    return out


def shares_apart(rows, fold, folds):
    """The largest difference of a fold's share of a label from an even one."""
    by = defaultdict(Counter)
    for grp, label in rows:
        by[label][fold[grp]] += 1
    return max(abs(c[f] / sum(c.values()) - 1 / folds) for c in by.values() for f in range(folds))


def test_stratified_group_folds(spark):
    rng = random.Random(5)
    rows = []
    for g in range(300):
        for _ in range(rng.choice([1, 1, 1, 2, 3, 8])):
            rows.append((g, rng.choices(["a", "b", "c", None], [6, 3, 1, 1])[0]))
    rows += [(1000, "a")] * 40 + [(None, "b")] * 3
    items = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(rows)], "id long, grp long, label string").repartition(7)
    for seed in (42, 7):
        got = E.stratified_group_folds(items, 5, seed).collect()
        assert sorted(r.id for r in got) == list(range(len(rows)))
        fold = {r.grp: r.fold for r in got}
        assert all(fold[r.grp] == r.fold for r in got) and fold == dealt_one_by_one(rows, 5, seed)
        assert shares_apart(rows, fold, 5) < 0.03
    apart = {r.grp: r.fold for r in E.stratified_group_folds(items, 5, 42, kinds=16).collect()}  # kinds in several tasks
    assert len(apart) == 302 and shares_apart(rows, apart, 5) < 0.15
    assert E.stratified_group_folds(items.where("false")).count() == 0


def test_layout_by_landmarks(spark):
    rng = np.random.default_rng(3)
    plane = rng.normal(size=(700, 2)) * 4
    turned = plane @ np.linalg.qr(rng.normal(size=(6, 6)))[0][:2]  # a plane in six dimensions
    data = [(i, v.tolist()) for i, v in enumerate(turned)] + [(900, turned[5].tolist()), (901, None), (902, [float("nan")] * 6), (903, [1.0]), (904, [None] * 6)]
    got = {r.id: r for r in I.landmark_layout(spark.createDataFrame(data, "id long, v array<double>"), 2.0, 60).collect()}
    assert len(got) == 705 and all(got[i].x is None and got[i].error is None for i in (901, 902, 903, 904))
    at = np.array([[got[i].x, got[i].y] for i in range(700)])
    gap = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(gap(at) - gap(plane) / 2).max() < 0.1 and max(got[i].error for i in range(700)) < 0.05
    assert np.hypot(got[900].x - got[5].x, got[900].y - got[5].y) < 0.05
    assert I.landmark_layout(spark.createDataFrame([], "id long, v array<double>")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (None, 1), (4, 3), *[(k, k + 1) for k in range(20, 60)]], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **{k: 20 for k in range(20, 61)}}
    assert connected_components(edges.where("a > 100")).count() == 0


def test_votes(spark):
    near = spark.createDataFrame([(0, r + 1, f"c{r}") for r in range(4)], "test long, rank int, label string").withColumn("z", F.lit(1))
    got = {(r.k, r.label): r.prob for r in E.votes(near, ("z",), (1, 3, 7)).collect()}
    for k in (1, 3, 7):
        assert sum(v for (kk, _), v in got.items() if kk == k) == pytest.approx(1)
    assert got[3, "c0"] > got[3, "c1"] > got[3, "c2"] and (7, "c3") in got
    said = {r.k: r.pred for r in E.predictions(E.votes(near, ("z",), (1, 3, 7)), ("z",)).collect()}
    assert set(said.values()) == {"c0"}
    full = E.aligned(E.votes(near, ("z",), (1,)), spark.createDataFrame([("c0",), ("c9",)], "label string"), ("z",)).collect()
    assert {r.label: r.prob for r in full} == {"c0": 1.0, "c9": 0.0}


def test_leaks(spark, line):
    items, _ = line
    folds = E.grouped_folds(items, 5, F.lit(42))
    assert E.group_leaks(folds).count() == 0 and folds.groupBy("fold").count().collect()[0]["count"] == 5
    repeated = E.grouped_folds(items.withColumn("grp", F.lit("one")), 5, F.lit(42))
    assert repeated.select("fold").distinct().count() == 1
    with pytest.raises(ValueError, match="group leakage"):
        E.assert_group_separation(items.where("id < 3"), items.where("id > 1"))
    E.assert_group_separation(items.where("id < 3"), items.where("id > 2"))
    other = {(r.id, r.fold) for r in E.grouped_folds(items, 5, F.lit(43)).collect()}
    assert other != {(r.id, r.fold) for r in folds.collect()} == {(r.id, r.fold) for r in E.grouped_folds(items, 5, F.lit(42)).collect()}


def test_nested_evaluation(spark, line):
    items, dist = line
    results, picked = E.tuned_evaluation(dist, items, seeds=(2026,))
    assert results.count() == 25 and picked.count() == 5
    row = E.summarize("line", results).first()
    assert row.accuracy > 0.6 and row.mode_k in E.K_CANDIDATES
    ci = {r.metric: (r.low, r.high) for r in I.bootstrap_intervals(spark, results, 50).collect()}
    assert ci["accuracy"][0] <= row.accuracy <= ci["accuracy"][1]
    wide = E.summarize("line", staged(results, "r"), 50).first()
    assert wide.accuracy_low <= row.accuracy <= wide.accuracy_high and wide.macro_f1_low <= wide.macro_f1_high
    grid = dist.withColumn("w", F.lit(0.5)).unionByName(dist.withColumn("w", F.lit(0.1)))
    tuned, chosen = E.tuned_evaluation(grid, items, grid=("w",), seeds=(2026,))
    assert tuned.count() == 25 and {r.w for r in chosen.collect()} == {0.1}


def test_sensitivity_evaluates_each_cell_apart(spark, line):
    items, dist = line
    cells = None
    for n, w in ((48, 0.25), (96, 0.25), (48, 0.0)):
        one = dist.select(F.lit(n).alias("points"), F.lit(w).alias("weight"), "i", "j", (F.col("dist") + F.pmod(F.hash("i", "j", F.lit(n), F.lit(w)), F.lit(7))).alias("dist"))
        cells = one if cells is None else cells.unionByName(one)
    got = {(r.parameter, r.value): (r.fold_mean, r.fold_std) for r in E.sensitivity(cells, items, 96, seeds=(2026,)).collect()}
    assert got.keys() == {("resample_points", 48.0), ("resample_points", 96.0), ("velocity_weight", 0.25)}
    one = E.metrics(E.tuned_evaluation(cells.where("points = 96 AND weight = 0.25").drop("points", "weight"), items, seeds=(2026,))[0], ("fold",)).toPandas().accuracy
    assert got["resample_points", 96.0] == got["velocity_weight", 0.25] == pytest.approx((one.mean(), one.std())) != got["resample_points", 48.0]


def test_class_order_breaks_ties(spark):
    voted = spark.createDataFrame([(1, 0, 1, "a", 1, 0, 0.5), (1, 0, 1, "b", 1, 0, 0.5)], "z int, test long, k int, label string, n long, closeness long, prob double")
    assert E.predictions(voted, ("z",)).first().pred == "a" and E.predictions(voted, ("z",), ("b", "a")).first().pred == "b"
    probs = spark.createDataFrame([(0, "a", "a", 0.5), (0, "a", "b", 0.5)], "id long, label string, class string, prob double")
    assert M.best_class(probs).first().pred == "a" and M.best_class(probs, (), ("b", "a")).first().pred == "b"


def test_disagreements_come_first(spark):
    side = lambda preds: spark.createDataFrame([(i, label, p, 0.5) for (i, label), p in zip([("b", "x"), ("A", "x"), ("c", "x"), ("d", "y")], preds, strict=True)], "id string, label string, pred string, prob double")
    rows = E.disagreements({"m": side("xyyy"), "n": side("yyxy")}).collect()
    assert [(r.id, r.disagree) for r in rows] == [("b", 1), ("c", 1), ("A", 0)]
    assert [(r["rank"], r.id) for r in E.leading(side("xxxx"), 2, F.desc("id")).orderBy("rank").collect()] == [(1, "d"), (2, "c")]


def test_repeated_validation(spark, line):
    items, dist = line
    rows = items.withColumns({"x": F.col("id").cast("double"), "y": (F.col("id") % 5).cast("double")})
    grid = dist.withColumn("w", F.lit(0.5)).unionByName(dist.withColumn("w", F.lit(0.1)))
    runs, summary = M.repeated_validation({2026: (rows, grid)}, ["x", "y"], lambda t: M.fit_forest(t, ["x", "y"], 3), (23,), (2026,), ("w",))
    got = {(r.method, r.sample_seed, r.outer_seed): r for r in runs.collect()}
    assert set(got) == {(m, 2026, s) for m in ("tuned_mhd", "rf", "fusion") for s in (23,)}
    plain = E.summarize("t", E.tuned_evaluation(grid, rows, 23, grid=("w",), seeds=(2026,))[0]).first()
    assert got["tuned_mhd", 2026, 23].accuracy == pytest.approx(plain.accuracy) and got["tuned_mhd", 2026, 23].fold_std == pytest.approx(plain.fold_std)
    assert {r.method: r.runs for r in summary.collect()} == {"tuned_mhd": 1, "rf": 1, "fusion": 1}


def test_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("a", "z")]
    got = E.metrics(spark.createDataFrame(rows, "label string, pred string")).first()
    assert got.accuracy == pytest.approx(3 / 5) and got.balanced_accuracy == pytest.approx((1 / 3 + 1) / 2) and got.macro_f1 == pytest.approx((0.5 + 0.8 + 0) / 3)


def runs_45(spark):
    rows = [(s, o, m, v, v, v) for s in (2026, 2027, 2028) for o in E.OUTER_SEEDS for m, v in (("mhd", 0.40), ("rf", 0.56), ("fusion", 0.54))]
    return spark.createDataFrame(rows, "sample_seed int, outer_seed int, method string, accuracy double, balanced_accuracy double, macro_f1 double")


def test_runs(spark):
    runs = runs_45(spark)
    got = {r.method: r for r in E.run_summary(runs).collect()}
    assert got["rf"].runs == 15 and got["rf"].sample_seeds == 3 and got["rf"].accuracy_std == pytest.approx(0)
    for a, b, want in (("mhd", "rf", -0.16), ("rf", "fusion", 0.02)):
        r = I.paired_bootstrap(spark, I.paired_differences(runs, a, b), 200).first()
        assert r["mean"] == pytest.approx(want) and r.low == pytest.approx(want) and r.n == 15


def test_statistics(spark, line):
    items, dist = line
    pairs = I.labelled_pairs(dist.where("i < j"), items)
    p = pairs.toPandas()
    w, b = p.dist[p.same == 1].to_numpy(), p.dist[p.same == 0].to_numpy()
    auc = ((w[:, None] < b).sum() + 0.5 * (w[:, None] == b).sum()) / (len(w) * len(b))
    assert I.pair_auc(pairs).first().auc == pytest.approx(auc)
    s = I.distance_statistics(pairs).first()
    assert s.gap == pytest.approx(b.mean() - w.mean()) and s.within_median == np.median(w)
    t = I.permutation_test(spark, dist.where("i < j"), items, 99).first()
    assert t.p == pytest.approx(0.01) and t.observed == pytest.approx(s.gap)
    with pytest.raises(ValueError, match="several labels"):
        I.permutation_test(spark, dist, items.withColumn("grp", F.lit("x")), 9)
    rng = np.random.default_rng(4)
    loose = spark.createDataFrame([(i, f"g{i % 13}", f"c{i % 13 % 3}") for i in range(40)], "id long, grp string, label string")
    noise = {(i, j): float(rng.random()) for i in range(40) for j in range(i + 1, 40)}
    t = I.permutation_test(spark, spark.createDataFrame([(i, j, d) for (i, j), d in noise.items()], "i long, j long, dist double"), loose, 60, block=7, batch=9).first()
    groups = sorted({f"g{i % 13}" for i in range(40)})
    own = np.array([int(g[1:]) % 3 for g in groups])

    def gap(of_group):
        c = [of_group[groups.index(f"g{i % 13}")] for i in range(40)]
        same = np.array([c[i] == c[j] for i, j in noise])
        d = np.array(list(noise.values()))
        return d[~same].mean() - d[same].mean()

    hits = sum(gap(np.random.default_rng([2026, k]).permutation(own)) >= gap(own) - 1e-12 for k in range(60))
    assert t.observed == pytest.approx(gap(own)) and t.p == pytest.approx((1 + hits) / 61)
    m = rng.integers(0, 9, 500) / 4
    some = spark.createDataFrame([(float(v), int(k)) for k, v in enumerate(m)], "dist double, same int").withColumn("same", F.col("same") % 2)
    q = I.quantiles(*I.ranked_values(some), {"a": ("w", 0.3), "z": ("b", 0.995)}).first()
    assert q.a == pytest.approx(np.quantile(m[1::2], 0.3)) and q.z == pytest.approx(np.quantile(m[::2], 0.995))
    assert I.label_mean_matrix(pairs).count() == 25
    h = I.distance_histogram(pairs, 10).toPandas()
    assert (h.between * 1.0).sum() > 0
    x, stress = I.mds(np.abs(np.arange(8)[:, None] - np.arange(8)[None]).astype(float))
    assert x.shape == (8, 2) and stress < 1


def test_mcnemar_and_holm(spark):
    a = spark.createDataFrame([(i, "x", "x" if i < 8 else "y") for i in range(10)], "id long, label string, pred string")
    b = spark.createDataFrame([(i, "x", "x" if i > 7 else "y") for i in range(10)], "id long, label string, pred string")
    r = I.mcnemar(a, b, "a vs b").first()
    assert (r.a_only, r.b_only) == (8, 2) and r.p == pytest.approx(2 * (1 + 10 + 45) / 1024)
    assert I.mcnemar(a, a, "same").first().p == 1.0
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "comparison string, p double")
    assert [(q.comparison, round(q.p_holm, 6)) for q in I.holm(p).orderBy("p").collect()] == [("a", 0.03), ("c", 0.06), ("b", 0.06)]


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("Classical/a.mid", "Classical", "one", "s1", "m1"), ("Jazz/renamed.mid", "Jazz", "two", "s1", None), ("Jazz/b.mid", "Jazz", "three", "s3", ""), ("Jazz/c.mid", "Jazz", "three", "s4", ""),
        ("Classical/d.mid", "Classical", "four", "s5", None), ("Classical/e.mid", "Classical", "five", "s6", None), ("Jazz/f.mid", "Jazz", "six", None, None),
    ]
    return spark.createDataFrame(rows, "path string, genre string, canonical_title string, sha256 string, melody_fingerprint string")


def test_duplicates_and_sample(spark, files):
    labelled = dedup.duplicate_labels(files)
    groups = {r.label: r for r in dedup.duplicate_groups(labelled).collect()}
    assert len(groups) == 5 and groups["Classical/a.mid"].cross_genre == 1 and groups["Classical/a.mid"].versions == 2 and groups["Jazz/b.mid"].versions == 2
    conflict = dedup.conflict_summary(dedup.duplicate_groups(labelled)).collect()
    assert [(r.genres, r.group_count, r.versions) for r in conflict] == [("Classical/Jazz", 1, 2)]
    sample = dedup.checked_sample(dedup.balanced_sample(labelled, 2, 2026))
    assert sorted(r.genre for r in sample.collect()) == ["Classical", "Classical", "Jazz", "Jazz"]
    assert {r.path for r in sample.collect()} == {r.path for r in dedup.balanced_sample(labelled, 2, 2026).collect()}
    many = spark.createDataFrame([(f"Jazz/group-{k:02d}", "Jazz", f"t{k}", None, None) for k in range(20)], files.schema).withColumn("label", F.col("path"))
    order = lambda seed: [r.path for r in dedup.balanced_sample(many, 20, seed).orderBy("position").collect()]
    assert order(2026) == order(2026) != order(2027)
    audit = {r.genre: r for r in dedup.data_audit(labelled, 2, 2026).collect()}
    assert audit["TOTAL"].raw == 7 and audit["TOTAL"].cross_genre_groups == 1 and audit["TOTAL"].selected == 4
    assert {r.identifier: r.duplicate_sets for r in dedup.identifier_audit(files).collect()} == {"canonical_title": 1, "sha256": 1, "melody_fingerprint": 0}
    with pytest.raises(ValueError, match="no usable"):
        dedup.checked_sample(dedup.balanced_sample(labelled, 2, 1, "false"))


def test_sampling_reads_few_files(spark):
    """Planted broken versions: the sample is that of a filter beforehand, and few files are read for it, none twice."""
    rng = np.random.default_rng(9)
    rows = [(f"{g}/{i}-{v}", g, f"{g}/{i}", int(rng.random() < 0.6)) for g in ("Jazz", "Rock") for i in range(60) for v in range(int(rng.integers(1, 4)))]
    rows += [(f"both/{i}", g, "both", 1) for i, g in enumerate(("Jazz", "Rock"))]
    files = spark.createDataFrame(rows, "path string, genre string, label string, fine int")
    seen = []

    def parse(some):
        seen.extend(r.path for r in some.collect())
        return some.where("fine = 1")

    got, read = dedup.sample_by_rounds(files, 12, 5, parse)
    want = dedup.balanced_sample(files, 12, 5, "fine = 1")
    columns = ["genre", "label", "path", "position"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())) and got.count() == 24
    assert read == len(seen) == len(set(seen)) < 60
    assert dedup.sample_by_rounds(files, 12, 5, lambda some: some.where("false"))[0].count() == 0
    with pytest.raises(RuntimeError):
        dedup.sample_by_rounds(files, 60, 5, lambda some: some.where("fine = 1"), 1)


def test_models(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"g{i}", "ab"[i % 2], float(i % 2 + rng.normal() * 0.2), float(rng.normal())) for i in range(40)]
    items = spark.createDataFrame(rows, "id long, grp string, label string, good double, noise double")
    cols = ["good", "noise"]
    forest = M.cross_validated(items, cols, lambda t: M.fit_forest(t, cols, 10), folds=3)
    assert E.metrics(M.best_class(forest)).first().accuracy > 0.8
    logit = M.cross_validated(items, cols, lambda t: M.fit_logistic(t, cols), folds=3)
    assert E.metrics(M.best_class(logit)).first().accuracy > 0.8
    dist = spark.createDataFrame([(a[0], b[0], abs(a[3] - b[3])) for a in rows for b in rows if a[0] != b[0]], "i long, j long, dist double")
    fused = M.nested_fusion(items, dist, cols, lambda t: M.fit_forest(t, cols, 5), folds=2, inner=2)
    assert fused.count() == 40 and E.metrics(fused).first().accuracy > 0.8
    assert M.nested_logistic(items, cols, 2, inner_seeds=(1,)).count() == 80
    drops = {r.feature: r.importance for r in M.importance_summary(M.permutation_importance(M.fit_forest(items, cols, 10), items, {c: [c] for c in cols}, 3)).collect()}
    assert drops["good"] > drops["noise"]
    change = {r.removed: r.change for r in M.feature_ablation(items, {c: [c] for c in cols}, lambda t, c: M.fit_logistic(t, c), folds=2).collect()}
    assert change["good"] < -0.2 < change["noise"]


def test_fusion_chooses_the_distance_too(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"g{i}", "ab"[i % 2], float(i % 2 + rng.normal() * 0.1), float(rng.normal())) for i in range(24)]
    items = spark.createDataFrame(rows, "id long, grp string, label string, good double, noise double")
    cells = [(p, w, a[0], b[0], abs(a[k] - b[k])) for p, w, k in ((8, 0.0, 4), (16, 0.5, 3)) for a in rows for b in rows if a[0] != b[0]]
    dist = spark.createDataFrame(cells, "points int, weight double, i long, j long, dist double")
    fits = []
    small = lambda n: lambda t: fits.append(n) or M.fit_forest(t, ["noise"], n)
    got = M.nested_fusion(items, dist, ["noise"], small(2), folds=2, inner=2, inner_seeds=(1, 2), grid=("points", "weight"), inner_fit=small(1)).collect()
    assert len(got) == 24 and {(r.points, r.weight) for r in got} == {(16, 0.5)} and sum(r.label == r.pred for r in got) > 20
    assert sorted(fits) == [1] * 8 + [2] * 2


def test_importance_is_of_held_out_rows(spark):
    rows = [(i, f"g{i}", "ab"[i % 2], float(i * 0.37 % 1)) for i in range(30)]
    items = spark.createDataFrame(rows, "id long, grp string, label string, x double")
    seen = []
    drops = M.heldout_importance(items, {"x": ["x"]}, lambda t: seen.append({r.id for r in t.collect()}) or M.fit_forest(t, ["x"], 2), folds=3, repeats=2).collect()
    assert sorted((r.fold, r.repeat) for r in drops) == [(f, r) for f in range(3) for r in range(2)]
    assert all(len(s) == 20 for s in seen) and not set.intersection(*seen)


def test_tables_in_and_out(spark, tmp_path):
    df = spark.createDataFrame([("é", 1)], "a string, b int")
    write_csv(df, str(tmp_path / "t"))
    assert read_csv(spark, str(tmp_path / "t"), "a string, b int").collect() == df.collect()
    write_csv(df.where("b > 1"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfx,y\n1,2\n")
    assert read_csv(spark, str(tmp_path / "bom.csv")).columns == ["x", "y"]
    assert (tmp_path / "t").exists() and next((tmp_path / "t").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfa,b")
    with pytest.raises(ValueError):
        write_json({"a": float("nan")}, str(tmp_path / "j"))
    write_json({"a": "é"}, str(tmp_path / "j"))
    assert (tmp_path / "j").read_text() == '{\n  "a": "é"\n}' and get_text(str(tmp_path / "j")) == '{\n  "a": "é"\n}' and get_text(str(tmp_path / "none")) is None
    both = frame_of(spark, [{"b": 1, "a": None}, {"c": "x"}])
    assert both.columns == ["b", "a", "c"] and [tuple(r) for r in both.collect()] == [("1", None, None), (None, None, "x")]
    cells = spark.createDataFrame([(a, b, float(i)) for i, (a, b) in enumerate([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")])], "label_a string, label_b string, mean_dist double")
    write_matrix_csv(cells, ["y", "x"], str(tmp_path / "m"))
    assert next((tmp_path / "m").glob("*.csv")).read_text() == "y,x\n3.0,2.0\n1.0,0.0\n"
    assert json_ready({"a": np.float64(2), "b": np.zeros(3), "c": float("inf")}) == {"a": 2.0, "c": None}
    assert cache_path("r", "mhd", seed=1, points=96) == "r/mhd/version=v4/points=96/seed=1"
