"""Registered queries against their SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from curvelark.operators import distance, inference, models
from curvelark.plans import bases as B
from curvelark.plans.catalog import ORACLES, QUERIES
from jobs.registered import QUERIES as JOBS

CHEAP = ["skyline", "resample_in_time", "melody_fingerprint", "features_rhythm", "canonical_titles", "document_duplicate_groups", "dedup_audit", "midi_note_ons", "curve_phase_rmse", "knn_probabilities", "knn_pivots", "mcnemar_holm", "pair_auc", "synthetic_robustness", "fold_leak_check", "aligned_probabilities", "distance_checks", "top_disagreements", "base_distances", "distance_statistics", "distance_histogram", "grouped_folds", "stratified_group_folds"]


def tables(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}{'/*.parquet' if os.path.isdir(f'{sf}/{f}') else ''}')")
    return c


def rows(frame):
    cell = lambda v: None if not hasattr(v, "__len__") and pd.isna(v) else round(v, 6) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), tables(sf).sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract(spark, sf):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_contract_without_the_subpackage(tmp_path):
    """The entry, from a copy without the subpackage: whether corpus_pipeline.py is left over or gone."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "curvelark", tmp_path / "curvelark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    for left in (True, False):
        (tmp_path / "corpus_pipeline.py").write_text("import curvelark.llm.bpe\n") if left else (tmp_path / "corpus_pipeline.py").unlink()
        out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        assert out.stdout.split()[-3:] == [str(len(QUERIES) + len(JOBS)), "True", "False"]


def test_grids_are_whole(spark, sf):
    n = B.melodies(spark, sf).select("piece_id").distinct().count()
    pairs = n * (n - 1) // 2
    mhd = {(r.points, r.weight): r["count"] for r in QUERIES["mhd_grid"](spark, sf).groupBy("points", "weight").count().collect()}
    assert mhd == {(p, w): pairs for p in (48, 72, 96) for w in (0.0, 0.1, 0.25, 0.5)}
    dtw = {(r.points, r.weight, r.window): r["count"] for r in QUERIES["dtw_grid"](spark, sf).groupBy("points", "weight", "window").count().collect()}
    assert dtw == {(p, w, s): pairs for p in (36, 48) for w in (0.0, 0.25, 0.5) for s in (0.1, 0.2)}


def test_base_distances_have_96_points(spark, sf):
    got, want = QUERIES["base_distances"](spark, sf), distance.base_distances(B.curves(spark, sf, 96))
    assert rows(got.toPandas()) == rows(want.toPandas())


def test_model_queries_run_the_whole_job(spark, sf, monkeypatch):
    trees, stacks, fusions, ablations, tests = [], [], [], [], []
    fit = models.fit_forest
    monkeypatch.setattr(models, "fit_forest", lambda t, cols, n=500, seed=42: trees.append(n) or fit(t, cols, 1, seed))
    QUERIES["rf_eval"](spark, sf)
    assert trees == [500] * 5
    trees.clear()
    QUERIES["permutation_importance"](spark, sf)
    assert trees == [500] * 5
    stacked = models.Stacked
    monkeypatch.setattr(models, "Stacked", lambda rows, n_sets, n_classes, costs: stacks.append((n_sets, costs)) or stacked(rows, n_sets, n_classes, costs))
    monkeypatch.setattr(stacked, "fit", lambda self: np.zeros((len(self.sets), self.n_classes, self.dim + 1)))
    QUERIES["logistic_eval"](spark, sf)
    assert stacks == [(5 * 3 * 3 + 5, (0.01, 0.1, 1.0, 10.0))]
    stub = spark.createDataFrame([("a", "a", 1.0)], "label string, pred string, prob double")
    monkeypatch.setattr(models, "nested_fusion", lambda items, dist, cols, fit, **kw: fusions.append((dist.select("points", "weight").distinct().count(), kw["grid"], fit, kw["inner_fit"])) or stub)
    QUERIES["fusion_eval"](spark, sf)
    assert fusions[0][:2] == (12, ("points", "weight"))
    monkeypatch.setattr(models, "feature_ablation", lambda items, groups, fit, seeds: ablations.append((seeds, fit)) or stub)
    QUERIES["feature_ablation"](spark, sf)
    assert [s for s, _ in ablations] == [(11, 23, 42, 67, 101)]
    trees.clear()
    monkeypatch.setattr(models, "fit_forest", lambda t, cols, n=500, seed=42: trees.append(n))
    fusions[0][2](None), fusions[0][3](None), ablations[0][1](None, [])
    assert trees == [500, 250, 400]
    monkeypatch.setattr(inference, "permutation_test", lambda s, pairs, items, iterations=9999: tests.append(iterations))
    QUERIES["permutation_test"](spark, sf)
    assert tests == [9999]
