"""Both jobs on copies of the tables: growing input, runs that find nothing new, runs that were cut off, and the command line."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from curvelark.plans import bases as B
from jobs import curve_cells, duplicate_register
from jobs.registered import ORACLES, QUERIES
from tests.test_queries import rows, tables

ROOT = Path(duplicate_register.__file__).parent.parent
KINDS = ("canonical_title", "sha256", "melody_fingerprint")


def register(spark, out):
    return sorted(map(tuple, spark.read.schema(duplicate_register.REGISTER).parquet(f"{out}/register").drop("batch", "part").collect()))


def expected(documents):
    files, out = B.files_of(documents).collect(), {}
    for kind in KINDS:
        for f in files:
            if f[kind]:
                out.setdefault((kind, f[kind]), []).append(f)
    path = lambda fs: min((f.path for f in fs if f.path is not None), default=None)
    return sorted(((k, v, len(fs), path(fs), len({f.genre for f in fs}), "/".join(sorted({f.genre for f in fs}))) for (k, v), fs in out.items()), key=str)


@pytest.mark.parametrize("per_trigger", [1, 64])
def test_register_takes_only_what_is_new(spark, sf, tmp_path, per_trigger):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, out, mark = f"file://{tmp_path}/documents", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    run = lambda: duplicate_register.run(spark, at, out, mark, {"files_per_trigger": per_trigger, "parts": 5})
    first, second, odd = docs.where("doc_id < 90"), docs.where("doc_id >= 90"), docs.where("doc_id < 4").withColumn("text", F.when(F.col("doc_id") > 1, F.col("text"))).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    first.coalesce(1).write.parquet(at)
    got = run()
    assert (got["read"], got["batches"]) == (first.count(), 1) and sorted(register(spark, out), key=str) == expected(first)
    second.repartition(2).write.mode("append").parquet(at)
    odd.coalesce(1).write.mode("append").parquet(at)  # copies of earlier ones, null texts and a null id
    got = run()
    whole = spark.read.parquet(at)
    assert (got["read"], got["batches"]) == (second.count() + 4, 3 if per_trigger == 1 else 1)
    assert sorted(register(spark, out), key=str) == expected(whole)
    assert run() == {"read": 0, "batches": 0, "parts": []} and sorted(register(spark, out), key=str) == expected(whole)


def test_only_touched_parts_are_made_anew(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, out, mark = f"file://{tmp_path}/documents", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    docs.coalesce(1).write.parquet(at)
    duplicate_register.run(spark, at, out, mark, {"parts": 64})
    docs.where("doc_id = 7").write.mode("append").parquet(at)
    late = duplicate_register.run(spark, at, out, mark, {"parts": 64})["parts"]
    assert 1 <= len(late) <= 3
    held = {r.part: r.batch for r in spark.read.schema(duplicate_register.REGISTER).parquet(f"{out}/register").groupBy("part").agg(F.max("batch").alias("batch")).collect()}
    assert {p for p, b in held.items() if b == 1} == set(late)


def test_a_run_that_was_cut_off_is_made_good(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, out, mark = f"file://{tmp_path}/documents", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    docs.where("doc_id < 50").coalesce(1).write.parquet(at)
    duplicate_register.run(spark, at, out, mark)
    docs.where("doc_id >= 50").coalesce(1).write.mode("append").parquet(at)
    put, calls = duplicate_register.put, []

    def breaks(rows, path, *by):
        put(rows, path, *by)
        calls.append(path)
        raise OSError("gone")  # the batch is written, but not marked as taken

    monkeypatch.setattr(duplicate_register, "put", breaks)
    with pytest.raises(Exception, match="gone"):
        duplicate_register.run(spark, at, out, mark)
    assert calls == [f"{out}/deltas"]
    monkeypatch.setattr(duplicate_register, "put", put)
    assert duplicate_register.run(spark, at, out, mark)["read"] == docs.where("doc_id >= 50").count()
    assert sorted(register(spark, out), key=str) == expected(docs)


def test_register_without_documents(spark, sf, tmp_path):
    at, out, mark = f"file://{tmp_path}/documents", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(at)
    assert duplicate_register.run(spark, at, out, mark)["read"] == 0
    assert register(spark, out) == []


@pytest.mark.parametrize("name", ["job1_duplicate_register", "job2_curve_cells"])
def test_queries_against_sql(spark, sf, name):
    before = dict(spark.sparkContext.getConf().getAll())
    got, want = QUERIES[name](spark, sf).toPandas(), tables(sf).sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert dict(spark.sparkContext.getConf().getAll()) == before


def cells(spark, out):
    return {(r.points, r.weight): (r.signature, r.pairs) for r in spark.read.schema(curve_cells.CELLS).parquet(f"{out}/cells").collect()}


def stored_rows(spark, out, name, schema):
    return sorted(map(tuple, spark.read.schema(schema).parquet(f"{out}/{name}").collect()))


def test_cells_are_computed_once(spark, sf, tmp_path, monkeypatch):
    """A grid that is cut off goes on where it was, a longer one adds its cells, and other events replace all."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    at, out, alone = f"file://{tmp_path}/events", f"file://{tmp_path}/out", f"file://{tmp_path}/alone"
    users = sorted(r.user_id for r in B.melodies(spark, sf).select(F.col("piece_id").alias("user_id")).distinct().collect())
    events.where(F.col("user_id").isin(users[:10])).write.parquet(at)
    config = {"points": [8, 12], "weights": [0.0, 0.5], "neighbours": 3}
    grid, asked = curve_cells.mhd_grid, []

    def counted(melodies, points, weights):
        asked.append((points, weights))
        if len(asked) == 2:
            raise OSError("gone")
        return grid(melodies, points, weights)

    monkeypatch.setattr(curve_cells, "mhd_grid", counted)
    with pytest.raises(OSError):
        curve_cells.run(spark, at, out, config)
    assert set(cells(spark, out)) == {(8, 0.0), (8, 0.5)}
    assert curve_cells.run(spark, at, out, config) == [(12, 0.0), (12, 0.5)]
    assert curve_cells.run(spark, at, out, config) == []
    assert curve_cells.run(spark, at, out, config | {"weights": [0.0, 0.25, 0.5]}) == [(8, 0.25), (12, 0.25)]
    assert asked == [((8,), (0.0, 0.5)), ((12,), (0.0, 0.5)), ((12,), (0.0, 0.5)), ((8,), (0.25,)), ((12,), (0.25,))]
    known = cells(spark, out)
    assert len(set(known.values())) == 1 and {p for _, p in known.values()} == {45}
    events.where(F.col("user_id").isin(users[10:13])).write.mode("append").parquet(at)
    assert len(curve_cells.run(spark, at, out, config | {"weights": [0.0, 0.25, 0.5]})) == 6
    assert {p for _, p in cells(spark, out).values()} == {78}
    curve_cells.run(spark, at, alone, config | {"weights": [0.0, 0.25, 0.5]})
    for name, schema in (("distances", curve_cells.DISTANCES), ("neighbours", curve_cells.NEIGHBOURS)):
        assert stored_rows(spark, out, name, schema) == stored_rows(spark, alone, name, schema)


def test_neighbours_of_a_cell(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.1)], "i long, j long, mhd double")
    assert sorted(map(tuple, curve_cells.nearest(pairs, 1).collect())) == [(1, 1, 2, 0.5), (2, 1, 3, 0.1), (3, 1, 2, 0.1)]


def test_no_events(spark, sf, tmp_path):
    """Also after a run on many."""
    at = f"file://{tmp_path}"
    curve_cells.run(spark, f"{sf}/events.parquet", f"{at}/out", {"points": [8], "weights": [0.0]})
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{at}/events")
    assert len(curve_cells.run(spark, f"{at}/events", f"{at}/out", {"points": [8], "weights": [0.0]})) == 1
    assert spark.read.schema(curve_cells.NEIGHBOURS).parquet(f"{at}/out/neighbours").count() == 0


@pytest.mark.parametrize("job, args", [("duplicate_register", ["--documents", "{sf}/documents.parquet", "--out", "{at}/out", "--checkpoint", "{at}/mark"]), ("curve_cells", ["--events", "{sf}/events.parquet", "--out", "{at}/out", "--config", "{at}/small.json"])])
def test_command_line(spark, sf, tmp_path, job, args):
    (tmp_path / "small.json").write_text('{"points": [8], "weights": [0.0], "neighbours": 2, "min_onsets": 32}')
    got = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{job}.py"), *(a.format(sf=sf, at=tmp_path) for a in args)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    assert f"{job} " in got.stderr
    assert spark.read.parquet(f"file://{tmp_path}/out/{'register' if job == 'duplicate_register' else 'neighbours'}").count() > 0
