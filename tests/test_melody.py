import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelark.functions.scalars import FEATURE_GROUPS, FEATURES, ascii_title, feature_group, group_id, latex_conflicts, latex_escape, latex_macros, point_distance, title_of
from curvelark.operators.melody import load_pieces, melody_features, minmax_curve, relative_curve, resample


@pytest.fixture(scope="module")
def wave(spark):
    i = np.arange(40)
    return i * 0.5, 60 + 5 * np.sin(i), 70 + 10 * np.cos(i)


@pytest.fixture(scope="module")
def melody(spark, wave):
    return spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(*wave)], "piece_id long, beat double, pitch double, velocity double")


def test_groups_hold_each_descriptor_once():
    assert len(FEATURES) == len(set(FEATURES)) == 55
    assert {g: len(v) for g, v in FEATURE_GROUPS.items()} == {"scale": 3, "pitch": 5, "interval_contour": 18, "dynamics": 6, "rhythm": 8, "tonality": 15}
    assert feature_group("pc_3") == "tonality" and feature_group("x") is None


def test_features_against_numpy(spark, melody, wave):
    t, p, v = wave
    got = melody_features(melody).first().asDict()
    iv, ioi = np.diff(p), np.diff(t)
    assert got["pitch_std"] == pytest.approx(p.std())
    assert got["pitch_q10"] == pytest.approx(np.quantile(p, 0.1))
    assert got["contour_slope"] == pytest.approx(np.polyfit((t - t[0]) / (t[-1] - t[0]), p - p.mean(), 1)[0])
    assert got["pitch_autocorrelation"] == pytest.approx(np.corrcoef(p[:-1], p[1:])[0, 1])
    assert got["pitch_velocity_correlation"] == pytest.approx(np.corrcoef(p, v)[0, 1])
    assert got["direction_change"] == pytest.approx(np.mean(np.sign(iv[1:]) * np.sign(iv[:-1]) < 0))
    assert got["velocity_change_std"] == pytest.approx(np.diff(v).std())
    assert got["ioi_mean"] == pytest.approx(ioi.mean()) and got["ioi_entropy"] == 0
    h = np.bincount(np.clip(np.rint(iv).astype(int), -12, 12) + 12, minlength=25) / len(iv)
    assert got["interval_entropy"] == pytest.approx(-(h[h > 0] * np.log2(h[h > 0])).sum())
    assert all(np.isfinite(x) for x in got.values())


def test_constant_melody_has_no_correlations(spark):
    flat = spark.createDataFrame([(7, float(i), 60.0, 64.0) for i in range(34)], "piece_id long, beat double, pitch double, velocity double")
    got = melody_features(flat).first()
    assert got.pitch_autocorrelation == got.pitch_velocity_correlation == got.interval_entropy == 0 and got.pc_0 == 1


def test_resampling_is_linear_interpolation(spark, melody, wave):
    t, p, v = wave
    got = resample(melody, 96).orderBy("k").toPandas()
    grid = np.linspace(0, 1, 96)
    phase = (t - t[0]) / (t[-1] - t[0])
    assert len(got) == 96
    assert np.allclose(got.pitch, np.interp(grid, phase, p)) and np.allclose(got.velocity, np.interp(grid, phase, v))
    one = spark.createDataFrame([(1, 0.0, 60.0, 60.0)], "piece_id long, beat double, pitch double, velocity double")
    assert resample(one, 8).count() == 0


def test_curves(spark):
    c = spark.createDataFrame([(1, 0, 0.0, 60.0, 64.0), (1, 1, 1.0, 72.0, 64.0)], "piece_id long, k int, t double, pitch double, velocity double")
    assert [tuple(r)[2:] for r in minmax_curve(c).orderBy("k").collect()] == [(0.0, 0.0, 0.5), (1.0, 1.0, 0.5)]
    assert [tuple(r)[2:] for r in relative_curve(c).orderBy("k").collect()] == [(0.0, -0.5, 0.0), (1.0, 0.5, 0.0)]


def test_pieces(spark, melody):
    notes = melody.select("piece_id", F.lit(4).alias("division"), (F.col("beat") * 4).cast("long").alias("tick"), F.col("pitch").cast("int").alias("pitch"), F.col("velocity").cast("int").alias("velocity"))
    got = load_pieces(notes, 24).first()
    assert got.onsets == 40 and len(got.curve) == 24 and got.duration == 19.5


TITLES = [
    ("Sinfonia 5.mid", "sinfonia5"), ("For Your Precious Love_1.mid", "foryourpreciouslove"), ("Maple Leaf Rag (LP Version).mid", "mapleleafrag"), ("Maple Leaf Rag.mid", "mapleleafrag"),
    ("Live and Let Die.mid", "untitled-live and let die.mid"), ("song_live.mid", "songlive"), ("Alive.mid", "alive"), ("Song - Take 2.mid", "song"), ("Song-3.mid", "song"), ("a/b/Song [Demo 1999].mid", "song"),
]


def test_titles(spark):
    assert [title_of(n) for n, _ in TITLES] == [t for _, t in TITLES]
    assert title_of("Café.mid") == "cafe"
    df = spark.createDataFrame(TITLES, "name string, want string")
    assert [r.want for r in df.collect()] == [r.t for r in df.select(ascii_title(F.col("name")).alias("t")).collect()]


def test_small_scalars(spark):
    row = spark.range(1).select(group_id(F.array(F.lit("b"), F.lit("a"))).alias("g"), point_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("d")).first()
    assert row.g.startswith("grp_") and len(row.g) == 20 and row.d == 5
    assert latex_escape("a_b & 5%") == r"a\_b \& 5\%"
    assert latex_macros({"x": 1.239}) == "\\newcommand{\\x}{1.24}\n"
    rows = [{"genres": g, "group_count": n, "versions": n, "title": "t" * 80} for g, n in (("b", 1), ("a", 1), ("c", 2))]
    assert [line[0] for line in latex_conflicts(rows, 2).splitlines()] == ["c", "a"]
