"""From note-ons to melodies, curves, fingerprints and descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.scalars import FEATURES


def _piece() -> WindowSpec:
    return W.partitionBy("piece_id")


def _order() -> WindowSpec:
    return _piece().orderBy("beat")


def skyline(notes: DataFrame, min_onsets: int = 32) -> DataFrame:
    """(piece_id, division, tick, pitch, velocity) -> (piece_id, beat, pitch, velocity): of each tick the highest, then loudest, note; pieces with fewer than ``min_onsets`` onsets go."""
    top = (
        notes.where("velocity > 0")
        .groupBy("piece_id", "tick")
        .agg(F.max(F.struct("pitch", "velocity")).alias("top"), F.first("division").alias("division"))
        .select("piece_id", (F.col("tick") / F.col("division")).alias("beat"), F.col("top.pitch").alias("pitch"), F.col("top.velocity").alias("velocity"))
    )
    if min_onsets <= 0:
        return top
    return top.withColumn("_n", F.count("*").over(_piece())).where(F.col("_n") >= min_onsets).drop("_n")


def resample(melody: DataFrame, points: int) -> DataFrame:
    """(piece_id, k, t, pitch, velocity): piecewise linear at ``points`` even steps of time.

    Each segment makes its own grid points, so there is no range join. Times that do not increase are dropped, and so are
    pieces of one onset.
    """
    steps = points - 1
    seg = (
        melody.withColumn("_last", F.lag("beat").over(_order())).where("_last IS NULL OR beat > _last")
        .withColumns({"_b0": F.min("beat").over(_piece()), "_b1": F.max("beat").over(_piece())})
        .where("_b1 > _b0")
        .withColumn("p0", (F.col("beat") - F.col("_b0")) / (F.col("_b1") - F.col("_b0")))
        .withColumns({"p1": F.lead("p0").over(_order()), "_q": F.lead("pitch").over(_order()), "_v": F.lead("velocity").over(_order())})
        .where("p1 IS NOT NULL")
        .withColumn("k", F.explode(F.sequence(F.floor(F.col("p0") * steps).cast("int"), F.ceil(F.col("p1") * steps).cast("int"))))
        .withColumn("t", F.col("k") / F.lit(float(steps)))
        .where("t >= p0 AND (t < p1 OR (p1 = 1 AND t = 1))")
    )
    share = (F.col("t") - F.col("p0")) / (F.col("p1") - F.col("p0"))
    return seg.select("piece_id", "k", "t", (F.col("pitch") + share * (F.col("_q") - F.col("pitch"))).alias("pitch"), (F.col("velocity") + share * (F.col("_v") - F.col("velocity"))).alias("velocity"))


def resample_selected(melody: DataFrame, sample: DataFrame, points: int) -> DataFrame:
    """The curves, of any number of points, of the pieces that a sample (piece_id) holds: the same pieces again, read anew."""
    return resample(melody.join(sample.select("piece_id").distinct(), "piece_id", "left_semi"), points)


def minmax_curve(curve: DataFrame) -> DataFrame:
    """Each coordinate of each piece scaled to 0..1; without extent it is 0.5."""

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(_piece()), F.max(c).over(_piece())
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)

    return curve.select("piece_id", "k", *(scaled(c).alias(c) for c in ("t", "pitch", "velocity")))


def relative_curve(curve: DataFrame, weight: float = 0.25) -> DataFrame:
    """Phase, octaves from the median pitch, and weighted loudness from the middle of the scale."""
    median = F.expr("percentile(pitch, 0.5)").over(_piece())
    return curve.select("piece_id", "k", "t", ((F.col("pitch") - median) / 12).alias("pitch"), (weight * (F.col("velocity") - 64) / 32).alias("velocity"))


def melody_fingerprint(melody: DataFrame) -> DataFrame:
    """(piece_id, melody_fingerprint): SHA-256 of phase and relative pitch, both rounded half to even, as big-endian 32-bit integers after their number; null for fewer than two events."""
    lo, hi = F.min("beat").over(_piece()), F.max("beat").over(_piece())
    hex8 = lambda x: F.right(F.lpad(F.hex(x.cast("long")), F.lit(16), F.lit("0")), F.lit(8))
    rows = melody.select(
        "piece_id", "beat",
        F.rint((F.col("beat") - lo) / F.greatest(hi - lo, F.lit(1e-12)) * 10000).alias("a"),
        F.rint(F.col("pitch") - F.expr("percentile(pitch, 0.5)").over(_piece())).alias("b"),
    )
    listed = rows.groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("beat", "a", "b"))).alias("e"))
    body = F.array_join(F.transform("e", lambda x: F.concat(hex8(x["a"]), hex8(x["b"]))), "")
    return listed.select("piece_id", F.when(F.size("e") >= 2, F.sha2(F.unhex(F.concat(hex8(F.size("e")), body)), 256)).alias("melody_fingerprint"))


def _entropy(shares: Column) -> Column:
    return -F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s + p * F.log2(p))


def _corr(a: str, b: str) -> Column:
    """Pearson correlation; 0 where either side is constant. (Under ANSI rules the built-in one raises there.)"""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))), F.lit(0.0))


def melody_features(melody: DataFrame) -> DataFrame:
    """piece_id and the 55 descriptors of FEATURES: one ordered window and one aggregate for each piece."""
    diffs = {"_p0": F.lag("pitch").over(_order()), "_iv": F.col("pitch") - F.lag("pitch").over(_order()), "_ioi": F.col("beat") - F.lag("beat").over(_order()), "_vd": F.col("velocity") - F.lag("velocity").over(_order())}
    span = F.greatest(F.max("beat").over(_piece()) - F.min("beat").over(_piece()), F.lit(1e-9))
    rows = (
        melody.select("piece_id", "beat", F.col("pitch").cast("double").alias("pitch"), F.col("velocity").cast("double").alias("velocity"))
        .withColumns(diffs)
        .withColumns({"_a": F.abs("_iv"), "_turn": F.signum("_iv") * F.signum(F.lag("_iv").over(_order())), "_phase": (F.col("beat") - F.min("beat").over(_piece())) / span, "_log": F.log1p("_ioi")})
        .withColumns({"_lo": F.min("_log").over(_piece()), "_hi": F.max("_log").over(_piece())})
        .withColumns({
            "_bin": F.when(F.col("_log").isNotNull(), F.least(F.floor((F.col("_log") - F.col("_lo")) / ((F.col("_hi") + 1e-9 - F.col("_lo")) / 8)), F.lit(7))),
            "_pc": F.pmod(F.rint("pitch").cast("int"), F.lit(12)), "_f": F.col("beat") - F.floor("beat"),
            "_step": F.when(F.col("_iv").isNotNull(), F.least(F.greatest(F.rint("_iv"), F.lit(-12)), F.lit(12))),
        })
    )
    share = lambda cond: F.avg(F.when(cond.isNotNull(), cond.cast("int")))
    a, iv = F.col("_a"), F.col("_iv")
    edges = {"unison": (0, 1), "step": (1, 3), "third_fourth": (3, 5), "fifth_seventh": (5, 8), "octave": (8, 13), "large": (13, float("inf"))}
    n = F.count("*")
    out = {
        "duration_beats": F.greatest(F.max("beat") - F.min("beat"), F.lit(1e-9)), "onset_count": n.cast("double"), "onset_density": n / F.greatest(F.max("beat") - F.min("beat"), F.lit(1e-9)),
        "pitch_mean": F.avg("pitch"), "pitch_std": F.stddev_pop("pitch"), "pitch_range": F.max("pitch") - F.min("pitch"),
        "pitch_q10": F.percentile("pitch", 0.1), "pitch_q90": F.percentile("pitch", 0.9),
        "interval_abs_mean": F.avg(a), "interval_abs_std": F.stddev_pop(a), "interval_abs_max": F.max(a),
        "step_fraction": share(a <= 2), "leap_fraction": share(a >= 5), "repeat_fraction": share(a == 0), "ascending_fraction": share(iv > 0), "descending_fraction": share(iv < 0),
        "direction_change": share(F.col("_turn") < 0),
        "contour_slope": F.regr_slope("pitch", "_phase"), "pitch_autocorrelation": F.when(F.stddev_pop("pitch") > 1e-9, _corr("_p0", "pitch")),
        "interval_entropy": _entropy(F.array(*(share(F.col("_step") == k) for k in range(-12, 13)))),
        **{f"interval_{name}_fraction": share((a >= lo) & (a < hi)) for name, (lo, hi) in edges.items()},
        "velocity_mean": F.avg("velocity"), "velocity_std": F.stddev_pop("velocity"), "velocity_range": F.max("velocity") - F.min("velocity"),
        "velocity_change_abs_mean": F.avg(F.abs("_vd")), "velocity_change_std": F.stddev_pop("_vd"),
        "pitch_velocity_correlation": F.when((F.stddev_pop("pitch") > 1e-9) & (F.stddev_pop("velocity") > 1e-9), _corr("pitch", "velocity")),
        "ioi_mean": F.avg("_ioi"), "ioi_std": F.stddev_pop("_ioi"), "ioi_cv": F.stddev_pop("_ioi") / F.greatest(F.avg("_ioi"), F.lit(1e-9)),
        "ioi_q25": F.percentile("_ioi", 0.25), "ioi_q75": F.percentile("_ioi", 0.75),
        "offbeat_fraction": share(F.least(F.col("_f"), 1 - F.col("_f")) > 0.10),
        "rhythm_regularity": 1 / (1 + F.stddev_pop("_ioi") / F.greatest(F.avg("_ioi"), F.lit(1e-9))),
        "ioi_entropy": _entropy(F.array(*(share(F.col("_bin") == k) for k in range(8)))),
        **{f"pc_{k}": share(F.col("_pc") == k) for k in range(12)},
    }
    wide = rows.groupBy("piece_id").agg(*(v.alias(k) for k, v in out.items()))
    classes = F.array(*(F.col(f"pc_{k}") for k in range(12)))
    top = F.slice(F.reverse(F.array_sort(classes)), 1, 3)
    wide = wide.withColumns({"pitch_class_entropy": _entropy(classes), "pitch_class_peak": F.array_max(classes), "pitch_class_top3": F.aggregate(top, F.lit(0.0), lambda s, x: s + x)})
    finite = lambda c: F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.col(c))
    return wide.select("piece_id", *(finite(c).alias(c) for c in FEATURES))


def load_pieces(notes: DataFrame, points: int = 96, min_onsets: int = 32) -> DataFrame:
    """A row for each usable piece: its curve as an array of (t, pitch, velocity), the descriptors, and onsets, duration and pitch range."""
    melody = skyline(notes, min_onsets)
    curves = resample(melody, points).groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("k", "t", "pitch", "velocity"))).alias("curve"))
    span = melody.groupBy("piece_id").agg(F.count("*").alias("onsets"), (F.max("beat") - F.min("beat")).alias("duration"), F.min("pitch").alias("pitch_min"), F.max("pitch").alias("pitch_max"))
    finite = F.forall("curve", lambda p: ~F.isnan(p["pitch"]) & ~F.isnan(p["velocity"]))
    return curves.join(melody_features(melody), "piece_id").join(span, "piece_id").where(finite)
