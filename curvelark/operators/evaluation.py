"""Folds, nearest-neighbour votes, model selection and metrics: fold and parameter numbers are columns, so one job evaluates all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged
from .vectors import SCHEMES, neighbours_by_scheme, part_code

# Fixed values of the protocol.
K_CANDIDATES = (1, 3, 5, 7, 9)
INNER_SEEDS = (2026, 2027, 2028)
OUTER_SEEDS = (11, 23, 42, 67, 101)
PRIMARY_SEED = 42


def grouped_folds(items: DataFrame, folds: int, seed: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, grp, label) -> with ``fold``: groups of each label are dealt out in the order of a hash with the seed; a group is in one fold.

    Places in that order are counted in ranges of the hash and offset by the ranges before, so no task orders a whole class.
    """
    groups = items.select(*by, "label", "grp").distinct().withColumn("_h", F.md5(F.concat_ws("|", seed.cast("string"), F.col("grp").cast("string"))))
    dealt = _placed(groups, (*by, "label")).withColumn("fold", (F.col("_place") % folds).cast("int"))
    one = dealt.groupBy(*by, "grp").agg(F.min("fold").alias("fold"))  # a group with several labels follows its first
    return items.join(one, [*by, "grp"])


def _placed(groups: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """Adds ``_place``, from 0, in the order of a hash ``_h`` (hexadecimal digits) among the groups with the same ``own`` columns."""
    ranged = groups.withColumn("_b", F.substring("_h", 1, 2))
    sizes = ranged.groupBy(*own, "_b").agg(F.count("*").alias("_n"))  # 256 rows at most for each value of own
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*own).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    within = F.row_number().over(W.partitionBy(*own, "_b").orderBy("_h", "grp")) - 1
    return ranged.withColumn("_within", within).join(before, [*own, "_b"]).withColumn("_place", F.col("_within") + F.col("_before")).drop("_b", "_within", "_before")


#: Kinds of groups that one task deals out.
KINDS = 4096


def stratified_group_folds(items: DataFrame, folds: int = 5, seed: int = 42, kinds: int = KINDS) -> DataFrame:
    """(id, grp, label) -> with ``fold``: a group is in one fold, and the rows of every label are spread over the folds as evenly as whole groups allow.

    Groups with equal counts of all labels are of one kind. Whole rounds of a kind (a group for each fold) change no fold's shares, so they are dealt
    in the order of a hash with the seed; only what is left over of each kind, fewer groups than folds, is dealt one after another, larger groups first, each
    to the fold where it least raises the sum over labels of the squared shares (ties to the fold with fewer rows, then to the first). The cost is thus that of
    kinds, not of groups; beyond ``kinds`` of them, shares of the kinds by hash are balanced apart, each in a task of its own. Rows without a
    group are one group, those without a label one label; an empty table stays empty.
    """
    totals = items.groupBy("label").agg(F.count("*").alias("n")).collect()  # a row for each label
    names = sorted(r["label"] for r in totals if r["label"] is not None)
    number = F.coalesce(F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("label").cast("string")), F.lit(0)).cast("int")
    size = {r["label"]: r["n"] for r in totals}
    weight = [1.0 / max(1, size.get(None, 0)) ** 2, *(1.0 / size[n] ** 2 for n in names)]
    held = items.groupBy("grp", number.alias("_l")).agg(F.count("*").alias("_n")).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("_l", "_n"))).alias("_v"))
    kind = F.array_join(F.transform("_v", lambda x: F.concat_ws(":", x["_l"].cast("string"), x["_n"].cast("string"))), ",")
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("grp").cast("string"), F.lit(""))))
    groups = staged(_placed(held.select("grp", "_v", kind.alias("kind"), hashed.alias("_h")), ("kind",)), "groups")
    left = groups.groupBy("kind").agg(F.count("*").alias("_m"), F.first("_v").alias("_v")).where(F.col("_m") % folds > 0)
    chunks = max(1, -(-left.count() // kinds))
    chunk = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "kind")), 1, 8), 16, 10).cast("long"), F.lit(chunks)).cast("int")

    def deal(own: pd.DataFrame) -> pd.DataFrame:
        order = sorted(((-sum(x["_n"] for x in v), k, m, [(x["_l"], x["_n"]) for x in v]) for k, m, v in zip(own["kind"], own["_m"], own["_v"], strict=True)), key=lambda o: o[:2])
        have, rows, out = [[0] * len(weight) for _ in range(folds)], [0] * folds, []
        for negative, k, m, v in order:
            for place in range(m - m % folds, m):
                cost = [round(sum(have[f][label] * n * weight[label] for label, n in v), 12) for f in range(folds)]
                f = min(range(folds), key=lambda f: (cost[f], rows[f], f))
                rows[f] -= negative
                for label, n in v:
                    have[f][label] += n
                out.append((k, place, (f + int(own["_c"].iloc[0])) % folds))
        return pd.DataFrame(out, columns=["kind", "_place", "_f"])

    dealt = left.withColumn("_c", chunk).groupBy("_c").applyInPandas(deal, "kind string, _place long, _f int")
    fold = F.coalesce("_f", (F.col("_place") % folds).cast("int"))
    one = groups.join(dealt, ["kind", "_place"], "left").select(F.col("grp").alias("_grp"), fold.alias("fold"))
    return items.join(one, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")


def group_leaks(folds: DataFrame) -> DataFrame:
    """(grp, folds) of groups in more than one fold: none, if folds are sound."""
    return folds.groupBy("grp").agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def assert_group_separation(train: DataFrame, test: DataFrame) -> None:
    if train.select("grp").intersect(test.select("grp")).limit(1).count():
        raise ValueError("group leakage: a group is in both training and test")


def ranked_neighbours(dist: DataFrame, test: DataFrame, train: DataFrame, keys: tuple[str, ...], most: int = max(K_CANDIDATES), grid: tuple[str, ...] = ()) -> DataFrame:
    """(grid, keys, test, rank, label): of each test item its nearest training items, ties by position; one ranking serves every k.

    ``test`` is (keys, i) and ``train`` (keys, j, label); ``grid`` are parameter columns of ``dist``.
    """
    near = W.partitionBy(*grid, *keys, "i").orderBy("dist", "j")
    return dist.join(test, "i").join(train, [*keys, "j"]).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= most).select(*grid, *keys, F.col("i").alias("test"), "rank", "label")


def votes(neighbours: DataFrame, keys: tuple[str, ...], candidates: tuple[int, ...] = K_CANDIDATES) -> DataFrame:
    """(keys, test, k, label, n, closeness, prob): a vote for each of the k nearest, a hair more for nearer ones; k is at most the number of neighbours there are.

    n and closeness are whole numbers that order classes exactly as the weights do.
    """
    there = W.partitionBy(*keys, "test")
    rows = neighbours.withColumn("_most", F.max("rank").over(there)).withColumn("k", F.explode(F.array(*map(F.lit, candidates)))).where("rank <= k").withColumn("_k", F.least("k", "_most"))
    weight = 1 + 1e-9 * (F.col("_k") - (F.col("rank") - 1))
    each = rows.groupBy(*keys, "test", "k", "label").agg(F.count("*").alias("n"), F.sum(F.col("_k") - F.col("rank")).alias("closeness"), F.sum(weight).alias("_w"))
    return each.withColumn("prob", F.col("_w") / F.sum("_w").over(W.partitionBy(*keys, "test", "k"))).drop("_w")


def class_place(column: str, classes: tuple[str, ...] | None) -> Column:
    """What orders classes that are otherwise equal: their place in ``classes``, if given, or their names."""
    return F.array_position(F.array(*map(F.lit, classes)), F.col(column)) if classes else F.col(column)


def predictions(voted: DataFrame, keys: tuple[str, ...], classes: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, test, k, pred, prob): most votes, then the nearer voters, then the class that comes first (in ``classes``, or by name)."""
    best = W.partitionBy(*keys, "test", "k").orderBy(F.desc("n"), F.desc("closeness"), class_place("label", classes))
    return voted.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, "test", "k", F.col("label").alias("pred"), "prob")


def aligned(voted: DataFrame, classes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row for each class, absent ones with probability 0."""
    asked = voted.select(*keys, "test", "k").distinct()
    all_ = asked.withColumn("label", F.explode(F.array(*[F.lit(r[0]) for r in classes.select("label").distinct().orderBy("label").collect()])))
    return all_.join(voted.select(*keys, "test", "k", "label", "prob"), [*keys, "test", "k", "label"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))


def confusion(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, pred, n) of (keys, label, pred)."""
    return results.groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))


def metrics(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, accuracy, balanced_accuracy, macro_f1) of (keys, label, pred).

    Balanced accuracy averages the recall of labels that occur; macro F1 averages over labels that occur or are predicted, 0 where undefined.
    """
    return metrics_of(confusion(results, keys), keys)


def metrics_of(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same from counts (keys, label, pred, n)."""
    by_label = cells.groupBy(*keys, F.col("label").alias("c")).agg(F.sum("n").alias("truth"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    by_pred = cells.groupBy(*keys, F.col("pred").alias("c")).agg(F.sum("n").alias("said"))
    both = by_label.join(by_pred, [*keys, "c"], "full").na.fill(0, ["truth", "hit", "said"])
    return both.groupBy(*keys).agg((F.sum("hit") / F.sum("truth")).alias("accuracy"), F.avg(F.when(F.col("truth") > 0, F.col("hit") / F.col("truth"))).alias("balanced_accuracy"), F.avg(2 * F.col("hit") / (F.col("truth") + F.col("said"))).alias("macro_f1"))


def class_recall(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return results.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("recall"))


def inner_dealt(items: DataFrame, outer: DataFrame, seeds: tuple[int, ...], inner_folds: int) -> DataFrame:
    """(outer, seed, id, grp, label, inner): the inner folds of the training part of each outer fold."""
    n_outer = [r[0] for r in outer.select("fold").distinct().orderBy("fold").collect()]
    training = items.join(outer.select("id", "fold"), "id").withColumn("outer", F.explode(F.array(*map(F.lit, n_outer)))).where("fold <> outer").drop("fold").withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return grouped_folds(training, inner_folds, F.col("seed"), ("outer", "seed")).withColumnRenamed("fold", "inner")


def _scored(ranked: DataFrame, items: DataFrame, keys: tuple[str, ...], candidates: tuple[int, ...]) -> DataFrame:
    """(keys, k, balanced_accuracy) of every candidate from (keys, test, rank, label)."""
    said = predictions(votes(ranked, keys, candidates), keys).join(items.select(F.col("id").alias("test"), F.col("label").alias("label")), "test")
    return metrics(said, (*keys, "k")).select(*keys, "k", "balanced_accuracy")


def inner_scores_of_vectors(vectors: DataFrame, items: DataFrame, outer: DataFrame, divisor: float = 1.0, seeds: tuple[int, ...] = INNER_SEEDS, inner_folds: int = 3, candidates: tuple[int, ...] = K_CANDIDATES) -> DataFrame:
    """(outer, seed, inner, k, balanced_accuracy) as :func:`inner_scores`, by distances between vectors (id, v) over ``divisor``: no pair leaves its task that
    cannot be among the nearest. Outer folds and seeds are searched for together, SCHEMES of them at once.
    """
    inner = staged(inner_dealt(items, outer, seeds, inner_folds).select("outer", "seed", "id", "label", "inner"), "inner")
    asked = [(r["outer"], r["seed"]) for r in inner.select("outer", "seed").distinct().orderBy("outer", "seed").collect()]  # outer folds times seeds
    near = None
    for first in range(0, len(asked), SCHEMES):
        some = asked[first : first + SCHEMES]
        part = [F.max(F.when((F.col("outer") == o) & (F.col("seed") == s), F.col("inner"))) for o, s in some]
        found = neighbours_by_scheme(vectors.join(inner.groupBy("id").agg(part_code(part).alias("parts")), "id"), max(candidates), len(some), divisor)
        own = F.element_at(F.array(*(F.struct(F.lit(o).alias("outer"), F.lit(s).alias("seed")) for o, s in some)), F.col("scheme") + 1)
        one = found.select(own.alias("_s"), "id", "rank", "neighbour").select("_s.*", "id", "rank", "neighbour")
        near = one if near is None else near.unionByName(one)
    keys = ("outer", "seed", "inner")
    if near is None:
        return _scored(inner.select(*keys, F.col("id").alias("test"), F.lit(1).alias("rank"), "label"), items, keys, candidates)
    ranked = near.join(inner.select(*keys, "id"), ["outer", "seed", "id"]).join(items.select(F.col("id").alias("neighbour"), "label"), "neighbour")
    return _scored(ranked.select(*keys, F.col("id").alias("test"), "rank", "label"), items, keys, candidates)


def inner_scores(dist: DataFrame, items: DataFrame, outer: DataFrame, seeds: tuple[int, ...] = INNER_SEEDS, inner_folds: int = 3, candidates: tuple[int, ...] = K_CANDIDATES, grid: tuple[str, ...] = ()) -> DataFrame:
    """(grid, outer, seed, inner, k, balanced_accuracy): every candidate on every inner fold of every outer fold, in one job.

    ``outer`` is (id, fold); the inner folds of an outer fold divide its training part. ``grid`` are parameter columns of ``dist``.
    """
    inner = inner_dealt(items, outer, seeds, inner_folds)
    keys = (*grid, "outer", "seed", "inner")
    test = inner.select("outer", "seed", "inner", F.col("id").alias("i"))
    train = inner.select("outer", "seed", F.col("inner").alias("_own"), F.col("id").alias("j"), "label").withColumn("inner", F.explode(F.array(*map(F.lit, range(inner_folds))))).where("inner <> _own").drop("_own")
    near = W.partitionBy(*keys, "i").orderBy("dist", "j")
    ranked = dist.join(test, "i").join(train, ["outer", "seed", "inner", "j"]).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= max(candidates)).select(*keys, F.col("i").alias("test"), "rank", "label")
    return _scored(ranked, items, keys, candidates)


def choose(scores: DataFrame, parameters: tuple[str, ...] = ("k",), apart: tuple[str, ...] = ()) -> DataFrame:
    """(outer, apart, parameters, score): the best mean over seeds and inner folds, ties to the smaller parameters; one choice for each value of ``apart``."""
    mean = scores.groupBy("outer", *apart, *parameters).agg(F.round(F.avg("balanced_accuracy"), 12).alias("score"))
    best = W.partitionBy("outer", *apart).orderBy(F.desc("score"), *parameters)
    return mean.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def tuned_evaluation(dist: DataFrame, items: DataFrame, seed: int = PRIMARY_SEED, folds: int = 5, grid: tuple[str, ...] = (), apart: tuple[str, ...] = (), **kw) -> tuple[DataFrame, DataFrame]:
    """Nested evaluation of a distance, or of a grid of them: (out-of-fold predictions (id, label, fold, apart, parameters, pred, prob), chosen parameters by outer fold).

    ``grid`` and ``apart`` are parameter columns of ``dist``: those of ``grid`` are chosen together with k, those of ``apart`` have an evaluation of their own for each value.
    """
    cells = (*apart, *grid)
    outer = grouped_folds(items, folds, F.lit(seed)).select("id", "fold")
    picked = choose(inner_scores(dist, items, outer, grid=cells, **kw), (*grid, "k"), apart)
    test = outer.select(F.col("fold").alias("outer"), F.col("id").alias("i"))
    train = outer.join(items.select("id", "label"), "id").withColumn("outer", F.explode(F.array(*map(F.lit, range(folds))))).where("fold <> outer").select("outer", F.col("id").alias("j"), "label")
    chosen = dist.join(test, "i").join(picked.select("outer", *cells).distinct(), ["outer", *cells]) if cells else dist.join(test, "i")
    keys = (*cells, "outer")
    near = W.partitionBy(*keys, "i").orderBy("dist", "j")
    ranked = chosen.join(train, ["outer", "j"]).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= max(K_CANDIDATES)).select(*keys, F.col("i").alias("test"), "rank", "label")
    return _tuned(ranked, picked, items, cells), picked


def _tuned(ranked: DataFrame, picked: DataFrame, items: DataFrame, cells: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, fold, cells, k, pred, prob): what the nearest training items (cells, outer, test, rank, label) say with the chosen parameters."""
    said = predictions(votes(ranked, (*cells, "outer")), (*cells, "outer")).join(picked.select("outer", *cells, "k"), ["outer", *cells, "k"])
    return said.join(items.select(F.col("id").alias("test"), "label"), "test").select(F.col("test").alias("id"), "label", F.col("outer").alias("fold"), *cells, "k", "pred", "prob")


def tuned_evaluation_of_vectors(vectors: DataFrame, items: DataFrame, divisor: float = 1.0, seed: int = PRIMARY_SEED, folds: int = 5, **kw) -> tuple[DataFrame, DataFrame]:
    """As :func:`tuned_evaluation`, by distances between vectors (id, v) over ``divisor``: no pair leaves its task that cannot be among the nearest."""
    outer = staged(grouped_folds(items, folds, F.lit(seed)).select("id", "fold"), "outer")
    picked = staged(choose(inner_scores_of_vectors(vectors, items, outer, divisor, **kw)), "picked")
    near = neighbours_by_scheme(vectors.join(outer.select("id", part_code([F.col("fold")]).alias("parts")), "id"), max(K_CANDIDATES), 1, divisor)
    ranked = near.join(outer.select("id", F.col("fold").alias("outer")), "id").join(items.select(F.col("id").alias("neighbour"), "label"), "neighbour")
    return _tuned(ranked.select("outer", F.col("id").alias("test"), "rank", "label"), picked, items), picked


def sensitivity(dist: DataFrame, items: DataFrame, base_points: int = 96, base_weight: float = 0.25, **kw) -> DataFrame:
    """(parameter, value, fold_mean, fold_std): the accuracy over outer folds of each cell of a grid (points, weight, i, j, dist) that has the base weight, or the base points.

    Each cell is evaluated apart, with its own k; all in one job.
    """
    cells = dist.where((F.col("weight") == base_weight) | (F.col("points") == base_points))
    return cell_accuracies(tuned_evaluation(cells, items, apart=("points", "weight"), **kw)[0], base_points, base_weight)


def cell_accuracies(results: DataFrame, base_points: int = 96, base_weight: float = 0.25) -> DataFrame:
    """What :func:`sensitivity` gives, from the results of each cell."""
    by_fold = metrics(results, ("points", "weight", "fold"))
    rows = by_fold.groupBy("points", "weight").agg(F.avg("accuracy").alias("fold_mean"), F.stddev_samp("accuracy").alias("fold_std"))
    said = F.array(
        F.when(F.col("weight") == base_weight, F.struct(F.lit("resample_points").alias("parameter"), F.col("points").cast("double").alias("value"))),
        F.when(F.col("points") == base_points, F.struct(F.lit("velocity_weight").alias("parameter"), F.col("weight").alias("value"))),
    )
    return rows.withColumn("_s", F.explode(F.filter(said, lambda x: x.isNotNull()))).select("_s.*", "fold_mean", "fold_std")


def fold_rows(results: DataFrame) -> DataFrame:
    """Metrics of each outer fold with its size and chosen k."""
    sizes = results.groupBy("fold").agg(F.count("*").alias("n_test"), F.first("k").alias("k"))
    return metrics(results, ("fold",)).join(sizes, "fold")


def summarize(method: str, results: DataFrame, iterations: int = 0) -> DataFrame:
    """Metrics over all pieces, mean and sample deviation of fold accuracies, and the k chosen most often (ties: by the first fold).

    With ``iterations``, the bootstrap interval of each metric too, as <metric>_low and <metric>_high.
    """
    rows = fold_rows(results)
    mode = rows.groupBy("k").agg(F.count("*").alias("_n"), F.min("fold").alias("_f")).orderBy(F.desc("_n"), "_f").limit(1).select(F.col("k").alias("mode_k"))
    folds = rows.agg(F.avg("accuracy").alias("fold_mean"), F.stddev_samp("accuracy").alias("fold_std"))
    out = metrics(results).join(folds).join(mode).withColumn("method", F.lit(method))
    if not iterations:
        return out
    from .inference import bootstrap_intervals

    ends = bootstrap_intervals(results.sparkSession, results, iterations)
    only = lambda m, end: F.max(F.when(F.col("metric") == m, F.col(end))).alias(f"{m}_{end}")
    return out.join(ends.agg(*(only(m, end) for m in ("accuracy", "balanced_accuracy", "macro_f1") for end in ("low", "high"))))


def disagreements(named: dict[str, DataFrame]) -> DataFrame:
    """(id, label, a prediction and its probability for each method, disagree, any_error): disagreements first, then by label and, whatever the case of its letters, by id."""
    out = None
    for name, r in named.items():
        one = r.select("id", "label", F.col("pred").alias(name), F.col("prob").alias(f"{name}_prob"))
        out = one if out is None else out.join(one.drop("label"), "id")
    preds = F.array(*(F.col(n) for n in named))
    return out.withColumns({"disagree": (F.size(F.array_distinct(preds)) > 1).cast("int"), "any_error": F.exists(preds, lambda p: p != F.col("label")).cast("int")}).where("disagree = 1 OR any_error = 1").orderBy(F.desc("disagree"), "label", F.lower(F.col("id").cast("string")), "id")


def leading(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in an order, with their place as ``rank``: the top of a table. One task orders ``n`` rows of each part of the table."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def complementarity(a: DataFrame, b: DataFrame, fused: DataFrame) -> DataFrame:
    """(a_right, b_right, n, fused_right): who is right where, and how often the fusion is."""
    right = lambda r, name: r.select("id", (F.col("label") == F.col("pred")).cast("int").alias(name))
    return right(a, "a_right").join(right(b, "b_right"), "id").join(right(fused, "f"), "id").groupBy("a_right", "b_right").agg(F.count("*").alias("n"), F.sum("f").alias("fused_right"))


def run_summary(runs: DataFrame) -> DataFrame:
    """(method, sample_seed, outer_seed, metrics) -> by method: runs, distinct seeds, and mean, sample deviation (0 for one run), least and most of each metric."""
    out = [F.count("*").alias("runs"), F.count_distinct("sample_seed").alias("sample_seeds"), F.count_distinct("outer_seed").alias("outer_seeds")]
    for m in ("accuracy", "balanced_accuracy", "macro_f1"):
        out += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return runs.groupBy("method").agg(*out)


def ablation_summary(rows: DataFrame) -> DataFrame:
    """(removed, seed, change) -> by removed group: mean, sample deviation, least, most, and the share of changes below zero."""
    return rows.groupBy("removed").agg(F.avg("change").alias("change_mean"), F.coalesce(F.stddev_samp("change"), F.lit(0.0)).alias("change_std"), F.min("change").alias("change_min"), F.max("change").alias("change_max"), F.avg((F.col("change") < 0).cast("int")).alias("share_negative"))
