"""Exact nearest neighbours without all pairs: distances to pivots bound those between items, and only pairs that can hold a neighbour are computed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import hash_sample, staged

#: Pivots, items that they are chosen from at most, and items of a block at least, about, until there are BLOCKS of them, and at most: a task compares two blocks.
PIVOTS, FIT_ROWS, BLOCK_ROWS, BLOCKS, BLOCK_MOST = 16, 2048, 512, 32, 32768
#: Cells of a matrix of bounds or products that a task holds at once, and the share of a block from which on products tell which items are near.
CELLS, DENSE = 1 << 20, 0.1
#: Digits that distances are rounded to before they are ordered, so that ties are ties everywhere.
DIGITS = 9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.empty((0, 0))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices, from their differences, a row at a time."""
    return np.stack([np.sqrt(((y - v) ** 2).sum(axis=1)) for v in x]) if len(x) else np.empty((0, len(y)))


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each next one is the farthest from those before; equal ones are taken once."""
    chosen = sample[:1]
    far = _apart(chosen, sample)[0] if len(sample) else np.empty(0)
    while 0 < len(chosen) < n and far.max() > 0:
        chosen = np.vstack((chosen, sample[far.argmax()]))
        far = np.minimum(far, _apart(chosen[-1:], sample)[0])
    return chosen


def _search(k: int, divisor: float, same_block: bool):
    """The function of two blocks: (id, neighbour, dist, computed) of the k nearest items of the second for each item of the first, as far as they are
    within its reach.
    """

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asks.num_rows and rows.num_rows:
            ids, x, at, part = rows["id"].to_numpy(), _matrix(rows["v"]).astype(np.float64), _matrix(rows["at"]), rows["part"].to_numpy()
            own, q, q_at, reach, kind = asks["id"].to_numpy(), _matrix(asks["v"]).astype(np.float64), _matrix(asks["at"]), asks["reach"].to_numpy(), asks["part"].to_numpy()
            square, q_square, some = (x * x).sum(axis=1), (q * q).sum(axis=1), 4 * k
            step = max(1, CELLS // len(x))

            def said(a: np.ndarray, near: np.ndarray, dist: np.ndarray, there: np.ndarray, met: np.ndarray) -> None:
                """Of asks the rows ``near``, as far as they are ``there``: a row at least, with how many were met."""
                keep = there.copy()
                keep[:, 0] = True
                i, j = np.nonzero(keep)
                n = np.where(j == 0, met[i], 0)
                found = there[i, j]
                out.append((own[a][i], np.where(found, ids[near[i, j]], -1), np.where(found, dist[i, j], np.inf), n))

            def plainly(a: int, met: np.ndarray) -> None:
                dist = np.round(np.sqrt(((x[met] - q[a]) ** 2).sum(axis=1)) / divisor, DIGITS)
                best = np.lexsort((ids[met], dist))[:k]
                near, there = (met[best], np.ones(len(best), bool)) if len(best) else (np.zeros(1, int), np.zeros(1, bool))
                said(np.array([a]), near[None], (dist[best] if len(best) else np.zeros(1))[None], there[None], np.array([len(met)]))

            for first in range(0, len(q), step):
                a = np.arange(first, min(first + step, len(q)))
                fit = (ids != own[a, None]) & ((part != kind[a, None]) | (kind[a, None] < 0))
                for p in range(at.shape[1] if not same_block else 0):  # the triangle inequality, by each pivot
                    fit &= np.abs(q_at[a, p, None] - at[:, p]) <= reach[a, None]
                met = fit.sum(axis=1)
                if met.sum() < DENSE * fit.size or some >= len(x):
                    for b, mine in zip(a, fit, strict=True):
                        plainly(b, np.flatnonzero(mine))
                    continue
                cost = q[a] @ (-2 * x.T)
                cost += square
                cost[~fit] = np.inf
                near = np.argpartition(cost, some - 1, axis=1)[:, :some]
                there = np.isfinite(np.take_along_axis(cost, near, axis=1))
                most = np.take_along_axis(cost, near, axis=1).max(axis=1) + q_square[a]
                edge = np.sqrt(np.maximum(0, most - 1e-12 * (q_square[a] + square.max()))) / divisor - 2 * 10.0**-DIGITS  # what products may be off by
                dist = x[near] - q[a, None]
                dist = np.where(there, np.round(np.sqrt((dist * dist).sum(axis=2)) / divisor, DIGITS), np.inf)
                order = np.lexsort((ids[near], dist), axis=-1)[:, :k]
                near, dist, there = (np.take_along_axis(v, order, axis=1) for v in (near, dist, there))
                settled = np.isinf(most) | (dist[:, -1] < edge)
                said(a[settled], near[settled], dist[settled], there[settled], met[settled])
                for b in np.flatnonzero(~settled):  # many equal ones
                    plainly(a[b], np.flatnonzero(fit[b]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 4
        return pa.table({"id": cols[0].astype(np.int64), "neighbour": cols[1].astype(np.int64), "dist": cols[2].astype(np.float64), "computed": cols[3].astype(np.int64)})

    return run


def nearest_neighbours(items: DataFrame, k: int, divisor: float = 1.0, pivots: int = PIVOTS, block_rows: int | None = None) -> DataFrame:
    """(id, v, part) -> (id, rank, neighbour, dist, computed): of each item its k nearest items of other parts, by Euclidean distance of v over
    ``divisor`` (to DIGITS digits), ties to the smaller id.

    Every item has its distances to a bounded number of pivots and is in the cell of its nearest one; cells are split into blocks by hash. 1. Each
    item is compared with its own block, so its kth
    distance cannot be larger than what it finds. 2. It then meets the blocks of those cells whose pivot distances, by the triangle inequality, let
    them hold a nearer item, and there
    only such items. ``computed`` tells how many distances were computed for the item, which is what pruning saves; it is nearly all where items have
    no clusters. Blocks meet in tasks of two blocks, and an item is copied to BLOCKS of them at most (beyond BLOCKS times BLOCK_MOST items, to one for each BLOCK_MOST);
    which blocks can meet is told by the extremes of each, the one thing that is collected.

    A null part means that the item may have neighbours of every part. Vectors have one length; items with null vectors or components take no part.
    Ids are unique. Fewer candidates than k give as many ranks, an empty table gives none.
    """
    spark = items.sparkSession
    v = F.col("v") if dict(items.dtypes)["v"] == "array<float>" else F.col("v").cast("array<double>")
    sound = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c))
    rows = staged(items.where(sound).select(F.col("id").cast("long").alias("id"), v.alias("v"), F.coalesce(F.col("part"), F.lit(-1)).cast("int").alias("part")), "near-items")
    held = dict(rows.dtypes)["v"]
    schema = "id long, rank int, neighbour long, dist double, computed long"
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    sample = np.array([r["v"] for r in hash_sample(rows, "id", FIT_ROWS, 0).collect()], dtype=np.float64)
    points = farthest_first(sample, pivots)
    n = len(points)
    block_rows = block_rows or min(BLOCK_MOST, max(BLOCK_ROWS, -(-total // BLOCKS)))
    cells = max(1, min(n, total // block_rows))
    shared = spark.sparkContext.broadcast(points)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = _apart(_matrix(b["v"]).astype(np.float64), shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(at[:, :cells].argmin(axis=1).astype(np.int32))], ["id", "v", "part", "at", "cell"])

    placed = staged(rows.mapInArrow(place, f"id long, v {held}, part int, at array<double>, cell int"), "near-placed")
    parts = {r["cell"]: -(-r["count"] // block_rows) for r in placed.groupBy("cell").count().collect()}  # a row for each pivot at most
    starts, blocks = {}, 0
    for cell in sorted(parts):
        starts[cell], blocks = blocks, blocks + parts[cell]
    told = lambda of: F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("cell"))
    index = staged(placed.withColumn("block", (told(starts) + F.pmod(F.xxhash64("id"), told(parts))).cast("int")).drop("cell"), "near-index")

    columns = ["id", "v", "part", "at"]
    asks = index.select(*columns, "block", F.lit(float("inf")).alias("reach"))
    result = "id long, neighbour long, dist double, computed long"
    anew = [F.col(c).alias(c) for c in columns]  # columns of their own: both sides of a pair of blocks come from one table
    own = index.select(*anew, F.col("block").alias("own"))
    first = staged(asks.groupBy("block").cogroup(own.groupBy("own")).applyInArrow(_search(k, divisor, True), result), "near-first")
    order = W.partitionBy("id").orderBy("dist", "neighbour")
    kth = first.where("neighbour >= 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select("id", "dist")
    reach = F.coalesce((F.col("dist") + 2 * 10.0**-DIGITS) * divisor * (1 + 1e-9), F.lit(float("inf")))
    asked = staged(index.join(kth, "id", "left").select(*columns, "block", reach.alias("reach")), "near-asked")
    ends = asked.groupBy("block").agg(F.max("reach").alias("reach"), *(f(F.get("at", F.lit(p))).alias(f"{name}{p}") for p in range(n) for f, name in ((F.min, "low"), (F.max, "high")))).collect()  # a row for each block
    low, high = ({r["block"]: np.array([r[f"{name}{p}"] for p in range(n)]) for r in ends} for name in ("low", "high"))
    meets = [(a["block"], b) for a in ends for b in low if a["block"] != b and np.maximum(low[b] - high[a["block"]], low[a["block"]] - high[b]).max() <= a["reach"]]
    met = {b: [f for f, to in meets if to == b] for b in low}
    named = lambda of, by: F.explode(F.element_at(F.create_map(*[x for b, others in of.items() for x in (F.lit(b), F.array(*map(F.lit, others)).cast("array<int>"))]), F.col(by)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, reach, block = _matrix(b["at"]), b["reach"].to_numpy(), b["block"].to_numpy()
            for to in low:
                able = np.flatnonzero((np.maximum(low[to] - at, at - high[to]).max(axis=1) <= reach) & (block != to))
                if len(able):
                    some = b.take(pa.array(able))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(able), to), pa.int32())], [*some.schema.names, "to"])

    sent = asked.mapInArrow(route, f"id long, v {held}, part int, at array<double>, block int, reach double, to int")
    copies = index.select(*anew, F.col("block").alias("t"), named(met, "block").alias("f"))
    second = sent.groupBy("block", "to").cogroup(copies.groupBy("f", "t")).applyInArrow(_search(k, divisor, False), result)
    every = first.unionByName(second)
    computed = F.sum("computed").over(W.partitionBy("id"))
    ranked = every.withColumn("computed", computed).where("neighbour >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("id", "rank", "neighbour", "dist", "computed")
