"""Vectors against all others, block against block, without the pairs: a pair of blocks gives only neighbours, counts or sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nearest import DIGITS, _matrix
from .staging import staged

#: Blocks of a table, if they have BLOCK_LEAST rows, and rows of a block at most: a task holds two blocks.
BLOCKS, BLOCK_LEAST, BLOCK_MOST = 12, 256, 32768
#: Cells of a matrix of products that a task holds at once.
CELLS = 1 << 22
#: Bits of the part of one scheme in ``parts``, schemes that fit, and ids whose neighbours one task ranks.
PART_BITS, SCHEMES, RANKED_IDS = 4, 15, 8192


def sound(v: str = "v"):
    """Whether a vector is there with all its components, which are finite."""
    return F.col("id").isNotNull() & F.col(v).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def meet_blocks(items: DataFrame, columns: tuple[str, ...], run: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str, n_rows: int | None = None, most: int | None = None) -> DataFrame:
    """(id, v, columns) -> what ``run`` gives for each two blocks, and for each block with itself (then the second is None).

    The number of blocks is fixed until they are full, so a table is sent about BLOCKS times, whatever its size, and beyond that once for each BLOCK_MOST (or ``most``) rows.
    """
    n = items.count() if n_rows is None else n_rows
    blocks = max(1, min(BLOCKS, n // BLOCK_LEAST), -(-n // (most or BLOCK_MOST)))
    names = ["id", "v", *columns]
    dealt = items.select(*names, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_b")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sides = dealt.select(*names, "_b", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))

    def both(table: pa.Table) -> pa.Table:
        lo, hi = table["_lo"][0].as_py(), table["_hi"][0].as_py()
        if lo == hi:
            return run(table, None)
        first = table["_b"].to_numpy() == lo
        return run(table.filter(pa.array(first)), table.filter(pa.array(~first)))

    return sides.repartition(blocks * (blocks + 1) // 2, "_lo", "_hi").groupBy("_lo", "_hi").applyInArrow(both, schema)


def _exact(x: np.ndarray, y: np.ndarray, divisor: float) -> np.ndarray:
    """Distances of vectors and their likes along the last axis, from their differences."""
    d = x - y
    return np.round(np.sqrt(np.einsum("...i,...i->...", d, d)) / divisor, DIGITS)


def _asks(k: int, divisor: float, schemes: int, asks: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, parts, neighbour, its parts, dist) of the k nearest rows of another part in each scheme, for each of the ``asks``."""
    ids, x, code = rows["id"].to_numpy(), _matrix(rows["v"]).astype(np.float64), rows["parts"].to_numpy()
    own, q, own_code = asks["id"].to_numpy(), _matrix(asks["v"]).astype(np.float64), asks["parts"].to_numpy()
    square, q_square = (x * x).sum(axis=1), (q * q).sum(axis=1)
    part = lambda c, s: (c >> (PART_BITS * s)) & ((1 << PART_BITS) - 1)
    some, step = min(len(x), 4 * k), max(1, CELLS // max(1, len(x)))

    def kept(at: slice | np.ndarray, near: np.ndarray, dist: np.ndarray, edge: np.ndarray | float):
        """The rows to keep among ``near``, and which of the asks are settled by them: nothing outside is nearer than ``edge``."""
        order = np.lexsort((ids[near], dist), axis=-1)
        near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
        there, keep, settled = code[near], np.zeros(near.shape, bool), np.ones(len(near), bool)
        apart = ids[near] != own[at, None]
        for s in range(schemes):
            mine, other = part(own_code[at], s)[:, None], part(there, s)
            fit = apart & (other != mine) & (other > 0) & (mine > 0)
            rank = fit.cumsum(axis=1)
            keep |= fit & (rank <= k)
            last = np.take_along_axis(dist, np.minimum((rank < k).sum(axis=1), near.shape[1] - 1)[:, None], axis=1)[:, 0]
            settled &= (mine[:, 0] == 0) | ((rank[:, -1] >= k) & (last < edge))
        return near, dist, keep, settled | (np.asarray(edge) == np.inf)

    for start in range(0, len(q), step):
        at = slice(start, min(start + step, len(q)))
        if some < len(x):
            cost = q[at] @ (-2 * x.T)
            cost += square
            near = np.argpartition(cost, some - 1, axis=1)[:, :some]
            most = np.take_along_axis(cost, near, axis=1).max(axis=1) + q_square[at]
            edge = np.sqrt(np.maximum(0, most - 1e-12 * (q_square[at] + square.max()))) / divisor - 2 * 10.0**-DIGITS  # what products may be off by
        else:
            near, edge = np.broadcast_to(np.arange(len(x)), (at.stop - start, len(x))), np.full(at.stop - start, np.inf)
        near, dist, keep, settled = kept(at, near, _exact(x[near], q[at, None], divisor), edge)
        keep &= settled[:, None]
        i, j = np.nonzero(keep)
        yield own[at][i], own_code[at][i], ids[near[i, j]], code[near[i, j]], dist[i, j]
        for a in start + np.flatnonzero(~settled):  # many equal ones, or few of other parts: the whole block
            one = np.array([a])
            near, dist, keep, _ = kept(one, np.arange(len(x))[None], _exact(x, q[a], divisor)[None], np.inf)
            j = np.flatnonzero(keep[0])
            yield np.full(len(j), own[a]), np.full(len(j), own_code[a]), ids[near[0, j]], code[near[0, j]], dist[0, j]


def part_code(parts: list) -> F.Column:
    """One number for the parts (0 and up, null where an item takes none) of an item in up to SCHEMES schemes."""
    code = F.lit(0).cast("long")
    for s, p in enumerate(parts):
        code = code.bitwiseOR(F.shiftleft(F.coalesce(p + 1, F.lit(0)).cast("long"), PART_BITS * s))
    return code


def neighbours_by_scheme(items: DataFrame, k: int, schemes: int, divisor: float = 1.0) -> DataFrame:
    """(id, v, parts) -> (scheme, id, rank, neighbour): in each scheme of :func:`part_code`, of each item that has a part its k nearest items of other parts,
    by Euclidean distance of v over ``divisor`` (to DIGITS digits), ties to the smaller id.

    All distances are formed, once for all schemes, and none leaves its task but those that may be among the k nearest: products tell which
    these are, differences their values; where products cannot tell (many equal vectors), all rows of the block are compared by differences.
    Vectors have one length; such as are not whole and finite take no part. Ids are unique.
    """
    if not 0 < schemes <= SCHEMES:
        raise ValueError(f"schemes must be 1 to {SCHEMES}")
    rows = staged(items.where(sound()).select(F.col("id").cast("long").alias("id"), "v", "parts"), "vectors")
    n = rows.count()
    schema = pa.schema([("id", pa.int64()), ("parts", pa.int64()), ("neighbour", pa.int64()), ("other", pa.int64()), ("dist", pa.float64())])

    def search(left: pa.Table, right: pa.Table | None) -> pa.Table:
        found = [t for a, b in ([(left, left)] if right is None else [(left, right), (right, left)]) for t in _asks(k, divisor, schemes, a, b)]
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema) if found else schema.empty_table()

    met = meet_blocks(rows, ("parts",), search, "id long, parts long, neighbour long, other long, dist double", n)
    out = pa.schema([("scheme", pa.int32()), ("id", pa.int64()), ("rank", pa.int32()), ("neighbour", pa.int64())])

    def rank(table: pa.Table) -> pa.Table:
        own, code, near, other, dist = (table[c].to_numpy() for c in ("id", "parts", "neighbour", "other", "dist"))
        order, cols = np.lexsort((near, dist, own)), []
        own, code, near, other = own[order], code[order], near[order], other[order]
        for s in range(schemes):
            mine, its = ((c >> (PART_BITS * s)) & ((1 << PART_BITS) - 1) for c in (code, other))
            fit = np.flatnonzero((mine > 0) & (its > 0) & (mine != its))
            new = np.r_[True, own[fit][1:] != own[fit][:-1]] if len(fit) else np.empty(0, bool)
            place = np.arange(len(fit)) - np.maximum.accumulate(np.where(new, np.arange(len(fit)), 0)) + 1
            top = place <= k
            cols.append((np.full(top.sum(), s), own[fit][top], place[top], near[fit][top]))
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*cols, strict=True), out, strict=True)], schema=out)

    dealt = met.withColumn("_g", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(max(1, -(-n // RANKED_IDS), min(BLOCKS, n // BLOCK_LEAST)))).cast("int"))
    return dealt.groupBy("_g").applyInArrow(rank, "scheme int, id long, rank int, neighbour long")
