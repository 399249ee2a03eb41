"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import hash_sample, staged

#: Rows that the tree is fitted to, at most.
FIT_ROWS = 8192
#: Queries that the visits are calibrated with, at most.
CALIBRATION_ROWS = 96
#: Rows of a leaf of the shared tree, about, as long as that has LEAVES leaves at most, and rows of the bins that each leaf is split into where it lies.
LEAF_ROWS, LEAVES, BIN_ROWS = 1024, 1024, 5
#: Of the share of true neighbours that may be missed, what the choice of leaves may miss; the choice of bins may miss the rest.
LEAF_SHARE = 0.2


def _vectors(column) -> np.ndarray:
    """An Arrow list column of one length as a float64 matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


@dataclass
class KMeansTree:
    """Centroids of all nodes, children of each, and the leaf number of those that have none."""

    centroids: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, branching: int = 8, leaf_rows: int = 48, seed: int = 5) -> KMeansTree:
        rng = np.random.default_rng(seed)
        centroids, children, leaf, todo, leaves = [x.mean(axis=0)], [[]], [-1], [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop()
            groups: list[np.ndarray] = []
            if len(rows) > leaf_rows:
                own = x[rows]
                c = own[rng.choice(len(rows), min(branching, len(rows)), replace=False)]
                for _ in range(8):
                    at = ((c * c).sum(axis=1) - 2 * own @ c.T).argmin(axis=1)
                    c = np.stack([own[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
                at = ((c * c).sum(axis=1) - 2 * own @ c.T).argmin(axis=1)
                groups = [rows[at == i] for i in range(len(c)) if (at == i).any()]
            if len(groups) < 2:
                leaf[node], leaves = leaves, leaves + 1
                continue
            for g in groups:
                children[node].append(len(centroids))
                todo.append((len(centroids), g))
                centroids.append(x[g].mean(axis=0))
                children.append([])
                leaf.append(-1)
        return cls(np.stack(centroids), children, leaf)

    @property
    def n_leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node, to the child with the nearest centroid."""
        out, todo = np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centroids[self.children[node]]
            at = ((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(child, rows[at == i]) for i, child in enumerate(self.children[node]) if (at == i).any()]
        return out

    def visits(self, q: np.ndarray, n: int) -> Iterator[list[int]]:
        """For each query, its first n leaves, best bin first: the queue holds the open nodes by inner product with their centroids."""
        for near in q @ self.centroids.T:
            queue, out = [(0.0, 0)], []
            while queue and len(out) < n:
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(queue, (-near[child], child))
                else:
                    out.append(self.leaf[node])
            yield out


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v), without vectors that are null, zero, or hold null or non-finite components; of rows with one id the smallest vector stays."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def _top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query id, row, score) of each query's k best rows of a block, from ``near``, the products with those rows that it meets (others are -inf). Scores are then summed row by row, so equal vectors score equal."""
    out: list[tuple] = []
    for own, v, s in zip(q_ids, q, near, strict=True):
        s = np.where(ids == own, -np.inf, s)
        if len(s) > k:
            kth = np.partition(s, len(s) - k)[len(s) - k]
            at = np.flatnonzero(s >= kth - 1e-9 * (1 + abs(kth))) if np.isfinite(kth) else np.flatnonzero(np.isfinite(s))
        else:
            at = np.flatnonzero(np.isfinite(s))
        exact = (x[at] * v).sum(axis=1)
        best = np.lexsort((ids[at], -exact))[:k]
        out.append((np.full(len(best), own), at[best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _bins(at: np.ndarray, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(query, bin): the cosine of each query with the centroid of each bin of a leaf, ``at`` being the rows' bins."""
    c = np.zeros((at.max(initial=-1) + 1, x.shape[1]))
    np.add.at(c, at, x)
    size = np.linalg.norm(c, axis=1) * np.linalg.norm(q, axis=1)[:, None]
    return np.divide(q @ c.T, size, out=np.zeros(size.shape), where=size > 0)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def tree_search(vectors: DataFrame, is_query, k: int = 20, target_recall: float = 0.95, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS, leaf_rows: int = LEAF_ROWS, block_rows: int = 4096) -> DataFrame:
    """(id, v) -> (query_id, rank, vec_id, score, met): of each query, its k nearest by inner product in double precision, as found, and how many rows it met.

    The upper tree is fitted to at most ``fit_rows`` rows (smallest hashes first), which bounds what is broadcast; it has a leaf for each ``leaf_rows`` rows of the table, LEAVES
    at most. Every row is indexed in its leaf, a leaf with more than ``block_rows`` rows in parts by hash, and each part is split further where it lies, down to bins of
    some BIN_ROWS rows, so the tree grows with the table; the queries that visit a leaf meet it in blocks of some ``block_rows`` too, so no task holds more. A query visits leaves best bin first, and in each leaf all bins whose cosine with it reaches a threshold.
    Both are calibrated: of at most ``calibration_rows`` queries the true neighbours among all rows are found by brute force; leaf visits are widened, and the
    threshold is lowered, until ``target_recall`` of them is met. A query that met fewer than k other rows searches all of them.

    Only vectors of the most frequent length take part. Fewer candidates than k give as many ranks; an empty table gives none; columns of other names are ignored.
    """
    spark = vectors.sparkSession
    rows = staged(vectors, "ann-vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, met long")
    dim, total = sizes[0]
    rows = rows.where(F.size("v") == dim)
    sample = np.array([r["v"] for r in hash_sample(rows, "id", fit_rows, 0).collect()], dtype=np.float64)
    leaves = min(LEAVES, max(1, total // leaf_rows))
    tree = KMeansTree.fit(sample, leaf_rows=ceil(len(sample) / leaves))
    shared = spark.sparkContext.broadcast(tree)
    kind = rows.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(shared.value.assign(_vectors(b["v"])), pa.int32())], ["id", "v", "leaf"])

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _vectors(table["v"])
        bins = KMeansTree.fit(x, leaf_rows=BIN_ROWS)
        return table.append_column("bin", pa.array(bins.assign(x), pa.int32()))

    # what is left of the tables below has a row for each leaf of a bounded tree
    assigned = staged(rows.mapInArrow(assign, f"id long, v {kind}, leaf int"), "ann-assigned")
    parts = staged(assigned.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")), "ann-parts")
    dealt = assigned.join(F.broadcast(parts), "leaf").select("id", "v", "leaf", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    indexed = staged(dealt.groupBy("leaf", "part").applyInArrow(split, f"id long, v {kind}, leaf int, part int, bin int"), "ann-index")

    probes = hash_sample(indexed.where(is_query), "id", calibration_rows, 1).select("id", "v").collect()
    probe_ids, probe_v = np.array([r["id"] for r in probes], np.int64), np.array([r["v"] for r in probes], np.float64).reshape(len(probes), dim)

    def brute(table: pa.Table) -> pa.Table:
        ids, x, at = table["id"].to_numpy(), _vectors(table["v"]), table["bin"].to_numpy()
        own, row, score = _top(probe_ids, probe_v, ids, x, k, probe_v @ x.T)
        which = {q: i for i, q in enumerate(probe_ids.tolist())}
        near = _bins(at, x, probe_v)[[which[q] for q in own.tolist()], at[row]]
        return pa.table({"query_id": own.astype(np.int64), "vec_id": ids[row], "score": score, "leaf": table["leaf"].to_numpy()[row], "near": near})

    truth = _ranked(indexed.groupBy("leaf", "part").applyInArrow(brute, "query_id long, vec_id long, score double, leaf int, near double"), k).select("query_id", "leaf", "near").collect() if probes else []
    order = {q: {leaf: i for i, leaf in enumerate(v)} for q, v in zip(probe_ids.tolist(), tree.visits(probe_v, tree.n_leaves), strict=True)}
    depth = np.array([order[r["query_id"]][r["leaf"]] for r in truth])
    near = np.array([r["near"] for r in truth])
    n_visits, least = tree.n_leaves, -np.inf
    if len(truth):
        n_visits = int(np.quantile(depth, 1 - LEAF_SHARE * (1 - target_recall), method="higher")) + 1
        missed = int((1 - target_recall) * len(truth)) - int((depth >= n_visits).sum())
        least = float(np.sort(near[depth < n_visits])[max(0, missed)])

    def searched(queries: DataFrame, visits: int, least: float) -> DataFrame:
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(list(shared.value.visits(_vectors(b["v"]), visits)), pa.list_(pa.int32()))], ["id", "v", "leaves"])

        def search(table: pa.Table) -> pa.Table:
            at = table["bin"].to_numpy()
            ask = at < 0
            ids, x = table["id"].to_numpy(), _vectors(table["v"])
            q_ids, q = ids[ask], x[ask]
            ids, x, at = ids[~ask], x[~ask], at[~ask]
            by_bin = np.argsort(at, kind="stable")
            ids, x, at = ids[by_bin], x[by_bin], at[by_bin]
            edge = np.searchsorted(at, np.arange(at.max(initial=-1) + 2))
            out = []
            for i in range(0, len(q), 512):
                asked, v = q_ids[i : i + 512], q[i : i + 512]
                meets = _bins(at, x, v) >= least
                near = np.full((len(v), len(ids)), -np.inf)
                for k_bin, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    here = np.flatnonzero(meets[:, k_bin])
                    near[here, a:b] = v[here] @ x[a:b].T
                own, row, score = _top(asked, v, ids, x, k, near)
                met = dict(zip(asked.tolist(), np.isfinite(near).sum(axis=1).tolist(), strict=True))
                first = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.empty(0, bool)
                out.append((own, ids[row], score, np.where(first, [met[o] for o in own.tolist()], 0)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 4
            return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2].astype(np.float64), "met": cols[3].astype(np.int64)})

        routed = staged(queries.select("id", "v").mapInArrow(route, f"id long, v {kind}, leaves array<int>"), "ann-routed")
        # a leaf that many queries visit is met by blocks of them
        blocks = staged(routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "ann-blocks")
        asked = (
            routed.select("id", "v", F.explode("leaves").alias("leaf"))
            .join(F.broadcast(parts), "leaf")
            .join(F.broadcast(blocks), "leaf")
            .select("id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).alias("bin"), F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).cast("int").alias("block"))
        )
        met = indexed.join(F.broadcast(blocks), "leaf").select(*indexed.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        found = met.unionByName(asked).groupBy("leaf", "part", "block").applyInArrow(search, "query_id long, vec_id long, score double, met long")
        ranked = _ranked(found.withColumn("met", F.sum("met").over(W.partitionBy("query_id"))), k)
        return staged(ranked.select("query_id", "rank", "vec_id", "score", "met"), "ann-found")

    queries = indexed.where(is_query)
    found = searched(queries, n_visits, least)
    short = staged(queries.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti").select("id", "v"), "ann-short")
    if not short.limit(1).count():
        return found
    rest = searched(short, tree.n_leaves, -np.inf)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def op8_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return tree_search(rows, F.col("id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score", "met")
