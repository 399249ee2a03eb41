"""Hard negatives by a pivot table: inner products as distances of augmented vectors, bracketed by the triangle inequality, survivors checked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import hash_sample, staged

#: Pivots, and rows that they are chosen from at most.
PIVOTS, FIT_ROWS = 16, 4096
#: Kinds of labels by hash, rows of a block and anchors of a chunk, about: a task compares one chunk with one block.
BUCKETS, BLOCK_ROWS, CHUNK_ROWS = 16, 4096, 2048
#: Beyond any score.
_FAR = 1 << 60


def _matrix(column, kind=np.float64) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(c), -1) if len(c) else np.empty((0, 0), kind)


@dataclass
class Pivots:
    """Some vectors x, each with one more component sqrt(R - x.x), R being the largest squared length of all vectors: all then have the length sqrt(R), and the squared distance to an anchor q, whose
    added component is zero, is q.q + R - 2 q.x, so near means a large inner product."""

    points: np.ndarray
    radius: float

    @classmethod
    def choose(cls, sample: np.ndarray, radius: float, n: int) -> Pivots:
        """Each next one is the farthest from those before; equal vectors are taken once."""
        own = cls(sample[:1], radius)
        far = own.distances(sample, own.extra(sample))[:, 0] if len(sample) else np.empty(0)
        while 0 < len(own.points) < n and far.max() > 0:
            own = cls(np.vstack((own.points, sample[far.argmax()])), radius)
            far = np.minimum(far, cls(own.points[-1:], radius).distances(sample, own.extra(sample))[:, 0])
        return own

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.radius - (x * x).sum(axis=1)))

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """(row, pivot); ``extra`` is the added component of each row: zero for anchors."""
        square = ((x * x).sum(axis=1) + extra * extra)[:, None] + self.radius - 2 * (x @ self.points.T + extra[:, None] * self.extra(self.points))
        return np.sqrt(np.maximum(0.0, square))

    def score(self, lengths: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The inner product of anchors (of some squared lengths) that is meant by a distance."""
        return (lengths + self.radius - distance * distance) / 2

    @property
    def slack(self) -> float:
        """More than what rounding can add to a bound."""
        return 1 + 1e-6 * self.radius


def _compare(pivots: Pivots, same: bool, k: int, kind):
    """The function of one chunk of anchors and one block of rows: (anchor, w, id, score) of the k best rows of each anchor in each of its ranges of scores."""

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asks.num_rows and rows.num_rows:
            labels = pa.chunked_array([*asks["label"].chunks, *rows["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            ids, x, at = rows["id"].to_numpy(), _matrix(rows["v"], kind), _matrix(rows["at"])
            for i in range(0, asks.num_rows, 128):
                part = asks.slice(i, 128)
                q_ids, q, q_at = part["id"].to_numpy(), _matrix(part["v"], kind), _matrix(part["at"])
                low, high = np.zeros((len(q), len(x))), np.full((len(q), len(x)), np.inf)
                for p in range(at.shape[1]):  # the triangle inequality, by each pivot
                    np.maximum(low, np.abs(q_at[:, p, None] - at[None, :, p]), out=low)
                    np.minimum(high, q_at[:, p, None] + at[None, :, p], out=high)
                lengths = (q.astype(np.float64) ** 2).sum(axis=1)[:, None]
                most, least = pivots.score(lengths, low) + pivots.slack, pivots.score(lengths, high) - pivots.slack
                fit = ((labels[i : i + len(q), None] == labels[None, asks.num_rows :]) == same) & (q_ids[:, None] != ids[None, :])
                wanted = part["wanted"].to_pylist()
                for j, (own, ranges) in enumerate(zip(q_ids.tolist(), wanted, strict=True)):
                    maybe = np.zeros(len(x), bool)
                    for r in ranges:
                        maybe |= (most[j] >= r["low"]) & (least[j] <= r["high"])
                    met = np.flatnonzero(maybe & fit[j])
                    score = (x[met] @ q[j]).astype(np.int64)
                    for r in ranges:
                        here = np.flatnonzero((score >= r["low"]) & (score <= r["high"]))
                        if len(here) > k:
                            here = here[score[here] >= np.partition(score[here], len(here) - k)[len(here) - k]]
                        best = here[np.lexsort((ids[met[here]], -score[here]))][:k]
                        out.append((np.full(len(best), own), np.full(len(best), r["w"]), ids[met[best]], score[best]))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table({"anchor": cols[0], "w": pa.array(cols[1], pa.int32()), "id": cols[2], "score": cols[3]})

    return run


class PivotTable:
    """Rows (id, label, v) dealt into blocks by their nearest pivot and the hash of their label, with their distances to all pivots; exact searches in it."""

    def __init__(self, rows: DataFrame, pivots: Pivots, kind, block_rows: int, chunk_rows: int) -> None:
        self.pivots, self.kind, self.chunk_rows, spark = pivots, kind, chunk_rows, rows.sparkSession
        total = rows.count()
        self.cells = max(1, min(len(pivots.points), total // block_rows))
        self.index = staged(self._placed(rows, True), "pivot-index")
        n = len(pivots.points)
        edges = [f(F.get("at", F.lit(p))).alias(f"{name}{p}") for p in range(n) for f, name in ((F.min, "low"), (F.max, "high"))]
        bounds = self.index.groupBy("cell").agg(*edges).collect()  # a row for each pivot at most
        self.low, self.high = np.full((self.cells, n), np.inf), np.full((self.cells, n), -np.inf)
        for r in bounds:
            self.low[r["cell"]], self.high[r["cell"]] = [r[f"low{p}"] for p in range(n)], [r[f"high{p}"] for p in range(n)]
        sizes = self.index.groupBy("cell", "bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")).collect()  # at most pivots times BUCKETS rows
        self.held = np.zeros((self.cells, BUCKETS), bool)
        for r in sizes:
            self.held[r["cell"], r["bucket"]] = True
        self.parts = spark.createDataFrame([tuple(r) for r in sizes], "cell int, bucket int, parts int")
        dealt = self.index.join(F.broadcast(self.parts), ["cell", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        self.dealt = dealt.select("cell", "bucket", "part", "id", "label", "v", "at")

    def _placed(self, rows: DataFrame, lifted: bool) -> DataFrame:
        """Rows with their distances to the pivots, the nearest pivot among those that name cells, and their label's bucket; anchors are not lifted."""
        shared = rows.sparkSession.sparkContext.broadcast((self.pivots, self.cells))
        fields = [(f.name, f.dataType.simpleString()) for f in rows.schema]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, cells = shared.value
            for b in batches:
                if b.num_rows:
                    x = _matrix(b["v"])
                    lift = pivots.extra(x)
                    at = pivots.distances(x, lift if lifted else np.zeros(len(x)))
                    near = pivots.distances(x, lift)[:, :cells].argmin(axis=1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel()))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), lists], [*(n for n, _ in fields), "cell", "at"])

        schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", cell int, at array<double>"
        return rows.mapInArrow(place, schema).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int"))

    def chunks(self, anchors: DataFrame) -> DataFrame:
        """Anchors with their distances to the pivots, in chunks of neighbours: those of several small cells, or a part of those of a large one."""
        placed = staged(self._placed(anchors, False), "pivot-anchors")
        named, chunk, held = [], 0, 0
        for r in placed.groupBy("cell").count().orderBy("cell").collect():  # a row for each pivot at most
            if held and held + r["count"] > self.chunk_rows:
                chunk, held = chunk + 1, 0
            parts = -(-r["count"] // self.chunk_rows)
            named.append((r["cell"], chunk, parts))
            chunk, held = (chunk, held + r["count"]) if parts == 1 else (chunk + parts, 0)
        cells = placed.sparkSession.createDataFrame(named, "cell int, _c int, _n int")
        return placed.join(F.broadcast(cells), "cell").select("id", "label", "v", "at", "bucket", (F.col("_c") + F.pmod(F.xxhash64("id"), F.col("_n"))).cast("long").alias("chunk"))

    def _round(self, asks: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
        """The k best of each range of scores: in the first round in one block for each anchor, that with the best bound; else in all blocks whose brackets meet a range."""
        shared = asks.sparkSession.sparkContext.broadcast((self.pivots, self.low, self.high, self.held))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, low, high, held = shared.value
            for b in batches:
                out = []
                lengths = (_matrix(b["v"]) ** 2).sum(axis=1) if b.num_rows else []
                for own, at, length, bucket, ranges in zip(b["id"].to_pylist(), _matrix(b["at"]), lengths, b["bucket"].to_pylist(), b["wanted"].to_pylist(), strict=True):
                    near = np.maximum(np.maximum(low - at, at - high), 0).max(axis=1)
                    far = (at + high).min(axis=1)
                    most, least = pivots.score(length, near) + pivots.slack, pivots.score(length, far) - pivots.slack
                    fit = held.copy()
                    if same:
                        fit[:, np.arange(BUCKETS) != bucket] = False
                    meets = np.zeros(len(most), bool)
                    for r in ranges:
                        meets |= (most >= r["low"]) & (least <= r["high"])
                    fit[~meets] = False
                    cells, buckets = np.nonzero(fit)
                    if first and len(cells):
                        best = most[cells].argmax()
                        cells, buckets = cells[best : best + 1], buckets[best : best + 1]
                    out.append((np.full(len(cells), own), cells, buckets))
                ids, cells, buckets = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.empty(0)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells.astype(np.int32)), pa.array(buckets.astype(np.int32))], ["id", "cell", "bucket"])

        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int") if first else F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        places = asks.mapInArrow(route, "id long, cell int, bucket int").join(F.broadcast(self.parts), ["cell", "bucket"]).select("id", "cell", "bucket", part.alias("part"))
        sent = staged(asks.select("id", "chunk").join(places, "id"), "pivot-sent")
        block = ["cell", "bucket", "part"]
        copies = self.dealt.join(sent.select(*block, F.col("chunk").alias("to")).distinct(), block)
        asked = sent.drop("chunk").join(asks.select("id", "label", "v", "at", "wanted", "chunk"), "id")
        found = asked.groupBy(*block, "chunk").cogroup(copies.groupBy(*block, "to")).applyInArrow(_compare(self.pivots, same, k, self.kind), "anchor long, w int, id long, score long")
        best = W.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def search(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, label, v, at, bucket, chunk, wanted) -> (anchor, w, rank, id, score): of each anchor and each of its wanted ranges of scores (w, low, high) the first k rows of its own label, or of others,
        by score, then id. What a first block holds raises the ranges' lower ends before all others are met."""
        known = self._round(asks, same, k, True).where(F.col("rank") == k).groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("_k"))
        raised = F.transform("wanted", lambda r: r.withField("low", F.coalesce(F.greatest(r["low"], F.element_at("_k", r["w"])), r["low"])))
        return self._round(asks.join(known, "id", "left").withColumn("wanted", raised).drop("_k"), same, k, False)


def hard_negatives(
    rows: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50, high_percent: int = 95, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """(id, label, v) with whole components -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its inner product with the anchor; higher ones come first, ties by smaller id. Positives of an anchor are the first ``n_positives`` other rows of its label; for each of them
    the first ``n_negatives`` rows of other labels are given whose score is within ``low_percent`` to ``high_percent`` of the positive's.

    Vectors are augmented so that a large inner product is a small distance. Every row has its distances to a bounded number of pivots in a table, is in the cell of its nearest pivot, and
    cells are split into blocks; anchors are in chunks. By the triangle inequality these distances bracket the score of an anchor with a cell and with a row: a chunk meets only the
    blocks whose brackets reach its wanted scores, and in a block products are formed only for such rows. All rows in reach are checked exactly.

    Rows with a null id, label, vector or component take no part. Of rows with one id the smallest (vector, label) stays. A shorter vector counts as filled up with zeros. Of rows with equal vectors and labels only the
    smallest ids are candidates, as many as an answer can need, so groups of copies of any size cost no more; all are anchors. A positive with a negative score, or without negatives in its range,
    gives no row; an empty table gives none. Columns of other names are ignored. Vectors whose products may pass 2**56 are refused with a ValueError.
    """
    spark = rows.sparkSession
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    plain = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<long>").alias("v")).where(sound)
    rows = staged(plain.groupBy("id").agg(F.min(F.struct("v", "label")).alias("_m")).select("id", "_m.label", "_m.v"), "pivot-rows")
    most = F.array_max(F.transform("v", lambda x: F.greatest(x, -x)))
    dim, largest = rows.agg(F.max(F.size("v")), F.max(most)).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dim is None:
        return spark.createDataFrame([], schema)
    dim, bound = max(1, dim), max(1, dim) * max(1, largest or 0) ** 2
    if bound >= 1 << 56:
        raise ValueError(f"components up to {largest} in {dim} dimensions: products may not fit")
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    radius = float(rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()[0])
    copies = W.partitionBy("label", "v").orderBy("id")
    candidates = staged(rows.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= max(n_positives + 1, n_negatives)).drop("_r"), "pivot-candidates")
    sample = np.array([r["v"] for r in hash_sample(candidates, "id", FIT_ROWS, 0).collect()], dtype=np.float64).reshape(-1, dim)
    table = PivotTable(candidates, Pivots.choose(sample, radius, pivots), np.float64 if bound < 1 << 53 else np.int64, block_rows, chunk_rows)
    anchors = staged(table.chunks(rows.where(is_anchor)), "pivot-chunks")

    every = F.array(F.struct(F.lit(1).alias("w"), F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high")))
    positives = staged(table.search(anchors.withColumn("wanted", every), True, n_positives).select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "pivot-positives")
    floor = lambda c: f"({c} - pmod({c}, 100L)) div 100L"
    low, high = f"-({floor(f'(-{low_percent}L * positive_score)')})", floor(f"({high_percent}L * positive_score)")
    ends = positives.select(F.col("anchor").alias("id"), "w", F.expr(low).alias("low"), F.expr(high).alias("high"))
    wanted = ends.where("low <= high").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("w", "low", "high"))).alias("wanted"))
    negatives = table.search(anchors.join(wanted, "id"), False, n_negatives)
    named = negatives.select("anchor", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor", "w"])
    return named.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of the table, on components as whole 256ths."""
    v = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("label").isNotNull() & v.isNotNull() & F.forall(v, finite))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform(v, lambda x: F.floor(256 * x.cast("double"))).alias("v"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
