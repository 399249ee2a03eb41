"""Exact top-k search of binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import staged

BYTE = 8
#: Bits of a segment at least and at most: between, as many as tell about as many values as there are codes.
LEAST_BITS, MOST_BITS = 8, 24
#: Probes that a task makes before it hands them on.
PROBES = 1 << 18


@lru_cache(maxsize=64)
def masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int32)


def segment_widths(bits: int, segment: int) -> list[int]:
    """Nearly equal widths of about ``segment`` bits that make ``bits``."""
    n = max(1, round(bits / segment), -(-bits // MOST_BITS))
    return [bits // n + (i < bits % n) for i in range(n)]


def segments(codes: np.ndarray, segment: int) -> np.ndarray:
    """Codes as rows of bytes -> the value of each segment."""
    bits, out, at = np.unpackbits(codes, axis=1).astype(np.int32), [], 0
    for w in segment_widths(bits.shape[1], segment):
        out.append(bits[:, at : at + w] @ (1 << np.arange(w - 1, -1, -1, dtype=np.int32)))
        at += w
    return np.stack(out, axis=1).astype(np.int32)


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): a bit for each component, set where it is above zero, in whole bytes.

    Null vectors and vectors that are empty or hold null or NaN take no part. Of rows with one id, the smallest vector stays.
    Columns of other names are ignored; an empty table gives no codes.
    """
    v = F.col("_v")
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v"))
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)))
        .groupBy("id")
        .agg(F.min("_v").alias("_v"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1)
            size = np.diff(v.offsets.to_numpy())
            width = -(-size // BYTE) * BYTE
            bits = np.zeros(width.sum(), np.uint8)
            begin = np.cumsum(width) - width
            place = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            bits[place] = v.flatten().to_numpy(zero_copy_only=False) > 0
            packed = np.packbits(bits)
            codes = [packed[i : i + n].tobytes() for i, n in zip((begin // 8).tolist(), (width // 8).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], ["id", "code"])

    return rows.mapInArrow(pack, "id long, code binary")


def exact_hamming_topk(codes: DataFrame, is_query, k: int = 20, segment: int | None = None) -> DataFrame:
    """(id, code) -> (query_id, rank, vec_id, distance): of each query its k nearest other codes, ties to the smaller id.

    One global index holds every code under the value of each of its segments. Round r looks up, for every query that is still open and every
    segment, all values that differ in just r bits; what is found is verified by its whole distance. After round r each code within
    segments * (r + 1) - 1 bits has been seen, so a query whose kth distance is no larger is closed. A pair is taken only in the round and
    at the segment that find it first, which follows from the two codes, so nothing is looked at twice.

    Equal codes are asked once, and of equal codes the index holds the k + 1 smallest ids, as no answer can need more: groups of copies of any size cost no more than that.
    Codes of another length than a query's are no candidates. Fewer than k candidates give as many ranks; an empty table gives none, rows with a null id or code take no part,
    and of repeated ids every row is a candidate but none of the query's own id. Columns of other names are ignored.
    """
    spark = codes.sparkSession
    codes = staged(codes.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code"), "hamming-codes")
    bits = segment or min(MOST_BITS, max(LEAST_BITS, round(log2(max(2, codes.count())))))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["code"].to_pylist()
            size = np.array([len(c) for c in raw])
            values: list = [None] * len(raw)
            for n in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == n)
                found = segments(np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(-1, n), bits)
                for i, v in zip(at.tolist(), found, strict=True):
                    values[i] = v
            yield pa.RecordBatch.from_arrays([b["id"], b["code"], pa.array(values, pa.list_(pa.int32()))], ["id", "code", "segs"])

    cut = codes.mapInArrow(split, "id long, code binary, segs array<int>").where("segs IS NOT NULL")
    smallest = W.partitionBy("code").orderBy("id")
    kept = staged(cut.withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k + 1).select(F.octet_length("code").alias("len"), "segs", "id"), "hamming-kept")
    index = staged(kept.select("len", F.posexplode("segs").alias("seg", "value"), "segs", "id").repartition("len", "seg", "value"), "hamming-index")
    total = {r["len"]: r["n"] for r in kept.groupBy("len").agg(F.count_distinct("id").alias("n")).collect()}  # a row for each length of code
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    queries = staged(codes.where(is_query).select("id", "code"), "hamming-queries")
    asked = staged(cut.join(queries.select("code").distinct(), "code", "left_semi").groupBy("code").agg(F.min("segs").alias("segs")).withColumn("q", F.monotonically_increasing_id()), "hamming-asked")
    active = asked.select("q", F.octet_length("code").alias("len"), "segs")
    sums = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    nearest = W.partitionBy("q").orderBy("distance", "id")
    enough = F.element_at(F.create_map(*[x for n, c in total.items() for x in (F.lit(n), F.lit(min(k + 1, c)))]), F.col("len"))
    carried, done = None, []
    for radius in range(bits + MOST_BITS):

        def probe(batches: Iterator[pa.RecordBatch], radius: int = radius) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out, held = [], 0
                for q, n, segs in zip(b["q"].to_pylist(), b["len"].to_pylist(), b["segs"].to_pylist(), strict=True):
                    for j, (w, v) in enumerate(zip(segment_widths(8 * n, bits), segs, strict=True)):
                        if radius <= w:
                            found = masks(w, radius) ^ np.int32(v)
                            out.append((q, n, j, found, segs))
                            held += len(found)
                    if held > PROBES:
                        yield table(out)
                        out, held = [], 0
                yield table(out)

        def table(out: list) -> pa.RecordBatch:
            n = [len(x[3]) for x in out]
            repeated = [pa.array(np.repeat(np.array([x[i] for x in out], t), n)) for i, t in ((0, np.int64), (1, np.int32), (2, np.int32))]
            which = pa.array(np.repeat(np.arange(len(out)), n))
            segs = pa.array([x[4] for x in out], pa.list_(pa.int32())).take(which)
            return pa.RecordBatch.from_arrays([*repeated, pa.array(np.concatenate([x[3] for x in out]) if out else np.empty(0, np.int32)), segs], ["q", "len", "seg", "value", "asked"])

        probes = active.mapInArrow(probe, "q long, len int, seg int, value int, asked array<int>")
        apart = F.zip_with("asked", "segs", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        m = F.size("segs")
        # probes are many more than the queries that their size is guessed from: never broadcast
        met = probes.hint("merge").join(index, ["len", "seg", "value"]).select("q", "len", "id", "seg", m.alias("m"), apart.alias("d"))
        first = F.array_min(F.transform("d", lambda x, i: x * F.col("m") + i)) == radius * F.col("m") + F.col("seg")
        new = met.where(first).select("q", "len", "m", "id", sums(F.col("d")).alias("distance"))
        both = new if carried is None else new.unionByName(carried.select(*new.columns))
        top = both.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k + 1)
        all_ = W.partitionBy("q")
        closed = (F.count("*").over(all_) >= enough) & (F.max("distance").over(all_) <= F.col("m") * (radius + 1) - 1)
        top = staged(top.withColumn("closed", closed).drop("_r"), "hamming-top")
        done.append(top.where("closed"))
        carried = top.where("NOT closed")
        active = staged(active.join(top.where("closed").select("q").distinct(), "q", "left_anti"), "hamming-active")
        if not active.limit(1).count():
            break
        if radius >= max(max(segment_widths(8 * n, bits)) for n in total):
            done.append(carried)  # every code has been met
            break
    best = done[0]
    for d in done[1:]:
        best = best.unionByName(d)
    named = queries.join(asked.select("code", "q"), "code").select(F.col("id").alias("query_id"), "q")
    order = W.partitionBy("query_id").orderBy("distance", "vec_id")
    found = named.join(best.select("q", F.col("id").alias("vec_id"), "distance"), "q").where("vec_id <> query_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return exact_hamming_topk(codes, F.col("id") % 50 == 0, 20)


ORACLE = """
WITH code AS (
  SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS c
  FROM embeddings),
pair AS (
  SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.c, v.c))::INT AS distance
  FROM code q JOIN code v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance
FROM pair QUALIFY rank <= 20
"""
