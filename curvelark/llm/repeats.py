"""Substring dedup by seed and extend: winnowed anchors, extended both ways, maximal repeats over a length removed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import release_memory, small_batches, staged
from .ngram_join import _SPACE, _chunks, _mix, _powers, _texts

#: Words of an anchor, and of a repeat at least.
ANCHOR_WORDS, REPEAT_WORDS = 8, 35
#: Occurrences beyond which an anchor is not extended in one task, but window by window; HOT_ANCHORS bounds the number of such anchors.
HOT_ROWS, HOT_ANCHORS = 4096, 10_000_000
#: Bits of a set of anchors that is broadcast, whatever the input: 8 MB. A bit that is set for another anchor costs work, never a result.
_BITS = 26
#: Bytes of a piece of text that is hashed at once, and of a word that is hashed on its own.
_PIECE, _LONG = 1 << 18, 2048
#: Windows of words that choose their anchors at once.
_SEGMENT = 1 << 18
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_R, _STEP = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)
_UP, _DOWN = _powers(_R, _PIECE + 2), _powers(np.uint64(pow(int(_R), -1, 1 << 64)), _PIECE + 2)


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each range of ``values``, a hash of its sequence, wherever it begins."""
    n = len(values)
    up, down = (_UP, _DOWN) if n <= _PIECE else (_powers(_R, n + 1), _powers(np.uint64(pow(int(_R), -1, 1 << 64)), n + 1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:n])))
    return _mix((total[end] - total[begin]) * down[begin])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, letters in their case, and where each text's words begin (one more entry for the end)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    found, at = [(np.empty(0, np.int64), np.empty(0, np.uint64))], 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        spaces = np.flatnonzero(_SPACE[raw[at:end]])
        if len(spaces):
            end = at + int(spaces[-1]) + 1
            piece = raw[at:end]
            edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[piece], [True])).view(np.int8)))
            start, stop = edge[::2], edge[1::2]
            hashes = _mix(_sums(piece.astype(np.uint64) + np.uint64(1), start, stop) + (stop - start).astype(np.uint64))
            for i in np.flatnonzero(stop - start > _LONG).tolist():  # sums of long words could be made to meet
                hashes[i] = _digest(piece[start[i] : stop[i]])
        else:  # one word longer than a piece
            while not len(spaces := np.flatnonzero(_SPACE[raw[end : end + _PIECE]])):
                end += _PIECE
            end += int(spaces[0]) + 1
            start, hashes = np.zeros(1, np.int64), np.array([_digest(raw[at : end - 1])], np.uint64)
        found.append((start + at, hashes))
        at = end
    start, hashes = (np.concatenate(c) for c in zip(*found, strict=True))
    return hashes, np.searchsorted(start, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))


def _digest(word: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Seeds:
    """The anchors of some texts: each window of ``words`` words chooses the leftmost least of its anchors, so equal windows choose alike.

    For each anchor chosen: ``doc`` and ``place`` (its first word), ``first`` (the first window that chose it), ``count`` (how many did, one after another) and ``name``, its hash; ``reach``
    holds, for all of them in turn, a hash of each such window: what the anchor is when it is extended both ways to that window's ends.
    """

    def __init__(self, texts: list[bytes], words: int) -> None:
        h, bounds = word_hashes(texts)
        parts = [self._part(h[i : i + _SEGMENT + words - 1], i, bounds, words) for i in range(0, max(1, len(h) - words + 1), _SEGMENT)]
        self.doc, self.place, self.first, self.count, self.name, self.reach = (np.concatenate(c) for c in zip(*parts, strict=True))

    @staticmethod
    def _part(h: np.ndarray, at: int, bounds: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
        """The anchors of the windows that lie in ``h``, which is what follows word ``at``."""
        k = min(ANCHOR_WORDS, words)
        n, span = len(h) - words + 1, words - k + 1
        start = np.arange(max(0, n))
        doc = np.searchsorted(bounds, start + at, "right") - 1
        whole = start + at + words <= bounds[doc + 1]
        if not whole.any():
            none = np.empty(0, np.int64)
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        begin = np.arange(len(h) - k + 1)
        grams = _sums(h, begin, begin + k)
        best, width = begin, 1
        while width < span:
            step = min(width, span - width)
            left, right = best[: len(best) - step], best[step:]
            best, width = np.where(grams[left] <= grams[right], left, right), width + step
        start, doc, best = start[whole], doc[whole], best[whole]
        run = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        count = np.diff(np.concatenate((run, [len(best)])))
        chosen, origin = best[run], bounds[doc[run]] - at
        return doc[run], chosen - origin, start[run] - origin, count, grams[chosen], _sums(h, start, start + words)


    def rows(self, take: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """(anchor, a, b, first, reach) of some anchors; a and b are the halves of the texts' digests."""
        reach = self.reach[np.repeat(take, self.count)].view(np.int64)
        offsets = np.concatenate(([0], np.cumsum(self.count[take]))).astype(np.int32)
        doc = self.doc[take]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(reach))
        return pa.RecordBatch.from_arrays([pa.array(self.name[take].view(np.int64)), pa.array(a[doc]), pa.array(b[doc]), pa.array(self.first[take].astype(np.int32)), lists], ["anchor", "a", "b", "first", "reach"])

    def hot_rows(self, take: np.ndarray, a: np.ndarray, b: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
        """The same with ``whole``, a hash of all windows: of those alike in a text only the first, and rows without anchor for the ranges [first, stop) of windows that those alike have."""
        edge = np.cumsum(self.count)
        at = np.flatnonzero(take)
        whole = _sums(self.reach, (edge - self.count)[at], edge[at]) if len(at) else np.empty(0, np.uint64)
        order = np.lexsort((at, whole, self.name[at], self.doc[at]))
        by = [x[order] for x in (self.doc[at], self.name[at], whole)]
        new = np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in by]))) if len(order) else np.empty(0, bool)
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
        one, twice = np.zeros(len(self.name), bool), np.zeros(len(self.name), bool)
        one[at[order[new]]] = True
        twice[at[order]] = np.repeat(size > 1, size)
        names = np.zeros(len(self.name), np.uint64)
        names[at] = whole
        batch = self.rows(one, a, b)
        columns = ["anchor", "a", "b", "first", "reach", "whole", "stop"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[one].view(np.int64)), pa.nulls(batch.num_rows, pa.int32())], columns)
        i = np.flatnonzero(twice)
        head = np.concatenate(([True], (self.doc[i[1:]] != self.doc[i[:-1]]) | (self.first[i[1:]] != (self.first + self.count)[i[:-1]]))) if len(i) else np.empty(0, bool)
        tail = np.concatenate((head[1:], [True])) if len(i) else head
        doc, first, stop = self.doc[i[head]], self.first[i[head]], (self.first + self.count)[i[tail]] + words - 1
        none = pa.nulls(len(doc), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(a[doc]), pa.array(b[doc]), pa.array(first.astype(np.int32)), pa.nulls(len(doc), pa.list_(pa.int64())), none, pa.array(stop.astype(np.int32))], columns)


def _spot(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One number for a place in a text."""
    return _mix(a.view(np.uint64) ^ _mix(b.view(np.uint64) + place.astype(np.uint64) * _STEP))


def _new_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts with the two halves of their digests, copies within the task left out."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        keys, fresh = list(zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)), []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                fresh.append(i)
        if fresh:
            part = b.take(pa.array(fresh))
            texts = _texts(part["text"])
            for i, j in _chunks(texts):
                yield texts[i:j], part["a"].to_numpy()[i:j], part["b"].to_numpy()[i:j]
    release_memory()


def _bits(anchors: DataFrame) -> np.ndarray:
    """A set of bits, one for each anchor: at most 2^_BITS of them come to the driver."""
    place = f"shiftrightunsigned(anchor, {64 - _BITS})"
    rows = anchors.groupBy(F.expr(f"shiftrightunsigned({place}, 6)").alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({place} & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 6), np.int64)
    out[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _within(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = names >> np.uint64(64 - _BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _extended(rows: pa.Table, words: int) -> pa.RecordBatch:
    """(a, b, start, stop): of occurrences of some anchors, the ranges in which each, extended both ways, agrees with another one over ``words`` words or more."""
    rows = rows.combine_chunks()
    reach = rows["reach"].chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int64()))
    count = np.diff(reach.offsets.to_numpy())
    own = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    a, b, anchor, first = (rows[c].to_numpy() for c in ("a", "b", "anchor", "first"))
    window, start = reach.flatten().to_numpy(), first[own] + place
    spot = _spot(a[own], b[own], start)
    order = np.lexsort((window, anchor[own]))
    by = np.stack((anchor[own], window))[:, order]
    edge = np.flatnonzero(np.concatenate(([True], (by[:, 1:] != by[:, :-1]).any(axis=0)))) if len(order) else np.empty(0, np.int64)
    agree = np.zeros(len(order), bool)
    if len(order):
        several = np.minimum.reduceat(spot[order], edge) != np.maximum.reduceat(spot[order], edge)
        agree[order] = np.repeat(several, np.diff(np.concatenate((edge, [len(order)]))))
    at = np.flatnonzero(agree)
    begins = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]]))) if len(at) else np.empty(0, bool)
    ends = np.concatenate((begins[1:], [True])) if len(at) else begins
    head, tail = at[begins], at[ends]
    return pa.RecordBatch.from_arrays([pa.array(a[own[head]]), pa.array(b[own[head]]), pa.array(start[head].astype(np.int32)), pa.array((start[tail] + words).astype(np.int32))], ["a", "b", "start", "stop"])


def repeated_ranges(texts: DataFrame, words: int = REPEAT_WORDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b, text) -> (a, b, start, stop): by text (a and b are the halves of its digest), ranges of words that cover all its windows of ``words`` words which also begin elsewhere, in this text or another one.

    1. Every window of ``words`` words chooses one anchor of ANCHOR_WORDS words by winnowing. Anchors are counted by key, combined before the
    shuffle; those at one place only are no seeds, and neither are the windows that chose them repeats. 2. The seeds' occurrences are joined by anchor, each with
    hashes of all windows that chose it, that is, of its extensions both ways; where two occurrences agree over ``words`` words or more, the ranges in which they do are
    kept. A task reads its occurrences sorted by anchor and holds those of one anchor, of ``hot_rows`` at most. 3. Anchors with more occurrences (a bounded number, HOT_ANCHORS) are
    extended by keys instead, which are counted before the shuffle: occurrences that agree in all their windows first, within a text before that, and then, of one occurrence for each
    kind, the single windows.

    Seeds and hot anchors are told to the tasks as bits, 8 MB each whatever the input. Copies of a text count as one text here.
    """
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, a, b in _new_texts(batches):
            s = Seeds(own, words)
            yield pa.RecordBatch.from_arrays([pa.array(s.name.view(np.int64)), pa.array(_spot(a[s.doc], b[s.doc], s.place).view(np.int64))], ["anchor", "spot"])

    spots = texts.mapInArrow(count, "anchor long, spot long")
    counted = spots.groupBy("anchor").agg(F.min("spot").alias("low"), F.max("spot").alias("high"), F.count("*").alias("n"))
    seeds = staged(counted.where("low < high").select("anchor", "n"), "repeat-seeds")
    total = seeds.agg(F.sum("n")).first()[0] or 0
    hot = seeds.where(F.col("n") > max(hot_rows, total // HOT_ANCHORS)).select("anchor")
    any_hot = bool(hot.limit(1).count())
    shared = spark.sparkContext.broadcast((_bits(seeds), _bits(hot)))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_bits, hot_bits = shared.value
        for own, a, b in _new_texts(batches):
            s = Seeds(own, words)
            yield s.rows(_within(seed_bits, s.name) & ~_within(hot_bits, s.name), a, b)

    def hot_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_bits, hot_bits = shared.value
        for own, a, b in _new_texts(batches):
            s = Seeds(own, words)
            yield from s.hot_rows(_within(seed_bits, s.name) & _within(hot_bits, s.name), a, b, words)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            anchors = b["anchor"].to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
            if cut:
                held[-1] = b.slice(0, cut)
                yield _extended(pa.Table.from_batches(held), words)
                held = [b.slice(cut)]
        if held:
            yield _extended(pa.Table.from_batches(held), words)
        release_memory()

    columns = "anchor long, a long, b long, first int, reach array<long>"
    found = texts.mapInArrow(occurrences, columns).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(extend, "a long, b long, start int, stop int")
    if not any_hot:
        return found
    spot, key = F.xxhash64("a", "b", "first"), ["anchor", "whole"]
    met = staged(texts.mapInArrow(hot_occurrences, columns + ", whole long, stop int"), "repeat-hot")
    within_texts = met.where("anchor IS NULL").select("a", "b", F.col("first").alias("start"), "stop")
    met = met.where("anchor IS NOT NULL").drop("stop").withColumn("spot", spot)
    kinds = met.groupBy(*key).agg(F.min("spot").alias("low"), F.max("spot").alias("high"))
    met = staged(met.join(kinds.hint("merge"), key), "repeat-kinds")
    alike = met.where("low < high").select("a", "b", F.col("first").alias("start"), (F.col("first") + F.size("reach") - 1 + words).alias("stop"))
    windows = met.where("spot = low").select("anchor", "whole", "a", "b", "first", (F.col("low") == F.col("high")).alias("lone"), F.posexplode("reach").alias("at", "window"))
    several = windows.groupBy("anchor", "window").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low < high").select("anchor", "window")
    edges = windows.where("lone").join(several.hint("merge"), ["anchor", "window"], "left_semi").withColumn("start", F.col("first") + F.col("at"))
    return found.unionByName(within_texts).unionByName(alike).unionByName(edges.select("a", "b", "start", (F.col("start") + words).alias("stop")))


def remove_repeats(docs: DataFrame, columns: list[str], words: int = REPEAT_WORDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``columns`` of every row, with n_words, n_removed, kept_text (the other words, joined by one space) and repeats: its maximal repeats, ranges of words [start, stop) whose windows of ``words`` words all begin elsewhere too.

    Words are runs of bytes other than space, tab and line breaks, as they stand. A window that begins twice in one text is repeated, overlapping itself or not. Windows are judged
    on the input. Rows with equal texts are each other's elsewhere: all words of theirs go if there are ``words`` of them. Null and empty texts have no words and keep an empty text; texts under
    ``words`` words stay whole; texts of any length are read whole. Null and repeated ids make no difference, columns of other names are ignored, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    digest = F.md5(F.coalesce("text", F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    keyed = docs.select(*columns, F.col("text").alias("_t"), half(1).alias("_a"), half(17).alias("_b"))
    texts = keyed.where("_t IS NOT NULL").select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_t").alias("text"))
    several = texts.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b", F.lit(0).alias("start"), F.lit(None).cast("int").alias("stop"))
    ranges = staged(repeated_ranges(texts, words, hot_rows).unionByName(several), "repeat-ranges")
    by_text = ranges.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.collect_set(F.struct("start", "stop")).alias("_r"))
    kept = [f for f in docs.select(*columns).schema]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_words long", "n_removed long", "kept_text string", "repeats array<struct<start:int,stop:int>>"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, texts, repeats = [], [], [], []
            for text, found in zip(_texts(b["_t"]), b["_r"].to_pylist(), strict=True):
                own = _WORD.findall(text)
                runs: list[list[int]] = []
                for start, stop in sorted((r["start"], len(own) if r["stop"] is None else r["stop"]) for r in found or []):
                    if stop - start < words:  # a copy with too few words
                        continue
                    if runs and start <= runs[-1][1] - words + 1:  # the next window is repeated too
                        runs[-1][1] = max(stop, runs[-1][1])
                    else:
                        runs.append([start, stop])
                out, at = [], 0
                for start, stop in runs:
                    out += own[at:start]
                    at = max(at, stop)
                out += own[at:]
                n_words.append(len(own))
                n_removed.append(len(own) - len(out))
                texts.append(b" ".join(out).decode())
                repeats.append([{"start": s, "stop": e} for s, e in runs])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            own_columns = [b.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own_columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string()), pa.array(repeats, kind)], [*(f.name for f in kept), "n_words", "n_removed", "kept_text", "repeats"])

    return keyed.join(by_text, ["_a", "_b"], "left").select(*columns, "_t", "_r").mapInArrow(cut, schema)


def op12_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeats of 35 words and more."""
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], 35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("repeats").alias("n_repeats"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d),
y AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM x),
z AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM y) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM z),
word AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT r, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
runs AS (SELECT r, count(*) AS n FROM (SELECT r, s - lag(s) OVER (PARTITION BY r ORDER BY s) AS step FROM z) WHERE step IS NULL OR step > 1 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256, coalesce(runs.n, 0)::INT AS n_repeats
FROM d LEFT JOIN kept USING (r) LEFT JOIN runs USING (r)
"""
