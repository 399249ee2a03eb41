"""Exact Jaccard join of word n-gram sets: prefix lists skipped by position, answers derived from similar sets' answers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.staging import release_memory, small_batches, staged

#: Cells of a sketch, whatever the input: what is broadcast is a byte for each.
CELLS = 1 << 22
_SLICES = 64
#: Share of the hashes whose shingles are counted exactly, in shares of shingles in which linked sets may differ.
SAMPLED = 2.2
#: Level of a cell (a power of two above the mean) from which its shingles are frequent.
FREQUENT = 4
#: Sets of a block, about, and their bytes: a task compares the sets of two blocks at most.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Blocks beyond which a cluster is not worked in all pairs of its blocks, but by the shingles that its sets share.
GIANT = 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WINDOW = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_R, _WINDOW + 2), _powers(_R_INVERSE, _WINDOW + 2)


def _window_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of the words in a window of bytes that begins and ends between words."""
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    n = len(raw)
    up, down = (_UP, _DOWN) if n <= _WINDOW else (_powers(_R, n + 1), _powers(_R_INVERSE, n + 1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:n])))
    return start, _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more entry for the end). Bounded windows are cut between words."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + _WINDOW)
        if end < len(raw):
            back = np.flatnonzero(_SPACE[raw[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # a word longer than the window
                ahead = np.flatnonzero(_SPACE[raw[end:]])
                end += int(ahead[0]) + 1
        s, h = _window_words(raw[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.searchsorted(start, begin)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The set of each text: sorted 64-bit hashes of its distinct n-word shingles; of a text with fewer words, of the whole sequence."""
    words, bounds = word_hashes(texts)
    odd = [np.uint64(0xC2B2AE3D27D4EB4F + 2 * 0x165667B19E3779F9 * k & 0xFFFFFFFFFFFFFFFF | 1) for k in range(n)]
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled += _mix(words[k : k + len(rolled)] * odd[k] + np.uint64(k))
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(_mix(np.array([sum(int(_mix(words[a + k : a + k + 1] * odd[k] + np.uint64(k))[0]) for k in range(b - a)) + (b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _chunks(texts: list[bytes], size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i == len(texts) - 1:
            yield a, i + 1
            a, held = i + 1, 0


class Sketch:
    """Counts of hashes by cell in one task, given out in compressed slices."""

    def __init__(self) -> None:
        self.cells = np.zeros(CELLS, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.cells, (hashes >> np.uint64(64 - 22)).astype(np.int64), np.uint32(1))

    def slices(self) -> Iterator[tuple[int, bytes]]:
        per, press = CELLS // _SLICES, zstandard.ZstdCompressor(level=1)
        for s in range(_SLICES):
            if (own := self.cells[s * per : (s + 1) * per]).any():
                yield s, press.compress(own.tobytes())


def summed(slices: DataFrame) -> np.ndarray:
    """The tasks' slices (slice, cells) added up by key; CELLS numbers reach the driver, whatever the input."""
    per = CELLS // _SLICES

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(per, np.uint64)
        for blob in table["cells"].to_pylist():
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32)
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "cells": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})

    out = np.zeros(CELLS, np.uint32)
    for r in slices.groupBy("slice").applyInArrow(add, "slice int, cells binary").collect():
        out[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["cells"]), np.uint32)
    return out


def bitmap(ids: DataFrame) -> np.ndarray:
    """Whether any of the ids (one column of longs) falls into each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch()
        for b in batches:
            own.add(_ids(b.column(0).to_numpy()))
        found = list(own.slices())
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], ["slice", "cells"])

    return summed(ids.mapInArrow(count, "slice int, cells binary")) > 0


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 22)).astype(np.int64)


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _print(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _key(fingerprint: bytes) -> int:
    return int.from_bytes(fingerprint[:8], "little", signed=True)


def _ids(ids: np.ndarray) -> np.ndarray:
    return _mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


class Lists:
    """Inverted lists: for each token its entries, gathered for many tokens at once."""

    def __init__(self, tokens: np.ndarray, n_tokens: int, *values: np.ndarray):
        self.offsets = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=n_tokens))))
        self.values = values

    def at(self, tokens: np.ndarray, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the token in ``tokens``, entry number) of all entries, those from ``stop`` on left out."""
        lo = self.offsets[tokens]
        n = (self.offsets[tokens + 1] if stop is None else stop) - lo
        which = np.repeat(np.arange(len(tokens)), n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def join_block(sets: list[np.ndarray], percent: int, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, earlier rows that link with it) among ``sets``, each in the global order; rows of sides 0 and 1 are only compared with the other side.

    Only prefixes are indexed, and a list is sorted by the position that the token has in the indexed set, so the
    entries whose position leaves too few tokens for the wanted overlap are a tail that is skipped unread. A row
    without a candidate has no links. The overlaps of a row with all others are derived from those of a
    similar earlier row, from the lists of only the tokens in which the two differ; the first of its like is counted in full.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    size = size[order]
    row = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(flat, return_inverse=True)
    n_tokens = int(token.max()) + 1 if len(token) else 0
    begin = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(len(flat)) - begin[row]
    prefix = size - -(-percent * size // 100) + 1
    head = place < prefix[row]
    by_place = np.lexsort((place[head], token[head]))
    listed = Lists(token[head], n_tokens, row[head][by_place], place[head][by_place])
    l_row, l_place = listed.values
    sortkey = token[head][by_place].astype(np.int64) * (int(place.max(initial=0)) + 2) + l_place
    whole = Lists(token, n_tokens, row[np.argsort(token, kind="stable")])
    side = side[order]
    kept: dict[int, np.ndarray] = {}
    for x in range(len(sets)):
        n = int(size[x])
        mine = token[begin[x] : begin[x] + prefix[x]]
        # of a pair with sizes y <= x, a common token at place j of y leaves y - j >= p / (100 + p) * (x + y) only if j <= x * (100 - p) / (100 + p)
        last = n * (100 - percent) // (100 + percent)
        stop = np.searchsorted(sortkey, mine.astype(np.int64) * (int(place.max(initial=0)) + 2) + last, side="right")
        which, entry = listed.at(mine, stop)
        y, j = l_row[entry], l_place[entry]
        most = 1 + np.minimum(n - which - 1, size[y] - j - 1)
        ok = (y < x) & (100 * size[y] >= percent * n) & ((100 + percent) * most >= percent * (n + size[y]))
        near = np.unique(y[ok])
        if side[x] < 2:
            near_other = near[side[near] != side[x]]
            if not len(near_other):
                continue
        elif not len(near):
            continue
        own = token[begin[x] : begin[x + 1]]
        hub = next((int(h) for h in near if int(h) in kept), None)
        if hub is not None:
            theirs = token[begin[hub] : begin[hub + 1]]
            plus, minus = np.setdiff1d(own, theirs, True), np.setdiff1d(theirs, own, True)
            if len(plus) + len(minus) >= n:
                hub = None
        if hub is None:
            overlap = np.bincount(whole.values[0][whole.at(own)[1]], minlength=len(sets))
            kept[x] = overlap
        else:
            overlap = kept[hub] + np.bincount(whole.values[0][whole.at(plus)[1]], minlength=len(sets)) - np.bincount(whole.values[0][whole.at(minus)[1]], minlength=len(sets))
        linked = np.flatnonzero((100 + percent) * overlap[:x] >= percent * (n + size[:x]))
        if side[x] < 2:
            linked = linked[side[linked] != side[x]]
        if len(linked):
            yield int(order[x]), order[linked]


def _band_width(percent: int) -> float:
    """Width of a band of log sizes: sets link only within a band or with the next one."""
    return float(1.001 * np.log(100 / percent))


def _band_token(shingles: np.ndarray, band: int) -> np.ndarray:
    return _mix(shingles + np.uint64((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _meeting(s: np.ndarray, t: np.ndarray, percent: int) -> int:
    """The token by which two linked sets are told apart from all others that they share: their first common prefix shingle, in the larger band."""
    p = s[: _prefix(len(s), percent)]
    common = p[np.isin(p, t[: _prefix(len(t), percent)])][:1]
    return int(_band_token(common, int(np.log(max(len(s), len(t))) / _band_width(percent))).view(np.int64)[0])


def _verify(percent: int):
    """Of a group's rows (cluster, by_token, rep, copies, side, set): a spanning forest of its links, and the number of linked documents of each row.

    The sets of a token (by_token, the cluster being the token) link only where that is the token they meet by, so each link is counted once.
    """

    def run(table: pa.Table) -> pa.Table:
        cluster, doc = table["cluster"].to_numpy(), table["rep"].to_numpy()
        copies, side, by_token = table["copies"].to_numpy(), table["side"].to_numpy(), table["by_token"].to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
        a, b, links = [], [], np.zeros(len(doc), np.int64)
        order = np.argsort(cluster, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            if len(rows) < 2:
                continue
            root = list(range(len(rows)))

            def find(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for x, near in join_block([sets[i] for i in rows], percent, side[rows]):
                if by_token[rows[0]]:
                    near = near[[_meeting(sets[rows[x]], sets[rows[y]], percent) == cluster[rows[0]] for y in near.tolist()]]
                    if not len(near):
                        continue
                links[rows[x]] += copies[rows[near]].sum()
                links[rows[near]] += copies[rows[x]]
                for y in near.tolist():
                    if (p := find(x)) != (q := find(y)):
                        root[max(p, q)] = min(p, q)
                        a.append(doc[rows[x]])
                        b.append(doc[rows[y]])
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array([*a, *doc[some]], pa.int64()), "b": pa.array([*b, *[None] * len(some)], pa.int64()), "n": pa.array([*[None] * len(a), *links[some]], pa.int64())})

    return run


def jaccard_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id, n_links, text_hash, component) by the links of Jaccard similarity >= ``percent`` / 100 of sets of ``words``-word shingles.

    1. One pass over the texts gives each set's size and fingerprint, and a sketch of fixed size that counts all shingles by
    cell; equal sets become one representative with a number of copies. 2. Of the shingles with a low hash and no
    frequent cell, those of two sets or more are found by key. A global order puts shingles so known to be in one set only first, then
    the others found, by frequency, then all else, rare cells first. A set whose prefix is full of the first kind links with
    nothing. 3. Of the rest, sets that share a prefix shingle and a size band are clustered: every linked pair is in one
    cluster. 4. Clustered sets go to their cluster's block, or, of clusters beyond BLOCK sets or BLOCK_BYTES, to the pairs of blocks
    whose sizes can link; those of clusters beyond GIANT blocks meet by each shingle that they share instead, so work does not grow with the square of a cluster that common passages hold together; see :func:`join_block`. Blocks give a forest of links and counts, never pairs. 5. Components of the forest are joined
    to all copies.

    Documents without words have no shingles, link with nothing and are their own component. Rows with a null id come out with
    a null component, linked with nothing; repeated rows are copies. Each row is a document: different texts under one id have links and components of
    their own. n_links counts linked documents, copies included. ``text_hash`` (xxhash64 of the text) tells which of an id's texts a row is about, ``component`` is one
    number for each component (null without words or id), since components of texts that share an id may have one component_id.
    Columns of other names are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = ["doc_id", "hash", "n", "print", "key", "slice", "cells"], Sketch()
        for b in batches:
            texts = _texts(b["text"])
            for i, j in _chunks(texts):
                sets = shingle_sets(texts[i:j], words)
                for s in sets:
                    own.add(s)
                prints = [_print(s) for s in sets]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), b["hash"].slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([_key(p) for p in prints], pa.int64()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names)
        for s, cells in own.slices():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([s], pa.int32()), pa.array([cells], pa.binary())], names)
        del own
        release_memory()

    told = staged(docs.mapInArrow(describe, "doc_id long, hash long, n long, print binary, key long, slice int, cells binary"), "join-base")
    base = told.where("slice IS NULL").select("doc_id", "hash", "n", "print", "key")
    counts = summed(told.where("slice IS NOT NULL").select("slice", "cells"))
    mean = 1 + float(counts.mean())
    levels = spark.sparkContext.broadcast(np.concatenate([np.log2(1 + part / mean).astype(np.uint8) for part in np.split(counts, _SLICES)]))  # CELLS bytes
    del counts
    release_memory()
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    reps = staged(base.where(linkable).groupBy("print", "n").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.min("key").alias("key")).withColumn("rep", F.monotonically_increasing_id()), "join-reps")
    low = np.uint64(int((1 << 64) * min(1.0, SAMPLED * (100 - percent) / 100)))

    def sampled(s: np.ndarray) -> np.ndarray:
        return (s < low) & (levels.value[_cell(s)] < FREQUENT)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b["text"])
            for i, j in _chunks(texts):
                tokens, keys, slack = [], [], []
                for s in shingle_sets(texts[i:j], words):
                    if not len(s):
                        continue
                    own = s[: int(np.searchsorted(s, low))]
                    own = own[levels.value[_cell(own)] < FREQUENT]
                    spare = len(own) - _prefix(len(s), percent)
                    key = _key(_print(s))
                    if spare < 0:  # a row of its own kind keeps the set, whatever its shingles
                        own = np.append(own, _ids(np.array([key])))
                    tokens.append(own)
                    keys.append(np.full(len(own), key, np.int64))
                    slack.append(np.full(len(own), max(spare, -1), np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(slack))], ["token", "key", "slack"])
        release_memory()

    same = W.partitionBy("token")
    shared = (
        docs.where("doc_id IS NOT NULL").select("text").mapInArrow(draw, "token long, key long, slack int")
        .withColumns({"_lo": F.min("key").over(same), "_hi": F.max("key").over(same), "_n": F.count("*").over(same).cast("int")})
        .where("_lo <> _hi OR slack < 0")
        .groupBy("key")
        .agg(F.collect_set(F.when(F.col("_lo") != F.col("_hi"), F.struct("_n", "token"))).alias("shared"), F.max("slack").alias("slack"))  # shingles of one set
        .where(F.size("shared") > F.col("slack"))
    )
    open_ = staged(shared.join(reps, "key").select("rep", "doc", "n", "copies", "print", "shared"), "join-open")
    wanted = spark.sparkContext.broadcast(bitmap(open_.select("doc")))  # CELLS bytes

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            part = b.take(pa.array(np.flatnonzero(wanted.value[_cell(_ids(b["doc_id"].to_numpy()))])))
            texts = _texts(part["text"])
            for i, j in _chunks(texts):
                sets = shingle_sets(texts[i:j], words)
                yield pa.RecordBatch.from_arrays([part["doc_id"].slice(i, j - i), pa.array([_print(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "print", "set"])
        release_memory()

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, unique = [], []
            for raw, known in zip(b["set"].to_pylist(), b["shared"].to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                rank = np.where(sampled(s), 0, (1 << 40) + levels.value[_cell(s)].astype(np.int64))
                token = np.array([k["token"] for k in known], np.int64).view(np.uint64)
                at = np.searchsorted(s, token)
                rank[at] = [k["_n"] for k in known]
                unique.append(int((rank == 0).sum()))
                sets.append(s[np.argsort(rank, kind="stable")].tobytes())
            yield pa.RecordBatch.from_arrays([b["rep"], b["n"], b["copies"], pa.array(unique, pa.int64()), pa.array(sets, pa.binary())], ["rep", "n", "copies", "unique", "set"])

    sets = docs.where("doc_id IS NOT NULL").mapInArrow(full, "doc long, print binary, set binary").join(open_, ["doc", "print"]).dropDuplicates(["rep"])
    ordered = staged(sets.select("rep", "n", "copies", "set", "shared").mapInArrow(arrange, "rep long, n long, copies long, unique long, set binary"), "join-sets")
    width = _band_width(percent)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, docs = [], []
            for doc, n, unique, raw in zip(b["rep"].to_pylist(), b["n"].to_pylist(), b["unique"].to_pylist(), b["set"].to_pylist(), strict=True):
                head = np.frombuffer(raw, np.uint64)[unique : _prefix(n, percent)]
                for k in (0, 1):
                    tokens.append(_band_token(head, int(np.log(n) / width) + k))
                    docs.append(np.full(len(head), doc))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(docs))], ["token", "rep"])

    lists = staged(ordered.mapInArrow(postings, "token long, rep long"), "join-lists")
    first = staged(lists.groupBy("token").agg(F.min("rep").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("token", "_first"), "join-first")
    edges = lists.join(first, "token").where(F.col("rep") != F.col("_first")).select(F.col("rep").alias("a"), F.col("_first").alias("b"))
    clusters = staged(connected_components(edges), "join-clusters").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))

    members = staged(clusters.join(ordered.select("rep", "n", "copies"), "rep"), "join-members")
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    banded = members.withColumn("_band", band)
    loads = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(8 * size / BLOCK_BYTES))
    sizes = banded.groupBy("cluster", "_band").agg(F.count("*").alias("_n"), F.sum("n").alias("_size"))
    whole = sizes.groupBy("cluster").agg(loads(F.sum("_n"), F.sum("_size")).alias("_all"), F.map_from_entries(F.collect_list(F.struct("_band", loads(F.col("_n"), F.col("_size")).cast("int").alias("_blocks")))).alias("_blocks"))
    n_groups = members.agg(F.coalesce(loads(F.count("*"), F.sum("n")), F.lit(0)).cast("int")).first()[0] or 1
    blocks = lambda k: F.coalesce(F.element_at("_blocks", F.col("_band") + k), F.lit(0))
    numbers = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    i = F.col("_i")
    task = lambda lo, a, hi, b, side: F.struct(F.concat_ws(":", F.col("cluster"), lo, a, hi, b).alias("group"), side.cast("int").alias("side"))
    band_, next_, last_ = F.col("_band"), F.col("_band") + 1, F.col("_band") - 1
    same = F.transform(numbers(blocks(0)), lambda j: task(band_, F.least(i, j), band_, F.greatest(i, j), F.when(i == j, 2).when(i < j, 0).otherwise(1)))
    above = F.transform(numbers(blocks(1)), lambda j: task(band_, i, next_, j, F.lit(0)))
    below = F.transform(numbers(blocks(-1)), lambda j: task(last_, j, band_, i, F.lit(1)))
    small = F.array(F.struct(F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(n_groups))).alias("group"), F.lit(2).alias("side")))
    whole = staged(whole, "join-sizes")
    tasks = (
        banded.join(whole.where(F.col("_all") <= GIANT), "cluster")
        .withColumn("_i", F.pmod(F.xxhash64("rep"), blocks(0)).cast("int"))
        .withColumn("_t", F.explode(F.when(F.col("_all") <= 1, small).otherwise(F.concat(same, above, below))))
        .select("rep", "cluster", F.lit(False).alias("by_token"), "copies", "_t.group", "_t.side")
    )
    giant = whole.where(F.col("_all") > GIANT).select("cluster")
    if giant.limit(1).count():
        # the lists of a shingle and band: alone in a task or with other short ones, or in pairs of blocks
        within = lists.join(first.select("token"), "token").join(members.join(giant, "cluster", "left_semi").select("rep", "n", "copies"), "rep")
        long = staged(within.groupBy("token").agg(loads(F.count("*"), F.sum("n")).cast("int").alias("_m"), F.count("*").alias("_n")), "join-long")
        n_lists = long.agg(F.coalesce(F.ceil(F.sum("_n") / BLOCK), F.lit(0)).cast("int")).first()[0] or 1
        i, m = F.pmod(F.xxhash64("rep"), F.col("_m")).cast("int"), F.col("_m")
        short = F.array(F.struct(F.concat(F.lit("t"), F.pmod(F.xxhash64("token"), F.lit(n_lists))).alias("group"), F.lit(2).alias("side")))
        cross = F.transform(numbers(m), lambda j: F.struct(F.concat_ws(":", F.lit("t"), F.col("token"), F.least(i, j), F.greatest(i, j)).alias("group"), F.when(i == j, 2).when(i < j, 0).otherwise(1).cast("int").alias("side")))
        tasks = tasks.unionByName(
            within.join(long.select("token", "_m"), "token")
            .withColumn("_t", F.explode(F.when(m <= 1, short).otherwise(cross)))
            .select("rep", F.col("token").alias("cluster"), F.lit(True).alias("by_token"), "copies", "_t.group", "_t.side")
        )
    found = staged(tasks.join(ordered.select("rep", "set"), "rep").groupBy("group").applyInArrow(_verify(percent), "a long, b long, n long"), "join-found")
    components = staged(connected_components(found.where("b IS NOT NULL").select("a", "b")), "join-components").withColumnRenamed("node", "rep")
    least = staged(components.join(reps.select("rep", "doc"), "rep").groupBy("component").agg(F.min("doc").alias("least")), "join-least")
    links = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    told = components.join(least, "component")
    answers = staged(
        reps.join(told, "rep", "left").join(links, "rep", "left")
        .select("print", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("least", "doc").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")),
        "join-answers",
    )
    return (
        base.select("doc_id", "hash", "n", "print")
        .join(answers, ["print", "n"], "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(linkable, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(linkable, F.col("links")).otherwise(0).alias("n_links"), F.col("hash").alias("text_hash"), F.when(linkable, F.col("component")).alias("component"),
        )
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS g
  FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
reach AS (
  SELECT doc_id, doc_id AS r FROM n
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id, (SELECT count(*) FROM link WHERE a = n.doc_id) AS n_links
FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
"""
