"""Byte-level BPE: higher-order functions fold ranked merges over byte arrays of distinct words, with a literal rank map."""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import release_heap, release_memory, shared_dir, small_batches, staged

#: Distinct words that a task holds, beside the common ones, before it begins a new dictionary, and the bytes of pieces of long words.
MAX_WORDS, MAX_PIECE_BYTES = 500_000, 16 << 20
#: Texts that the words known to all tasks come from, about, and the number of these words at most.
CACHE_DOCS, CACHE_WORDS = 16_000, 600_000
#: Bytes of text that a task takes together at most, where input splits are smaller.
TASK_BYTES = 64 << 20
#: Characters that are split at once, and numbers of words or ids that are put together at once.
WINDOW, CHUNK = 1 << 17, 1 << 16
#: Characters of a plan that the session keeps.
PLAN_CHARS = 200_000
#: Words of more characters are encoded in pieces of so many bytes, each of which begins so many bytes after the one before.
LONG, PIECE, STRIDE = 256, 512, 384
# Fixed value: the pattern whose matches are found by classes of characters; those of any other pattern are found by it.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a tiktoken file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left ids, right ids, ids of their concatenations), for all splits of all tokens into two tokens."""
    left, right, whole = array("i"), array("i"), array("i")
    for t, r in ranks.items():
        for i in range(1, len(t)):
            if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None:
                left.append(a)
                right.append(b)
                whole.append(r)
    return tuple(np.array(x, np.int64) for x in (left, right, whole))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges of a word, plainly: the leftmost pair of the least rank, until no pair has one."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What :func:`merged` gives, in time that is nearly linear in the length: a queue of pairs by rank and place."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place: its end, and where the part before it begins
    live = bytearray(b"\1") * n
    queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(queue, (r, i, j, end[j]))

    while queue:
        _, i, j, k = heapq.heappop(queue)
        if not live[i] or end[i] != j or j >= n or not live[j] or end[j] != k:
            continue
        live[j], end[i] = 0, k
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class RankMap:
    """The rank map as literal arrays for SQL: a perfect hash (hash and displace) of the packed pair and rank.

    A map literal is searched from its first entry to its last at every look-up; here a look-up reads two elements.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must count from 0 without gaps and hold every byte")
        #: Bits of an id; the highest such number is no id.
        self.bits = (len(ranks) + 1).bit_length()
        if self.bits > 20:
            raise ValueError("the ranks are too many to pack")
        left, right, values = merge_pairs(ranks)
        keys = (left << self.bits) + right
        self.size = _prime(int(len(keys) * 1.1) + 11)
        self.groups = _prime(len(keys) // 3 + 7)
        self.packed, self.shift = self._displace(keys, values)
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), 1 << self.bits) for a in range(256) for b in range(256)], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # tokens that two splits make of overlapping neighbours (a + aa, aa + a): there the leftmost pair need not have the smaller id
        self.overlapping = np.zeros(len(ranks), np.int64)
        for t, r in ranks.items():
            splits = [i for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
            self.overlapping[r] = any(len(t) - i in splits and t[i:] == t[: len(t) - i] for i in splits)
        # tokens that their own merges do not reach: a word equal to one is that token
        self.whole = {t: r for t, r in ranks.items() if len(t) > 1 and merged(t, ranks) != [r]}

    def _displace(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed, shift = np.full(self.size, -1, np.int64), np.zeros(self.groups, np.int64)
        taken = np.zeros(self.size, bool)
        group, h1, h2 = keys % self.groups, keys % self.size, keys % (self.size - 2) + 1
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) > 0)))
        parts = np.split(order, starts[1:])
        for rows in sorted(parts, key=len, reverse=True):
            a, b = h1[rows], h2[rows]
            d = 0
            while True:
                at = (a + d * b) % self.size
                if not taken[at].any() and len(set(at.tolist())) == len(at):
                    break
                d += 1
            taken[at], packed[at], shift[group[rows[0]]] = True, (keys[rows] << self.bits) | values[rows], d
        return packed, shift

    def look_up(self, key: Column, packed: Column, shift: Column) -> Column:
        """The rank of a pair of ids, the left one above the right one in ``key``, or a number of at least 2 ** bits if it has none."""
        at = F.pmod(F.pmod(key, F.lit(self.size)) + F.get(shift, F.pmod(key, F.lit(self.groups))) * (F.pmod(key, F.lit(self.size - 2)) + 1), F.lit(self.size))
        return F.get(packed, at.cast("int")).bitwiseXOR(key * (1 << self.bits)).bitwiseAND(F.lit((1 << 63) - 1))

    def encode(self, word: Column) -> Column:
        """Ids of a word given as an array of its bytes.

        The state is one array with a sentinel at each end: of each id, the rank of its pair with the next one above the id itself. A step takes
        the least element, and the leftmost of its rank, puts the merged id (its rank) in place of the two, and looks up
        the two new pairs only.
        """
        bits = self.bits
        packed, shift, flags = literal_array(self.packed), literal_array(self.shift), literal_array(self.overlapping)
        first, single = literal_array(self.byte_pairs), literal_array(self.bytes)
        mask, rest = F.lit((1 << bits) - 1).cast("bigint"), F.lit(1 << 30)
        none = F.lit(1 << (2 * bits)).cast("bigint")
        edge = F.array(F.lit((1 << (2 * bits)) + (1 << bits) - 1).cast("bigint"))
        unranked = F.lit(1 << bits).cast("bigint")
        begin = F.concat(
            edge,
            F.zip_with(F.slice(word, F.lit(1), F.size(word) - 1), F.slice(word, F.lit(2), F.size(word) - 1), lambda a, b: F.shiftleft(F.get(first, a.cast("int") * 256 + b.cast("int")), bits) + F.get(single, a.cast("int"))),
            F.transform(F.slice(word, F.lit(-1), F.lit(1)), lambda a: F.get(single, a.cast("int")) + none),
            edge,
        )

        def let(value: Column, body) -> Column:
            return F.get(F.transform(F.array(value), body), F.lit(0))

        def step(s: Column, _: Column) -> Column:
            def merge(e: Column, p: Column) -> Column:
                new = F.shiftright(e, bits)
                pairs = F.array(F.shiftleft(F.get(s, p - 2).bitwiseAND(mask), bits) + new, F.shiftleft(new, bits) + F.get(s, p + 1).bitwiseAND(mask))
                return F.concat(F.slice(s, F.lit(1), p - 2), F.transform(pairs, lambda k: F.shiftleft(F.least(self.look_up(k, packed, shift), unranked), bits) + F.shiftright(k, bits)), F.slice(s, p + 2, rest))

            def place(e: Column) -> Column:
                rank = F.shiftright(e, bits)
                ranks = F.transform(s, lambda x: F.shiftright(x, bits))
                return F.when(F.get(flags, rank.cast("int")) == 1, F.array_position(ranks, rank)).otherwise(F.array_position(s, e)).cast("int")

            return let(F.array_min(s), lambda e: F.when(e >= none, s).otherwise(let(place(e), lambda p: merge(e, p))))

        # a word of n bytes is merged n - 1 times at most
        folded = F.aggregate(F.slice(word, F.lit(2), rest), begin, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(mask)))
        if self.whole:
            known = F.create_map(*[x for t, r in self.whole.items() for x in (F.lit(",".join(map(str, t))), F.lit(r))])
            found = F.get(F.transform(F.array(F.array_join(word.cast("array<string>"), ",")), lambda w: F.element_at(known, w)), F.lit(0))
            return F.when(found.isNotNull(), F.array(found.cast("bigint"))).otherwise(folded)
        return folded


def literal_array(values: np.ndarray) -> Column:
    """An array of numbers that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@lru_cache(maxsize=4)
def rank_map(path: str) -> RankMap:
    out = RankMap(load_ranks(path))
    release_memory()
    return out


def _byte_lists(words: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int16), pa.int16()))


@lru_cache(maxsize=1)
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """(first code point, class) of all runs of code points of one class, as the regular expressions see them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kind = np.full(0x110000, _OTHER, np.uint8)
    for k, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        kind[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = k
    first = np.flatnonzero(np.diff(kind, prepend=255))
    return first, kind[first]


class Splitter:
    """The pattern's matches in texts, in windows of bounded size, with two 64-bit hashes of each."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.runs = class_runs() if pattern == SPLIT_PATTERN else None
        self._table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def classes(self, codes: np.ndarray) -> np.ndarray:
        if self._table is None:
            first, kind = self.runs
            self._table = np.repeat(kind, np.diff(first, append=0x110000))
        return self._table[codes]

    def _cut(self, text: str, at: int) -> int:
        """A place beyond ``at`` where a match must begin, at about a window's length: before white space, or where letters or digits meet other characters."""
        size = WINDOW
        while at + size < len(text):
            kind = self.classes(_codes(text[at : at + size]))
            before, here = kind[:-1], kind[1:]
            places = np.flatnonzero((before != here) & (before != _SPACE) & (here != _LETTER))
            if len(places):
                return at + int(places[-1]) + 1
            size *= 2
        return len(text)

    def windows(self, texts: list[str]) -> Iterator[list[tuple[int, str, bool]]]:
        """(text number, stretch, whether the text begins with it) of some WINDOW characters together."""
        group, held = [], 0
        for i, t in enumerate(texts):
            at = 0
            while len(t) - at > WINDOW and self.runs is not None:
                if group:
                    yield group
                group, held = [], 0
                end = self._cut(t, at)
                yield [(i, t[at:end], at == 0)]
                at = end
            if at < len(t) or at == 0:
                if group and held + len(t) - at > WINDOW:
                    yield group
                    group, held = [], 0
                group.append((i, t[at:], at == 0))
                held += len(t) - at
        if group:
            yield group

    def split(self, group: list[tuple[int, str, bool]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(stretches joined, code points, starts, ends, text numbers) of all matches of a window."""
        joined = "\0".join(s for _, s, _ in group) + "\0\0\0\0"
        codes = _codes(joined)
        stop = np.cumsum([len(s) + 1 for _, s, _ in group]) - 1
        if self.runs is None:
            found = [(m.start() + e - len(s), m.end() + e - len(s)) for (_, s, _), e in zip(group, stop.tolist(), strict=True) for m in regex.finditer(self.pattern, s)]
            start, end = np.array(found, np.int64).reshape(-1, 2).T
        else:
            kind = self.classes(codes)
            kind[stop], kind[stop[-1] :] = _END, _END
            begins = np.empty(len(codes), bool)
            begins[0], begins[1:] = True, kind[1:] != kind[:-1]
            # the last of some white space is a match of its own, or the first character of the next one if it is a blank
            last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] < _END) & (kind[1:] != _SPACE))
            begins[last] = True
            begins[last[codes[last] == 0x20] + 1] = False
            # contractions: an apostrophe that begins a match, and one or two letters
            for i in np.flatnonzero((codes == 0x27) & begins & (kind == _OTHER)).tolist():
                after = joined[i + 1 : i + 3]
                n = 1 if after[:1] in _ONE else 2 if after in _TWO else 0
                if n:
                    begins[i + 1], begins[i + 1 + n] = False, True
            edge = np.flatnonzero(begins | (kind == _END))
            match = kind[edge] != _END
            start, end = edge[match], np.append(edge[1:], len(codes))[match]
        return joined, codes, start, end, np.array([i for i, _, _ in group])[np.searchsorted(stop, start)]


# The letters that follow an apostrophe in a match of SPLIT_PATTERN
_ONE, _TWO = ("s", "t", "m", "d"), ("re", "ve", "ll")
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


@lru_cache(maxsize=1)
def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in _BASES:
        both = []
        for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            x = np.full(size + 1, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x))
        out.append(tuple(both))
    return out


def hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each stretch of code points."""
    out, size = [], max(WINDOW * 2, 1 << max(0, len(codes) - 1).bit_length())
    for up, down in _powers(size):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        x = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(x ^ (x >> np.uint64(32)))
    return out


class Book:
    """Numbers of words, found by a hash; a second hash tells whether a word is the one that was numbered, others and long words go by their bytes.

    A word takes 24 bytes here, however long it is.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.n = 0
        self.keys = np.empty((2, max(1024, 2 * len(first))), np.uint64)
        self.slots = np.full(1 << (4 * len(first) + 1024).bit_length(), -1, np.int32)
        self.by_bytes: dict[bytes, int] = {}
        self.piece_bytes = 0
        self._add(first, second)

    def _place(self, first: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (first >> np.uint64(20)).astype(np.int64) & mask
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            left = self.slots[at] != numbers
            at, numbers = (at[left] + 1) & mask, numbers[left]

    def _add(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        numbers = self.reserve(len(first))
        self.keys[0, numbers], self.keys[1, numbers] = first, second
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
            known = np.setdiff1d(np.arange(self.n, dtype=np.int32), np.fromiter(self.by_bytes.values(), np.int32, len(self.by_bytes)))
            self._place(self.keys[0, known], known)
        else:
            self._place(first, numbers)
        return numbers

    def reserve(self, n: int) -> np.ndarray:
        numbers = np.arange(self.n, self.n + n, dtype=np.int32)
        self.n += n
        if self.n > self.keys.shape[1]:
            grown = np.empty((2, 2 * self.n), np.uint64)
            grown[:, : self.keys.shape[1]] = self.keys
            self.keys = grown
        return numbers

    def find(self, first: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        mask, out, todo = len(self.slots) - 1, np.full(len(first), -1, np.int32), np.arange(len(first))
        at = (first >> np.uint64(20)).astype(np.int64) & mask
        while len(todo):
            number = self.slots[at[todo]]
            same = (number >= 0) & (self.keys[0][number] == first[todo])
            out[todo[same]] = number[same]
            todo = todo[(number >= 0) & ~same]
            at[todo] = (at[todo] + 1) & mask
        return out

    def own(self, raw: bytes, new: list[bytes]) -> int:
        """The number of a word by its bytes; ``new`` gets it if it had none."""
        if raw not in self.by_bytes:
            self.by_bytes[raw] = int(self.reserve(1)[0])
            self.piece_bytes += len(raw)
            new.append(raw)
        return self.by_bytes[raw]

    def number(self, joined: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(numbers, how many of them are of each word, new words by number) of a window's words.

        A word of over PIECE bytes has several: the negative number of its pieces, its length, and those of its pieces.
        """
        first, second = hashes(codes, start, end)
        numbers = self.find(first)
        long = end - start > LONG
        fresh = np.flatnonzero((numbers < 0) & ~long)
        _, at = np.unique(first[fresh], return_index=True)
        at = fresh[at]
        self._add(first[at], second[at])
        new = [joined[a:b].encode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        numbers[fresh] = self.find(first[fresh])
        odd = long | (self.keys[1][numbers] != second)
        counts = np.ones(len(start), np.int64)
        if not odd.any():
            return numbers, counts, new
        own: dict[int, list[int]] = {}
        for i in np.flatnonzero(odd).tolist():
            raw = joined[start[i] : end[i]].encode()
            if len(raw) <= PIECE:
                own[i] = [self.own(raw, new)]
            else:
                cuts = [*range(0, len(raw) - PIECE, STRIDE), len(raw) - PIECE]
                own[i] = [-len(cuts), len(raw), *(self.own(raw[c : c + PIECE], new) for c in cuts)]
            counts[i] = len(own[i])
        flat, place = np.repeat(numbers, counts), np.cumsum(counts) - counts
        for i, values in own.items():
            flat[place[i] : place[i] + len(values)] = values
        return flat, counts, new


class Pieces:
    """Byte strings, or lists of ids as little-endian unsigned 32-bit integers, by number, in one growing buffer."""

    def __init__(self, strings: pa.Array):
        self.unit = np.uint8 if pa.types.is_binary(strings.type) else np.dtype("<u4")
        self.data, self.used, self.begin, self.n = np.empty(0, self.unit), 0, np.zeros(1, np.int64), 0
        self.add(strings)

    def add(self, strings: pa.Array) -> None:
        if pa.types.is_binary(strings.type):
            at = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
            new = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        else:
            at = strings.offsets.to_numpy().astype(np.int64)
            new = strings.flatten().to_numpy(zero_copy_only=False)
        self.data, self.begin = _room(self.data, self.used + len(new)), _room(self.begin, self.n + 1 + len(strings))
        self.data[self.used : self.used + len(new)] = new
        self.begin[self.n + 1 : self.n + 1 + len(strings)] = self.used + np.cumsum(np.diff(at))
        self.used, self.n = self.used + len(new), self.n + len(strings)

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self.begin[numbers + 1] - self.begin[numbers]

    def join(self, numbers: np.ndarray) -> np.ndarray:
        numbers = numbers.astype(np.int64)
        n = self.lengths(numbers)
        return self.data[np.arange(n.sum()) + np.repeat(self.begin[numbers] - (np.cumsum(n) - n), n)]


def _room(x: np.ndarray, size: int) -> np.ndarray:
    if size <= len(x):
        return x
    out = np.empty(max(size, len(x) + len(x) // 2), x.dtype)
    out[: len(x)] = x
    return out


def stitched(parts: list[np.ndarray], size: int, lengths) -> np.ndarray | None:
    """The ids of a word of ``size`` bytes from those of its pieces, or None if two pieces have no token in common where they overlap.

    A sequence of tokens is what merging gives if each two neighbours are, and neighbours within a piece's ids are. So a token that two
    overlapping pieces have at one place joins them: what stands before it comes from the one, it and the rest from the other.
    """
    out, begin, place, spans = [], 0, 0, None
    for k, part in enumerate(parts):
        at = size - PIECE if k == len(parts) - 1 else k * STRIDE
        end = at + np.cumsum(lengths(part))
        here = (end - lengths(part) << 24) + lengths(part)
        if k:
            same, i, j = np.intersect1d(spans, here, True, return_indices=True)
            ok = np.flatnonzero(i >= begin)
            if not len(ok):
                return None
            out.append(parts[k - 1][begin : i[ok[0]]])
            begin = int(j[ok[0]])
        spans = here
    return np.concatenate([*out, parts[-1][begin:]])


def _common(path: str, column: str) -> pa.Array:
    store, base = pafs.FileSystem.from_uri(path)
    parts = sorted(f.path for f in store.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet"))
    found = [pq.read_table(f, filesystem=store, columns=[column])[column].combine_chunks() for f in parts]
    found = [c for f in found for c in (f.chunks if isinstance(f, pa.ChunkedArray) else [f]) if len(c)]
    return pa.concat_arrays(found) if found else pa.array([], pa.int64() if column != "ids" else pa.list_(pa.int32()))


def common_words(docs: DataFrame, total: int, ranks: RankMap, splitter: Splitter, sample_rows: int = CACHE_DOCS, max_words: int = CACHE_WORDS) -> str:
    """Where the most frequent words of about ``sample_rows`` of ``total`` texts, chosen by hash, are stored, at most ``max_words``, encoded like all others.

    They only spare tasks from encoding common words each for itself: which words are there changes no result. They lie in the shared folder, and
    never pass through the driver or through one task.
    """
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(min(1.0, sample_rows / max(1, total)) * (1 << 40))).select("text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for b in batches:
            for group in splitter.windows([t or "" for t in b["text"].to_pylist()]):
                joined, codes, start, end, _ = splitter.split(group)
                short = end - start <= 64
                start, end = start[short], end[short]
                first, second = hashes(codes, start, end) if len(start) else (none, none)
                _, at, n = np.unique(first, return_index=True, return_counts=True)
                word = _byte_lists([joined[a:b].encode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64)), pa.array(n.astype(np.int64)), word], ["first", "second", "n", "word"])
        release_memory()

    words = chosen.mapInArrow(distinct, "first long, second long, n long, word array<smallint>").groupBy("first").agg(F.min(F.struct("second", "word")).alias("_w"), F.sum("n").alias("n"))
    words = staged(words.select("first", "_w.second", "_w.word", "n"), "words")
    counts, least = words.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect(), 1001
    for r in counts:  # 1000 rows at most
        max_words -= r["count"]
        if max_words < 0:
            break
        least = r["n"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the plan with the literal rank map is large in print: it gets no shuffle, so that it is told once and not after each stage
    chosen = staged(words.where(F.col("n") >= least).repartition(parts, "first"), "common")
    encoded = chosen.select("first", "second", ranks.encode(F.col("word")).cast("array<int>").alias("ids"))
    path = f"{shared_dir(docs.sparkSession)}/staged/encoded-{uuid.uuid4().hex}"
    encoded.write.parquet(path)
    return path


def short_plans(spark: SparkSession) -> None:
    """Let this session tell at most PLAN_CHARS characters of a plan: it keeps what it tells, and the literal rank map takes megabytes each time."""
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))


def encode_documents(docs: DataFrame, keep: list[str], ranks_path: str, pattern: str, max_words: int = MAX_WORDS, common_rows: int = CACHE_DOCS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens, ids (little-endian unsigned 32-bit, binary) digested as ids_sha256, and decoded_sha256.

    One pass without a shuffle. In each task, a first function splits texts into the pattern's matches, in windows, and numbers the
    distinct ones by hashes; new words leave it once, as byte arrays, before the first document that holds them, and documents as word
    numbers. SQL encodes the word rows by folded merges. A second function in the same task
    keeps the words' ids by number, puts documents together, and decodes their ids by concatenating the tokens' bytes. Frequent words are encoded once for all tasks, see
    :func:`common_words`. A dictionary that reaches ``max_words`` others is begun anew,
    so memory is bounded whatever the partition holds: one function holds 24 bytes a word, the other its ids. A word of more than PIECE bytes is encoded in pieces
    that overlap, joined by a token which both have (:func:`stitched`), so its cost is linear; where there is none (long repeats), it is merged whole.

    Every row has a result: null and empty texts have no tokens, repeated rows and null ids are rows like others, columns of other names are ignored, and an empty table gives an empty one.
    """
    ranks = rank_map(ranks_path)
    small_batches(docs.sparkSession)
    short_plans(docs.sparkSession)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    # few large tasks rather than many small ones: each word is encoded once a task
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    docs = docs.coalesce(max(2 * cores, -(-(size or 0) // TASK_BYTES)))
    given = docs.select(*keep, F.col("text").alias("_text"))
    kept = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep)
    splitter = Splitter(pattern)
    path = common_words(docs, total, ranks, splitter, common_rows)
    release_heap(docs.sparkSession)  # of the plan before, whose literals come again in this one

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "word", "doc"]

        def begun() -> Book:
            return Book(*(_common(path, c).to_numpy().view(np.uint64) for c in ("first", "second")))

        book = begun()
        most = book.n + max_words
        for b in batches:
            texts = [t or "" for t in b["_text"].to_pylist()]
            parts: list[list[np.ndarray]] = [[] for _ in texts]
            done = held = 0

            def given_out(upto: int, b: pa.RecordBatch = b, parts: list = parts) -> pa.RecordBatch:
                docs = [b"".join(x.tobytes() for x in parts[i]) for i in range(done, upto)]
                for i in range(done, upto):
                    parts[i] = []
                part = b.slice(done, upto - done)
                return pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.nulls(upto - done, pa.list_(pa.int16())), pa.array(docs, pa.binary())], names)

            for group in splitter.windows(texts):
                begins = group[0][0]
                if group[0][2] and (held > WINDOW or book.n >= most or book.piece_bytes > MAX_PIECE_BYTES):
                    if begins > done:
                        yield given_out(begins)
                    done, held = begins, 0
                    if book.n >= most or book.piece_bytes > MAX_PIECE_BYTES:
                        book = begun()
                        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, b[c].type) for c in keep), pa.nulls(1, pa.list_(pa.int16())), pa.nulls(1, pa.binary())], names)
                joined, codes, start, end, owner = splitter.split(group)
                if not len(start):
                    continue
                numbers, counts, new = book.number(joined, codes, start, end)
                for i in range(0, len(new), 20_000):
                    part = new[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), b[c].type) for c in keep), _byte_lists(part), pa.nulls(len(part), pa.binary())], names)
                edge = np.flatnonzero(np.diff(owner)) + 1
                last = np.cumsum(counts)
                for i, x in zip(owner[np.concatenate(([0], edge))].tolist(), np.split(numbers, last[edge - 1]), strict=True):
                    parts[i].append(x)
                held += len(numbers)
            if len(texts) > done:
                yield given_out(len(texts))
        del book
        release_memory()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = Pieces(_common(path, "ids")), {}

        def long_word(numbers: np.ndarray, size: int) -> np.ndarray:
            own = [ids.join(numbers[k : k + 1]) for k in range(len(numbers))]
            found = stitched(own, size, lambda x: pieces.lengths(x.astype(np.int64)))
            if found is not None:
                return found
            raw = [pieces.join(x).tobytes() for x in own]
            whole = b"".join(r[:STRIDE] for r in raw[:-2]) + raw[-2][: size - PIECE - STRIDE * (len(raw) - 2)] + raw[-1]
            if not known:
                known.update((pieces.join(np.array([i])).tobytes(), i) for i in range(pieces.n))
            return np.array(merged_long(whole, known), np.uint32)

        def ids_of(numbers: np.ndarray) -> Iterator[np.ndarray]:
            at = 0
            for m in [*np.flatnonzero(numbers < 0).tolist(), len(numbers)]:
                if m < at:
                    continue
                for k in range(at, m, CHUNK):
                    yield ids.join(numbers[k : min(m, k + CHUNK)])
                if m < len(numbers):
                    at = m + 2 - int(numbers[m])
                    yield long_word(numbers[m + 2 : at], int(numbers[m + 1]))

        for b in batches:
            kind = np.where(b["doc"].is_valid().to_numpy(zero_copy_only=False), 2, b["ids"].is_valid().to_numpy(zero_copy_only=False).astype(int))
            for run in np.split(np.arange(len(kind)), np.flatnonzero(np.diff(kind)) + 1):
                if not len(run):
                    continue
                part = b.slice(int(run[0]), len(run))
                if kind[run[0]] == 0:
                    ids = Pieces(_common(path, "ids"))
                elif kind[run[0]] == 1:
                    ids.add(part["ids"])
                else:
                    out = []
                    for doc in part["doc"]:
                        n, coded, plain = 0, hashlib.sha256(), hashlib.sha256()
                        for x in ids_of(np.frombuffer(doc.as_buffer(), np.int32)):
                            n += len(x)
                            coded.update(x.astype("<u4").tobytes())
                            for k in range(0, len(x), CHUNK):
                                plain.update(pieces.join(x[k : k + CHUNK]).tobytes())
                        out.append((n, coded.hexdigest(), plain.hexdigest()))
                    cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), *cols], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
        del ids
        release_memory()

    tokens = [t for t, _ in sorted(ranks.ranks.items(), key=lambda x: x[1])]
    pieces = Pieces(pa.array(tokens, pa.binary()))

    numbered = given.mapInArrow(number, f"{kept}, word array<smallint>, doc binary")
    encoded = numbered.select(*keep, "doc", F.when(F.col("word").isNotNull(), ranks.encode(F.col("word")).cast("array<int>")).alias("ids"))
    return encoded.mapInArrow(assemble, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, ["doc_id"], public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
