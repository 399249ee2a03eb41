"""Secret scans through nested encodings: a worklist of decoded layers, each rescanned, with spans mapped to the text."""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import zlib
from binascii import a2b_base64
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import release_memory, small_batches

#: Kinds in the order in which spans at one start are listed. Pattern and least length of what is measured.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST = 12
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_ESCAPED = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
_LETTER = "[A-Za-z0-9+/_-]"
#: A line break, raw or escaped, with the blanks around it.
_BREAK = r"(?:[ \t\r]*+\n[ \t\r]*+|(?:\\[rn])++)"
#: A run of base64 over all its lines: one long line with what follows it, or several of any length.
_BASE64 = re.compile(rf"(?<!{_LETTER})(?:{_LETTER}{{20,}}+(?:{_BREAK}{_LETTER}++)*+|{_LETTER}++(?:{_BREAK}{_LETTER}++)++)={{0,2}}")
_BREAKS = re.compile(_BREAK)
#: Characters of a run of base64, at least, that can hold a secret without compression.
LEAST_RUN = 20


def _zlib_headers() -> list[int]:
    """The 16 bits that zlib data may begin with: method 8, no preset dictionary, divisible by 31."""
    return [h for h in range(0x0800, 0x8000) if h >> 8 & 15 == 8 and h % 31 == 0 and not h & 32]


def _packed_base64() -> re.Pattern:
    """Compressed data in runs too short for all else: the first three characters of each header, and as many more as the least data take."""
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    heads = [f"{signs[h >> 10]}{signs[h >> 4 & 63]}[{re.escape(signs[(h & 15) * 4 : (h & 15) * 4 + 4])}{'_-' if h & 15 == 15 else ''}]" for h in _zlib_headers()]
    return re.compile(rf"(?=[{''.join(sorted({x[0] for x in heads}))}][A-Z])(?:{'|'.join(heads)}){_LETTER}{{5,}}={{0,2}}")


_SHORT = _packed_base64()
#: Headers of gzip and of zlib in bytes, and in text whose characters stand for bytes.
_PACKED = re.compile(rb"\x1f\x8b\x08|" + b"|".join(re.escape(h.to_bytes(2, "big")) for h in _zlib_headers()), re.DOTALL)
_PACKED_TEXT = re.compile("\x1f\x8b\x08|x[\x01^\x9c\xda]")
_WIDE = re.compile("[^\x00-\xff]")
_NOISE = re.compile("[\x00-\x08\x0e-\x1b\x7f-\x9f\udc80-\udcff]")
#: Fewer bytes are no compressed data, and so hold no secret in any coding: all other codings shrink when they are undone.
LEAST_BYTES = 8
#: Text of two bytes a character, the low or the high byte first; all signs that secrets and their codings are made of have a zero byte there.
_UTF16 = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){8,}"), "utf-16-le"), (re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){8,}"), "utf-16-be")
_PIECE = 1 << 14
#: Of compressed data, so many bytes are a layer, which begins so many bytes before the last one's end: matches and codings shorter than that are in one layer whole.
PART_BYTES, OVERLAP_BYTES = 16 << 20, 1 << 20
#: Bytes that all compressed data of a document unfold to at most (what is beyond is counted in n_refused): the guard against archives that unfold without end.
MAX_DOCUMENT_BYTES = 4 << 30

_UTF16_TEXT = re.compile("(?:[\t\n\r\x20-\x7e]\x00){8}|(?:\x00[\t\n\r\x20-\x7e]){8}")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Runs:
    """Where the characters of a text come from: stretches of which each character takes equally many characters of another text."""

    def __init__(self) -> None:
        self.size, self.out, self.at, self.step = 0, array("q"), array("q"), array("q")

    def add(self, n: int, at: int, step: int = 1) -> None:
        """The next ``n`` characters come from ``step`` characters each, from ``at`` on."""
        if not n:
            return
        if not self.out or self.step[-1] != step or self.at[-1] + (self.size - self.out[-1]) * step != at:
            self.out.append(self.size)
            self.at.append(at)
            self.step.append(step)
        self.size += n

    def span(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.out, a) - 1, bisect_right(self.out, b - 1) - 1
        return self.at[i] + (a - self.out[i]) * self.step[i], self.at[j] + (b - self.out[j]) * self.step[j]


class Layer:
    """A decoded text. ``span`` maps a stretch of it to that of the document it comes from.

    Bytes that are no UTF-8 are characters U+DC80 to U+DCFF of the text, so no layer is given up for a part that cannot be read.
    """

    __slots__ = ("_at", "_of_bytes", "_raw", "text")

    def __init__(self, text: str, of_bytes: Callable[[int, int], tuple[int, int]], raw: bytes | None = None):
        """``of_bytes`` maps stretches of ``raw``, or of ``text`` if there are no bytes."""
        self.text, self._of_bytes, self._raw, self._at = text, of_bytes, raw, None

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self._raw is None or len(self._raw) == len(self.text):
            return self._of_bytes(a, b)
        if self._at is None:
            self._at = _byte_offsets(self.text)
        return self._of_bytes(int(self._at[a]), int(self._at[b]))

    def bytes_span(self, raw: bytes) -> Callable[[int, int], tuple[int, int]]:
        """The map of stretches of ``raw``, the bytes of the whole text."""
        if self._raw is not None or len(raw) == len(self.text):
            return self._of_bytes
        at = _byte_offsets(self.text)
        return lambda a, b: self.span(int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b, "left")))

    def bytes(self) -> bytes:
        return self._raw if self._raw is not None else self.text.encode("utf-8", "surrogateescape")


def _byte_offsets(text: str) -> np.ndarray:
    """Where each character begins in the bytes, and their number."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    width[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    return np.concatenate(([0], np.cumsum(width, dtype=np.int64)))


def _lossy(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


def _parts(raw: memoryview, begin: int, budget: list[int]) -> Iterator[tuple[bytes | None, int, bool]]:
    """(output, end of what was read, whether the stream ended) of the gzip members or the zlib data at ``begin``, in overlapping parts; of damaged data, all that comes before the damage.

    ``budget`` holds the bytes that may still be unfolded; without any left the output is None.
    """
    held, at = b"", begin
    while True:
        one, pos, step, tail = zlib.decompressobj(47), at, _PIECE, b""
        while not one.eof and (tail or pos < len(raw)):
            piece = tail or raw[pos : pos + step]
            try:
                got = one.decompress(piece, PART_BYTES)
            except zlib.error:
                if step == 1 or tail:
                    break
                one, step = zlib.decompressobj(47), 1
                again = raw[at:pos]
                while len(again):  # what was given out before is not given out again
                    one.decompress(again, PART_BYTES)
                    again = one.unconsumed_tail
                continue
            pos += 0 if tail else len(piece)
            tail = one.unconsumed_tail
            held += got
            budget[0] -= len(got)
            if budget[0] < 0:
                yield None, pos, False
                return
            if len(held) >= PART_BYTES + OVERLAP_BYTES:
                yield held, pos, False
                held = held[-OVERLAP_BYTES:]
        end = pos - len(one.unused_data)
        if not one.eof or bytes(raw[end : end + 3]) != b"\x1f\x8b\x08":
            yield held, end, one.eof
            return
        at = end


def _inflated(raw: bytes, budget: list[int]) -> Iterator[tuple[bytes | None, int, int]]:
    """(text, start, end) of all gzip and zlib data in ``raw``, wherever it begins; members that follow each other are one text, long ones in overlapping parts. No text: refused for the size of all.

    A damaged stream gives what comes before the damage; but amid other bytes, a stream whose header is not of the usual window must be whole, for chance makes such headers.
    """
    view, at = memoryview(raw), 0
    while found := _PACKED.search(raw, at):
        begin = end = found.start()
        whole = False
        for text, end, whole in _parts(view, begin, budget):
            if text is None:
                yield None, begin, len(raw)
                return
            if len(text) >= LEAST_BYTES and (whole or begin == 0 or raw[begin] in b"\x1fx"):
                yield text, begin, end if whole else len(raw)
        at = max(begin + 1, end if whole else 0)


def _constant(span: tuple[int, int]) -> Callable[[int, int], tuple[int, int]]:
    return lambda a, b: span


def decoded_layers(layer: Layer, budget: list[int], document: bool = False) -> Iterator[Layer | None]:
    """The layers that one step unwraps, none for one that is refused.

    Percent and backslash escapes rewrite the layer as a whole; a run of base64 is a layer of its own for each of the four places where
    its groups may begin, since other text may stand before it without a gap; its characters come from the groups of four they are coded in. Stretches of text in two bytes a character are layers, too.
    Of compressed data every character comes from the whole of it.
    """
    text = layer.text
    for pattern, decode in ((_PERCENT, _percent), (_ESCAPE, _unescape)):
        if ("%" if pattern is _PERCENT else "\\") not in text:
            continue
        parts, runs, at = [], Runs(), 0
        for m in pattern.finditer(text):
            parts.append(text[at : m.start()])
            runs.add(m.start() - at, at)
            parts.append(decode(m[0], m.start(), runs))
            at = m.end()
        if at:
            parts.append(text[at:])
            runs.add(len(text) - at, at)
            yield Layer("".join(parts), lambda a, b, r=runs: layer.span(*r.span(a, b)))
        del parts
    done = 0
    for m in _BASE64.finditer(text):
        yield from _short_layers(layer, done, m.start())
        yield from _base64_layers(layer, m)
        done = m.end()
    yield from _short_layers(layer, done, len(text))
    if "\x00" in text:
        raw = layer.bytes()
        of = layer.bytes_span(raw)
        for m, coding in _two_bytes(raw):
            yield Layer(m[0].decode(coding), lambda a, b, of=of, at=m.start(): of(at + 2 * a, at + 2 * b))
    if not document:
        raw = layer.bytes()
        if _PACKED.search(raw):
            of = layer.bytes_span(raw)
            yield from (out and Layer(_lossy(out), _constant(of(a, b)), out) for out, a, b in _inflated(raw, budget))
    if not text.isascii() and (m := _PACKED_TEXT.search(text)):
        at = m.start()
        while at < len(text):
            wide = _WIDE.search(text, at)  # a character that stands for no byte ends the data
            stop = wide.start() if wide else len(text)
            raw = text[at:stop].encode("latin-1")
            for out, a, b in _inflated(raw, budget):
                yield out and Layer(_lossy(out), _constant(layer.span(at + a, at + b)), out)
            at = stop + 1


def _two_bytes(raw: bytes) -> Iterator[tuple[re.Match, str]]:
    """Stretches of text in two bytes a character with their coding. One order of bytes looks like the other, shifted by one, but for the ends: the longer one is meant."""
    low, high = ([(m, coding) for m in pattern.finditer(raw)] for pattern, coding in _UTF16)
    for own, other, least in ((low, high, 0), (high, low, 1)):
        at = 0
        for m, coding in own:
            while at < len(other) and other[at][0].end() <= m.start():
                at += 1
            rest = other[at][0] if at < len(other) and other[at][0].start() < m.end() else None
            if rest is None or len(m[0]) >= len(rest[0]) + least:
                yield m, coding


def _base64_layers(layer: Layer, m: re.Match) -> Iterator[Layer]:
    run = m[0].rstrip("=")
    pieces, begin = [], 0
    for p in _BREAKS.finditer(run):
        pieces.append((begin, p.start()))
        begin = p.end()
    pieces.append((begin, len(run)))
    clean = "".join(run[a:b] for a, b in pieces)
    if len(clean) < LEAST_RUN:
        return
    at = Runs()
    for a, b in pieces:
        at.add(b - a, m.start() + a)
    clean, n = clean.translate(_URLSAFE), len(clean)

    def of_bytes(k: int) -> Callable[[int, int], tuple[int, int]]:
        def span(a: int, b: int) -> tuple[int, int]:
            first, last = k + a // 3 * 4, k + ((b - 1) // 3 + 1) * 4
            first, end = at.span(first, min(last, n))
            return layer.span(first, m.end() if last >= n else end)

        return span

    for k in range(4):
        size = n - k
        coded = clean[k : n - (size % 4 == 1)]
        raw = a2b_base64(coded + "=" * (-len(coded) % 4))
        yield Layer(_lossy(raw), of_bytes(k), raw)


def _short_layers(layer: Layer, begin: int, end: int) -> Iterator[Layer]:
    """Compressed data in base64 of the text between two runs that are decoded anyway."""
    for m in _SHORT.finditer(layer.text, begin, end):
        run = m[0].rstrip("=").translate(_URLSAFE)
        coded = run[: len(run) - (len(run) % 4 == 1)]
        raw = a2b_base64(coded + "=" * (-len(coded) % 4))
        yield Layer(_lossy(raw), _constant(layer.span(*m.span())), raw)


_URLSAFE = str.maketrans("-_", "+/")
#: Stretches of characters of one, two, three and four bytes.
_WIDTHS = re.compile("([\0-\x7f\udc80-\udcff]+)|([\x80-\u07ff]+)|([\u0800-\uffff]+)|(.)", re.DOTALL)


def _percent(run: str, at: int, runs: Runs) -> str:
    """The text of a run of percent escapes; a byte that is no UTF-8 is a character of its own."""
    text = _lossy(urllib.parse.unquote_to_bytes(run))
    for m in _WIDTHS.finditer(text):
        runs.add(len(m[0]), at, 3 * m.lastindex)
        at += 3 * m.lastindex * len(m[0])
    return text


def _unescape(run: str, at: int, runs: Runs) -> str:
    """The text of a run of backslash escapes; a pair of surrogates is one character, a single one U+FFFD."""
    out: list[str] = []
    high, begin = 0, 0
    for m in _ESCAPED.finditer(run):
        code = int(m[1] or m[2] or m[3] or m[4], 16)
        if high and 0xDC00 <= code <= 0xDFFF:
            out.append(chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00))
            runs.add(1, at + begin, m.end() - begin)
            high = 0
            continue
        if high:
            out.append("\ufffd")
            runs.add(1, at + begin, m.start() - begin)
        high = code if 0xD800 <= code <= 0xDBFF else 0
        if high:
            begin = m.start()
        else:
            out.append("\ufffd" if code > 0x10FFFF or 0xDC00 <= code <= 0xDFFF else chr(code))
            runs.add(1, at + m.start(), m.end() - m.start())
    if high:
        out.append("\ufffd")
        runs.add(1, at + begin, len(run) - begin)
    return "".join(out)


def deep_scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, int]:
    """(base spans, all spans, decoded layers that can be read or hold a match, refused layers) of a text.

    The worklist holds layers not yet unwrapped, with each character's span in the text. A layer seen before, at the same place, is
    not opened again, so nesting ends at its fixpoint whatever it holds. A match in a layer spans, in the text, what its characters come from.
    """
    base = scan(text)
    found, layers, refused, budget = set(base), 0, 0, [MAX_DOCUMENT_BYTES]
    if not _may_decode(text):
        return base, _sorted(found), 0, 0
    todo, document = [Layer(text, lambda a, b: (a, b))], True
    seen = {(hashlib.blake2b(text.encode("utf-8", "surrogatepass")).digest(), 0, len(text))}
    while todo:
        for inner in decoded_layers(todo.pop(), budget, document):
            if inner is None:
                refused += 1
                continue
            if not inner.text:
                continue
            matches = scan(inner.text)
            counts = bool(matches) or _NOISE.search(inner.text) is None
            further = _may_decode(inner.text) or _PACKED.search(inner.bytes()) is not None
            if not counts and not further:
                continue
            key = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass")).digest(), *inner.span(0, len(inner.text)))
            if key in seen:
                continue
            seen.add(key)
            layers += counts
            found.update((kind, *inner.span(a, b)) for kind, a, b in matches)
            if further:
                todo.append(inner)
        document = False
    return base, _sorted(found), layers, refused


def _may_decode(text: str) -> bool:
    return "%" in text or "\\" in text or _BASE64.search(text) is not None or _SHORT.search(text) is not None or ("\x00" in text and _UTF16_TEXT.search(text) is not None) or (not text.isascii() and _PACKED_TEXT.search(text) is not None)


def _sorted(spans: set[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind} removed]"]
        at = b
    return "".join([*out, text[at:]])


FIELDS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("n_refused", pa.int64()), ("clean_text", pa.string())]


def scan_documents(docs: DataFrame, keep: list[str], clean: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` with counts of base matches by kind, the digest of the base spans, all spans, the numbers of decoded and of refused layers, and with ``clean`` the text without secrets.

    Null text counts as empty (its clean text stays null). Each row is scanned alone and whole, where it is read: there is no shuffle. Repeated rows and rows
    with a null id have results of their own, equal texts equal ones; columns of other names are ignored, and an empty table gives an empty one. A very long text takes
    some tens of bytes a character while its layers are open.
    """
    small_batches(docs.sparkSession)
    given = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b["_text"].to_pylist():
                base, spans, layers, refused = deep_scan(text or "")
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(_sorted(set(base))).encode()).hexdigest(), joined(spans), layers, refused, redacted(text, spans) if clean and text is not None else None))
            columns = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True))], [*keep, *(n for n, _ in FIELDS)])
        release_memory()

    schema = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(run, f"{schema}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_refused long, clean_text string")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_documents(docs, ["doc_id"]).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_refused")
