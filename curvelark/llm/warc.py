"""WARC archives of Zstandard frames: one frame a record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import hash_sample, shared_dir, small_batches, staged

# Fixed values of the format: the skippable frame of a dictionary, and the magic numbers of frames and of dictionaries.
DICT_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
DICT_MAGIC = 0xEC30A437

#: Payloads of fewer bytes are stored however often they occur.
MIN_REVISIT = 1000
#: Rows and bytes of each that the dictionary is trained on at most, and its size.
DICT_ROWS, DICT_ROW_BYTES, DICT_BYTES = 400, 4096, 48_000
#: Uncompressed bytes after which an archive is closed and another begun.
ARCHIVE_BYTES = 48 << 20


class WarcError(ValueError):
    """An archive that breaks the format."""


def _date(_: object = None) -> str:
    return "2024-01-01T00:00:00Z"  # fixed, so that archives of equal input are equal


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record. A revisit has no block; its headers carry the digest and length of the payload that it stands for."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_date()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    head.append(f"X-Payload-Length: {size}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and block of one record; version line, required headers, lengths and the digest of a stored payload are validated."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header without a colon: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise WarcError(f"headers are missing: {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, but the frame has {len(rest) - 4} bytes of content")
    fields["block"] = rest[:n]  # type: ignore[assignment]
    if fields["warc-type"] == "response" and (given := fields.get("warc-payload-digest")) and given != "sha1:" + base64.b32encode(hashlib.sha1(rest[:n]).digest()).decode():
        raise WarcError("the payload does not have its digest")
    return fields


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of the samples, or none where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, threads=0).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=6).compress(dictionary)
    return struct.pack("<II", DICT_FRAME, len(packed)) + packed if dictionary else b""


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time. The dictionary is taken from the skippable frame, if it is led by one.

    The dictionary may itself be compressed. Every other frame is decoded alone with it; skippable frames
    elsewhere are passed over; a truncated or foreign frame raises.
    """
    view, at, used = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_FRAME:
        (n,) = struct.unpack_from("<I", data, 4)
        at = 8 + n
        if at > len(data):
            raise WarcError("the dictionary frame is truncated")
        raw = bytes(view[8:at])
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if raw[:4] != struct.pack("<I", DICT_MAGIC):
            raise WarcError("the leading skippable frame holds no dictionary")
        used = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=used) if used else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("a frame is truncated")
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME:
            raise WarcError(f"no frame begins at byte {at}")
        one, out, pos = reader.decompressobj(), io.BytesIO(), at
        while not one.eof and pos < len(data):
            step = view[pos : pos + (1 << 16)]
            out.write(one.decompress(step))
            pos += len(step)
        if not one.eof:
            raise WarcError("a frame is truncated")
        at = pos - len(one.unused_data)
        yield out.getvalue()


def records(data: bytes) -> Iterator[dict]:
    return map(parse_record, frames(data))


def revisit_plan(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is the largest page_id of those with the payload, null for that page itself and for small payloads.

    A page without an id revisits like others; where no page with the payload has one, none is a revisit. Rows that repeat the largest id all stay responses.

    Payloads are compared by SHA-1 over narrow rows. Digests of single pages need no join; the others are one row each, salted,
    so a payload that a third of all pages share is spread.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    shared = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    shared = staged(shared.select("payload_digest", "_last"), "warc-shared").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
        .join(shared, ["payload_digest", "_salt"], "left")
        .select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("page_id").isNull() | (F.col("_last") > F.col("page_id")), F.col("_last")).alias("refers_to"))
    )


def write_archives(pages: DataFrame, folder: str) -> int:
    """Write a record for each page into ``*.warc.zst`` files under ``folder`` (a URI that all executors reach); the number of records.

    A task writes under names of its own and moves its files to their final names when all are whole, so a task that is run again
    replaces its files and leaves neither halves nor surplus ones. The dictionary is trained on at most DICT_ROWS pages, by hash.

    Null html is an empty payload, and null urls have no header; repeated rows and null ids are records like others, columns of other names are ignored, an empty table writes
    no file. A record is held whole, so a very long payload takes a few times its size in a task, and its archive is longer than ARCHIVE_BYTES.
    """
    small_batches(pages.sparkSession)
    sample = hash_sample(pages.where("html IS NOT NULL"), "page_id", DICT_ROWS, 0).select(F.substring("html", 1, DICT_ROW_BYTES)).collect()
    dictionary = train_dictionary([r[0].encode() for r in sample])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=3, dict_data=kept, write_checksum=True) if kept else zstandard.ZstdCompressor(level=3, write_checksum=True)
        out, tmp, size, part, n, whole = None, "", 0, 0, 0, []

        def close() -> None:
            nonlocal out, part
            if out is not None:
                out.close()
                whole.append(tmp)
                out, part = None, part + 1

        def settle() -> None:
            """Give the files their names, in place of those of an earlier attempt, which may have cut its rows into more."""
            own = f"part-{task.partitionId():06d}-"
            for i, at in enumerate(whole):
                store.move(at, f"{base}/{own}{i:04d}.warc.zst")
            for f in store.get_file_info(pafs.FileSelector(base)) if task.attemptNumber() else []:
                if f.base_name.startswith(own) and int(f.base_name[len(own) :].split(".")[0]) >= len(whole):
                    store.delete_file(f.path)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    tmp, size = f"{base}/.part-{task.partitionId():06d}-{part:04d}.{task.taskAttemptId()}", 0
                    out = store.open_output_stream(tmp)
                    out.write(dictionary_frame(dictionary))
                page_id, url, payload, length, digest, refers_to = row
                raw = record("response" if refers_to is None else "revisit", page_id, url, payload, digest, length, refers_to)
                out.write(press.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return revisit_plan(pages).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives under ``folder``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits).

    Archives are read by Spark's binary source, whole (they are bounded by ARCHIVE_BYTES), and decoded frame by frame.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    target = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def number(uri: str | None) -> int | None:
        return int(x) if uri and (x := uri.strip("<>").rpartition(":")[2]) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for r in records(data.as_buffer().to_pybytes()):
                    kind, block = r["warc-type"], r["block"]
                    url = r.get("warc-target-uri")
                    rows.append((number(r["warc-record-id"]), int(r["x-payload-length"]), base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex(), kind, number(r.get("warc-refers-to")), url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), block if kind == "response" else None))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(read, schema)


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page written and read back. Rows that repeat the largest page_id of a payload are all responses; null html is an empty payload."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND last > page_id THEN last END AS refers_to
FROM m
"""
