"""The file index, its cache, and tables in and out."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import math
import platform
import subprocess
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_title
from ..operators.melody import melody_fingerprint, skyline
from .midi import note_rows, scan_files

#: The classes, in the order that breaks ties, and the version of the pipeline.
GENRES = ["Classical", "Jazz", "Rock", "Blues", "Electronic"]
PIPELINE_VERSION = "v4"
#: The byte order mark that CSV files begin with.
BOM = "\ufeff"


def genre_order(column: str = "genre", genres: list[str] = GENRES):
    return F.array_position(F.array(*map(F.lit, genres)), F.col(column))


def build_index(spark: SparkSession, root: str, genres: list[str] = GENRES) -> DataFrame:
    """A row for each file: genre, file, relative_path, canonical_title, file_size, modified, sha256, melody_fingerprint, fingerprint_error.

    Files that cannot be parsed stay, with a null fingerprint and the error.
    """
    files = scan_files(spark, root, genres)
    base = files.select("path", "genre", "file", F.concat_ws("/", "genre", "file").alias("relative_path"), canonical_title(F.col("file")).alias("canonical_title"), "file_size", "modified", F.sha2("content", 256).alias("sha256"))
    notes = note_rows(files)
    prints = melody_fingerprint(skyline(notes.where("error IS NULL").withColumnRenamed("path", "piece_id"), 0)).withColumnRenamed("piece_id", "path")
    errors = notes.where("error IS NOT NULL").select("path", "error")
    return (
        base.join(prints, "path", "left").join(errors, "path", "left")
        .withColumn("fingerprint_error", F.coalesce("error", F.when(F.col("melody_fingerprint").isNull(), F.lit("melody has fewer than two events"))))
        .drop("path", "error")
        .orderBy(genre_order(genres=genres), F.lower("file"))
    )


def signature(files: DataFrame) -> DataFrame:
    """What tells whether files have changed: (relative_path, file_size, modified)."""
    return files.select(F.concat_ws("/", "genre", "file").alias("relative_path"), "file_size", "modified")


def cache_valid(now: DataFrame, cached: DataFrame) -> bool:
    """Whether two signatures are equal as sets; the order of names, which depends on the file system, doesn't matter."""
    return now.exceptAll(cached).limit(1).count() == 0 and cached.exceptAll(now).limit(1).count() == 0


def cached_index(spark: SparkSession, root: str, cache: str, genres: list[str] = GENRES, force: bool = False) -> DataFrame:
    """The index as stored under ``cache`` if no file has changed since, else built and stored anew."""
    if not force:
        try:
            stored = spark.read.parquet(cache)
            if cache_valid(signature(scan_files(spark, root, genres)), stored.select("relative_path", "file_size", "modified")):
                return stored.orderBy(genre_order(genres=genres), F.lower("file"))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    build_index(spark, root, genres).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache).orderBy(genre_order(genres=genres), F.lower("file"))


def cache_path(folder: str, kind: str, **keys: object) -> str:
    """Where a result with these parameters is kept: partition-style names under the pipeline's version."""
    return "/".join([folder.rstrip("/"), kind, f"version={PIPELINE_VERSION}", *(f"{k}={keys[k]}" for k in sorted(keys))])


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV in UTF-8 whose header begins with a byte order mark; an empty table writes nothing."""
    if df.limit(1).count():
        first, *others = df.columns
        df.toDF(BOM + first, *others).write.mode("overwrite").option("header", True).csv(path)


def frame_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Result rows, some tens, as a table of strings: its columns are the keys of all rows, each where it comes first; what a row lacks is null."""
    keys = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([[None if r.get(k) is None else str(r[k]) for k in keys] for r in rows], ", ".join(f"`{k}` string" for k in keys))


def write_matrix_csv(cells: DataFrame, names: list[str], path: str) -> None:
    """(label_a, label_b, mean_dist) as one CSV file of numbers: a line and a column for each of ``names``, in that order, under a header."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("label_a"))
    wide = cells.groupBy("label_a").pivot("label_b", names).agg(F.first("mean_dist")).orderBy(place)
    wide.select(*names).coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # as many lines as classes


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header, a byte order mark or none; all columns are strings unless a schema is given."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema).option("enforceSchema", True) if schema else reader).csv(path)
    return df.toDF(*(c.removeprefix(BOM) for c in df.columns))


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(path: str, text: str) -> None:
    """Write one file in UTF-8, wherever Spark can write."""
    at, store = _hadoop_path(SparkSession.active(), path)
    out = store.create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def get_text(path: str) -> str | None:
    """The text of one file, or None if it isn't there."""
    spark = SparkSession.active()
    at, store = _hadoop_path(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if store.exists(at) else None


def write_json(value: object, path: str) -> None:
    """JSON without NaN: a result that is not finite is an error, not a value."""
    put_text(path, json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False))


#: Packages whose versions a manifest tells.
PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow")


def environment() -> dict[str, object]:
    """What a run depends on: interpreter, machine, package versions, time, and the state of the repository."""
    def git(*args: str) -> str | None:
        out = subprocess.run(["git", *args], capture_output=True, text=True, check=False)
        return out.stdout.strip() or None if out.returncode == 0 else None

    def version(name: str) -> str:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return "not installed"

    changes = git("status", "--porcelain")
    return {
        "time": datetime.now(UTC).isoformat(timespec="seconds"), "python": sys.version, "executable": sys.executable, "platform": platform.platform(), "processor": platform.processor(),
        "packages": {name: version(name) for name in PACKAGES}, "commit": git("rev-parse", "HEAD"), "branch": git("branch", "--show-current"), "changed": changes is not None, "changes": changes,
    }


def artifact_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, folder: str, path: str, **extra: object) -> dict:
    """Environment, parameters and inventory of a finished run."""
    rows = artifact_inventory(spark, folder).orderBy("path").collect()
    manifest = {"environment": environment(), "pipeline_version": PIPELINE_VERSION, **extra, "artifacts": [r.asDict() for r in rows]}
    write_json(manifest, path)
    return manifest


def run_signature(metrics: DataFrame, predictions: DataFrame) -> str:
    """A digest of all metrics and predictions: equal for runs with equal results, in whatever order rows come.

    Rows' digests are digested in order by their first three digits, and those 4096 digests in turn, so no task sees all rows.
    """
    lines = []
    for df in (metrics, predictions):
        kinds = dict(df.dtypes)
        row = F.concat_ws("\x1f", *(F.coalesce(F.format_number(c, 12) if kinds[c] == "double" else F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)))
        rows = df.select(F.sha2(row, 256).alias("h"))
        parts = rows.groupBy(F.left("h", F.lit(3)).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d")).orderBy("at").collect()
        lines += [f"{r['at']}:{r['d']}" for r in parts] + [""]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def determinism(signature_now: str, path: str) -> bool | None:
    """Whether a run repeats the stored signature; None and stored for later if there is none."""
    before = get_text(path)
    if before is None:
        put_text(path, signature_now)
        return None
    return before.strip() == signature_now


def json_ready(value: object) -> object:
    """A result without its raw arrays and with plain numbers; what is not finite becomes null."""
    if isinstance(value, dict):
        return {k: json_ready(v) for k, v in value.items() if not hasattr(v, "shape") or v.shape == ()}
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value
