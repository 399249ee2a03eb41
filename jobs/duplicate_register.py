"""Keep a register of the identifiers of incoming files, so that duplicates and conflicts between classes are known as files arrive.

    spark-submit jobs/duplicate_register.py --documents DIR --out DIR --checkpoint DIR [--config FILE]

A file stream takes each document file once (its checkpoint tells which are new) and runs until nothing new is left. Each batch writes what it
adds, counts by identifier value and class, to ``out/deltas`` (by batch and part); a batch that is repeated after a failure overwrites its own
partitions. Then those parts of ``out/register`` are made anew from all their deltas that have seen a later batch than the register: the others
stay as they are, and a run that ended between the two steps is made good by the next one. ``out`` and ``checkpoint`` belong together.

The register has a row for each value of each identifier: kind, value, n_files, first_path, n_genres, genres.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelark.plans.bases import files_of

CONFIG = Path(__file__).with_suffix(".json")
DELTA = "kind string, value string, genre string, n_files long, first_path string, batch long, part int"
REGISTER = "kind string, value string, n_files long, first_path string, n_genres long, genres string, batch long, part int"
log = logging.getLogger("duplicate_register")


def additions(documents: DataFrame, identifiers: list[str], parts: int) -> DataFrame:
    """(kind, value, genre, n_files, first_path, part) of some documents; null and empty identifiers are left out, rows without an id count but have no path."""
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in identifiers))).alias("_i")
    known = files_of(documents).select("path", "genre", named).select("path", "genre", "_i.*").where("value <> ''")
    counted = known.groupBy("kind", "value", "genre").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"))
    return counted.withColumn("part", F.pmod(F.xxhash64("kind", "value"), F.lit(parts)).cast("int"))


def put(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrite just those partitions that there are rows for."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stored(spark: SparkSession, path: str, schema: str, *by: str) -> DataFrame:
    """A partitioned table, made if there is none yet."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def refresh(spark: SparkSession, out: str) -> list[int]:
    """Make those parts of the register anew that lack a batch; their numbers."""
    deltas, register = stored(spark, f"{out}/deltas", DELTA, "batch", "part"), stored(spark, f"{out}/register", REGISTER, "part")
    last, held = deltas.groupBy("part").agg(F.max("batch").alias("last")), register.groupBy("part").agg(F.max("batch").alias("held"))
    late = sorted(r["part"] for r in last.join(held, "part", "left").where("held IS NULL OR held < last").select("part").collect())  # as many as parts at most
    if late:
        of = deltas.where(F.col("part").isin(late)).groupBy("part", "kind", "value")
        genres = F.array_sort(F.collect_set("genre"))
        whole = of.agg(F.sum("n_files").alias("n_files"), F.min("first_path").alias("first_path"), F.size(genres).cast("long").alias("n_genres"), F.array_join(genres, "/").alias("genres"), F.max("batch").alias("batch"))
        put(whole, f"{out}/register", "part")
    return late


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take what is new; (read, batches, parts): documents and batches taken, and parts of the register made anew."""
    own = json.loads(CONFIG.read_text()) | (config or {})
    seen = {"read": 0, "batches": 0}

    def take(batch: DataFrame, number: int) -> None:
        n = batch.count()
        put(additions(batch, own["identifiers"], own["parts"]).withColumn("batch", F.lit(number).cast("long")), f"{out}/deltas", "batch", "part")
        seen["read"], seen["batches"] = seen["read"] + n, seen["batches"] + 1
        log.info("batch %d: %d documents read from %s, written to %s/deltas", number, n, documents, out)

    own_path = documents.rstrip("/")
    pattern = f"{own_path[:-1]}[{own_path[-1]}]"  # fits the path itself only: a stream takes a single file by a pattern, and a folder either way
    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", own["files_per_trigger"]).parquet(pattern)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    late = refresh(spark, out)
    log.info("%d documents in %d batches; %d parts of %s/register made anew", seen["read"], seen["batches"], len(late), out)
    return seen | {"parts": late}


def main() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    options = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "out", "checkpoint"):
        options.add_argument(f"--{name}", required=True)
    options.add_argument("--config", type=Path, default=CONFIG)
    given = options.parse_args()
    spark = SparkSession.builder.appName("duplicate_register").getOrCreate()
    try:
        run(spark, given.documents, given.out, given.checkpoint, json.loads(given.config.read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
