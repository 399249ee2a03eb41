"""Identifiers are derived from whole texts: that is to happen once a file."""

from pyspark.sql import functions as F

from curvelark.operators import dedup


def counted(spark):
    """Files whose title counts how often it was derived, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def title(path):
        seen.add(1)
        return f"title {int(path[-3:]) // 3}"

    path = F.format_string("g%d/%03d", F.col("id") % 2, "id")
    files = spark.range(60).select(path.alias("path"), F.format_string("g%d", F.col("id") % 2).alias("genre"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit("").alias("melody_fingerprint"))
    return files.withColumn("canonical_title", F.udf(title, "string")("path")), seen


def test_conflicts_derive_identifiers_once(spark):
    files, seen = counted(spark)
    assert dedup.conflict_summary(dedup.duplicate_groups(dedup.duplicate_labels(files))).first().group_count == 20
    assert seen.value == 60


def test_rounds_derive_identifiers_once(spark):
    files, seen = counted(spark)
    own = files.withColumn("canonical_title", F.concat("genre", "canonical_title"))
    sample, read = dedup.sample_by_rounds(dedup.duplicate_labels(own), 5, 1, lambda some: some)
    assert sample.count() == read == 10 and seen.value == 60
