"""Temporal list join: dated list entries become validity intervals; captures are judged as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^]/?#]*\]|[^/:?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL; the empty string where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels at least; of an address, of four numbers or in brackets, itself alone."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).when((n < 2) | host.rlike(r"^([0-9.]+|\[.*)$"), F.array(host)).otherwise(parents)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, listed_on) -> (pattern, valid_from, valid_to): the spans of time in which a pattern is listed.

    ``action`` is add or remove. A later event of the same pattern ends the span that an earlier one opened; valid_to is
    exclusive and null while nothing ends it. Of events at one time, a removal counts last. Entries with a null
    pattern, action or time are ignored, repeated ones change nothing.
    """
    by_time = W.partitionBy("pattern").orderBy("listed_on", "action")
    return (
        entries.where("pattern IS NOT NULL AND action IS NOT NULL AND listed_on IS NOT NULL")
        .select("pattern", "action", "listed_on")
        .distinct()
        .withColumn("valid_to", F.lead("listed_on").over(by_time))
        .where((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("listed_on"))))
        .select("pattern", F.col("listed_on").alias("valid_from"), "valid_to")
    )


def judge_captures(captures: DataFrame, entries: DataFrame, salts: int = 16) -> DataFrame:
    """Captures (any columns, with url and fetched_on) joined as of fetch time with the entries active then.

    Adds host, blocked, n_active (patterns of the host or a parent domain that were active), pattern (the longest of
    them) and listed_on (when the span that holds the fetch time began: an add of what is listed already begins a new one); columns of these names that
    captures have are replaced. Captures are first reduced to distinct (host, fetch time). Those times and the starts of spans are put in one order
    for each pattern, and each time looks back to the last start: one row for each pattern of a key, however often the pattern was listed and
    removed. A parent domain that many hosts share is salted. Each capture has one result, repeated ones too; null URLs and times match nothing, and
    such captures are not brought together in one task. URLs of any length are read whole. Without captures there are no rows, without entries nothing is blocked.
    """
    keyed = captures.drop("host", "blocked", "n_active", "pattern", "listed_on").withColumn("host", host_of(F.col("url")))
    known = (F.col("host") != "") & F.col("fetched_on").isNotNull()
    keys = keyed.where(known).select("host", "fetched_on").distinct()
    asked = keys.select("host", "fetched_on", F.explode(suffixes(F.col("host"))).alias("pattern"), F.pmod(F.xxhash64("host", "fetched_on"), F.lit(salts)).cast("int").alias("_salt"))
    spans = validity_intervals(entries).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    starts = spans.select("pattern", "_salt", F.col("valid_from").alias("_at"), F.struct("valid_from", "valid_to").alias("_span"))
    times = asked.select("pattern", "_salt", F.col("fetched_on").alias("_at"), "host", "fetched_on")
    back = W.partitionBy("pattern", "_salt").orderBy("_at", F.col("host").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    active = (
        starts.unionByName(times, allowMissingColumns=True)
        .withColumn("_span", F.last("_span", ignorenulls=True).over(back))
        .where(F.col("host").isNotNull() & F.col("_span").isNotNull() & (F.col("_span.valid_to").isNull() | (F.col("fetched_on") < F.col("_span.valid_to"))))
        .groupBy("host", "fetched_on")
        .agg(F.count("*").alias("_judge_n"), F.max(F.struct(F.length("pattern"), F.col("pattern"), F.col("_span.valid_from").alias("valid_from"))).alias("_judge_top"))
        .withColumn("_judge_apart", F.lit(0).cast("long"))
    )
    # captures that can match nothing get a key of their own each
    apart = keyed.withColumn("_judge_apart", F.when(known, 0).otherwise(F.monotonically_increasing_id() + 1).cast("long"))
    return (
        apart.join(active, ["host", "fetched_on", "_judge_apart"], "left")
        .withColumns({"blocked": F.col("_judge_n").isNotNull(), "n_active": F.coalesce("_judge_n", F.lit(0)), "pattern": F.col("_judge_top.pattern"), "listed_on": F.col("_judge_top.valid_from")})
        .drop("_judge_top", "_judge_n", "_judge_apart")
    )


def example_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date that follows from the id, as the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")).alias("fetched_on"))


def example_entries(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts and parent domains of the pages: added, removed and added again at times that follow from a hash."""
    patterns = pages.select(host_of(F.col("url")).alias("host")).distinct().select(F.explode(suffixes(F.col("host"))).alias("pattern")).distinct()
    h = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 6), 16, 10).cast("int")
    first = F.date_add(F.lit("2024-01-01").cast("date"), F.col("h") % 730)
    event = lambda action, when: F.struct(F.lit(action).alias("action"), when.alias("listed_on"))
    gone = F.date_add(first, 30 + F.col("h") % 200)
    events = F.array(event("add", first), F.when(F.col("h") % 3 == 0, event("remove", gone)), F.when(F.col("h") % 6 == 0, event("add", F.date_add(gone, 60))))
    return patterns.withColumn("h", h).where("h % 4 < 2").select("pattern", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("pattern", "e.action", "e.listed_on")


def op3_url_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_captures(example_captures(pages), example_entries(pages)).select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "blocked", "n_active", "pattern", F.col("listed_on").cast("string").alias("listed_on"))


ORACLE = r"""
WITH cap AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^]/?#]*\]|[^/:?#]+)', 1)) AS host,
    (DATE '2024-01-01' + ((page_id * 7919) % 730)::INT)::DATE AS fetched_on FROM pages),
suf AS (
  SELECT host, unnest(CASE WHEN host = '' THEN []::VARCHAR[]
      WHEN len(string_split(host, '.')) < 2 OR regexp_matches(host, '^([0-9.]+|\[.*)$') THEN [host]
      ELSE list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) END) AS pattern
  FROM (SELECT DISTINCT host FROM cap)),
pat AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::INT AS h FROM (SELECT DISTINCT pattern FROM suf)),
listed AS (SELECT pattern, h, (DATE '2024-01-01' + h % 730)::DATE AS first FROM pat WHERE h % 4 < 2),
ev AS (
  SELECT pattern, 'add' AS action, first AS listed_on FROM listed
  UNION SELECT pattern, 'remove', (first + (30 + h % 200))::DATE FROM listed WHERE h % 3 = 0
  UNION SELECT pattern, 'add', (first + (30 + h % 200) + 60)::DATE FROM listed WHERE h % 6 = 0),
span AS (
  SELECT pattern, action, listed_on AS f, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on, action) AS t FROM ev),
hit AS (
  SELECT k.host, k.fetched_on, count(*) AS n, max((length(s.pattern), s.pattern, s.f)) AS top
  FROM (SELECT DISTINCT host, fetched_on FROM cap) k JOIN suf USING (host)
  JOIN span s ON s.pattern = suf.pattern AND s.action = 'add' AND s.f <= k.fetched_on AND (s.t IS NULL OR k.fetched_on < s.t)
  GROUP BY ALL)
SELECT cap.page_id, cap.host, cap.fetched_on::VARCHAR AS fetched_on, hit.n IS NOT NULL AS blocked, coalesce(hit.n, 0) AS n_active,
  top[2] AS pattern, top[3]::VARCHAR AS listed_on
FROM cap LEFT JOIN hit USING (host, fetched_on)
"""
