"""Mixing sources to target weights: fixed-length token blocks, multinomial draws, index permutations. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Draws that one row of the generator expands to at most.
CHUNK = 4_096
#: Rows of one (source, bucket) window, about.
BUCKET_ROWS = 500_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """From (source, source_size): the words that each source shall give.

    Sources by code point, null last, weigh ``weights`` in turn. All sizes together are shared by weight; a
    source stops at ``max_repeats`` times its size and the excess is shared again. Ordered by saturation
    ratio, the saturated sources are a prefix, so one pass of running sums gives the common level.
    One row per source: the table is as long as the list of weights, and small.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), F.col("_i"))
    return (
        sizes.withColumn("_i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumns({"_w": w, "_cap": F.col("source_size") * float(max_repeats), "_total": F.sum("source_size").over(all_)})
        .withColumns({
            "_left": F.col("_total") - F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "_open": F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
            "_rank": F.row_number().over(by_ratio),
        })
        .withColumn("_level", F.col("_left") / F.col("_open"))
        .withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
        .withColumn("_common", F.min_by(F.when(~F.col("_full"), F.col("_level")), F.when(~F.col("_full"), F.col("_rank"))).over(all_))
        .select("source", "source_size", F.when(F.col("_full") | F.col("_common").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_common") * F.col("_w"))).alias("target"))
    )


def permuted(index: Column, n: Column, key: Column, seed: int) -> Column:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds over a grid just larger than n, and cycle walking.

    The grid has fewer than one row of cells beyond n, so a walk leaves it after at most that many steps.
    """
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(x: Column) -> Column:
        mix = lambda i, v, m: F.pmod(F.xxhash64(F.lit(seed + i), key, v), m)
        left, right = x % a, F.floor(x / a).cast("long")
        left = (left + mix(1, right, a)) % a
        right = (right + mix(2, left, b)) % b
        left = (left + mix(3, right, a)) % a
        right = (right + mix(4, left, b)) % b
        return left + a * right

    first = once(index)
    return F.when(first < n, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), a), first, lambda acc, _: F.when(acc < n, acc).otherwise(once(acc))))


def mix(rows: DataFrame, block: int = 512, n_shards: int = 64, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 20_24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (rid unique, order_by, source, size), a stored table -> (placed rows, draws, doc-block overlaps).

    Each source's words form one stream: rows by bucket of their hash, then ``order_by``; offsets come from bucket
    totals, so no source is ordered by one task. The stream is packed into blocks of ``block`` words, the last one
    shorter. The source's target, rounded to words, is a number of draws; draw d is in pass d // blocks and
    takes block permuted(d % blocks); the short block is the last of a pass and the last draw takes the words that
    are left, so the target is met to the word and no block is taken more than ``max_repeats`` times.
    How many draws of a source each output shard gets is drawn first (multinomial: every draw falls to a shard by a hash, and is counted); the shard's slots
    of that source are then the next so many draws, so slots are mapped to blocks through the source's permutation.

    Rows of one (source, bucket) window are ordered by one task: a bucket holds about BUCKET_ROWS rows, unless that many repeat one id and one text. Ties in order and repeated rows
    are rows of their own, told apart by rid; an empty table gives empty results.
    """
    keyed = rows.withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    n_buckets = max(64, rows.count() // BUCKET_ROWS)
    keyed = keyed.withColumn("_b", F.pmod(F.xxhash64("order_by", "tie"), F.lit(n_buckets)))
    per_bucket = keyed.groupBy("_k", "source", "_b").agg(F.sum("size").alias("_n"))
    per_source = per_bucket.groupBy("_k", "source").agg(F.sum("_n").alias("source_size"))
    targets = source_targets(per_source.select("source", "source_size"), weights, max_repeats)
    n, t = F.col("source_size"), F.col("_words")
    targets = staged(
        targets.withColumns({"_k": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "_words": F.round("target").cast("long"), "_blocks": F.ceil(n / block)})
        .withColumns({"_passes": F.when(n > 0, F.floor(t / n)).otherwise(0)})
        .withColumn("_rest", t - F.col("_passes") * n)
        .withColumn("_draws", F.when(n > 0, F.col("_passes") * F.col("_blocks") + F.ceil(F.col("_rest") / block)).otherwise(0).cast("long")),
        "mix-targets",
    )
    offsets = (
        per_bucket.drop("source")
        .withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(targets.select("_k", "source_size", "target"), "_k")
        .drop("_n")
    )
    inside = W.partitionBy("_k", "_b").orderBy("order_by", "tie", "size", "rid").rowsBetween(W.unboundedPreceding, 0)
    placed = keyed.withColumn("_end", F.sum("size").over(inside)).join(offsets, ["_k", "_b"]).withColumn("_end", F.col("_end") + F.col("_before")).withColumn("_start", F.col("_end") - F.col("size"))

    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK).cast("long")))
    within = lambda n: F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least((F.col("_chunk") + 1) * CHUNK, n) - 1))
    thrown = (
        targets.where("_draws > 0").select("_k", "_draws", pieces(F.col("_draws")).alias("_chunk")).repartition(parts, "_k", "_chunk")
        .select("_k", within(F.col("_draws")).alias("_draw"))
        .select("_k", F.pmod(F.xxhash64(F.lit(seed), F.col("_k"), F.col("_draw")), F.lit(n_shards)).cast("int").alias("_shard"))
    )
    # a row for each source and shard
    counts = thrown.groupBy("_k", "_shard").agg(F.count("*").alias("_slots")).withColumn("_first", F.sum("_slots").over(W.partitionBy("_k").orderBy("_shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("_slots"))
    full = F.floor(n / block).cast("long")
    d, j = F.col("_draw"), F.col("_place")
    draws = (
        staged(counts, "mix-counts").join(F.broadcast(targets), "_k")
        .withColumn("_chunk", pieces(F.col("_slots"))).repartition(parts, "_k", "_shard", "_chunk")
        .withColumn("_slot", within(F.col("_slots")))
        .withColumn("_draw", F.col("_first") + F.col("_slot"))
        .withColumns({"_pass": F.floor(d / F.col("_blocks")).cast("long"), "_place": (d % F.col("_blocks")).cast("long")})
        .select(
            "_k", "source", "_shard", "_slot", "_pass", "_place",
            F.when(j < full, permuted(j, full, F.col("_k"), seed)).otherwise(j).alias("_block"),
            F.when(F.col("_pass") < F.col("_passes"), F.lit(block).cast("long")).otherwise(F.least(F.lit(block).cast("long"), F.col("_rest") - j * block)).alias("_take"),
        )
    )
    overlaps = placed.select(
        "*", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("_start") / block).cast("long"), F.floor((F.col("_end") - 1) / block).cast("long"))).otherwise(F.array(F.lit(-1).cast("long")))).alias("_block")
    ).withColumns({"_from": F.greatest(F.col("_start"), F.col("_block") * block), "_to": F.least(F.col("_end"), (F.col("_block") + 1) * block)})
    return placed, draws, overlaps


def taken_words(rows: DataFrame, block: int = 512, **settings) -> DataFrame:
    """Of each row of ``rows`` (see :func:`mix`): rid, doc_id, size, source_size, target, the words that the mix takes of it, repeats counted, and the shards that hold them.

    ``shards`` is a list of shard:words by shard, as a string. Every row has a result; rows without words take none.
    """
    _, draws, overlaps = mix(rows, block, **settings)
    # a block is drawn once a pass
    uses = draws.groupBy("_k", "_block").agg(F.collect_list(F.struct("_shard", "_take")).alias("_uses"))
    some = F.explode_outer("_uses")
    words = F.greatest(F.lit(0), F.least(F.col("_to"), F.col("_block") * block + F.col("_use._take")) - F.col("_from"))
    same = ("rid", "doc_id", "source", "size", "source_size", "target")
    return (
        overlaps.join(uses.hint("merge"), ["_k", "_block"], "left")  # its size is not that of the small table it is generated from
        .select(*same, "_block", "_from", "_to", some.alias("_use"))
        .select(*same, F.col("_use._shard").alias("_shard"), F.when((F.col("_block") >= 0) & F.col("_use").isNotNull(), words).otherwise(0).cast("long").alias("_words"))
        .repartition("rid")
        .groupBy(*same, "_shard").agg(F.sum("_words").alias("_words"))
        .groupBy(*same)
        .agg(F.sum("_words").alias("taken"), F.array_sort(F.collect_list(F.when(F.col("_words") > 0, F.struct("_shard", "_words")))).alias("_s"))  # an entry for each shard
        .withColumn("shards", F.array_join(F.transform("_s", lambda x: F.concat_ws(":", x["_shard"].cast("string"), x["_words"].cast("string"))), ","))
        .drop("_s")
    )


def narrow(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, order_by, tie, source, size) of documents; null text has size 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("doc_id").alias("order_by"), F.xxhash64("text").alias("tie"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def mixed_documents(docs: DataFrame, block: int = 512, **settings) -> DataFrame:
    """The mix as documents, with the columns doc_id, text, lang, source, n_chars: a row for each pass over a document, with the words that the pass takes.

    A document that a pass takes whole keeps its text; of others, the words taken stay, in order, with the white space before
    each. Documents without words are taken whole once. Null ids, texts and sources are kept as they are.
    """
    stored = staged(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "lang", "source", "n_chars"), "mix-docs")
    rows = stored.select("rid", "doc_id", F.col("doc_id").alias("order_by"), F.xxhash64("text").alias("tie"), "source", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = staged(rows, "mix-rows")
    _, draws, overlaps = mix(rows, block, **settings)
    upto = F.least(F.col("_to"), F.col("_block") * block + F.col("_take"))
    pieces = (
        overlaps.where("_block >= 0")
        .join(draws.select("_k", "_block", "_pass", "_take").hint("merge"), ["_k", "_block"])
        .where(upto > F.col("_from"))
        .groupBy("rid", "size", "_pass")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("_from") - F.col("_start") + 1).cast("int").alias("at"), (upto - F.col("_from")).cast("int").alias("n")))).alias("_runs"), F.sum(upto - F.col("_from")).alias("_got"))  # at most size / block + 1 runs
    )
    empty = rows.where("size = 0").select("rid", "size", F.lit(0).cast("long").alias("_pass"), F.array().cast("array<struct<at:int,n:int>>").alias("_runs"), F.lit(0).cast("long").alias("_got"))
    words = F.regexp_extract_all(F.col("text"), F.lit(SPACED_WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform(F.col("_runs"), lambda r: F.slice(F.col("_w"), r["at"], r["n"]))), "")
    return (
        stored.join(pieces.unionByName(empty), "rid")
        .withColumn("_w", F.when(F.col("_got") < F.col("size"), words))
        .withColumn("text", F.when(F.col("_got") < F.col("size"), some).otherwise(F.col("text")))
        .select("doc_id", "text", "lang", "source", F.when(F.col("_got") < F.col("size"), F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))
    )


def mixed_blocks(docs: DataFrame, block: int = 512, **settings) -> DataFrame:
    """The mix by output shards: (shard, source, slot, text), a row for each slot, with the words of the block that its draw takes, one blank between two.

    Slots of a source in a shard count from 0 without gaps.
    """
    stored = staged(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "source"), "mix-docs")
    rows = stored.select("rid", "doc_id", F.col("doc_id").alias("order_by"), F.xxhash64("text").alias("tie"), "source", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    _, draws, overlaps = mix(staged(rows, "mix-rows"), block, **settings)
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    at, n = (F.col("_from") - F.col("_start") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")
    held = overlaps.where("_block >= 0").join(stored.select("rid", words.alias("_w")), "rid").select("_k", "_block", "_from", F.slice("_w", at, n).alias("_w"))
    filled = held.groupBy("_k", "_block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_from", "_w"))), lambda x: x["_w"])).alias("_w"))  # block words at most
    return draws.hint("merge").join(filled, ["_k", "_block"]).select(F.col("_shard").alias("shard"), "source", F.col("_slot").alias("slot"), F.array_join(F.slice("_w", F.lit(1), F.col("_take").cast("int")), " ").alias("text"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(narrow(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-rows")
    return taken_words(rows).select("doc_id", "size", "source_size", "target", "taken", "shards", "source")
