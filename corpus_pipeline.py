"""From raw documents to token ids: language, near-duplicates, secrets, mix, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents, but
for the last. It begins by clearing the driver's memory of the plans before it, and does so again after its own preparations. Between stages the documents are written as Parquet in the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelark.llm.bpe import encode_documents
from curvelark.llm.langid import identify, train
from curvelark.llm.mixing import mixed_documents
from curvelark.llm.ngram_join import jaccard_components
from curvelark.llm.secrets import scan_documents
from curvelark.operators.staging import lasting, release_heap, staged, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No stage can be told in SQL: a trained model, nested decoding, hashed permutations and ranked merges.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with the calibrated certainty; the others go (null texts and those without a letter among them)."""
    release_heap(spark)
    marked = identify(docs, train(docs), COLUMNS)
    release_heap(spark)
    return marked.where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links between five-word shingle sets of similarity 0.8 or more: that with the smallest id, of several with that id the one with the smallest hash of its text.

    Of rows that repeat an id and a text the smallest by language, source and length stays. Texts without words are in no group and stay, once for each id; rows with a null id are in no
    group and stay, all of them. An empty table gives an empty one.
    """
    release_heap(spark)
    found = staged(jaccard_components(docs, 5, 80).where("doc_id = component_id").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("_n")), "near")
    release_heap(spark)
    none = F.col("component").isNull()
    first = found.where(~none).groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "_n")).alias("_f")).select("_f.*")
    kept = staged(first.unionByName(found.where(none).select("doc_id", "text_hash", "_n")), "kept")
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    pick = lambda rows: named.join(rows.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi")
    repeated = pick(kept.where("_n > 1")).groupBy("doc_id", "text_hash").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("_d")).select("doc_id", "_d.*")
    return pick(kept.where("_n = 1")).select(*COLUMNS).unionByName(repeated.select(*COLUMNS)).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text, nested ones too; null, empty and repeated rows stay as they are, of an empty table none."""
    release_heap(spark)
    scanned = scan_documents(docs, COLUMNS, clean=True)
    found = F.col("spans") != ""
    return scanned.select("doc_id", F.when(found, F.col("clean_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(found, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass over a document. Repeated rows are documents of their own, null and empty texts stay once, an empty table gives an empty mix."""
    release_heap(spark)
    mixed = mixed_documents(docs)
    release_heap(spark)
    return mixed


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix, repeated rows and null ids too; null and empty texts have no tokens."""
    import public_tokenizers

    release_heap(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_documents(docs, ["doc_id", "lang", "source"], path, public_tokenizers.PATTERN)
    release_heap(spark)
    return encoded


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary(spark):  # what a stage stores is of no use once its result is written
            now = stage(spark, docs, sf_dir)
            with lasting():
                docs = staged(now, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
