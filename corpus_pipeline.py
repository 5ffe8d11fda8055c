"""A corpus pipeline of the operators in tidelog.llm: judge, deduplicate, cut repeats, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import minhash_dedup, mixing, op3_query, op7_query, pu_quality, sentencepiece_coder, suffix_dedup
from tidelog.llm.cluster import drop, table, tables

#: No SQL: the classifier, the suffix construction and the tokenizer have none; tests hold the stages against brute force.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return pu_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    found = minhash_dedup.near_duplicates(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    gone = found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut from the texts; bytes of a character cut in two become U+FFFD."""
    cut = suffix_dedup.deduplicate(docs.select(*COLUMNS)).withColumn("text", F.make_valid_utf8(F.col("kept_bytes").cast("string")))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their raked probabilities."""
    mixed = mixing.mix(docs, F.col("source"), F.col("lang"), op3_query.topic(F.col("text")), op3_query.TARGETS, op3_query.BUDGET)
    return mixed.where("drawn").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return sentencepiece_coder.encode(docs, op7_query.model_bytes()).select("doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "restored")


STAGES = [
    ("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeats),
    ("mixing to target weights", mixture), ("SentencePiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's result is written; then what it was made from goes, so that two stages' files are kept at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(tables(spark))
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
        drop(spark, [t for t in tables(spark)[:-1] if t not in others])
    return STAGES[-1][1](spark, docs, sf_dir)
