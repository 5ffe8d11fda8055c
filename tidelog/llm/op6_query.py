"""op6: suffix-array dedup of every row of documents, at 100 bytes."""

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.suffix_dedup import deduplicate

NAME = "op6_suffix_array_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs, with_bytes=False).drop("kept_bytes")
