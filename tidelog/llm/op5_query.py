"""op5: MinHash near-dedup of every row of documents, on 4-word shingles at a similarity of 0.8."""

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.minhash_dedup import near_duplicates

NAME = "op5_minhash_near_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
