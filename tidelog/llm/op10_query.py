"""op10: quality scores of every row of documents."""

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.pu_quality import score

NAME = "op10_quality_classifier"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
