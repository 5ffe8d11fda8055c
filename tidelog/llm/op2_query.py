"""op2: near-duplicate vectors of every row of embeddings, at a cosine of 0.95."""

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.vector_dedup import near_vectors

NAME = "op2_embedding_near_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
