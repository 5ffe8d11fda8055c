"""op7: SentencePiece encoding and decoding of every row of documents."""

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.sentencepiece_coder import encode

NAME = "op7_sentencepiece"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def model_bytes(path: str = MODEL_PATH) -> bytes:
    """Read by the driver alone."""
    return Path(path).read_bytes()


def query(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, model_bytes(model_path), with_ids=False).drop("ids")
