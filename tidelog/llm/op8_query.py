"""op8: extendible-hash sharding of every row of documents."""

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.sharding import MAX_BITS, shard

NAME = "op8_sharding"
LIMIT = 1 << 20


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, LIMIT).drop("text")


ORACLE = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 12) AS BIGINT) AS h
  FROM documents),
every AS (
  SELECT doc_id, n_bytes, d AS depth, h >> ({MAX_BITS} - d) AS prefix FROM hashed, generate_series(0, {MAX_BITS}) AS g(d)),
sums AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM every GROUP BY ALL),
best AS (
  SELECT e.doc_id, e.prefix, e.depth, e.n_bytes, s.shard_bytes, s.shard_rows,
         row_number() OVER (PARTITION BY e.doc_id ORDER BY e.depth) AS place
  FROM every e JOIN sums s USING (depth, prefix) WHERE s.shard_bytes <= {LIMIT} OR e.depth = {MAX_BITS})
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), {MAX_BITS}, '0'), CAST(depth AS INTEGER)) END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes,
       CAST(shard_rows AS BIGINT) AS shard_rows, shard_bytes > {LIMIT} AS oversized
FROM best WHERE place = 1
"""
