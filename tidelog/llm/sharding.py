"""Sharding by extendible hashing.

A directory is indexed by the leading bits of each row's hash. A bucket that holds more than the byte limit is split on
its next bit, and only that bucket; so a shard is the shortest hash prefix whose rows fit the limit. The directory is
found without splitting row by row: one pass sums bytes in cells of ``depth`` leading bits (partial sums before the
shuffle), the cells, a small table, are rolled up to all shorter prefixes, and only cells that are still too large are
taken one more round, on the next bits of their own rows.

A row finds its shard in place: the directory, at most DIRECTORY_ROWS shards (counted), is broadcast a depth at a time and
looked up by the row's prefix of that length; of all depths one has it. Nothing of a row is shuffled. A larger directory joins
the rows' hashes by shuffle, and the rows with them.

Defined results: null keys and texts hash as their own values; an empty text counts 0 bytes. Rows equal in key and text
have one hash and can't be told apart: they stay together, and like a single row above the limit they end in a shard of
MAX_BITS bits marked ``oversized``. An empty table gives no shards. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import cut

MAX_BITS = 48
DIRECTORY_ROWS = 500_000
STEP = 16


def hash48(key: Column, text: Column) -> Column:
    """48 hash bits of a row, as a long."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long")


def _prefix(value: Column, bits: Column) -> Column:
    """The first bits of a 48-bit value, as a long that also tells their number: a leading one, then the bits."""
    shift = (F.lit(MAX_BITS) - bits).cast("int")
    return F.call_function("shiftright", F.lit(1 << MAX_BITS).cast("long") + value, shift)


def directory(hashed: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth, shard_bytes, shard_rows) of every shard. hashed: (h, n_bytes)."""
    shards, rest = None, hashed.select("h", "n_bytes").withColumn("floor", F.lit(0))
    for low in range(0, MAX_BITS, STEP):
        high = low + STEP
        cells = cut(rest.groupBy(_prefix(F.col("h"), F.lit(high)).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")))
        levels = cells.select(
            F.explode(F.sequence(F.lit(low if low == 0 else low + 1), F.lit(high))).alias("depth"), "cell", "bytes", "rows"
        ).withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int")))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        # a shard: it fits, and its parent doesn't (or it is the root); parents are joined on their prefix
        parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("shard_bytes").alias("parent_bytes"))
        tied = sums.withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(parents, ["depth", "parent"], "left")
        split = F.col("parent_bytes").isNull() | (F.col("parent_bytes") > limit)
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == MAX_BITS)
        found = tied.where(split & fits).select("prefix", "depth", "shard_bytes", "shard_rows")
        shards = found if shards is None else shards.unionByName(found)
        if high == MAX_BITS:
            break
        large = sums.where((F.col("depth") == high) & (F.col("shard_bytes") > limit)).select(F.col("prefix").alias("cell"))
        if large.isEmpty():
            break
        rest = rest.withColumn("cell", _prefix(F.col("h"), F.lit(high))).join(large, "cell", "left_semi").drop("cell")
    return cut(shards)


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard (the hash prefix as bits; the root is empty), depth, n_bytes, shard_bytes, shard_rows, oversized."""
    new = ("shard", "depth", "n_bytes", "shard_bytes", "shard_rows", "oversized")
    keep = [c for c in docs.columns if c not in new]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)),
        hash48(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    found = directory(rows, limit).select("prefix", F.col("depth").alias("at"), "shard_bytes", "shard_rows")
    depths = sorted(r.at for r in found.select("at").distinct().collect()) or [0]  # at most MAX_BITS + 1 numbers
    if found.count() <= DIRECTORY_ROWS:
        placed = rows
        for d in depths:
            own = found.where(F.col("at") == d).select(F.col("prefix").alias(f"p{d}"), F.struct("prefix", "at", "shard_bytes", "shard_rows").alias(f"s{d}"))
            placed = placed.join(F.broadcast(own), _prefix(F.col("h"), F.lit(d)) == F.col(f"p{d}"), "left").drop(f"p{d}")
        placed = placed.withColumn("own", F.coalesce(*(f"s{d}" for d in depths))).drop(*(f"s{d}" for d in depths)).select("*", "own.*")
    else:
        looked = rows.withColumn("prefix", F.explode(F.array(*(_prefix(F.col("h"), F.lit(d)) for d in depths))))
        placed = looked.join(found, "prefix")
    return placed.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)),
        F.substring(F.bin("prefix"), 2, MAX_BITS).alias("shard"), F.col("at").cast("int").alias("depth"), "n_bytes", "shard_bytes", "shard_rows",
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """One folder of Parquet per shard. A shard fits one task, so rows are dealt by shard and written in one pass."""
    shard(docs, limit, key, text).repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
