"""Differences between the images of updates, and what they add up to.

A change is a pair of cells at one place that differ, where null differs from every value but null; a cell that an image
doesn't have is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.measures import percent_bucket, share

SPARSE_PERCENT, FREQUENT_SHARE = 30.0, 0.5
CELL_BYTES = 24


def _cells(before: Column, after: Column) -> Column:
    n = F.greatest(F.coalesce(F.size(before), F.lit(0)), F.coalesce(F.size(after), F.lit(0)))
    n = F.greatest(n, F.lit(0))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("column_index"), F.get(before, i).alias("before"), F.get(after, i).alias("after")))


def diff(before: Column, after: Column, ignored: tuple[int, ...] = (), only: tuple[int, ...] | None = None) -> Column:
    """array<struct(column_index, before, after)> of changed cells, without ignored places, or of certain places only."""
    changed = F.filter(_cells(before, after), lambda c: ~c["before"].eqNullSafe(c["after"]))
    if ignored:
        changed = F.filter(changed, lambda c: ~c["column_index"].isin(*ignored))
    return changed if only is None else F.filter(changed, lambda c: c["column_index"].isin(*only) if only else F.lit(False))


def kind(before: Column, after: Column) -> Column:
    return F.when(before.isNull() & after.isNotNull(), "null_to_value").when(before.isNotNull() & after.isNull(), "value_to_null").when(before.isNotNull() & after.isNotNull(), "value_to_value").otherwise("unchanged")


def updates(feed: DataFrame) -> DataFrame:
    """Rows that have both images, with diff, changed (their number), total (columns) and percent."""
    rows = feed.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    rows = rows.withColumn("diff", diff(F.col("before"), F.col("after"))).withColumn("changed", F.size("diff"))
    return rows.withColumn("total", F.greatest(F.size("before"), F.size("after"))).withColumn("percent", share(F.col("changed").cast("double"), F.col("total")))


def fields(rows: DataFrame) -> DataFrame:
    """A row for each changed cell: column_index, before_value, after_value, kind."""
    flat = rows.select(*(c for c in ("event_id", "key") if c in rows.columns), F.explode("diff").alias("c"))
    return flat.select(*(c for c in ("event_id", "key") if c in rows.columns), "c.column_index", F.col("c.before").alias("before_value"), F.col("c.after").alias("after_value"), kind(F.col("c.before"), F.col("c.after")).alias("kind"))


def has_change(diff_: Column, index: int) -> Column:
    return F.exists(diff_, lambda c: c["column_index"] == index)


def change_at(diff_: Column, index: int) -> Column:
    """The change of one column; null if it has none."""
    return F.get(F.filter(diff_, lambda c: c["column_index"] == index), F.lit(0))


def new_values(diff_: Column) -> Column:
    """column_index -> new value of the changed columns."""
    return F.map_from_arrays(F.transform(diff_, lambda c: c["column_index"]), F.transform(diff_, lambda c: c["after"]))


def apply_diff(before: Column, diff_: Column) -> Column:
    """The image after, from the one before and the changes."""
    return F.transform(before, lambda v, i: F.when(F.exists(diff_, lambda c: c["column_index"] == i), F.get(F.filter(diff_, lambda c: c["column_index"] == i), F.lit(0))["after"]).otherwise(v))


def is_partial(changed: Column, total: Column) -> Column:
    return (changed > 0) & (changed < total)


def is_sparse(percent: Column, threshold: float = SPARSE_PERCENT) -> Column:
    return percent < threshold


def savings(changed: Column, total: Column) -> Column:
    """What a record of changed columns alone saves, in percent of all columns."""
    return share((total - changed).cast("double"), total)


def image_bytes(image: Column) -> Column:
    return F.aggregate(image, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(F.octet_length(c), F.lit(0)) + CELL_BYTES)


def analysis(rows: DataFrame, ignored: tuple[int, ...] = (), threshold: float = SPARSE_PERCENT) -> DataFrame:
    """Each update: changed columns without ignored ones, effective percent, bytes of images and changes, overhead, advice."""
    kept = F.filter("diff", lambda c: ~c["column_index"].isin(*ignored)) if ignored else F.col("diff")
    out = rows.withColumn("effective", F.size(kept)).withColumn("effective_percent", share(F.col("effective").cast("double"), F.col("total")))
    of_changes = F.aggregate(kept, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(F.octet_length(c["before"]), F.lit(0)) + F.coalesce(F.octet_length(c["after"]), F.lit(0)) + 2 * CELL_BYTES)
    out = out.withColumn("image_bytes", image_bytes(F.col("before")) + image_bytes(F.col("after"))).withColumn("diff_bytes", of_changes)
    return out.withColumn("overhead_percent", share(F.col("diff_bytes").cast("double"), F.col("image_bytes"))).withColumn("recommended", (F.col("effective") > 0) & is_sparse(F.col("effective_percent"), threshold))


def batch(rows: DataFrame, by: list[str], threshold: float = SPARSE_PERCENT) -> DataFrame:
    """Updates added up: their number, changed and partial and sparse ones, mean percent, share of all columns that changed."""
    sparse = is_sparse(F.col("percent"), threshold) & (F.col("changed") > 0)
    return rows.groupBy(*by).agg(
        F.count("*").alias("updates"), F.count_if(F.col("changed") > 0).alias("changed_updates"), F.count_if(is_partial(F.col("changed"), F.col("total"))).alias("partial_updates"),
        F.count_if(sparse).alias("sparse_updates"), F.count_if(F.col("percent") > 75).alias("full_updates"), F.avg("percent").alias("avg_percent"),
        (100.0 * F.sum("changed") / F.sum("total")).alias("changed_share"), (100.0 * F.count_if(sparse) / F.count("*")).alias("sparse_share"),
        (F.count_if(is_sparse(F.col("percent"), threshold)) * 2 >= F.count("*")).alias("mostly_sparse"),
    )


def frequency(rows: DataFrame, columns: int, frequent: float = FREQUENT_SHARE) -> DataFrame:
    """How often each column changed, its share of all updates, and whether that is frequent (at least floor(n * share))."""
    counted = rows.select(F.explode("diff.column_index").alias("column_index")).groupBy("column_index").agg(F.count("*").alias("changes"))
    everything = rows.agg(F.count("*").alias("updates"))
    all_columns = rows.sparkSession.range(columns).select(F.col("id").cast("int").alias("column_index"))
    out = all_columns.join(counted, "column_index", "left").join(F.broadcast(everything)).withColumn("changes", F.coalesce("changes", F.lit(0)).cast("long"))
    return out.withColumn("percent", share(F.col("changes").cast("double"), F.col("updates"))).withColumn("frequent", F.col("changes") >= F.floor(F.col("updates") * frequent))


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(percent_bucket(F.col("percent")).alias("bucket")).agg(F.count("*").alias("updates"))
