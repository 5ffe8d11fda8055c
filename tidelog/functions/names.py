"""Names: qualified, physical, and those of files and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_CATALOG = "default"


def qualified_name(name: Column) -> Column:
    """struct(catalog, database, table) of ``[catalog.]database.table``, each part with or without back-ticks; else null.

    A part without its closing back-tick, an empty part and any other number of parts give null.
    """
    part = r"(`[^`.]+`|[^`.]+)"
    three, two = rf"^{part}\.{part}\.{part}$", rf"^{part}\.{part}$"
    bare = lambda pattern, k: F.translate(F.regexp_extract(name, pattern, k), "`", "")
    whole = F.struct(bare(three, 1).alias("catalog"), bare(three, 2).alias("database"), bare(three, 3).alias("table"))
    short = F.struct(F.lit(DEFAULT_CATALOG).alias("catalog"), bare(two, 1).alias("database"), bare(two, 2).alias("table"))
    return F.when(name.rlike(three), whole).when(name.rlike(two), short)


def physical_name(name: Column) -> Column:
    """struct(schema, table, id) of ``schema##table##id``; else null."""
    pattern = r"^([^#]+)##([^#]+)##(\d+)$"
    take = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(take(1).alias("schema"), take(2).alias("table"), take(3).try_cast("bigint").alias("id")))


def segment_name(path: Column) -> Column:
    """struct(version, segment_id, first_index) of a segment file ``rlog-<version>-<id>-<first>.log``; else null."""
    pattern = r"rlog-(\d+)-(\d+)-(\d+)\.log$"
    take = lambda k: F.regexp_extract(path, pattern, k).try_cast("bigint")
    return F.when(path.rlike(pattern), F.struct(take(1).alias("version"), take(2).alias("segment_id"), take(3).alias("first_index")))


def host_port(address: Column) -> Column:
    """struct(host, port) of ``host:port``; null if there is no port."""
    pattern = r"^(.+):(\d{1,5})$"
    return F.when(address.rlike(pattern), F.struct(F.regexp_extract(address, pattern, 1).alias("host"), F.regexp_extract(address, pattern, 2).cast("int").alias("port")))


def is_healthy(group_status: Column, member_status: Column) -> Column:
    """Whether a shard's route can be used."""
    return F.coalesce((group_status == "RUNNING") & (member_status == "ACTIVE"), F.lit(False))


# Flag bits of an event header, from bit 0.
HEADER_FLAGS = (
    "in_use", "forced_rotate", "thread_specific", "suppress_use", "update_table_map_version", "artificial", "relay_log", "ignorable", "no_filter", "mts_isolate",
)
# SQL mode bits, from bit 0.
SQL_MODES = (
    "real_as_float", "pipes_as_concat", "ansi_quotes", "ignore_space", "not_used", "only_full_group_by", "no_unsigned_subtraction", "no_dir_in_create",
    "postgresql", "oracle", "mssql", "db2", "maxdb", "no_key_options", "no_table_options", "no_field_options", "mysql323", "mysql40", "ansi",
    "no_auto_value_on_zero", "no_backslash_escapes", "strict_trans_tables", "strict_all_tables", "no_zero_in_date", "no_zero_date", "invalid_dates",
    "error_for_division_by_zero", "traditional", "no_auto_create_user", "high_not_precedence", "no_engine_substitution", "pad_char_to_full_length",
)
# Bits of the second flags word of a query, and whether a set bit means off.
QUERY_FLAGS = {"auto_is_null": (14, False), "auto_commit": (19, True), "foreign_key_checks": (26, True), "unique_checks": (27, True)}
# Flag bits of a rows event, from bit 0.
ROW_FLAGS = ("stmt_end", "no_foreign_key_checks", "no_unique_checks", "complete_rows")


def bit(value: Column, k: int) -> Column:
    return F.call_function("bit_get", value.cast("long"), F.lit(k)) == 1


def flags(value: Column, names: tuple[str, ...]) -> list[Column]:
    """A boolean column for each flag."""
    return [bit(value, k).alias(name) for k, name in enumerate(names)]


def flag_list(value: Column, names: tuple[str, ...]) -> Column:
    """The names of the flags that are set, in the order of their bits, comma-joined."""
    return F.concat_ws(",", *(F.when(bit(value, k), F.lit(name)) for k, name in enumerate(names)))


def query_flags(value: Column) -> list[Column]:
    return [(bit(value, k) != F.lit(inverted)).alias(name) for name, (k, inverted) in QUERY_FLAGS.items()]
