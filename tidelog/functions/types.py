"""Column types of the log, of target records and of Spark, and the maps between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log's column type codes.
SOURCE_TYPES = {
    0: "DECIMAL", 1: "TINY", 2: "SHORT", 3: "LONG", 4: "FLOAT", 5: "DOUBLE", 6: "NULL", 7: "TIMESTAMP", 8: "LONGLONG", 9: "INT24",
    10: "DATE", 11: "TIME", 12: "DATETIME", 13: "YEAR", 14: "NEWDATE", 15: "VARCHAR", 16: "BIT", 17: "TIMESTAMP2", 18: "DATETIME2",
    19: "TIME2", 20: "ARRAY", 243: "INVALID", 244: "BOOL", 245: "JSON", 246: "NEWDECIMAL", 247: "ENUM", 248: "SET",
    249: "TINY_BLOB", 250: "MEDIUM_BLOB", 251: "LONG_BLOB", 252: "BLOB", 253: "VAR_STRING", 254: "STRING", 255: "GEOMETRY",
}
# The target types of relay records and their codes.
TARGET_TYPES = {
    "null": 0, "boolean": 1, "byte": 2, "short": 3, "int": 4, "long": 5, "decimal": 6, "double": 7, "float": 8, "time": 9, "date": 10,
    "timestamp": 11, "bytes": 12, "string": 13, "datetime": 14, "other": 19, "multivalue": 22, "geo2d": 23, "blob": 24, "binary": 25,
    "bytearray": 26, "shortarray": 27, "intarray": 28, "floatarray": 29, "json": 30, "stringarray": 31, "doublearray": 32, "longarray": 33,
    "jsonb": 40, "geojson": 41, "geometry": 42, "bitmap": 43, "map": 50,
}
# Other spellings of target type names.
TARGET_ALIASES = {"bool": "boolean", "integer": "int", "bigint": "long", "varchar": "string"}
# The target type of each source type. LONG (4 bytes) is an int: the value that is written is one.
SOURCE_TO_TARGET = {
    "null": ("NULL",), "decimal": ("DECIMAL", "NEWDECIMAL"), "int": ("TINY", "INT24", "YEAR", "LONG"), "short": ("SHORT",), "long": ("LONGLONG",),
    "float": ("FLOAT",), "double": ("DOUBLE",), "timestamp": ("TIMESTAMP", "TIMESTAMP2"), "date": ("DATE", "NEWDATE"), "time": ("TIME", "TIME2"),
    "datetime": ("DATETIME", "DATETIME2"), "string": ("VARCHAR", "ENUM", "SET", "VAR_STRING", "STRING", "ARRAY"), "bitmap": ("BIT",),
    "boolean": ("BOOL",), "json": ("JSON",), "blob": ("TINY_BLOB", "MEDIUM_BLOB", "LONG_BLOB", "BLOB"), "geometry": ("GEOMETRY",), "other": ("INVALID",),
}
# The Spark type of a target type's values.
TARGET_TO_SPARK = {
    "boolean": "boolean", "byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "decimal": "decimal(38,10)", "double": "double",
    "float": "float", "time": "interval day to second", "date": "date", "timestamp": "timestamp", "datetime": "timestamp_ntz", "string": "string",
    "json": "string", "jsonb": "string", "geojson": "string", "bytes": "binary", "blob": "binary", "binary": "binary", "geometry": "binary", "bitmap": "binary",
}
# The source type of each SQL type name of a table definition.
SQL_TO_SOURCE = {
    "VARCHAR": ("CHARACTER", "CHAR", "CHARACTER VARYING", "CHAR VARYING", "VARCHAR", "NVARCHAR"), "STRING": ("UUID", "REGCLASS", "STRING"),
    "VAR_STRING": ("CHARACTER LARGE OBJECT", "CHAR LARGE OBJECT", "CLOB", "TEXT", "TINYTEXT", "MEDIUMTEXT", "LONGTEXT"),
    "BLOB": ("BINARY", "VARBINARY", "BLOB", "BYTES", "BYTEA", "STRUCT", "TINYBLOB", "MEDIUMBLOB", "LONGBLOB"),
    "DECIMAL": ("NUMERIC", "DECIMAL", "BIGNUMERIC", "BIGDECIMAL", "DEC"), "FLOAT": ("FLOAT", "FLOAT4"), "TINY": ("TINYINT",),
    "SHORT": ("INT2", "SMALLINT"), "INT24": ("MEDIUMINT",), "LONG": ("INT", "INT4", "INTEGER"), "LONGLONG": ("INT64", "BIGINT", "INT8"),
    "DOUBLE": ("FLOAT64", "REAL", "FLOAT8", "DOUBLE", "DOUBLE PRECISION"), "BOOL": ("BOOL", "BOOLEAN"), "DATE": ("DATE",), "TIME": ("TIME",),
    "DATETIME": ("DATETIME",), "TIMESTAMP": ("TIMESTAMP", "INTERVAL"), "JSON": ("JSON", "JSONB"), "ARRAY": ("ARRAY",), "ENUM": ("ENUM",), "SET": ("SET",),
    "BIT": ("BIT",), "YEAR": ("YEAR",), "GEOMETRY": ("GEOMETRY", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION"),
}

TARGET_OF_SOURCE = {s: t for t, sources in SOURCE_TO_TARGET.items() for s in sources}
SOURCE_OF_SQL = {n: s for s, names in SQL_TO_SOURCE.items() for n in names}
CODE_OF_SOURCE = {n: c for c, n in SOURCE_TYPES.items()}


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v))), key)


def source_name(code: Column) -> Column:
    return _lookup(SOURCE_TYPES, code.cast("int"))


def target_name(source: Column) -> Column:
    """The target type of a source type's name; unknown ones are other."""
    return F.coalesce(_lookup(TARGET_OF_SOURCE, source), F.lit("other"))


def target_code(name: Column) -> Column:
    """The code of a target type's name, in any spelling and case; null if there is none."""
    lower = F.lower(name)
    return _lookup(TARGET_TYPES, F.coalesce(_lookup(TARGET_ALIASES, lower), lower))


def sql_source(sql_type: Column) -> Column:
    """The source type of an SQL type such as ``decimal(10,2) unsigned``; what isn't known is STRING."""
    bare = F.upper(F.trim(F.regexp_replace(F.regexp_replace(sql_type, r"\(.*", ""), r"(?i)\b(unsigned|signed|zerofill)\b", "")))
    return F.coalesce(_lookup(SOURCE_OF_SQL, bare), F.lit("STRING"))


def parse_cost(code: Column) -> Column:
    """Expected nanoseconds to parse a value of a type."""
    return F.when(code.between(1, 8) | (code == 13), 50).when(code.isin(15, 253, 254), 500).when(code.isin(245, 255), 5000).otherwise(1000)


def parse_complexity(code: Column, length: Column) -> Column:
    low = code.between(1, 8) | (code == 13)
    high = code.isin(245, 255)
    return F.when(low, "Low").when(high, F.when(length > 10_000, "VeryHigh").otherwise("High")).otherwise(F.when(length > 1000, "High").otherwise("Medium"))


def fast_path(code: Column, length: Column) -> Column:
    """Whether a value of a fixed-size type has exactly its size."""
    return F.coalesce(_lookup({1: 1, 2: 2, 3: 4, 8: 8, 4: 4, 5: 8, 13: 1}, code.cast("int")) == length, F.lit(False))


# Event codes of row changes, transaction ids and queries, and the events that may have no body.
ROW_EVENTS = (20, 21, 22, 23, 24, 25, 30, 31, 32, 39, 166, 167, 168, 169, 170)
GTID_EVENTS = (33, 34, 162)
QUERY_EVENT, BARE_EVENTS = 2, (3, 28)


def is_row(code: Column) -> Column:
    return code.isin(*ROW_EVENTS)


def is_gtid(code: Column) -> Column:
    return code.isin(*GTID_EVENTS)


def is_definition(code: Column) -> Column:
    """Any query may define something."""
    return code == QUERY_EVENT


def is_valid(code: Column, length: Column) -> Column:
    """Whether an event has a known kind of code, and a length unless it may have none."""
    return F.coalesce((code >= 0) & (code <= 255) & ((length > 0) | code.isin(*BARE_EVENTS)), F.lit(False))
