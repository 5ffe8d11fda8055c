"""Settings and catalogs from TOML, and other databases through JDBC."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of a connection.
DEFAULTS = {"host": "127.0.0.1", "port": "3306", "server_id": "65535", "heartbeat_seconds": "30", "payload_buffer": "4194304"}


def read_settings(text: str) -> dict[str, str]:
    """A TOML document as flat options, ``section.key`` -> text, over the defaults."""
    out = dict(DEFAULTS)

    def walk(prefix: str, value: object) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{prefix}.{k}" if prefix else k, v)
        else:
            out[prefix] = ",".join(map(str, value)) if isinstance(value, list) else str(value).lower() if isinstance(value, bool) else str(value)

    walk("", tomllib.loads(text))
    return out


CATALOG = "catalog string, database_name string, table_name string, column_name string, ordinal int, type string, nullable boolean, primary_key boolean, auto_increment boolean"


def read_catalog(spark: SparkSession, text: str) -> DataFrame:
    """The columns of a TOML catalog: [[tables]] with catalog, schema, name and [[tables.columns]]."""
    rows = []
    for table in tomllib.loads(text).get("tables", []):
        for i, c in enumerate(table.get("columns", [])):
            rows.append((table.get("catalog", "default"), table["schema"], table["name"], c["name"], i, c.get("type", "string"), c.get("nullable", True), c.get("primary_key", False), c.get("auto_increment", False)))
    return spark.createDataFrame(rows, CATALOG)


def query(spark: SparkSession, url: str, sql: str, fetch_size: int = 1000, **options: str) -> DataFrame:
    """A remote query's rows, streamed by the driver's cursor; needs the database's JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=sql, fetchsize=str(fetch_size), **options).load()


def typed_rows(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text-protocol rows as typed ones; text that doesn't fit its type is null."""
    return rows.select(*(F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns))
