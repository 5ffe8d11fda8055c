"""The catalog: databases, tables, columns; routing of changes; table definitions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.types import SOURCE_OF_SQL


def lookup(rows: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what the catalog says about their key; the catalog is broadcast by Spark where its size allows."""
    return rows.join(catalog, keys, "left")


def route(rows: DataFrame, rules: DataFrame, database: str = "database_name", table: str = "table_name") -> DataFrame:
    """Rows with the target of each task that takes them; rules: (task, databases array, tables array, target).

    Rules become one row for each pair of names, and the join is an equi join on both.
    """
    flat = rules.select("task", "target", F.explode("databases").alias(database), "tables").select("task", "target", database, F.explode("tables").alias(table)).distinct()
    return rows.join(flat, [database, table])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both by key; the one with the larger order wins."""
    names = [c for c in current.columns if c not in keys]
    both = current.unionByName(changes)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select(*keys, "r.*")


def tables_of(rows: DataFrame) -> DataFrame:
    """Tables of catalog rows: ids, names, and comma-separated key lists as arrays; ``def`` is the default catalog."""
    listed = lambda c: F.when(F.trim(F.col(c)) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(F.col(c)), r"\s*,\s*"))
    return rows.select(
        F.when(F.lower("catalog") == "def", "default").otherwise(F.col("catalog")).alias("catalog"), "database_name", "table_name",
        listed("primary_keys").alias("primary_keys"), listed("unique_keys").alias("unique_keys"),
    )


def checked_tables(rows: DataFrame) -> DataFrame:
    """Tables of catalog rows with ten fields, cross-checked with their physical name ``schema##table##id``.

    rows: schema_id, table_schema, table_id (text), table_name, physical_table_name, distribute_type, distribute_columns and
    primary_columns (comma-separated), current_version, is_materialized (0 or 1). A row that doesn't pass has its reason in
    `error`, and keeps what could be read.
    """
    from tidelog.functions.names import physical_name

    own, number = physical_name(F.col("physical_table_name")), F.col("table_id").try_cast("int")
    needed = ("schema_id", "table_schema", "table_id", "table_name", "physical_table_name", "distribute_type", "distribute_columns", "primary_columns", "current_version", "is_materialized")
    missing = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in needed))
    error = (
        F.when(missing != "", F.concat(F.lit("missing: "), missing)).when(number.isNull(), "table_id is no number").when(own.isNull(), "physical name has another form")
        .when(own["table"] != F.col("table_name"), "physical name is another table's").when(own["id"] != number, "physical name has another id")
    )
    return rows.select(
        F.lit("def").alias("catalog"), own["schema"].alias("schema_name"), "schema_id", "table_schema", number.alias("table_id"), "table_name", "physical_table_name", "distribute_type",
        F.split("distribute_columns", ",").alias("distribute_columns"), F.split("primary_columns", ",").alias("primary_columns"), F.col("current_version").alias("version"),
        (F.col("is_materialized") == 1).alias("is_materialized"), error.alias("error"),
    )


def precision_scale(sql_type: Column) -> Column:
    """struct(precision, scale) of a type such as ``decimal(10,2)``; scale 0 if only a precision is given."""
    pattern = r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)"
    scale = F.regexp_extract(sql_type, pattern, 2)
    return F.when(sql_type.rlike(pattern), F.struct(F.regexp_extract(sql_type, pattern, 1).cast("int").alias("precision"), F.when(scale == "", 0).otherwise(scale.try_cast("int")).alias("scale")))


def without_empty(schemas: DataFrame, tables: DataFrame) -> DataFrame:
    """Schemas that still have a table."""
    return schemas.join(tables.select("database_name").distinct(), "database_name", "left_semi")


_NAME = r"((?:`[^`]+`|[\w$]+)(?:\s*\.\s*(?:`[^`]+`|[\w$]+))?)"
_CREATE = re.compile(rf"^\s*create\s+(?:temporary\s+)?table\s+(?:if\s+not\s+exists\s+)?{_NAME}\s*\((.*)\)", re.I | re.S)
_ALTER = re.compile(rf"^\s*alter\s+table\s+{_NAME}\s+(.*)$", re.I | re.S)
_NO_COLUMN = re.compile(r"^\s*(primary|unique|key|index|constraint|foreign|fulltext|spatial|check)\b", re.I)
_TYPE = re.compile(r"^\s*(`[^`]+`|[\w$]+)\s+([a-z]+(?:\s+(?:precision|varying|large object))?)\s*(\([^)]*\))?\s*(.*)$", re.I | re.S)


def split_outside(text: str) -> list[str]:
    """Parts between commas that stand in no bracket and no quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def _plain(name: str) -> str:
    return ".".join(x.strip().strip("`") for x in name.split("."))


def _column(text: str, action: str) -> dict | None:
    found = _TYPE.match(text)
    if not found or _NO_COLUMN.match(text):
        return None
    name, kind, brackets, rest = found.groups()
    bare = re.sub(r"\s+", " ", kind).upper()
    low = (rest or "").lower()
    return {
        "action": action, "name": name.strip("`"), "sql_type": kind.lower() + (brackets or ""), "source_type": SOURCE_OF_SQL.get(bare, "STRING"),
        "nullable": "not null" not in low and "primary key" not in low, "unsigned": "unsigned" in low, "primary_key": "primary key" in low,
    }


def parse_definition(sql: str | None) -> tuple[str | None, str | None, list[dict] | None]:
    """(kind, table, columns) of CREATE TABLE and ALTER TABLE .. ADD / DROP / MODIFY; all None for other statements."""
    if not sql or not re.search(r"\b(create|alter)\b", sql[:200], re.I):  # a cheap test first
        return None, None, None
    if found := _CREATE.match(sql):
        columns = [c for part in split_outside(found[2]) if (c := _column(part, "add"))]
        for part in split_outside(found[2]):
            if key := re.match(r"^\s*(?:constraint\s+\S+\s+)?primary\s+key\s*\(([^)]*)\)", part, re.I):
                names = {_plain(x) for x in key[1].split(",")}
                for c in columns:
                    if c["name"] in names:
                        c |= {"primary_key": True, "nullable": False}
        return "CREATE", _plain(found[1]), columns
    if found := _ALTER.match(sql.rstrip().rstrip(";")):
        columns = []
        for part in split_outside(found[2]):
            if drop := re.match(r"^\s*drop\s+(?:column\s+)?(`[^`]+`|[\w$]+)\s*$", part, re.I):
                columns.append({"action": "drop", "name": drop[1].strip("`"), "sql_type": None, "source_type": None, "nullable": None, "unsigned": None, "primary_key": None})
            elif add := re.match(r"^\s*(add|modify|change)\s+(?:column\s+)?(.*)$", part, re.I | re.S):
                body = re.sub(r"^\s*(`[^`]+`|[\w$]+)\s+(?=(`[^`]+`|[\w$]+)\s+\w)", "", add[2]) if add[1].lower() == "change" else add[2]
                for inner in split_outside(body[1:-1]) if body.strip().startswith("(") else [body]:
                    if column := _column(re.sub(r"\s+(first|after\s+\S+)\s*$", "", inner, flags=re.I), "add" if add[1].lower() == "add" else "modify"):
                        columns.append(column)
        return "ALTER", _plain(found[1]), columns
    return None, None, None


DEFINITION = "struct<kind:string, table:string, columns:array<struct<action:string,name:string,sql_type:string,source_type:string,nullable:boolean,unsigned:boolean,primary_key:boolean>>>"


def _definitions(sql: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_definition(s) for s in sql], columns=["kind", "table", "columns"])


def definition(sql: Column) -> Column:
    """struct(kind, table, columns) of CREATE TABLE and ALTER TABLE statements; all null for others."""
    return F.pandas_udf(_definitions, DEFINITION)(sql)
