"""Events as lines of text, for a console or a text sink: brief, JSON or YAML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRIEF, JSON, YAML = "brief", "json", "yaml"


def _yaml_value(value: Column, kind: str) -> Column:
    """Numbers and booleans as they are, text in double quotes, nested values as JSON, null as null."""
    if kind == "string":
        quoted = value
        for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            quoted = F.replace(quoted, F.lit(plain), F.lit(written))
        text = F.concat(F.lit('"'), quoted, F.lit('"'))
    elif kind.startswith(("array", "struct", "map")):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def lines(events: DataFrame, style: str = BRIEF, columns: list[str] | None = None) -> DataFrame:
    """events with a column `line`. brief: ``[NAME], pos P in FILE``; json: an object, nulls left out; yaml: a document."""
    kinds = dict(events.dtypes)
    names = columns or events.columns
    if style == BRIEF:
        line = F.concat(F.lit("["), F.col("event_name"), F.lit("], pos "), F.col("pos").cast("string"), F.lit(" in "), F.coalesce(F.col("file"), F.lit("-")))
    elif style == JSON:
        line = F.to_json(F.struct(*names))
    elif style == YAML:
        line = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{c}: "), _yaml_value(F.col(c), kinds[c])) for c in names))
    else:
        raise ValueError(f"no such style: {style}")
    return events.withColumn("line", line)
