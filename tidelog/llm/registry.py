"""The queries opN_<name> with production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import op1_query, op10_query, op2_query, op3_query, op4_query, op5_query, op6_query, op7_query, op8_query, op9_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (op1_query, op2_query, op3_query, op4_query, op5_query, op6_query, op7_query, op8_query, op9_query, op10_query):
    QUERIES[module.NAME] = module.query
    if getattr(module, "ORACLE", None):
        ORACLES[module.NAME] = module.ORACLE
