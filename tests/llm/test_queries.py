"""Queries with SQL against it, on the small tables."""

import compare
import pytest

from tidelog.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare.differences(QUERIES[name](spark, SF), compare.connect(SF), ORACLES[name]) == ""


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
