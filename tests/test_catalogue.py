"""Every query of the catalogue against its SQL, on the small tables."""

import compare
import pytest

from tidelog.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert compare.differences(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_run_lengths_come_back(spark):
    rows = QUERIES["rle_roundtrip"](spark, SF)
    assert rows.where("not restored").count() == 0 and rows.count() > 0


def test_checksums_hold(spark):
    assert [r.crc_ok for r in QUERIES["crc32_check"](spark, SF).collect()] == [True]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
