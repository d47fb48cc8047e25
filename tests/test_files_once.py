"""Files of votes are parsed once each, whatever is taken from them."""

from __future__ import annotations

import pytest

from hustings.operators import serving
from hustings.plans import load

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["house_files", "senate_files"])
def test_files_are_parsed_once(spark, name):
    plan = load()[0][name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1


def test_positions_of_all_formats_are_made_once(spark):
    plan = load()[0]["connector_formats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 2


def test_pairs_are_not_shuffled(spark):
    """Only candidates of several keys, none here, have pairs that are compared: others are written as they are found."""
    candidates = spark.createDataFrame([(1, "Ann Lee", "s1", None, True), (1, "Ann Lee", "s2", None, True), (2, "Bo Lee", "s1", "B2", False), (3, "Cy Lee", "s1", None, True)], "cand_key long, name string, seat string, bioguide string, incumbent boolean")
    members = spark.createDataFrame([(7, "Di Lee", "s1", "B2"), (7, "Di Lee", "s2", "B2"), (7, "Di Lee", "s1", "B2"), (8, "Ed Lee", "s1", None)], "member_key long, name string, seat string, bioguide string")
    found = serving.incumbent_members(candidates, members)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (1, 8), (2, 7), (3, 7), (3, 8)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Union")
