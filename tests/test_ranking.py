"""Removal of equals by any of two keys against the sequential pass."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hustings.operators import ranking


def one_by_one(rows, most=None):
    seen, out = set(), []
    for i, score, a, p in sorted(rows, key=lambda r: (-r[1], r[0])):
        keys = {("a", a), ("p", p)} - {("a", None), ("p", None)}
        if not keys & seen:
            seen |= keys
            out.append(i)
    return out[:most]


@pytest.mark.parametrize("seed,most", [(1, None), (2, None), (3, 4), (4, 1)])
def test_agrees_with_the_sequential_pass(spark, seed, most):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(10), rng.choice([None, *"abcdefghij"]), rng.choice([None, None, *"abcdefghijkl"])) for i in range(60)]
    df = spark.createDataFrame(rows, "position long, score long, address string, point string").withColumns({"__x": F.lit(1), "k0": F.lit(2)})
    got = ranking.distinct_by_any(df, F.struct((-F.col("score")).alias("s"), "position"), ["address", "point"], most)
    assert sorted(r.position for r in got.collect()) == sorted(one_by_one(rows, most)) and got.columns == df.columns


def test_a_removed_row_blocks_nothing(spark):
    """B shares a point with A and an address with C: A and C stay, which two separate passes would not give."""
    where = {"state": "NY", "zip": None, "detail": None, "source": "osm"}
    rows = [{"position": 0, "house": "10", "street": "Broadway", "city": "Albany", "point_key": "p", **where}, {"position": 1, "house": "10", "street": "Broadway", "city": "Alban", "point_key": "p", **where}, {"position": 2, "house": "10", "street": "Broadway", "city": "Alban", "point_key": "q", **where}]
    df = spark.createDataFrame(rows, "position long, house string, street string, city string, point_key string, state string, zip string, detail string, source string")
    assert [r.position for r in ranking.rank(df, ranking.Typed("10", ("broadway", "alb"), "", "NY")).collect()] == [0, 2]


def test_chains_and_hot_keys(spark):
    chain = [(i, 100 - i, f"a{i // 2}", f"p{(i + 1) // 2}") for i in range(12)]
    hot = [(100 + i, 1, "same", f"h{i % 3}") for i in range(300)]
    rows = [*chain, *hot]
    df = spark.createDataFrame(rows, "position long, score long, address string, point string")
    order = F.struct((-F.col("score")).alias("s"), "position")
    assert sorted(r.position for r in ranking.distinct_by_any(df, order, ["address", "point"]).collect()) == sorted(one_by_one(rows))
    assert ranking.distinct_by_any(df.limit(0), order, ["address", "point"]).collect() == []
