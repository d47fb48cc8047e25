"""Absences counted by running sums against the absences written out, and both against loops."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hustings.operators import impute

DAY = datetime.date(2026, 1, 1)
VOTES = "chamber string, roll_id long, member_key long, choice string, roll_date date"
ROSTER = "chamber string, member_key long, start date, end date"


def day(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


def case(spark, seed):
    rng = random.Random(seed)
    rolls = [(rng.choice("ab"), i, day(rng.randrange(20))) for i in range(40)]
    roster = [(rng.choice("ab"), rng.choice([None, *range(6)]), day(rng.choice([None, *range(20)])), day(rng.choice([None, *range(25)]))) for _ in range(20)]
    votes = [(c, i, rng.choice([None, *range(8)]), rng.choice(["yes", "no"]) if i % 2 else "no", d) for c, i, d in rolls for _ in range(rng.randrange(4))]
    return rolls, roster, votes, spark.createDataFrame(rolls, "chamber string, roll_id long, roll_date date"), spark.createDataFrame(roster, ROSTER).withColumn("n", F.lit("x")), spark.createDataFrame(votes, VOTES).withColumn("seats", F.lit("x"))


def absences(rolls, roster, votes):
    """(roll, member) of each span that covers a roll and whose member isn't named."""
    named = {(i, m) for _, i, m, _, _ in votes}
    return [(i, m) for c, i, d in rolls for cc, m, a, b in roster if c == cc and (a is None or a <= d) and (b is None or d <= b) and (m is None or (i, m) not in named)]


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_agree_with_rows(spark, seed):
    rolls, roster, votes, r, s, v = case(spark, seed)
    away = Counter(i for i, _ in absences(rolls, roster, votes))
    there = Counter(i for _, i, _, _, _ in votes)
    want = {i: (there[i] + away[i], away[i]) for i in {*there, *away}}
    assert {x.roll_id: (x.positions, x.imputed) for x in impute.imputed_counts(r, s, v).collect()} == want
    rows = impute.complete(r, s, v).groupBy("roll_id").agg(F.count(F.lit(1)).alias("positions"), F.count(F.when(F.col("imputed"), 1)).alias("imputed")).collect()
    assert {x.roll_id: (x.positions, x.imputed) for x in rows} == want


def test_complement_counts_agree_with_rows(spark):
    rolls, roster, votes, r, s, v = case(spark, 3)
    away = Counter(i for i, _ in absences(rolls, roster, votes))
    yes = {i for _, i, _, c, _ in votes if c == "yes"}
    printed = r.withColumn("printed_yes", F.coalesce(*[F.when(F.col("roll_id") == i, n if i % 3 else n + 1) for i, n in away.items()], F.lit(0)))
    there = Counter(i for _, i, _, _, _ in votes)
    want = {i: (there[i], 0) for i in yes} | {i: (there[i] + n, n) for i, n in away.items() if i not in yes and i % 3}
    assert {x.roll_id: (x.positions, x.imputed) for x in impute.complement_counts(printed, s, v).collect()} == want
    rows = impute.complement(printed, s, v).groupBy("roll_id").agg(F.count(F.lit(1)).alias("positions"), F.count(F.when(F.col("imputed"), 1)).alias("imputed")).collect()
    assert {x.roll_id: (x.positions, x.imputed) for x in rows} == want


def test_empty_tables(spark):
    _, _, _, r, s, v = case(spark, 4)
    assert impute.imputed_counts(r.limit(0), s, v.limit(0)).collect() == []
    assert {x.imputed for x in impute.imputed_counts(r, s.limit(0), v).collect()} == {0}
