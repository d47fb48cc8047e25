"""What is dealt out into rows is a column made before it: Spark evaluates the expression of an explode without generated code,
and once more in the filter that it puts below an inner one."""

from __future__ import annotations

from hustings.operators import races
from hustings.sources import snapshots


def dealt(df) -> list[str]:
    """The explodes of a plan; none may go through an array by a function."""
    lines = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate " in line]
    assert lines
    return lines


def test_rules_of_races(spark):
    rows = spark.createDataFrame([("r1.json", None)], "file string, id string").selectExpr("file", f"from_json('{{}}', '{races.RACE}') AS r").select("file", "r.*")
    assert not [line for line in dealt(races.race_rules(rows)) if "lambda" in line]


def test_runs_of_letters(spark):
    votes = spark.createDataFrame([("f", r, m, c) for r, m, c in [(1, 1, "yes"), (1, 4, "no"), (2, 2, "yes"), (2, 3, "yes"), (3, None, "no"), (4, 4, "other")]], "file string, roll_id long, member_key long, choice string")
    roster, rolls = snapshots.encode_files(votes)
    assert {r.roll_id: (r.codes, r.runs) for r in rolls.collect()} == {1: ("Y--N", "1Y2-1N"), 2: ("-YY-", "1-2Y1-"), 3: ("----", "4-"), 4: ("----", "4-")}
    back = snapshots.decode_files(roster, rolls, form="runs")
    assert not [line for line in dealt(back) if "lambda" in line]
    assert sorted((r.roll_id, r.member_key, r.choice) for r in back.collect()) == [(1, "1", "yes"), (1, "4", "no"), (2, "2", "yes"), (2, "3", "yes")]
