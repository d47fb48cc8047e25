"""Thresholds of states, the queue of sources, citations and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import text as X
from hustings.operators import outcomes, serving
from hustings.streaming import incremental

ROLLS = "state string, chamber string, bill string, question string, official string, yes long, no long"
CASES = [
    (("ks", "lower", "HB 1", "Consider veto", None, 83, 1), 84, "Failed"), (("ks", "upper", "SB 1", "Consider veto", None, 27, 13), 27, "Passed"), (("ks", "lower", "HCR 1", "Final Action", None, 83, 42), 84, "Failed"), (("ks", "lower", "HCR 1", "Final Action; amend", None, 2, 1), 2, "Passed"),
    (("co", "lower", "HB 1", "Third Reading: Bill", None, 32, 31), 33, "Failed"), (("co", "upper", "SCR 1", "Third Reading: Concurrent Resolution", None, 24, 9), 24, "Passed"), (("ky", "lower", "HB 1", "Final passage", None, 50, 2), 51, "Failed"), (("ky", "upper", "HB 1", "Suspend the Rules", None, 2, 1), 2, "Passed"),
    (("ky", "lower", "HB 1", "Suspend the Rules", None, 21, 12), 51, "Failed"), (("nh", "upper", "CACR 1", "OTPA", None, 15, 9), 15, "Passed"), (("nh", "lower", "HB 1", "Veto override", None, 200, 100), 200, "Passed"), (("nh", "lower", "HB 1", "Veto override", None, 0, 0), 0, "Passed"),
    (("wv", "lower", "HB 1", "Constitutional rule dispensed with", None, 80, 20), 80, "Passed"), (("wv", "lower", "HB 1", "Constitutional rule dispensed with", None, 0, 0), 1, "Failed"), (("wv", "lower", "HB 1", "reference dispensed with", None, 2, 1), 2, "Passed"), (("md", "lower", "HB 1", "Passed notwithstanding the objections", None, 60, 40), 60, "Passed"),
    (("tx", "lower", "HB 1", "Passage", None, 5, 5), 6, "Failed"), (("tx", "lower", None, None, "Passed", None, None), 1, "Passed"), ((None, None, None, None, None, None, None), 1, "Failed"), (("az", "joint", "HB 1", "Third", None, 3, 2), 3, "Passed"), (("nj", "lower", "A1", "3RDG FINAL PASSAGE", None, 41, 39), 41, "Passed"),
]


def test_thresholds_of_states(spark):
    rolls = spark.createDataFrame([r for r, _, _ in CASES], ROLLS).withColumn("k", F.lit("x"))
    got = outcomes.outcomes(rolls.coalesce(1)).collect()
    assert [(r.needed, r.outcome) for r in got] == [(n, o) for _, n, o in CASES]
    assert outcomes.outcomes(rolls.limit(0)).collect() == []


def test_stated_results(spark):
    said = {"Final Action; passed": None, "EFA - Passed; lost": "Passed", "Veto of the bill sustained": "Failed", "Ruling of the chair was sustained": "Passed", "not adopted": "Failed", None: None}
    rows = spark.createDataFrame([(q,) for q in said], "q string")
    assert {r.q: r.x for r in rows.select("q", outcomes.stated_result(F.col("q")).alias("x")).collect()} == said


def test_a_queue_stops_at_its_budget_and_goes_on(spark):
    rows = [("a", None, 3), ("b", "2026-01-01", 9), ("c", "2026-01-02", None), ("d", "2026-01-03", 1), (None, None, 1), ("e", "2026-02-01", 1)]
    sources = spark.createDataFrame(rows, "source string, last_run string, pages int").withColumns({"place": F.lit("x"), "cost": F.lit("x")}).drop("place")
    run = lambda budget, since=None: [(r.source, r.place, r.spent) for r in sorted(incremental.work_queue(sources, budget, 4, since).collect(), key=lambda r: r.place)]
    assert run(100) == [("a", 1, 0), ("b", 2, 3), ("c", 3, 7), ("d", 4, 8), ("e", 5, 9)]
    assert run(11) == [("a", 1, 0), ("b", 2, 3), ("c", 3, 7)] and run(3) == [] and run(4) == [("a", 1, 0)]
    assert run(100, "2026-01-02") == [("a", 1, 0), ("b", 2, 3)]  # c to e were fetched since
    assert incremental.work_queue(sources.limit(0), 10, 4).collect() == []


def test_citations_and_addresses(spark):
    row = spark.range(1).select(X.cite_numbers(F.array(F.lit("b"), F.lit("x"), F.lit(None), F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("n"), X.cite_numbers(F.lit(None).cast("array<string>"), F.array(F.lit("a"))).alias("none"), X.roll_call_href(F.lit("f"), F.lit("a b*'~&")).alias("h")).first()
    assert (row.n, row.none, row.h) == ([2, 1], [], "/vote/f/a%20b*'~%26")
    officials = spark.createDataFrame([("o1",), ("o2",), (None,)], "official_id string")
    people = spark.createDataFrame([("o1", "b"), ("o1", "a"), (None, "c"), ("o2", None)], "official_id string, slug string")
    assert {r.official_id: r.href for r in serving.person_hrefs(officials, people).collect()} == {"o1": "/people/a", "o2": "/official/o2", None: None}
