"""Measures under vote: journals of three states, blocks by tally, and odd rows."""

from __future__ import annotations

import dataclasses
import re

import pytest
from pyspark.sql import functions as F

from hustings.operators import measures

MI = {
    "HB 4001": "House Bill No. 4001, entitled A bill to amend. The question being on the passage. Roll Call No. 5",
    "SB 12A": "House Bill No. 1, entitled x. Senate Bill No. 12a, entitled y. Roll Call No. 6",
    "HJR U": "House Joint Resolution U, entitled A joint resolution. Roll Call No. 7",
    "SCR 14": "Senate Concurrent Resolution No. 14.A concurrent resolution to honor. Roll Call No. 8",
    "IP 2": "Initiative Petition No. 1 came. Initiative Petition No. 2 came. INITIATIVE PETITION An initiation of legislation to. Roll Call No. 9",
    "HB 7": "House Bill No. 7, entitled z was read a first time. Third Reading of Bills. was read a first time. Roll Call No. 10",
    None: "House Bill No. 7, entitled z was read a first time and referred. Roll Call No. 11",
}
MO = {
    "HB 2637": "CCS for SS for SCS for HCS for HBs 2637 and 3155, entitled: An Act. Was read the 3rd time and finally passed by the following vote:",
    "SB 68": "On motion of Senator X, CCS for SB 68, entitled: An Act as enacted by senate bill no. 743. Was read the 3 rd time and passed by the following vote:",
    "HB 12": "CCR SS SCS HCS HB 12, to appropriate " + "money and " * 60 + "more was taken up by Representative Deaton. Was read the 3rd time and passed by the following vote:",
    None: "SB 1, entitled: An Act. On motion of Senator Y. Was read the 3rd time and passed by the following vote:",
}
TX = {
    "SB 11": "COMMITTEE SUBSTITUTESENATE BILL 11 ON THIRD READING\ntext. Yeas 31, Nays 0",
    "SCR 8": "SENATE BILL 1 ON X\nSENATE CONCURRENT RESOLUTION 8ON SECOND READING\nYeas 30, Nays 1",
    "HJR 110": "CONFERENCE COMMITTEE ON HOUSE JOINT RESOLUTION 110 on\n see SENATE BILL 3. Yeas 3, Nays 1",
    None: "nothing\nYeas 3, Nays 1",
}


@pytest.mark.parametrize("state,cases", [("mi", MI), ("mo", MO), ("tx", TX)])
def test_rules_of_a_state(spark, state, cases):
    rows = list(enumerate(cases.items()))
    texts = spark.createDataFrame([(k, text) for k, (_, text) in rows], "id long, text string")
    got = {r.id: r for r in measures.measure_under_vote(texts, "id", "text", measures.JOURNALS[state]).collect()}
    assert {k: got[k].bill for k, _ in rows} == {k: bill for k, (bill, _) in rows}
    for k, (_, text) in rows:
        assert got[k].nth == 1 and re.match(measures.JOURNALS[state].roll, text[got[k].position :])


def test_one_long_journal_is_folded_in_order(spark):
    """All the cases in one text of some megabytes: each roll keeps its own measure."""
    filler = "Words of a debate, é. " * 3000
    text = "".join(filler + body for bill, body in MI.items()) * 4
    texts = spark.createDataFrame([(1, text)], "id long, text string").withColumns({c: F.lit("x") for c in ("key", "k", "kind", "item", "position", "nth")})
    got = sorted((r.nth, r.bill, r.position) for r in measures.measure_under_vote(texts, "id", "text", measures.JOURNALS["mi"]).collect())
    assert [b for _, b, _ in got] == list(MI) * 4
    assert [p for _, _, p in got] == [m.start() for m in re.finditer(r"Roll Call No\. \d+", text)]


def test_reach(spark):
    body = "SB 9, entitled: An Act. {} Was read the 3rd time and passed by the following vote:"
    texts = spark.createDataFrame([(1, body.format("x" * 5800)), (2, body.format("x" * 6000))], "id long, text string")
    got = {r.id: r.bill for r in measures.measure_under_vote(texts, "id", "text", measures.JOURNALS["mo"]).collect()}
    assert got == {1: "SB 9", 2: None}


def test_odd_rows(spark):
    rows = [(None, MI["HB 4001"]), (1, None), (2, ""), (3, MI["HB 4001"]), (3, MI[None])]
    texts = spark.createDataFrame(rows, "id long, text string")
    got = sorted(((r.id or 0), r.nth, r.bill or "") for r in measures.measure_under_vote(texts, "id", "text", measures.JOURNALS["mi"]).collect())
    assert got == [(0, 1, "HB 4001"), (3, 1, ""), (3, 1, "HB 4001")]
    assert measures.measure_under_vote(texts.limit(0), "id", "text", measures.JOURNALS["mi"]).collect() == []


@pytest.mark.parametrize("state,cases", [("mi", MI), ("mo", MO), ("tx", TX)])
def test_leads_lose_no_mark(spark, state, cases):
    """The search by first letters finds what all patterns find at each place, whatever the case."""
    text = " ".join(cases.values()) + "\nVacancies. VACANCIES on Motion of. read a second time, Concurring, xconference report, HJRs No. 5, entitled: SCR 3 of x was taken up by Senator Z. INITIATIVE PETITIONAn initiation of legislation\nCONFERENCE COMMITTEE ON HOUSE BILL 4\nYeas 1, Nays 2"
    rows = [(1, text), (2, text.upper()), (3, text.lower()), (4, text.swapcase())]
    got = [
        sorted((r.key, r.k, r.kind, r.said, r.position) for r in measures.marks(spark.createDataFrame(rows, "id long, text string"), "id", "text", j).collect())
        for j in (measures.JOURNALS[state], dataclasses.replace(measures.JOURNALS[state], leads=()))
    ]
    assert got[0] == got[1] and len({kind for _, _, kind, _, _ in got[0]}) == len(measures.JOURNALS[state].kinds())


def test_texts_may_hold_the_bounds_of_marks(spark):
    text = f"{measures.BOUND}{MI['HB 4001']}{measures.BOUND * 2} Roll Call No. 6{measures.BOUND}"
    got = measures.measure_under_vote(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", measures.JOURNALS["mi"])
    assert sorted((r.nth, r.position, r.bill) for r in got.collect()) == [(i, m.start(), "HB 4001") for i, m in enumerate(re.finditer(r"Roll Call No\. \d+", text), 1)]


def test_marks_are_searched_and_sorted_once(spark):
    got = measures.measure_under_vote(spark.createDataFrame([(1, MI["HB 7"])], "id long, text string"), "id", "text", measures.JOURNALS["mi"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("INITIATIVE PETITION\\s*An initiation of legislation)|") == 1


def test_blocks_by_tally(spark):
    actions = spark.createDataFrame([(1, 7, "HCR 24", 20, 0), (2, 7, "SB 282", 20, 0), (3, 7, "HB 1", 9, 9)], "action long, page long, bill string, yes long, no long")
    blocks = spark.createDataFrame([(1, 7, "CSSB  282(FIN) final passage", 20, 0), (2, 7, "HCR 24 third reading", 20, 0), (3, 8, None, 9, 9)], "block long, page long, heading string, yes long, no long")
    assert {r.action: r.block for r in measures.blocks_by_tally(actions, blocks).collect()} == {1: 2, 2: 1, 3: None}
    one = lambda head, bill: spark.range(1).select(measures.names_other_bill(F.lit(head).cast("string"), F.lit(bill)).alias("x")).first().x
    assert [one("SB 1 and hb 2", "HB 2"), one("SB 1", "HB 2"), one("no bills", "HB 2"), one(None, "HB 2")] == [False, True, False, False]
