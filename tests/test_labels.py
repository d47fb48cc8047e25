"""Names and sentences of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import labels as L
from hustings.operators import guide, split


def values(spark, rows: list[tuple], schema: str, *made) -> list[tuple]:
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*made).collect()]


def test_chambers(spark):
    st, ch = F.col("st"), F.col("ch")
    rows = [("tx", "upper"), ("TX", "lower"), ("wv", "lower"), ("NJ", "lower"), ("NE", "legislature"), ("DC", "upper"), ("qq", "lower"), (None, "lower"), ("TX", None), ("TX", "other")]
    got = values(spark, rows, "st string, ch string", L.chamber_name(st, ch), L.snapshot_chamber(st, ch), L.lower_title(st))
    assert got == [
        ("State Senate", "TX SENATE", "State Representative"), ("State House", "TX HOUSE", "State Representative"), ("House of Delegates", "WV HOUSE OF DELEGATES", "Delegate"), ("General Assembly", "NJ GENERAL ASSEMBLY", "General Assembly Member"),
        ("Unicameral Legislature", "NE LEGISLATURE", "State Representative"), ("D.C. Council", "DC COUNCIL", "State Representative"), ("State House", "QQ HOUSE", "State Representative"), ("State House", None, "State Representative"), (None, None, "State Representative"), (None, None, "State Representative"),
    ]
    stored = [("U.S. SENATE",), ("VA HOUSE OF DELEGATES",), ("NYC COUNCIL",), ("CA ASSEMBLY",), ("XX SENATE",), ("TX",), ("",), (None,)]
    assert [x for (x,) in values(spark, stored, "s string", L.chamber_label(F.col("s")))] == ["U.S. Senate", "Virginia House of Delegates", "NYC Council", "California Assembly", "XX Senate", "Texas", "", ""]
    files = [("state-tx-lower",), ("house",), ("senate-ny",), ("other",), (None,)]
    assert [x for (x,) in values(spark, files, "s string", L.file_jurisdiction(F.col("s")))] == ["tx", "us", "ny", None, None]


def test_seats_and_bills(spark):
    keys = [("us-house-ak-al",), ("us-house-tx-7",), ("ny-ad-12",), ("ne-legislature-3",), ("ma-lower-Second Essex",), ("mayor",), ("",), (None,)]
    got = [x and tuple(x) for (x,) in values(spark, keys, "k string", L.slate_office(F.col("k")))]
    assert got == [("ak", "U.S. House", "AL", "house-al"), ("tx", "U.S. House", "7", "house-7"), ("ny", "State Assembly", "12", "assembly-12"), ("ne", "Unicameral Legislature", "3", "senate-3"), ("ma", "State House", "Second Essex", "house-second-essex"), None, None, None]
    bills = [("H.R. 12",), ("S.J.Res.  3 ",), ("S. 4a",), ("PN34-2",), ("PN7",), ("HR 1",), (None,)]
    assert [x and tuple(x) for (x,) in values(spark, bills, "k string", L.federal_subject(F.col("k")))] == [("bill", "hr", "12"), ("bill", "sjres", "3"), None, ("nomination", None, "34"), ("nomination", None, "7"), None, None]
    labels = [("U.S. House", "14", "NY"), ("U.S. House", None, "NY"), ("Governor", None, "TX"), ("Governor", "", "TX"), ("State House", "49B", "tx"), ("State Senate", "Second Essex", "MA")]
    got = values(spark, labels, "o string, d string, s string", L.ballot_label(F.col("o"), F.col("d"), F.col("s")))
    assert [x for (x,) in got] == ["U.S. House · NY-14", "U.S. House · NY-", "Governor · Texas", "Governor · Texas", "Texas House District 49B", "Massachusetts Senate Second Essex"]


def test_titles(spark):
    long = "A plain title " * 40
    rows = [("RESOLVED BY THE COUNCIL OF NEW YORK FOR FY 27, NYC",), ("SHORT SHOUT",), ("A \n plain\ttext",), (long,), ("x" * 200,), ("",), (None,)]
    got = [x for (x,) in values(spark, rows, "t string", L.card_title(F.col("t")))]
    assert got[:3] == ["Resolved by the council of New York for FY 27, NYC", "SHORT SHOUT", "A plain text"]
    assert got[3] == (long[:120].rsplit(" ", 1)[0]).rstrip() + "…" and got[4:] == ["x" * 120 + "…", "", None]
    pairs = [("One here. Two there.", "T"), ("", "The title! More"), (None, None), ("no end", "T"), ("w " * 130 + ". Next.", "Short title"), ("v1.2 is out. Next", "T")]
    assert [x for (x,) in values(spark, pairs, "s string, t string", L.summary_sentence(F.col("s"), F.col("t")))] == ["One here.", "The title!", ".", "no end.", "Short title.", "v1.2 is out."]
    names = [("NATIONAL ASSOCIATION OF LETTER-CARRIERS PAC (NALC)",), ("Mixed Case Fund",), ("ACME",), ("THE FUND/LOCAL 3",), (None,)]
    assert [x for (x,) in values(spark, names, "s string", L.committee_name(F.col("s")))] == ["National Association of Letter-Carriers PAC (NALC)", "Mixed Case Fund", "ACME", "The Fund/Local 3", None]
    big = [("WORDS OF A RESOLUTION " * 100_000,)]
    assert values(spark, big, "t string", F.length(L.unshout(F.col("t"))))[0][0] == 2_199_999


def test_sentences(spark):
    c = "same long, different long, mixed long, none long, answered long, in_line long, not_in_line long"
    got = values(spark, [(1, 2, 0, 0, 3, 0, 0), (1, 0, 2, 1, 1, 1, 4)], c, L.counts_sentence())
    assert [x for (x,) in got] == [
        "Statements: same as you on 1, different on 2 · No record on 0 of the 3 topics you answered",
        "Statements: same as you on 1, different on 0, mixed on 2 · Recorded votes: 1 vote in line with your answers, 4 not · No record on 1 of the 1 topic you answered",
    ]
    t = "d_yes long, d_no long, r_yes long, r_no long"
    assert [x for (x,) in values(spark, [(9, 1, 2, 8), (0, 0, 3, 0), (2, 2, 1, 0)], t, split.sides_sentence())] == ["Most Democrats voted yes; most Republicans voted no", "Most Republicans voted yes", ""]


def test_results(spark):
    races = spark.createDataFrame([("a",), ("b",), ("a",)], "race_id string")
    people = spark.createDataFrame([("a", 1, "Ann"), ("a", 1, "Ann"), ("b", 1, "Bo")], "race_id string, cand_id int, name string")
    r = "race_id string, status string, unconfirmed boolean, outcome string, winner int, winner_name string"
    results = spark.createDataFrame([("a", "called", None, None, 1, "x"), ("b", "called", None, None, 7, "x"), ("b", "uncalled", None, None, None, None), ("b", "uncalled", True, None, None, None), ("a", "called", None, "rejected", None, None), ("c", "runoff", None, None, None, None), (None, "runoff", None, None, None, None)], r)
    assert sorted(map(tuple, guide.result_lines(races, people, results).collect())) == [("a", "Ann, projected winner"), ("a", "Rejected"), ("b", "Not yet called"), ("b", "Result not confirmed yet"), ("b", "Winner projected")]
    assert guide.result_lines(races.limit(0), people, results).collect() == []


def test_said_vs_did(spark):
    said = spark.createDataFrame([("r", 1, "tax", "supports"), ("r", 1, "war", "opposes"), ("r", 1, "law", "mixed"), ("r", 1, None, "supports"), ("r", 2, "tax", None)], "race_id string, cand_id int, issue string, stance string")
    cast = [("tax", "yes", "supports"), ("tax", "yes", "supports"), ("tax", "no", "opposes"), ("tax", "no", "supports"), ("tax", "absent", "supports"), ("tax", "yes", None), ("war", "no", "supports"), ("war", "yes", "supports"), ("law", "yes", "supports"), (None, "yes", "supports")]
    votes = spark.createDataFrame([("r", 1, *v, 0) for v in cast], "race_id string, cand_id int, issue string, vote string, yes_means string, stance int")
    got = {(r.cand_id, r.issue): (r.comparable, r.same) for r in guide.said_vs_did(said, votes).collect()}
    assert got == {(1, "tax"): (4, 3), (1, "war"): (2, 1), (1, "law"): (0, 0), (1, None): (0, 0), (2, "tax"): (0, 0)}
    assert guide.said_vs_did(said.limit(0), votes).collect() == [] and guide.said_vs_did(said, votes.limit(0)).count() == 5


def test_titles_are_made_once(spark):
    """Each step over a text is in the plan once, not once for each use of its result."""
    from hustings.plans import load

    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = load()[0]["agenda_titles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    assert plan.count("regexp_replace(") < 30
