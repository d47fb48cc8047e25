"""Slates of state seats, keys of districts, bounded pages and all sources in one pass."""

from __future__ import annotations

import pytest

from hustings.operators import guide, serving, slates
from hustings.sources import connectors


def test_districts_of_offices(spark):
    known = spark.createDataFrame([("MA", "upper", "Second Essex and Middlesex", 1), ("MA", "upper", "1st Suffolk & Norfolk", 1), ("WA", "lower", "7", 1), ("VT", "lower", "Bennington-1", 1), ("TX", "lower", "12", 1), ("TX", "lower", "12", 1), ("TX", "lower", None, 1)], "state string, chamber string, label string, bare int")
    asked = [("MA", "upper", "2nd Essex and Middlesex District"), ("MA", "upper", "1st Suffolk and Norfolk"), ("WA", "lower", "District 7-Position 2"), ("VT", "lower", "Bennigton-1"), ("TX", "lower", "District 012"), ("TX", "upper", "District 12"), ("TX", "lower", "District 99"), ("TX", "lower", "Mayor"), ("TX", "lower", None), (None, "lower", "12")]
    offices = spark.createDataFrame([(i, *a, "x") for i, a in enumerate(asked)], "office_id int, state string, chamber string, office string, shape string")
    got = {r.office_id: (r.label, r.vacant) for r in slates.slate_districts(offices, known, vacancies=True).collect()}
    assert got == {0: ("Second Essex and Middlesex", False), 1: ("1st Suffolk & Norfolk", False), 2: ("7", False), 3: ("Bennington-1", False), 4: ("12", False), 5: (None, False), 6: ("99", True), 7: (None, False), 8: (None, False), 9: (None, False)}
    assert {r.office_id: r.label for r in slates.slate_districts(offices, known).collect()}[6] is None
    assert slates.slate_districts(offices.limit(0), known, True).collect() == [] and slates.slate_districts(offices, known.limit(0), True).where("label is not null").collect() == []


def test_seats_of_voters(spark):
    districts = spark.createDataFrame([(1, "TX", "lower", "012", None), (1, "TX", "upper", "3", None), (2, "TX", "lower", "16", None), (3, "TX", "lower", None, None), (4, "VA", "lower", "12", None)], "voter_id int, state string, side string, basename string, name string")
    s = [("tx-lower-12", 1, "Pat Lee", True), ("tx-lower-12", 2, "Al Fox", True), ("tx-lower-16A", 3, "Bo Roe", None), ("tx-upper-3", 4, "Cy Day", False), ("mayor", 5, "No One", True), (None, 6, "No One", True)]
    slate = spark.createDataFrame([(*x, "z") for x in s], "seat string, cand_id int, name string, incumbent boolean, label string")
    roster = spark.createDataFrame([("o2", "tx", "lower", "12", "P. Lee"), ("o1", "TX", "lower", "12", "Q. Lee"), ("o3", "tx", "upper", "3", "C Day")], "official_id string, state string, chamber string, label string, name string")
    got = sorted(tuple(r) for r in slates.state_seats(districts, slate, roster).collect())
    assert got == [
        (1, "tx-lower-12", "State House", "Texas House District 12", 1, "o1"), (1, "tx-lower-12", "State House", "Texas House District 12", 2, None),
        (1, "tx-upper-3", "State Senate", "Texas Senate District 3", 4, None), (2, "tx-lower-16A", "State House", "Texas House District 16A", 3, None),
    ]
    assert slates.state_seats(districts.limit(0), slate, roster).collect() == [] and slates.state_seats(districts, slate.limit(0), roster).collect() == []


def test_members_of_keys(spark):
    i = "0" * 36
    keys = spark.createDataFrame([(k,) for k in ("us-house-tx-7", "us-house-ak-al", "us-sen-tx-1", "ny-sd-4", "ny-ad-4", "nyc-council-9", f"tx-lower-{i}", f"ny-upper-{i}", "other", None, "ny-sd-4")], "district_key string")
    shots = spark.createDataFrame([("h", "U.S. HOUSE", None, None), ("s", "U.S. SENATE", None, None), ("n", "NY SENATE", None, None), ("c", "NYC COUNCIL", None, None), ("t", "TX HOUSE", "tx", "lower"), ("y", "NY SENATE", "ny", "upper")], "file string, chamber string, jurisdiction string, legislative_chamber string")
    members = spark.createDataFrame([("h", "tx-7", "M7"), ("h", "ak-al", "MA"), ("s", "sen-tx-2", "S2")], "file string, code string, member_key string")
    got = sorted(tuple(r) for r in slates.district_member_keys(keys, shots, members).collect())
    assert got == [("ny-sd-4", "n", "4"), ("nyc-council-9", "c", "9"), (f"tx-lower-{i}", "t", f"ocd-person/{i}"), ("us-house-ak-al", "h", "MA"), ("us-house-tx-7", "h", "M7")]
    assert slates.district_member_keys(keys.limit(0), shots, members).collect() == []


def test_pages_hold_the_newest(spark):
    votes = spark.createDataFrame([(r, m, "yes" if r % 2 else "absent") for r in range(30) for m in (1, 2)] + [(99, 1, "no")], "roll_id int, member_key int, choice string")
    rolls = spark.createDataFrame([(r, f"t{r}" if r != 28 else None, f"2026-01-{r // 2 + 1:02d}" if r else None) for r in range(30)], "roll_id int, title string, roll_date string")
    people = spark.createDataFrame([(1, "Ann", "D"), (2, "Bo", None), (3, "Cy", "R")], "member_key int, name string, party string")
    got = {r.member_key: r for r in serving.member_pages(votes, people, rolls, 3).collect()}
    assert set(got) == {1, 2} and (got[1].total, got[1].yes, got[1].no, got[1].absent, got[1].first_page) == (30, 15, 0, 15, "t29|t26")
    verdicts = spark.createDataFrame([(1, r, r // 2, "against" if r != 8 else "with") for r in range(10)] + [(2, 1, 1, "with")], "member_key int, roll_id int, roll_date int, verdict string")
    lines = {r.member_key: (r.with_party, r.against_party, r.latest_against) for r in guide.party_line_summary(verdicts).collect()}
    assert lines == {1: (1, 9, [9, 7, 6, 5]), 2: (1, 0, [])}


def test_all_sources_agree_with_each(spark):
    """One pass gives what the pipeline of a single source gives, for each of them."""
    rolls, printed, roster = [], [], []
    for s, x in connectors.SOURCES.items():
        words = [w for w in x.codes if w] + (["Not Voting/Excused"] if x.prefixes else [])
        for roll in (1, 2, 3):
            said = words + ([] if x.strict or roll == 2 else ["?"])
            printed += [(s, roll, f"n{i}", w) for i, w in enumerate(said)]
            yes, no = ([x.codes.get(w) for w in words].count(c) for c in ("yes", "no"))
            rolls.append((s, roll, yes + (roll == 3), no))
        roster += [(s, f"n{i}", i) for i in range(3)]
    r, p, m = (spark.createDataFrame(*a).coalesce(2) for a in ((rolls, "source string, roll_id int, printed_yes long, printed_no long"), (printed, "source string, roll_id int, name string, raw string"), (roster, "source string, name string, member_key int")))
    kept, votes = (x.collect() for x in connectors.ingest_all(r, p, m))
    for s in ("us-house", "nh", "ct", "oh", "nyc-council", "ca", "va", "mn"):
        one, cast = connectors.ingest(*(x.where(f"source = '{s}'").drop("source") for x in (r, p, m)), s)
        assert sorted((x.roll_id, x.agrees) for x in kept if x.source == s) == sorted((x.roll_id, x.agrees) for x in one.select("roll_id", "agrees").collect()), s
        assert sorted((x.roll_id, x.member_key or -1, x.choice) for x in votes if x.source == s) == sorted((x.roll_id, x.member_key or -1, x.choice) for x in cast.collect()), s
    odd = spark.createDataFrame([("va", 1, "n", None), ("nowhere", 1, "n", "Y"), (None, 1, "n", "Y"), ("va", 9, "n", "Y")], p.schema)
    kept, votes = connectors.ingest_all(r.where("source = 'us-house' and roll_id = 1"), odd, m)
    assert [(x.yes, x.no, x.agrees) for x in kept.collect()] == [(0, 0, None)] and votes.collect() == []
    with pytest.raises(Exception, match="unknown vote: al"):
        connectors.ingest_all(r, spark.createDataFrame([("al", 1, "n", "?")], p.schema), m)[1].collect()
