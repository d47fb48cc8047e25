"""Readers and writers: snapshots in both encodings, delimited and XML files, content files, validators, publishing."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from hustings.sources import connectors, content, snapshots


def snapshot(**over):
    base = {"generatedAt": "2026-10-01T00:00:00Z", "chamber": "NY SENATE", "sourceLabel": "x", "memberKeys": {"a": "1"}}
    return {**base, **over}


def roll(rid, **over):
    return {"id": rid, "bill": "S1", "title": "T", "kind": "substantive", "outcome": "Passed", "date": "2026-09-01", "sourceUrl": "https://a.gov", **over}


def test_both_encodings_and_broken_files(spark, tmp_path):
    verbose = snapshot(rollCalls=[roll("1", votes={"m1": "yes", "m2": "no"}), roll("2", votes={"m2": "absent"})])
    compact = snapshot(memberIndex=["m1", "m2", "m3", "m4", "m5"], rollCalls=[roll("1", codes="YAP-N"), roll("2", codes="NYAYY")])
    for name, body in (("verbose", json.dumps(verbose)), ("compact", json.dumps(compact, indent=1)), ("broken", "{"), ("other", '{"chamber": "X"}')):
        (tmp_path / f"{name}.json").write_text(body)
    s = snapshots.read_snapshots(spark, str(tmp_path))
    assert sorted(r.file for r in s.select("file").collect()) == ["compact", "verbose"]
    votes = {(r.file, r.roll_id, r.member_key): r.choice for r in snapshots.member_votes(s).collect()}
    assert votes["verbose", "1", "m1"] == "yes" and votes["compact", "1", "m3"] == "present" and ("compact", "1", "m4") not in votes and len(votes) == 3 + 4 + 5
    assert snapshots.roll_calls(s).count() == 4
    again = snapshots.decode(snapshots.encode(snapshots.member_votes(s).where("file = 'compact'").select("roll_id", "member_key", "choice")))
    assert {(r.roll_id, r.member_key, r.choice) for r in again.collect()} == {(r, m, c) for (f, r, m), c in votes.items() if f == "compact"}


def test_codec_orders_numbers_as_numbers(spark):
    votes = spark.createDataFrame([("r", k, "yes") for k in ("10", "9", "x", "1")], "roll_id string, member_key string, choice string")
    row = snapshots.encode(votes).first()
    assert row.member_index == ["1", "9", "10", "x"] and row.codes == "YYYY"


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\r\n1,"a, ""b""\nc"\r\n2\r\n\r\n3,x\r\n')
    rows = snapshots.csv_rows(spark, str(tmp_path / "a.csv")).collect()
    assert [(r[0], r[1]) for r in rows] == [("1", 'a, "b"\nc'), ("2", ""), ("3", "x")]
    assert snapshots.csv_rows(spark, str(tmp_path / "a.csv"), strict=True).count() == 2
    (tmp_path / "b.dat").write_text("k\tv\n`1`\tNULL\n`2`\t`a\tb`\n")
    got = snapshots.csv_rows(spark, str(tmp_path / "b.dat"), strict=True, sep="\t", quote="`", escape="`", nullValue="NULL").collect()
    assert [(r.k, r.v) for r in got] == [("1", None), ("2", "a\tb")]


def test_xml_records(spark, tmp_path):
    (tmp_path / "v.xml").write_text("<votes><v><name>A &amp; B</name><vote>Yea</vote></v><v><name>C</name><vote>Nay</vote></v></votes>")
    rows = snapshots.xml_records(spark, str(tmp_path / "v.xml"), "v", "name string, vote string").withColumn("choice", connectors.coded(F.col("vote"), "us-house"))
    assert [(r.name, r.choice) for r in rows.collect()] == [("A & B", "yes"), ("C", "no")]


def test_publish_swaps_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        version = snapshots.publish(spark.range(n), path)
        assert snapshots.published(spark, path).count() == n
    with pytest.raises(Exception):
        snapshots.publish(spark.range(1).select(F.raise_error(F.lit("bad")).alias("x")), path)
    assert snapshots.published(spark, path).count() == 5  # a failed refresh leaves the old table
    assert spark.read.parquet(version).count() == 5 and len(list((tmp_path / "t").glob("v-*"))) >= 2


def test_sources_that_drop_or_fail_on_unknown_words(spark):
    rolls = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "roll_id long, printed_yes long, printed_no long")
    printed = spark.createDataFrame([(1, "a", "Y"), (2, "a", "Y"), (2, "b", "?")], "roll_id long, name string, raw string")
    roster = spark.createDataFrame([("a", 1), ("b", 2)], "name string, member_key long")
    for source, kept in (("ct", [1]), ("ma", [1, 2])):
        got, votes = connectors.ingest(rolls, printed, roster, source)
        assert sorted(r.roll_id for r in got.collect()) == kept and sorted(r.roll_id for r in votes.collect()) == kept
    with pytest.raises(Exception):
        connectors.ingest(rolls, printed, roster, "al")[1].collect()
    words = spark.createDataFrame([("Yea",), ("Not Voting/Excused",), ("Not Voting",), ("Maybe",)], "raw string")
    assert [r[0] for r in words.select(connectors.coded(F.col("raw"), "nh")).collect()] == ["yes", "absent", "absent", None]


def test_codes_count_a_repeated_member_once(spark):
    votes = spark.createDataFrame([(1, "7", "yes"), (1, "7", "yes"), (1, "x", "no"), (2, "10", "absent")], "roll_id long, member_key string, choice string")
    assert sorted((r.roll_id, r.member_index, r.codes) for r in snapshots.encode(votes).collect()) == [(1, ["7", "10", "x"], "Y-N"), (2, ["7", "10", "x"], "-A-")]


def test_connectors(spark):
    assert len(connectors.SOURCES) == 38 and {s.policy for s in connectors.SOURCES.values()} == {"drop", "warn", "count", "none"}
    raw = spark.createDataFrame([("Yeas",), ("Sick",)], "raw string")
    assert [r[0] for r in raw.select(connectors.coded(F.col("raw"), "oh")).collect()] == ["yes", "absent"]
    assert [r[0] for r in raw.select(connectors.coded(F.col("raw"), "mi")).collect()] == ["yes", None]
    with pytest.raises(Exception, match="unknown vote"):
        raw.select(connectors.coded(F.col("raw"), "us-senate")).collect()
    assert connectors.code_table(spark).where("source = 'va'").count() == 4
    rolls = spark.createDataFrame([(1, 1, 1), (2, 2, 0)], "roll_id long, printed_yes long, printed_no long")
    printed = spark.createDataFrame([(1, "a", "AYE"), (1, "b", "NOE"), (2, "a", "AYE"), (2, "z", "?")], "roll_id long, name string, raw string")
    roster = spark.createDataFrame([("a", 10), ("b", 11)], "name string, member_key long")
    kept, votes = connectors.ingest(rolls, printed, roster, "ca")
    assert {(r.roll_id, r.agrees) for r in kept.collect()} == {(1, True), (2, False)} and votes.count() == 3
    kept, votes = connectors.ingest(rolls, printed.withColumn("raw", F.when(F.col("raw") == "AYE", "Y").otherwise("N")), roster, "va")
    assert [r.roll_id for r in kept.collect()] == [1] and votes.count() == 2


def bio(**over):
    cited = {"text": "A sentence.", "sources": ["s1"]}
    source = {"id": "s1", "url": "https://a.gov", "title": "t", "publisher": "p", "kind": "official"}
    return {"slug": "jane-doe", "name": "Jane", "summary": [cited], "paragraphs": [[cited]], "sources": [source], "researchedAt": "2026-01-02", **over}


def test_bio_rules(spark, tmp_path):
    bad = bio(slug="wrong", summary=[{"text": "A tireless one.", "sources": ["s9"]}] * 4, paragraphs=[[]] * 9, researchedAt="soon", sources=[{"id": "s1", "url": "https://en.wikipedia.org/x", "title": "t", "publisher": "p", "kind": "blog"}])
    for name, body in (("jane-doe", bio()), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    bios = content.json_files(spark, str(tmp_path), content.BIO)
    broken = {(r.slug, r.rule) for r in content.bio_violations(bios).collect()}
    assert {s for s, _ in broken} == {"wrong"} and {r for _, r in broken} == {"slug is the file's name", "one to three summary sentences", "at most eight paragraphs", "one to ten sentences a paragraph", "no loaded language", "citations exist", "sources are cited", "whole sources", "encyclopedia pages have a date", "research day"}
    assert content.bio(bios, "jane-doe").count() == 1 and content.bio(bios, "../x").count() == 0


def test_missing_path_is_an_empty_table(spark, tmp_path):
    assert content.json_files(spark, str(tmp_path / "none"), content.BIO).count() == 0
    assert content.races(spark, str(tmp_path / "none")).columns[-1] == "file"


def test_pairs_sitemap_and_positions(spark, tmp_path):
    pairs = {"a": {"id": "1", "officialId": "o", "status": "reviewed", "reviewedBy": "x", "reviewedAt": "2026-01-01"}, "b": {"id": "2", "officialId": "o", "status": "reviewed"}, "_t": {"id": "3", "status": "reviewed", "reviewedBy": "x", "reviewedAt": "y"}}
    for k, v in pairs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    got = content.reviewed_pairs(content.json_files(spark, str(tmp_path), content.PAIR), "o")
    assert [r.id for r in got.collect()] == ["1"] and "reviewedBy" not in got.columns
    urls = content.sitemap(["/", "/votes"], race=spark.createDataFrame([("us-sen-ak",), ("a b",)], "id string"), people=spark.range(2))
    assert {r.url for r in urls.collect()} == {"/", "/votes", "/race/us-sen-ak", "/race/a+b", "/people/0", "/people/1"}
    race = {"id": "r", "state": "NY", "candidates": [{"id": "c", "name": "C", "positions": [{"issue": "rent", "stance": "supports", "sources": ["s"]}]}]}
    folder = tmp_path / "races"
    folder.mkdir()
    (folder / "r.json").write_text(json.dumps(race))
    assert [(r.race_id, r.cand_id, r.issue) for r in content.positions(content.races(spark, str(folder))).collect()] == [("r", "c", "rent")]


ROLL = "file string, chamber string, source_label string, generated_at string, key_by string, roll_id string, roll_date string, title string, bill string, outcome string, kind string, source_url string, votes array<string>, summary string, summary_source string"
GOOD = dict(file="f", chamber="C", source_label="L", generated_at="2026-10-01T00:00:00Z", key_by=None, roll_id="1", roll_date="2026-09-30", title="T", bill="B", outcome="Passed", kind="procedural", source_url="https://clerk.house.gov/1", votes=["yes", "present"], summary=None, summary_source=None)
FAULTS = [
    (dict(source_label=""), "snapshot metadata"), (dict(generated_at="soon", roll_date="2026-01-01"), "snapshot metadata"), (dict(roll_id=None), "roll-call id"), (dict(roll_date="2026-02-30"), "real date"), (dict(roll_date="1 May"), "real date"),
    (dict(roll_date="2026-10-02"), "date not in the future"), (dict(bill=""), "title, bill and outcome"), (dict(kind=None), "kind"), (dict(source_url="http://clerk.house.gov/1"), "official source"), (dict(source_url="https://house.gov.example.com/"), "official source"),
    (dict(key_by="openstates", source_url="https://news.example.com/"), "official source"), (dict(source_url="not a url"), "official source"), (dict(votes=[]), "legal positions"), (dict(votes=["yes", None]), "legal positions"), (dict(summary="S"), "summary provenance"),
]


def rolls_of(spark, changes):
    return spark.createDataFrame([tuple({**GOOD, "roll_id": str(i), **c}.values()) for i, c in enumerate(changes)], ROLL).withColumn("count", F.lit("x"))


def test_each_snapshot_rule_alone(spark):
    right = [{}, dict(key_by="openstates", source_url="https://legis.x.gov/2"), dict(summary="S", summary_source="ai")]
    got = {(r.rule, r.roll_id) for r in snapshots.snapshot_violations(rolls_of(spark, [c for c, _ in FAULTS] + right)).collect()}
    want = {(rule, c.get("roll_id", str(i))) for i, (c, rule) in enumerate(FAULTS)}
    assert got - {("real date", "4"), ("date not in the future", "4")} | {("real date", "4")} == want
    twice = rolls_of(spark, [dict(roll_id="a"), dict(roll_id="a"), dict(roll_id="a", file="g"), {}])
    assert [tuple(r) for r in snapshots.snapshot_violations(twice).collect()] == [("unique id", "f", "a")]
    assert snapshots.snapshot_violations(rolls_of(spark, [{}]).limit(0)).collect() == []


def test_a_snapshot_with_a_broken_rule_is_not_published(spark, tmp_path):
    path = str(tmp_path / "s")
    version = snapshots.publish_checked(rolls_of(spark, [{}, {}, {}]).repartition(2), path)
    assert snapshots.published(spark, path).count() == 3
    bad = [([{}, dict(kind="x"), dict(kind="y", votes=None)], {"kind": 2, "legal positions": 1}), ([dict(roll_id="a"), dict(roll_id="a")], {"unique id": 1}), ([], {"not empty": 1})]
    for rows, counts in bad:
        with pytest.raises(snapshots.Refused) as refused:
            snapshots.publish_checked(rolls_of(spark, rows) if rows else rolls_of(spark, [{}]).limit(0), path)
        assert refused.value.counts == counts
        assert snapshots.published(spark, path).count() == 3  # the old version stays
    assert [str(p) for p in (tmp_path / "s").glob("v-*") if p.is_dir()] == [version]
    snapshots.publish_checked(rolls_of(spark, [{}]), path)
    assert snapshots.published(spark, path).count() == 1


def test_files_have_their_own_rosters_in_both_forms(spark):
    rows = [("f", "1", "10", "yes"), ("f", "1", "9", "no"), ("f", "2", "x", "present"), ("f", "2", "x", "absent"), ("f", "3", "9", "maybe"), ("f", "4", None, "yes"), ("g", "1", "5", "absent"), ("g", "2", "5", "absent"), ("g", "2", "6", "absent")]
    votes = spark.createDataFrame(rows, "file string, roll_id string, member_key string, choice string").withColumns({c: F.lit("z") for c in ("place", "size", "letter", "spots")})
    roster, rolls = snapshots.encode_files(votes)
    assert sorted((r.file, r.place, r.member_key, r["size"]) for r in roster.collect()) == [("f", 0, "9", 3), ("f", 1, "10", 3), ("f", 2, "x", 3), ("g", 0, "5", 2), ("g", 1, "6", 2)]
    assert {(r.file, r.roll_id): (r.codes, r.runs) for r in rolls.collect()} == {("f", "1"): ("NY-", "1N1Y1-"), ("f", "2"): ("--A", "2-1A"), ("f", "3"): ("---", "3-"), ("f", "4"): ("---", "3-"), ("g", "1"): ("A-", "1A1-"), ("g", "2"): ("AA", "2A")}
    want = {("f", "1", "10", "yes"), ("f", "1", "9", "no"), ("f", "2", "x", "absent"), ("g", "1", "5", "absent"), ("g", "2", "5", "absent"), ("g", "2", "6", "absent")}
    for form in ("codes", "runs"):
        assert {tuple(r) for r in snapshots.decode_files(roster, rolls, form).collect()} == want
    assert snapshots.encode_files(votes.limit(0))[1].collect() == []
