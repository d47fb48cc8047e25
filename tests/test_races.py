"""Race files: one fault at a time in a race that is otherwise right, and what must be reported."""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from hustings.operators import races as R

PEOPLE = [("r1", "c1", "ann-lee")]
SCHEMAS = ("race_id string, candidate_id string, slug string", "slug string", "bioguide_id string, member_name string")


def good():
    claim = {"text": "Voted for it.", "sources": ["s1"]}
    candidate = {
        "id": "c1", "name": "Ann Lee, Jr.", "parties": ["D"], "researchDepth": "full", "incumbent": True, "bioguideId": "B1", "website": "https://a.gov", "priorities": [claim],
        "statements": [{"issue": "guns", "quote": "I will.", "sources": ["s1"]}], "record": [{"kind": "vote", **claim}],
        "positions": [{"issue": "climate", "stance": "mixed", "summary": "Both.", "sources": ["s1"], "basis": "votes", "stated": {"stance": "opposes", "summary": "No.", "sources": ["s1"]}}],
    }
    measure = {"question": claim, "summary": claim, "yesMeans": "y", "noMeans": "n", "argumentsFor": [claim], "fiscalImpact": claim, "supporters": [claim], "fullTextUrl": "https://b.gov"}
    return {
        "id": "r1", "state": "NY", "officeType": "us-house", "office": "o", "title": "t", "area": "a", "electionDate": "2026-11-03", "inNYC": False, "researchedAt": "2026-10-01", "context": [claim],
        "sources": [{"id": "s1", "url": "https://a.gov", "title": "t", "publisher": "p", "kind": "news"}], "candidates": [candidate], "measure": measure,
    }


def put(path, value):
    """A race with one value changed; ``path`` leads there by keys and indexes, and a None removes it."""
    race = json.loads(json.dumps(good()))
    at = race
    for p in path[:-1]:
        at = at[p]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return race


C = ("candidates", 0)
CLAIM = {"text": "x", "sources": ["s1"]}
CASES = [
    (put(("state",), ""), [("race", "missing state")]),
    (put(("context",), None), [("race", "missing context")]),
    (put(("inNYC",), None), [("race", "inNYC must be boolean")]),
    (put(("officeType",), "mayor"), [("race", "bad officeType mayor")]),
    (put(("sources", 0, "title"), None), [("source s1", "missing title")]),
    (put(("sources", 0, "url"), "ftp://a"), [("source s1", "bad url")]),
    (put(("sources", 0, "kind"), "blog"), [("source s1", "bad kind blog")]),
    (put(("context", 0, "text"), " "), [("context[0]", "missing text")]),
    (put(("context", 0, "sources"), []), [("context[0]", "no sources")]),
    (put(("context", 0, "sources"), ["s1", "s2"]), [("context[0]", "unknown source s2")]),
    (put(("context", 0, "text"), "A Far-Left view"), [("context[0]", "loaded language")]),
    (put((*C, "name"), None), [("candidate c1", "missing name")]),
    (put((*C, "name"), "Bo Cruz"), [("candidate c1", "bioguideId belongs to Ann Lee")]),
    (put((*C, "name"), "Ann Leesmith"), []),
    (put((*C, "background"), "b"), [("candidate c1", "summary and background belong to the biography")]),
    (put((*C, "incumbent"), None), [("candidate c1", "incumbent must be boolean")]),
    (put((*C, "researchDepth"), "deep"), [("candidate c1", "bad researchDepth")]),
    (put((*C, "record"), None), [("candidate c1", "record must be an array")]),
    (put((*C, "website"), "a.gov"), [("candidate c1", "bad website")]),
    (put((*C, "id"), "c2"), [("candidate c2", "not among the people")]),
    (put((*C, "statements", 0, "issue"), "parks"), [("candidate c1.statements[0]", "bad issue parks")]),
    (put((*C, "statements", 0, "quote"), None), [("candidate c1.statements[0]", "quote required"), ("candidate c1.statements[0]", "missing text")]),
    (put((*C, "positions", 0, "stance"), "maybe"), [("candidate c1.positions[0]", "bad stance")]),
    (put((*C, "positions", 0, "basis"), "rumors"), [("candidate c1.positions[0]", "bad basis")]),
    (put((*C, "positions", 0, "stated", "stance"), None), [("candidate c1.positions[0].stated", "bad stance")]),
    (put((*C, "positions", 0, "stated", "sources"), ["x"]), [("candidate c1.positions[0].stated", "unknown source x")]),
    (put((*C, "record", 0, "kind"), "rumor"), [("candidate c1.record[0]", "bad kind rumor")]),
    (put(("measure", "yesMeans"), None), [("measure", "missing yesMeans")]),
    (put(("measure", "summary"), None), [("measure.summary", "missing text")]),
    (put(("measure", "fullTextUrl"), "http://b"), [("measure", "fullTextUrl must be https")]),
    (put(("measure", "opponents"), [CLAIM, {"text": "y"}]), [("measure.opponents[1]", "no sources")]),
    (put(("measure",), None), []),
    (good(), []),
]


def found(spark, rows):
    races = spark.createDataFrame(rows, "file string, body string").select("file", F.from_json("body", R.RACE).alias("r")).select("file", "r.*", F.lit(1).alias("claims"), F.lit(2).alias("f"))
    tables = [spark.createDataFrame(t, s) for t, s in zip((PEOPLE, [("ann-lee",)], [("B1", "Ann Lee")]), SCHEMAS)]
    out = {}
    for r in R.race_violations(races, *tables).collect():
        out.setdefault(r.file, []).append((r.place, r.rule, r.severity))
    return out


def test_each_rule_alone(spark):
    rows = [(f"{i}/r1.json", json.dumps(race)) for i, (race, _) in enumerate(CASES)]
    got = found(spark, rows)
    for i, (_, want) in enumerate(CASES):
        mine = got.get(f"{i}/r1.json", [])
        assert sorted((p, r) for p, r, _ in mine) == sorted(want), CASES[i]
        assert all((s == "warning") == (r == "loaded language") for _, r, s in mine)


def test_rules_of_lists_and_files(spark):
    twice, unused, misnamed = good(), good(), good()
    twice["sources"].append(twice["sources"][0])
    second = copy.deepcopy(twice["candidates"][0])
    second["positions"].append(second["positions"][0])
    twice["candidates"].append(second)
    unused["sources"].append({**unused["sources"][0], "id": "s2"})
    got = found(spark, [("r1.json", json.dumps(twice)), ("2/r1.json", json.dumps(unused)), ("x.json", json.dumps(misnamed)), ("e.json", "{}"), ("n.json", None)])
    assert sorted(got["r1.json"]) == [("candidate c1", "duplicate id", "error"), ("candidate c1", "issue climate listed twice", "warning"), ("source s1", "duplicate id", "error")]
    assert got["2/r1.json"] == [("source s2", "never cited", "warning")]
    assert got["x.json"] == [("race", "id does not match the file's name", "error")]
    assert sorted(r for _, r, _ in got["e.json"]) == sorted(r for _, r, _ in got["n.json"]) and len(got["e.json"]) == 12
    assert found(spark, [("a", "{}")]).keys() == {"a"}


def test_no_races(spark):
    races = spark.createDataFrame([], f"file string, {R.RACE}")
    tables = [spark.createDataFrame([], s) for s in SCHEMAS]
    assert R.race_violations(races, *tables).collect() == []
