"""Rules of single operators on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hustings.functions import text as X
from hustings.operators import explorer, guide, identity, quality, ranking, serving, split
from hustings.operators.topics import classify, parse_topics


def values(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expression).collect()]


@pytest.mark.parametrize(
    ("d", "r", "kind", "close"),
    [((5, 0), (4, 0), "unanimous", False), ((0, 0), (0, 0), "unanimous", False), ((10, 0), (0, 10), "party-line", None), ((10, 0), (1, 9), "party-line", None), ((8, 2), (0, 10), "crossed", None),
     ((9, 1), (8, 2), "bipartisan", None), ((5, 5), (0, 0), "unknown", None), ((1, 0), (0, 1), "unknown", None), ((51, 0), (0, 49), "party-line", True), ((56, 0), (0, 44), "party-line", False), ((2, 0), (0, 1), "unknown", True)],
)
def test_split_kinds(spark, d, r, kind, close):
    rows = [(1, p, c) for p, (y, n) in (("D", d), ("R", r)) for c, k in (("yes", y), ("no", n)) for _ in range(k)] + [(1, "D", "absent"), (1, None, "present")]
    got = split.party_split(spark.createDataFrame(rows, "roll_id long, party string, choice string")).first()
    assert got.split_kind == kind and (close is None or got.is_close == close) and (got.yes, got.no) == (d[0] + r[0], d[1] + r[1])


def test_contention_orders_votes(spark):
    cols = "id string, kind string, yes long, no long, d_yes long, d_no long, r_yes long, r_no long"
    rows = [("party-line", "substantive", 51, 49, 51, 0, 0, 49), ("lopsided", "substantive", 95, 5, 48, 2, 47, 3), ("procedural", "procedural", 51, 49, 51, 0, 0, 49), ("unanimous", "substantive", 9, 0, 5, 0, 4, 0)]
    got = {r.id: r.c for r in spark.createDataFrame(rows, cols).select("id", split.contention(F.col("kind")).alias("c")).collect()}
    assert got["party-line"] > 0.9 and got["lopsided"] < 0.15 and got["procedural"] == pytest.approx(got["party-line"] / 2, abs=1e-6) and got["unanimous"] == 0


def test_topics(spark):
    rows = [("Rent and health care",), ("Chairperson repair authority",), ("Rental vehicle company fees",), ("Mental health; child care",), (None,)]
    assert values(spark, classify(F.col("t")), rows, "t string") == [["housing", "health"], [], [], ["health", "education"], []]
    assert parse_topics("health,nonsense,health,other") == ["health", "other"]


def records(spark):
    rows = [("1", "H.R. 1", "Budget", True, "crossed", ["economy"]), ("2", "H.R. 10326", "Roads", False, "unanimous", []), ("3", "S. 5", "hr1 in words", True, "party-line", ["health", "economy"])]
    return spark.createDataFrame(rows, "roll_id string, bill string, title string, is_split boolean, split_kind string, topics array<string>").withColumns({"is_close": F.lit(False), "kind": F.lit("substantive"), "chamber": F.lit("X"), "state": F.lit("us")})


@pytest.mark.parametrize(("f", "want"), [
    (explorer.Filters(), {"1", "3"}), (explorer.Filters(query="h.r.-1"), {"1"}), (explorer.Filters(query="HR1"), {"1"}), (explorer.Filters(query="roads"), {"2"}), (explorer.Filters(query="hr9"), set()),
    (explorer.Filters(topics=["other"], show="all"), {"2"}), (explorer.Filters(topics=["health", "economy"]), {"1", "3"}), (explorer.Filters(show="party-line"), {"3"}), (explorer.Filters(state="ny"), set()),
])
def test_explorer_filters(spark, f, want):
    assert {r.roll_id for r in explorer.filter_records(records(spark), f).collect()} == want


def test_facets_ignore_the_chosen_topics(spark):
    got = {r.topic: r.records for r in explorer.topic_facets(records(spark), explorer.Filters(topics=["health"], show="all")).collect()}
    assert got == {"economy": 2, "health": 1, "other": 1}


def test_pages(spark):
    rows = spark.range(25).toDF("n")
    assert [r.n for r in explorer.paginate(rows, ["n"], 3).collect()] == [20, 21, 22, 23, 24] and explorer.paginate(rows, ["n"], 9).count() == 0
    last = explorer.paginate(rows, ["n"], 9, clamp=True).collect()
    assert len(last) == 5 and {r.total for r in last} == {25}


def test_names_and_slugs(spark):
    names = [("José (Joe) Núñez, Jr.",), ('Ann "Annie" O\'Neil III',), ("",), (None,), ("!!",)]
    assert values(spark, X.norm_name(F.col("n")), names, "n string") == ["jose nunez", "ann o neil", "", "", ""]
    assert values(spark, X.slugify(F.coalesce(F.col("n"), F.lit(""))), names, "n string") == ["jose-joe-nunez-jr", "ann-annie-oneil-iii", "person", "person", "person"]


def test_districts(spark):
    pairs = [("Coos 05", "Coos 5"), ("Chittenden South East", "Chittenden Southeast"), ("14th Suffolk District", "14th Suffolk"), ("Hampden, Hampshire and Worcester", "Hampden-Hampshire-Worcester"), ("State Senate District 26", "26")]
    assert all(values(spark, X.norm_district(F.col("a")) == X.norm_district(F.col("b")), pairs, "a string, b string"))
    census = spark.createDataFrame([(1, "16", None), (2, "62A", None), (3, "7", "Ward 7"), (4, "99", None)], "census_id long, basename string, name string")
    labels = spark.createDataFrame([("16A",), ("16B",), ("62A",), ("62B",), ("Ward 7",)], "label string")
    got = {(r.census_id, r.label) for r in identity.match_chamber(census, labels).collect()}
    assert got == {(1, "16A"), (1, "16B"), (2, "62A"), (3, "Ward 7"), (4, None)}


def test_dates_and_small_functions(spark):
    dates = [("30-Jun-2026",), ("June 24, 2026",), ("6/5/2026",), ("2026-02-30",), ("soon",), (None,)]
    assert [str(v) for v in values(spark, X.parse_date(F.col("d")), dates, "d string")] == ["2026-06-30", "2026-06-24", "2026-06-05", "None", "None", "None"]
    assert values(spark, F.array_join(X.street_tokens(F.col("s")), " "), [("W. 42 Street",), ("West 42nd St",), ("Fifth Avenue",), ("11 Pl",)], "s string") == ["w 42nd st", "w 42nd st", "5th ave", "11th pl"]
    assert values(spark, X.condense(F.col("s")), [("One. Two! Three?",), ("A" * 200 + ". More.",), ("no end",)], "s string") == ["One. Two! Three?", "A" * 200 + ".", "no end"]
    assert values(spark, X.nominee(F.col("s")), [("Confirmation: Jane Q. Doe of Ohio, to be Judge",), ("Motion to Invoke Cloture: En Bloc Nominations, x",), ("On Passage",)], "s string") == ["jane q doe", None, None]
    assert values(spark, X.strip_tags(F.col("s")), [("<p>A &amp;lt; B<br>C&nbsp;D<script>x<y</script></p>",), (None,)], "s string") == ["A &lt; B C D", ""]
    assert values(spark, X.chamber_state(F.col("s")), [("U.S. HOUSE",), ("NYC COUNCIL",), ("CA ASSEMBLY",)], "s string") == ["us", "ny", "ca"]


def test_matching_tiers(spark):
    o = spark.createDataFrame([(1, "Alexander Smith", "ny", None, ["s1"]), (2, "Dan Lee", "ny", None, ["s2"]), (3, "Dan Lee", "ny", None, ["s3"]), (4, "Ann King", "ny", "B4", ["s4"]), (5, "Danny Lee", "ny", None, ["s9"])], "official_key long, name string, state string, bioguide string, seats array<string>")
    c = [(1, "Alex Smith", "ny", None, False, []), (2, "Dan Lee", "ny", None, False, []), (3, "Dan Lee", "ny", None, True, ["s2"]), (4, "Somebody", "tx", "B4", False, []), (5, "Al Smith", "ny", None, False, []), (6, "Alexander Smith", "tx", None, False, [])]
    got = identity.match_officials(spark.createDataFrame(c, "cand_key long, name string, state string, bioguide string, incumbent boolean, seats array<string>"), o)
    assert {r.cand_key: (r.official_key, r.tier) for r in got.collect()} == {1: (1, "short"), 2: (None, "ambiguous"), 3: (2, "seat"), 4: (4, "id"), 5: (None, "none"), 6: (None, "none")}


def test_slugs_skip_issued_numbers(spark):
    people = spark.createDataFrame([(k, "Ann Lee", "NY", "x") for k in ("a", "b", "c")] + [("d", "Bo", "NY", None)], "key string, name string, state string, tag string")
    taken = spark.createDataFrame([("ann-lee-ny-x-2", None), ("bo", "gone")], "slug string, key string")
    got = {r.key: r.slug for r in identity.assign_slugs(people, taken).collect()}
    assert got == {"a": "ann-lee-ny-x", "b": "ann-lee-ny-x-3", "c": "ann-lee-ny-x-4", "d": "bo-ny"}


def test_printed_names(spark):
    roster = spark.createDataFrame([("c", 1, "Ann", "Smith"), ("c", 2, "Bob", "Smith"), ("c", 3, "Cy", "Wolfeschlegelstein"), ("c", 4, "Di", "King"), ("c", 5, "Ed", "King")], "chamber string, member_key long, first string, last string")
    names = spark.createDataFrame([(1, "c", "Smith A"), (1, "c", "Smith"), (1, "c", "WOLFESCHLEGELST"), (1, "c", "King"), (1, "c", "Nobody")], "roll_id long, chamber string, printed string")
    got = {r.printed: r.member_key for r in identity.resolve_truncated(names, roster).collect()}
    assert got == {"Smith A": 1, "Smith": 2, "WOLFESCHLEGELST": 3, "King": None, "Nobody": None}
    assert identity.partition_names("van der berg king lee", ["van der berg", "van", "king", "lee", "berg king"], 3) == ["van der berg", "king", "lee"]
    assert identity.partition_names("king king", ["king"], 2) is None


def test_nominations_move_to_their_number(spark):
    registry = spark.createDataFrame([("PN1", "Jane Doe"), ("PN2", "John Roe"), ("PN3", "Max Poe")], "number string, nominee string")
    rows = spark.createDataFrame([(1, "PN1", "John Roe"), (2, "PN1", "Jane Q Doe"), (3, "PN9", "Max Poe"), (4, "PN2", "Unknown Name")], "roll_id long, number string, nominee string")
    assert {r.roll_id: r.number for r in identity.fix_subjects(rows, registry).collect()} == {1: "PN2", 2: "PN1", 3: "PN9", 4: "PN2"}


def test_addresses(spark):
    rows = [(0, "100", "Broadway", "Albany", "NY", "12207", "nyc", None), (1, "10", "Broadway", "Albany", "NY", "12207", "osm", "p"), (2, "10", "Broadway", "Albany", "NY", None, "nys", "p"), (3, "10", "S Broadway", "Troy", "NY", None, "osm", None), (4, "10", "Main St", "Albany", "NY", None, "osm", None), (5, "10", "Broadway", "Aurora", "FL", None, "osm", None)]
    df = spark.createDataFrame(rows, "position long, house string, street string, city string, state string, zip string, source string, point_key string").withColumn("detail", F.lit(None).cast("string"))
    got = [r.position for r in ranking.rank(df, ranking.Typed("10", ("broadway", "alb"), "", "NY")).collect()]
    assert got == [2, 3]  # 1 is 2 again, 100 goes once 10 fits, Main St misses the street, Aurora the state
    scores = {r.position: (r.score, r.house_match, r.keep) for r in ranking.score(df, ranking.Typed("10", ("broadway", "alb"), "", "NY")).collect()}
    assert scores[2] == (40 + 10 + 6 + 3, "exact", True) and scores[0][1:] == ("prefix", True) and not scores[4][2]


def test_alignment_rules(spark):
    rows = [("supports", "agree", "same"), ("supports", "disagree", "different"), ("opposes", "disagree", "same"), ("mixed", "agree", "mixed"), ("not_inferred", "agree", "none"), (None, "agree", "none")]
    assert all(values(spark, guide.compare_issue(F.col("s"), F.col("a")) == F.col("w"), rows, "s string, a string, w string"))
    votes = [("yes", "supports", "agree", "in_line"), ("no", "supports", "agree", "not_in_line"), ("no", "opposes", "agree", "in_line"), ("yes", None, "agree", "not_compared")]
    assert all(values(spark, guide.compare_vote(F.col("v"), F.col("y"), F.col("a")) == F.col("w"), votes, "v string, y string, a string, w string"))
    assert guide.parse_stand("b:agree,a:disagree,b:disagree,c:maybe,zz", ["a", "b", "c"]) == [("a", "disagree"), ("b", "agree")] and guide.parse_stand("a:agree" * 400, ["a"]) == []


def test_checks(spark):
    rolls = spark.createDataFrame([(1, 2, 0), (2, 1, 1)], "roll_id long, printed_yes long, printed_no long")
    votes = spark.createDataFrame([(1, "yes"), (1, "yes"), (2, "yes")], "roll_id long, choice string")
    assert [r.roll_id for r in quality.reconcile(rolls, votes).collect()] == [1]
    assert {r.roll_id: r.agrees for r in quality.reconcile(rolls, votes, "warn").collect()} == {1: True, 2: False}
    assert tuple(quality.reconcile(rolls, votes, "count").first()) == (2, 1)
    with pytest.raises(ValueError, match="unknown policy"):
        quality.reconcile(rolls, votes, "ignore")
    with pytest.raises(ValueError, match="positive: 2"):
        quality.require(quality.violations(rolls, "roll_id", {"positive": F.col("printed_yes") > 1}))
    assert quality.duplicates(votes, "roll_id").count() == 1


def test_claims_of_sponsorship(spark):
    texts = spark.createDataFrame([(1, "Cosponsored the H.R. 12 and sponsored S. 3."), (2, None)], "cand_id long, text string")
    sponsors = spark.createDataFrame([(1, "H.R. 12")], "cand_id long, bill string")
    assert [(r.cand_id, r.bill) for r in serving.unsupported_claims(texts, sponsors).collect()] == [(1, "S.3")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "roll_id long, member_key long, party string, choice string")
    assert split.party_split(none).count() == 0 and split.broke_with_party(none).count() == 0 and split.roll_tally(none).count() == 0


def test_every_race_has_its_position(spark):
    from hustings.operators import guide as G
    from hustings.plans import guide, load

    sf = "/root/testdata/sf0.001"
    queries, _ = load()
    want = [r.race_id for r in guide.races(spark, sf).orderBy(*G.race_order()).collect()]
    got = sorted((r.position, r.race_id) for r in queries["race_order_all"](spark, sf).collect())
    assert got == list(enumerate(want, 1)) and len(got) > 60
