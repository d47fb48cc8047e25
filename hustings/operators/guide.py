"""The voter guide: positions from votes and bills, party-line verdicts, finance, comparisons, results, ballots.

A candidate is named by race_id and cand_id. Candidates keep the caller's order; nothing here scores people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import result_headline
from .ranking import name_score

CAND = ["race_id", "cand_id"]


def _count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def vote_positions(key_votes: DataFrame, votes: DataFrame, issues: DataFrame, stated: DataFrame) -> DataFrame:
    """A position for each candidate and issue that recorded yes or no votes touch.

    key_votes: CAND, vote_id, vote; votes: vote_id, bill, title, vote_date; issues: vote_id, issue, yes_means, why;
    stated: CAND, issue, stance. One line for each bill and vote, however often it was taken; a stated stance stays
    beside the votes. The result is stance ``not_inferred``.
    """
    cast = key_votes.where(F.col("vote").isin("yes", "no")).join(votes, "vote_id").join(issues, "vote_id")
    line = cast.groupBy(*CAND, "issue", "bill", "vote").agg(
        F.min(F.struct("vote_date", "vote_id", "title", "why", "yes_means")).alias("f"),
        F.array_sort(F.collect_set(F.col("vote_date").cast("string"))).alias("dates"),
        F.array_sort(F.collect_set(F.concat(F.lit("kv-"), F.col("vote_id").cast("string")))).alias("ids"),
    )
    words = F.concat(F.lit("Voted "), "vote", F.lit(" on "), "f.title", F.lit(" ("), "bill", F.lit(", "), F.array_join("dates", "; "), F.lit(")"), F.coalesce(F.concat(F.lit(", "), F.col("f.why")), F.lit("")), F.lit("."))
    per = line.groupBy(*CAND, "issue").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f.vote_date", "bill", "vote", words.alias("w")))), lambda s: s["w"]), " ").alias("summary"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("sources"),
        F.count(F.lit(1)).alias("recorded"),
    )
    prior = stated.select(*CAND, "issue", F.col("stance").alias("stated"))
    return per.join(prior, [*CAND, "issue"], "left").withColumns({"stance": F.lit("not_inferred"), "basis": F.lit("votes")})


def bill_positions(sponsors: DataFrame, bills: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions from sponsored bills on the issues that a candidate has said nothing about: mixed if the bills point
    both ways. sponsors: CAND, bill, role; bills: bill, issue, supports; positions: CAND, issue, basis."""
    spoken = positions.where("basis <> 'votes'").select(*CAND, "issue").distinct()
    per = sponsors.join(bills, "bill").groupBy(*CAND, "issue").agg(F.bool_and("supports").alias("all"), F.bool_or("supports").alias("any"), F.array_sort(F.collect_set(F.concat(F.lit("bill-"), "bill"))).alias("sources"))
    stance = F.when(F.col("all") != F.col("any"), "mixed").when(F.col("all"), "supports").otherwise("opposes")
    return per.join(spoken, [*CAND, "issue"], "left_anti").select(*CAND, "issue", stance.alias("stance"), "sources")


def sponsor_roles(sponsors: DataFrame) -> DataFrame:
    """One role a member and bill, sponsor before cosponsor; withdrawn ones are left out."""
    return sponsors.where("not withdrawn").groupBy("bill", "member_key").agg(F.min_by("role", F.when(F.col("role") == "sponsor", 0).otherwise(1)).alias("role"))


def party_line(votes: DataFrame, majorities: DataFrame) -> DataFrame:
    """with / against a caucus's majority; ties and other positions have no verdict. votes: member_key, caucus, roll_id,
    choice; majorities: roll_id, caucus, majority."""
    joined = votes.where(F.col("choice").isin("yes", "no")).join(majorities.where("majority is not null").select("roll_id", "caucus", "majority"), ["roll_id", "caucus"])
    return joined.withColumn("verdict", F.when(F.col("choice") == F.col("majority"), "with").otherwise("against"))


def party_line_summary(verdicts: DataFrame, most: int = 4) -> DataFrame:
    """Counts with and against, and the newest ``most`` votes against, of equal days the larger id. They are ranked by a window
    that Spark cuts in each partition before the shuffle, so no member's votes are gathered in one row."""
    counts = verdicts.groupBy("member_key").agg(_count(F.col("verdict") == "with").alias("with_party"), _count(F.col("verdict") == "against").alias("against_party"))
    against = verdicts.where("verdict = 'against'").select("member_key", "roll_id", F.row_number().over(W.partitionBy("member_key").orderBy(F.desc("roll_date"), F.desc("roll_id"))).alias("rank")).where(F.col("rank") <= most)
    newest = against.groupBy("member_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "roll_id"))), lambda s: s["roll_id"]).alias("latest_against"))
    return counts.join(newest, "member_key", "left").withColumn("latest_against", F.coalesce("latest_against", F.array().cast(newest.schema["latest_against"].dataType)))


def said_vs_did(said: DataFrame, votes: DataFrame) -> DataFrame:
    """CAND, issue, stance, comparable, same: each documented statement beside the recorded votes on its issue.

    ``said``: CAND, issue, stance (one a candidate and issue); ``votes``: CAND, issue, vote, yes_means. Only yes and no votes
    whose meaning is known can be compared, and only with a statement that supports or opposes; others count 0. Votes are
    counted before they meet the statements: those that point to support agree with support, the rest of them with opposition.
    Null stances and issues stay and count 0; repeated votes count each time; votes without a statement are left out.
    """
    known = votes.where(F.col("vote").isin("yes", "no") & F.col("yes_means").isin("supports", "opposes"))
    points = known.groupBy(*CAND, "issue").agg(F.count(F.lit(1)).alias("n"), _count((F.col("vote") == "yes") == (F.col("yes_means") == "supports")).alias("support"))
    both = said.select(*CAND, "issue", "stance").join(points, [*CAND, "issue"], "left")
    n, support = F.coalesce("n", F.lit(0)), F.coalesce("support", F.lit(0))
    same = F.when(F.col("stance") == "supports", support).when(F.col("stance") == "opposes", n - support).otherwise(0)
    return both.select(*CAND, "issue", "stance", F.when(F.col("stance").isin("supports", "opposes"), n).otherwise(0).alias("comparable"), same.alias("same"))


def result_lines(races: DataFrame, candidates: DataFrame, results: DataFrame) -> DataFrame:
    """race_id and headline of each race with a result. ``races``: race_id; ``candidates``: race_id, cand_id, name; ``results``:
    race_id, status, unconfirmed, outcome, winner (a cand_id of the race). A winner who is not listed has no name; results of
    other races and null race ids are left out; a repeated result has a line each time."""
    named = candidates.groupBy("race_id", F.col("cand_id").alias("winner")).agg(F.min("name").alias("winner_name"))
    own = results.select("race_id", "status", "unconfirmed", "outcome", "winner").join(races.select("race_id").distinct(), "race_id", "left_semi")
    return own.join(named, ["race_id", "winner"], "left").select("race_id", result_headline(F.col("status"), F.col("unconfirmed"), F.col("outcome"), F.col("winner_name")).alias("headline"))


def top_donors(gifts: DataFrame, most: int = 10) -> DataFrame:
    """The committees that gave a candidate most: gifts (cand_id, committee, kind, memo, amount) of direct kinds, memos
    aside, summed, positive only. Gifts are summed before the shuffle; ranks are cut per group."""
    direct = gifts.where(F.col("kind").isin("24K", "24Z") & (F.coalesce("memo", F.lit("")) != "X"))
    total = direct.groupBy("cand_id", "committee").agg(F.sum("amount").alias("total")).where(F.col("total") > 0)
    return total.withColumn("rank", F.row_number().over(W.partitionBy("cand_id").orderBy(F.desc("total"), "committee"))).where(F.col("rank") <= most)


def money_shares(amounts: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Percent of each positive part in the sum of the positive parts, rounded half up."""
    kept = {p: F.greatest(F.coalesce(F.col(p), F.lit(0)), F.lit(0)) for p in parts}
    whole = sum(kept.values())
    return amounts.select(key, *[F.when(whole > 0, F.floor(100.0 * v / whole + 0.5)).cast("long").alias(f"{p}_pct") for p, v in kept.items()])


def compare_issue(stance: Column, answer: Column) -> Column:
    return F.when(stance.isNull() | (stance == "not_inferred"), "none").when(stance == "mixed", "mixed").when((stance == "supports") == (answer == "agree"), "same").otherwise("different")


def compare_vote(vote: Column, yes_means: Column, answer: Column) -> Column:
    with_it = (vote == "yes") == (yes_means == "supports")
    return F.when(yes_means.isNull(), "not_compared").when(with_it == (answer == "agree"), "in_line").otherwise("not_in_line")


def alignment_counts(candidates: DataFrame, stand: DataFrame, statements: DataFrame, votes: DataFrame) -> DataFrame:
    """Plain tallies of a voter's answers against each candidate's statements and recorded votes, kept apart.

    stand: issue, answer; statements: CAND, issue, stance; votes: CAND, issue, vote, yes_means.
    """
    # One voter's answers, at most one an issue, in one row.
    answers = stand.agg(F.collect_list(F.struct("issue", "answer")).alias("__a"))
    items = candidates.select(*CAND).join(F.broadcast(answers)).select(*CAND, F.explode("__a").alias("__x")).select(*CAND, "__x.issue", "__x.answer")
    said = statements.where("stance <> 'not_inferred'").select(*CAND, "issue", "stance")
    match = compare_vote(F.col("vote"), F.col("yes_means"), F.col("answer"))
    cast = votes.join(F.broadcast(stand), "issue").withColumn("m", match).groupBy(*CAND, "issue").agg(F.count(F.lit(1)).alias("n"), _count(F.col("m") == "in_line").alias("in_line"), _count(F.col("m") == "not_in_line").alias("not_in_line"))
    both = items.join(said, [*CAND, "issue"], "left").join(cast, [*CAND, "issue"], "left")
    outcome = F.when(F.col("stance").isNotNull(), compare_issue(F.col("stance"), F.col("answer"))).when(F.col("n") > 0, "votes_only").otherwise("none")
    counts = [_count(F.col("outcome") == o).alias(o) for o in ("same", "different", "mixed", "votes_only", "none")]
    return both.withColumn("outcome", outcome).groupBy(*CAND).agg(F.count(F.lit(1)).alias("answered"), *counts, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("in_line", "not_in_line")])


def parse_stand(value: str, issues: list[str], most: int = 1000) -> list[tuple[str, str]]:
    """Answers of a shared link ('issue:agree,…'): unknown and malformed ones dropped, the first of each issue counts,
    in the order of ``issues``; nothing from a value that is too long."""
    if len(value) > most:
        return []
    got: dict[str, str] = {}
    for part in value.split(","):
        issue, _, answer = part.partition(":")
        if issue in issues and answer in ("agree", "disagree"):
            got.setdefault(issue, answer)
    return [(i, got[i]) for i in issues if i in got]


def comparison_pivot(positions: DataFrame, candidates: list[str]) -> DataFrame:
    """issue by candidate: one column a candidate, in the order given."""
    return positions.groupBy("issue").pivot("cand_id", candidates).agg(F.min("stance"))


def vote_pivot(votes: DataFrame, candidates: list[str], least: int = 2) -> DataFrame:
    """vote by candidate, for the votes that ``least`` of them cast."""
    enough = votes.groupBy("vote_id").agg(F.count_distinct("cand_id").alias("n")).where(F.col("n") >= least).select("vote_id")
    return votes.join(enough, "vote_id", "left_semi").groupBy("vote_id").pivot("cand_id", candidates).agg(F.min("vote"))


def vote_board(key_votes: DataFrame) -> DataFrame:
    """Who voted how on each key vote: sorted names for each choice."""
    return key_votes.groupBy("vote_id", "vote").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"), F.count(F.lit(1)).alias("voters"))


def results_by_office(races: DataFrame, winners: DataFrame) -> DataFrame:
    """office, d, r, other, uncalled: parties of projected winners by their first letter."""
    p = F.upper(F.substring("party", 1, 1))
    called = races.join(winners, "race_id", "left")
    return called.groupBy("office").agg(_count(p == "D").alias("d"), _count(p == "R").alias("r"), _count(F.col("party").isNotNull() & ~p.isin("D", "R")).alias("other"), _count(F.col("party").isNull()).alias("uncalled"))


def match_results(listed: DataFrame, feed: DataFrame) -> DataFrame:
    """The listed candidate of each feed row (race_id, position, first, middle, last): the best name score within race
    and surname; a candidate is matched once, by the first row.

    Scores depend on names only, so each different name of a race is compared once, with the first of the candidates who
    share one, and rows look their name's result up: pairs grow with the different names of a surname, not with rows.
    """
    names = listed.groupBy("race_id", "last", F.col("first").alias("f2"), F.col("middle").alias("m2")).agg(F.min("cand_id").alias("cand_id"))
    asked = feed.select("race_id", "last", "first", "middle").where("race_id is not null and last is not null").distinct()
    pairs = asked.join(names, ["race_id", "last"])
    s = name_score(F.col("first"), F.col("middle"), F.col("last"), F.col("f2"), F.col("m2"), F.col("last"))
    best = pairs.groupBy("race_id", "last", "first", "middle").agg(F.max(F.struct(s.alias("s"), (-F.col("cand_id")).alias("c"))).alias("b"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("first", "middle")]
    rows = feed.alias("r").join(best.alias("n"), [F.col("r.race_id") == F.col("n.race_id"), F.col("r.last") == F.col("n.last"), *same]).select("r.race_id", "r.position", "n.b")
    each = rows.groupBy("race_id", "position").agg(F.max("b").alias("b")).select("race_id", "position", (-F.col("b.c")).alias("cand_id"))
    once = each.groupBy("race_id", "cand_id").agg(F.min("position").alias("position"))
    return feed.join(once, ["race_id", "position"], "left")


# Offices in the order of a ballot; an office that is not listed comes before them.
OFFICES = ["governor", "comptroller", "attorney-general", "us-senate", "us-house", "state-senate", "state-assembly", "ballot-measure", "other"]
DEALT = 64  # parts of a state's races
BLOCK = 504  # addresses of a block; one run of Parquet's packed values
STATEWIDE = ["us-senate", "governor", "attorney-general", "comptroller", "secretary-of-state"]


def race_order() -> list[Column]:
    place = F.array_position(F.array(*map(F.lit, OFFICES)), F.col("office")) - 1
    number = F.when(F.col("district").rlike("^[0-9]+$"), F.col("district").try_cast("int")).otherwise(0)
    return [F.col("state"), place, number, F.col("race_id")]


def races_for(addresses: DataFrame, races: DataFrame) -> DataFrame:
    """address_id, race_id of the races on a ballot: all statewide ones of the state, the districts' own, measures (a
    city's only inside it). addresses: address_id, state, cd, sd, ad, in_city; races: race_id, state, office.

    Rows are as many as a state's addresses times its statewide races. A state's races are dealt into ``DEALT`` parts, its
    addresses into blocks of ``BLOCK`` or less; the blocks meet the parts one by one, so no task has a whole state. The rows
    of a block come race by race: a page of a file repeats one short list of addresses, which is stored once.
    """
    st = F.lower("state")
    cd = F.when(F.col("cd").isin("0", "98"), "al").otherwise(F.col("cd"))
    own = F.filter(F.array(F.concat_ws("-", F.lit("us-house"), st, cd), F.concat_ws("-", st, F.lit("sd"), "sd"), F.concat_ws("-", st, F.lit("ad"), "ad")), lambda x: x.isNotNull())
    local = addresses.select("address_id", F.explode(own).alias("race_id")).join(races.where(F.col("office").isin("us-house", "state-senate", "state-assembly")), "race_id").select("address_id", "race_id")
    asked = addresses.select("address_id", st.alias("state"), F.coalesce("in_city", F.lit(False)).alias("in_city")).sortWithinPartitions("state", "in_city", "address_id")
    row = F.monotonically_increasing_id()
    blocks = asked.withColumn("block", row - row % BLOCK).groupBy("state", "in_city", "block").agg(F.collect_list(F.struct("address_id")).alias("ids"))
    blocks = blocks.select("state", "in_city", F.col("ids.address_id").alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    offered = races.where(F.col("office").isin([*STATEWIDE, "ballot-measure"])).select(F.lower("state").alias("state"), F.pmod(F.xxhash64("race_id"), F.lit(DEALT)).cast("int").alias("part"), "race_id", "office")
    shown = (F.col("office") != "ballot-measure") | ~F.startswith("race_id", F.lit("nyc-")) | F.col("in_city")
    wide = blocks.join(offered.hint("merge"), ["state", "part"]).where(shown)
    return local.unionByName(wide.select(F.explode("ids").alias("address_id"), "race_id"))


def slate_stats(seats: DataFrame) -> DataFrame:
    return seats.groupBy("chamber").agg(F.sum(F.coalesce("seats", F.lit(1))).alias("seats"), F.count(F.lit(1)).alias("contests"), F.count_distinct("state").alias("states"))


def merge_fusion(candidates: DataFrame) -> DataFrame:
    """One row a name and seat: party lines in order without repeats, incumbent if any row says so."""
    lines = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "party"))), lambda s: s["party"]))
    return candidates.groupBy("seat", "name").agg(F.array_join(lines, ",").alias("parties"), F.bool_or("incumbent").alias("incumbent"))


def uncovered(slates: DataFrame, races: DataFrame) -> DataFrame:
    """Slate seats that no guide race covers."""
    return slates.join(races.select("seat").distinct(), "seat", "left_anti")
