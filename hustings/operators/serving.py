"""Views that pages and feeds are made of: a member's vote list, roll call detail, seats, coverage, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_name, surname, title_fit, title_words
from .asof import neighbours
from .explorer import paginate


def vote_list(record: DataFrame, member, kind: str = "", hide_unanimous: bool = True, page: int = 1, size: int = 10) -> DataFrame:
    """A page of one member's votes, newest first, with the total."""
    rows = record.where(F.col("member_key") == member)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if hide_unanimous:
        rows = rows.where("split_kind <> 'unanimous'")
    return paginate(rows, [F.desc("roll_date"), "roll_id"], page, size)


def member_pages(votes: DataFrame, members: DataFrame, rolls: DataFrame, size: int = 10) -> DataFrame:
    """The response of every member's page: name, party, tallies and the titles of the newest ``size`` votes, '|' between them.

    ``votes``: roll_id, member_key, choice; ``members``: member_key, name, party; ``rolls``: roll_id, title, roll_date. The
    newest are ranked by a window that Spark cuts in each partition before the shuffle; of one day the smaller id comes first,
    null days last. Null titles are left out of the page, not of the tallies. Votes of unknown members or rolls don't count.
    """
    each = votes.select("roll_id", "member_key", "choice").join(rolls.select("roll_id", "title", "roll_date"), "roll_id")
    count = lambda c: F.count(F.when(F.col("choice") == c, 1)).alias(c)
    tallies = each.groupBy("member_key").agg(F.count(F.lit(1)).alias("total"), count("yes"), count("no"), count("absent"))
    newest = each.select("member_key", "title", F.row_number().over(W.partitionBy("member_key").orderBy(F.desc_nulls_last("roll_date"), "roll_id")).alias("rank")).where(F.col("rank") <= size)
    page = newest.groupBy("member_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), "|").alias("first_page"))
    return members.select("member_key", "name", "party").join(tallies, "member_key").join(page, "member_key")


def named_titles(rolls: DataFrame, today: str, days: int = 90) -> DataFrame:
    """Recent rolls whose title names its subject: titles that start with 'On ' need a meaning."""
    return rolls.where((F.col("roll_date") >= F.date_sub(F.lit(today).cast("date"), days)) & (~F.startswith("title", F.lit("On ")) | F.col("meaning").isNotNull()))


def both_sides(splits: DataFrame, least: int = 5) -> DataFrame:
    return splits.where(F.least("yes", "no") >= least)


def kept_rolls(votes: DataFrame, curated: DataFrame) -> DataFrame:
    """Rolls that are curated or on which somebody voted no or abstained."""
    divided = votes.where(F.col("choice").isin("no", "present")).select("roll_id")
    return divided.unionByName(curated.select("roll_id")).distinct()


def without_ceremony(rolls: DataFrame, pattern: str = r"(?i)election of|nomination|congratulat|in memoriam") -> DataFrame:
    return rolls.where(~F.coalesce(F.col("title"), F.lit("")).rlike(pattern))


def offered_topics(positions: DataFrame, order: list[str], answered: list[str]) -> DataFrame:
    """Topics on which some candidate has a position, and those already answered, in their order."""
    topics = F.explode(F.array(*[F.struct(F.lit(t).alias("issue"), F.lit(i).alias("ordinal")) for i, t in enumerate(order)])).alias("t")
    known = positions.sparkSession.range(1).select(topics).select("t.*")
    have = positions.select("issue").distinct().withColumn("have", F.lit(True))
    return known.join(have, "issue", "left").where(F.col("have") | F.col("issue").isin(answered)).select("issue", "ordinal")


def any_token(text: Column, query: str) -> Column:
    found = F.lit(False)
    for t in query.lower().split():
        found = found | F.contains(F.lower(text), F.lit(t))
    return found


def who_is(votes: DataFrame, roster: DataFrame, snapshot_members: DataFrame) -> DataFrame:
    """Names of a roll's members: the roster's, else the snapshot's, else 'Former member'; unnamed ones come last.

    A roster name counts only if its surname occurs in the snapshot's name where that has one.
    """
    r = roster.select("member_key", F.col("name").alias("__r"), "official_id")
    s = snapshot_members.select("member_key", F.col("name").alias("__s"))
    both = votes.join(r, "member_key", "left").join(s, "member_key", "left")
    same = F.col("__s").isNull() | F.contains(norm_name(F.col("__s")), surname(F.col("__r")))
    name = F.coalesce(F.when(same, F.col("__r")), F.col("__s"), F.lit("Former member"))
    return both.withColumns({"name": name, "official_id": F.when(same, F.col("official_id")), "unnamed": F.col("__r").isNull() & F.col("__s").isNull()}).drop("__r", "__s")


def member_order() -> list[Column]:
    return [F.col("unnamed"), F.col("name")]


def next_election(seats: DataFrame, incumbents: DataFrame, slates: DataFrame, default_year: int) -> DataFrame:
    """election_year of each seat by the first rule that applies: an incumbent on a ballot, the end of a known term, a
    slate for the seat, the usual year. seats: seat, member_key, term_end; incumbents: member_key, year; slates: seat, year."""
    i = incumbents.groupBy("member_key").agg(F.min("year").alias("__i"))
    s = slates.groupBy("seat").agg(F.min("year").alias("__s"))
    out = seats.join(i, "member_key", "left").join(s, "seat", "left")
    rule = F.when(F.col("__i").isNotNull(), "incumbent").when(F.col("term_end").isNotNull(), "term").when(F.col("__s").isNotNull(), "slate").otherwise("default")
    return out.select("seat", F.coalesce("__i", F.col("term_end") - 1, "__s", F.lit(default_year)).alias("election_year"), rule.alias("rule"))


def incumbent_members(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """cand_key, member_key: the same biographical id, or an incumbent without one of the member's seat and surname.
    One equi-join in place of one with an or.

    Pairs can repeat only for candidates with several keys, so both sides drop repeats before they meet and only those
    candidates' pairs are compared after it; all other pairs are written as they are found, without a shuffle.
    """
    last = surname(F.col("name"))
    by_id = lambda df, k: df.where("bioguide is not null").select(k, F.lit("id").alias("by"), F.col("bioguide").alias("a"), F.lit("").alias("b"))
    by_seat = lambda df, k: df.where("seat is not null").select(k, F.lit("seat").alias("by"), F.col("seat").alias("a"), last.alias("b"))
    asked = by_id(candidates, "cand_key").unionByName(by_seat(candidates.where("incumbent and bioguide is null"), "cand_key")).distinct()
    known = by_id(members, "member_key").unionByName(by_seat(members, "member_key")).distinct()
    counted = asked.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("cand_key")))
    pairs = lambda rows: rows.join(known, ["by", "a", "b"]).select("cand_key", "member_key")
    return pairs(counted.where("n = 1")).unionByName(pairs(counted.where("n > 1")).distinct())


def best_by(left: DataFrame, right: DataFrame, on: list[str], key: str, value: str, size: str) -> DataFrame:
    """The ``value`` of the largest ``size`` among the right rows of each left row; the smallest value of equals."""
    best = right.groupBy(*on).agg(F.max(F.struct(F.col(size).alias("s"), (-F.col(value)).alias("v"))).alias("m"))
    return left.join(best, on, "left").select(key, (-F.col("m.v")).alias(value))


def stated_party(members: DataFrame) -> DataFrame:
    """A seat's party from the first file that states D or R. members: seat, file_ordinal, party."""
    return members.where(F.col("party").isin("D", "R")).groupBy("seat").agg(F.min_by("party", "file_ordinal").alias("party"))


def match_amendments(rolls: DataFrame, listed: DataFrame) -> DataFrame:
    """Amendment of a roll: the listed one of its bill and day whose text has the roll's number; else the one of its
    printed number and day; else none. rolls: roll_id, bill, roll_date, roll_number, printed_number; listed: bill,
    day, number, text."""
    day = rolls.join(listed.withColumnRenamed("day", "roll_date"), ["bill", "roll_date"])
    said = day.where(F.rlike("text", F.concat(F.lit(r"\b"), F.col("roll_number").cast("string"), F.lit(r"\b"))))
    by_text = said.groupBy("roll_id").agg(F.min("number").alias("a"))
    by_print = day.where(F.col("number") == F.col("printed_number")).groupBy("roll_id").agg(F.min("number").alias("b"))
    return rolls.join(by_text, "roll_id", "left").join(by_print, "roll_id", "left").select("roll_id", F.coalesce("a", "b").alias("number"), F.when(F.col("a").isNotNull(), "text").when(F.col("b").isNotNull(), "print").alias("how"))


def en_bloc(rolls: DataFrame) -> DataFrame:
    """One roll call for each bill of a vote on several: roll_id is vote and bill."""
    return rolls.withColumn("bill", F.explode("bills")).withColumn("roll_id", F.concat_ws("-", F.col("vote_id").cast("string"), "bill")).drop("bills")


def _terms(title: Column) -> Column:
    """What a caption's word may be to hit a title: each of its words, and their starts of five letters and more."""
    starts = lambda w: F.when(F.length(w) > 5, F.transform(F.sequence(F.lit(5), F.length(w) - 1), lambda k: F.substring(w, 1, k))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(title_words(title), lambda w: F.concat(F.array(w), starts(w)))))


def fitting_titles(asked: DataFrame, titles: DataFrame, share: float = 0.5) -> DataFrame:
    """bill, caption and the first title (priority, then text) of its bill that has ``share`` of the caption's words.

    An index of (bill, term) stands for the product of captions and titles. A caption that needs one word takes the first
    title of each of its words, a table of a row a term. One that needs k of n words must have one among its n - k + 1
    rarest: only those are looked up, and what they find is checked in full. Equal captions and titles of a bill count once.
    """
    offered = titles.groupBy("bill", "alternative").agg(F.min("priority").alias("priority"))
    index = offered.select("bill", F.explode(_terms(F.col("alternative"))).alias("term"), F.struct("priority", "alternative").alias("t"))
    best = index.groupBy("bill", "term").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("df"))
    words = asked.select("bill", "caption").distinct().withColumn("w", title_words(F.col("caption"))).withColumn("need", F.ceil(F.size("w") * share))
    each = words.select("bill", "caption", "need", F.size("w").alias("n"), F.explode("w").alias("term"))
    one = each.where("need <= 1").join(best, ["bill", "term"]).groupBy("bill", "caption").agg(F.min("t").alias("t"))
    rare = F.row_number().over(W.partitionBy("bill", "caption").orderBy(F.coalesce("df", F.lit(0)), "term"))
    several = each.where("need > 1").join(best.select("bill", "term", "df"), ["bill", "term"], "left").withColumn("rare", rare).where("rare <= n - need + 1 and df is not null")
    pairs = several.join(index, ["bill", "term"]).select("bill", "caption", "t").distinct()
    checked = pairs.where(title_fit(F.col("t.alternative"), F.col("caption")) >= share).groupBy("bill", "caption").agg(F.min("t").alias("t"))
    return one.unionByName(checked).select("bill", "caption", F.col("t.alternative").alias("found"))


def repaired_titles(rolls: DataFrame, titles: DataFrame) -> DataFrame:
    """The listed title if it fits the caption; else the first other title of the bill that does; else the listed one,
    flagged. rolls: roll_id, bill, title, caption; titles: bill, priority, alternative. Null captions and titles have no
    words: such captions fit, such titles don't."""
    own = rolls.select("roll_id", "bill", "title", "caption", F.coalesce(title_fit(F.coalesce("title", F.lit("")), F.coalesce("caption", F.lit(""))) >= 0.5, F.lit(False)).alias("fits"))
    asked = own.where("not fits")
    found = asked.join(fitting_titles(asked, titles.where("alternative is not null")), ["bill", "caption"], "left")
    both = own.where("fits").select("roll_id", "bill", "title", F.lit(False).alias("doubtful"))
    return both.unionByName(found.select("roll_id", "bill", F.coalesce("found", "title").alias("title"), F.col("found").isNull().alias("doubtful")))


def phase_titles(rolls: DataFrame, before: str, after: str, enacted: str) -> DataFrame:
    """The title a chamber had a bill under, by phase: at first passage the next reliable printing, at later passage
    the enacted title, else (amendments, procedure, failures) the latest printing before."""
    passed = F.col("passage") & ~F.col("failed")
    return rolls.withColumn("phase_title", F.when(passed & F.col("first"), F.coalesce(after, before)).when(passed, F.coalesce(enacted, before)).otherwise(F.col(before)))


def relink_by_items(rolls: DataFrame, history: DataFrame) -> DataFrame:
    """A roll without a link joins the one history row of its chamber and day with the same set of items."""
    items = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    one = history.withColumn("__k", items(F.col("items"))).groupBy("chamber", "day", "__k").agg(F.count_distinct("bill").alias("n"), F.min("bill").alias("__b")).where("n = 1").drop("n")
    return rolls.withColumn("__k", items(F.col("items"))).join(one, ["chamber", "day", "__k"], "left").withColumn("bill", F.coalesce("bill", "__b")).drop("__k", "__b")


def nearest_column(marks: DataFrame, headers: DataFrame, width: float | None = None) -> DataFrame:
    """Each mark (page, mark_id, x) belongs to the header (page, column, hx) with the least horizontal distance; of two as
    near the smaller column. ``width`` cuts pages into strips, so that several tasks can share one page. Marks without a
    place or a header on their page are left out."""
    near = neighbours(marks.select("page", "mark_id", "x"), headers, "page", "x", "hx", "column", (lambda x: F.floor(x / width)) if width else None)
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("x") - F.col(f"{side}.s")).alias("d"), F.col(f"{side}.v").alias("v")))
    best = F.array_min(F.array_compact(F.array(far("prev"), far("next"))))
    return near.select("page", "mark_id", best["v"].alias("column")).where("column is not null")


def roster_transform(people: DataFrame, default_url: str) -> DataFrame:
    """Rows of a roster file: the last term decides the office, at-large districts are 'al', the first link or else the
    first source that is no aggregator or else a default is the address."""
    term = F.element_at("terms", -1)
    district = F.when(term["district"].cast("string").isin("0", "98"), "al").otherwise(term["district"].cast("string"))
    parts = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: x != "")
    own = F.try_element_at(F.filter(parts("sources"), lambda x: ~x.rlike("openstates|ballotpedia|wikipedia")), F.lit(1))
    return people.select("member_key", "name", term["state"].alias("state"), district.alias("district"), term["party"].alias("party"), F.coalesce(F.try_element_at(parts("links"), F.lit(1)), own, F.lit(default_url)).alias("url"))


def newest_per_chamber(rolls: DataFrame, most: int = 300) -> DataFrame:
    w = W.partitionBy("chamber").orderBy(F.desc("roll_date"), "roll_id")
    return rolls.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def last_listed(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def seat_merge(seats: DataFrame) -> DataFrame:
    """Rows of one seat: seats summed (one where not told), candidates joined in order."""
    names = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "candidates"))), lambda s: s["candidates"]))
    return seats.groupBy("seat").agg(F.sum(F.coalesce("seats", F.lit(1))).alias("seats"), names.alias("candidates"))


def cited(positions: DataFrame) -> DataFrame:
    """Distinct sources that each candidate's positions cite."""
    return positions.select("cand_id", F.explode("sources").alias("source")).groupBy("cand_id").agg(F.count_distinct("source").alias("cited"))


def guide_stats(races: DataFrame) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    official = F.size(F.filter("sources", lambda s: s["kind"] == "official"))
    return races.agg(F.count(F.lit(1)).alias("races"), F.sum(size("candidates")).alias("candidates"), F.sum(size("sources")).alias("sources"), F.sum(F.coalesce(official, F.lit(0))).alias("official_sources"), F.count_distinct("state").alias("states"))


def coverage_ratio(keys: DataFrame, known: DataFrame, by: str = "file") -> DataFrame:
    """matched and all keys of each file."""
    k = known.select("member_key").distinct().withColumn("__k", F.lit(1))
    return keys.distinct().join(k, "member_key", "left").groupBy(by).agg(F.count("__k").alias("matched"), F.count(F.lit(1)).alias("keys"))


def known_answers(votes: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected positions (roll_id, member_key, expected) that the votes contradict or lack; any row blocks a release."""
    return expected.join(votes, ["roll_id", "member_key"], "left").where(~F.col("choice").eqNullSafe(F.col("expected"))).select("roll_id", "member_key", "expected", "choice")


def small_rosters(roster: DataFrame, least: dict[str, int]) -> DataFrame:
    """Chambers whose roster is smaller than it can be."""
    need = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    return roster.groupBy("chamber").agg(F.count_distinct("member_key").alias("members")).where(F.col("members") < F.try_element_at(need, F.col("chamber")))


def unsupported_claims(texts: DataFrame, sponsors: DataFrame) -> DataFrame:
    """Claims of sponsorship in a text (cand_id, text) that the official list (cand_id, bill) doesn't have."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)(?:co)?sponsor(?:ed|s)? (?:the )?((?:H\.R\.|S\.) ?\d+)"), F.lit(1))
    claims = texts.select("cand_id", F.explode(F.array_distinct(found)).alias("bill")).withColumn("bill", F.regexp_replace("bill", " ", ""))
    return claims.join(sponsors.select("cand_id", F.regexp_replace("bill", " ", "").alias("bill")), ["cand_id", "bill"], "left_anti")


def seat_counts(votes: DataFrame, seats: DataFrame) -> DataFrame:
    """Rolls with more positions than the chamber had members that day (seats: roll_id, seated)."""
    return votes.groupBy("roll_id").agg(F.count(F.lit(1)).alias("positions")).join(seats, "roll_id").where(F.col("positions") > F.col("seated"))


def dead_links(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Sources with an archived address where their link is dead."""
    dead = health.where("status = 'dead'").select("url", F.lit(True).alias("dead"), "archived_url")
    return sources.join(dead, "url", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))


def attach_bio(candidates: DataFrame, bios: DataFrame) -> DataFrame:
    """Candidates with their biography's sources under ids of their own."""
    b = bios.select("slug", F.col("sources").alias("__s"))
    return candidates.join(b, "slug", "left").withColumn("bio_sources", F.transform("__s", lambda s: F.concat_ws("~", F.col("cand_id").cast("string"), s["id"]))).drop("__s")


#: Chambers that come first in a list of options, in this order.
PINNED = ["U.S. HOUSE", "U.S. SENATE", "NY SENATE", "NY ASSEMBLY", "NYC COUNCIL", "DC COUNCIL"]


def option_order(label: str) -> list[Column]:
    at = F.array_position(F.array(*map(F.lit, PINNED)), F.col(label))
    return [F.when(at > 0, at).otherwise(len(PINNED) + 1), F.col(label)]


def person_hrefs(officials: DataFrame, people: DataFrame) -> DataFrame:
    """official_id and href: the permanent page of the person that holds an office, or the office's own page where none is
    known (a vacant seat, a stub). ``people``: official_id, slug; the first slug of an official counts. Null ids have none."""
    known = people.where("official_id is not null and slug is not null").groupBy("official_id").agg(F.min("slug").alias("__slug"))
    page = F.coalesce(F.concat(F.lit("/people/"), F.col("__slug")), F.concat(F.lit("/official/"), F.col("official_id")))
    return officials.select("official_id").join(known, "official_id", "left").select("official_id", page.alias("href"))
