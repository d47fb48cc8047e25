"""A member's record: standout votes, contested votes, roll-up by issue, attendance, latest vote.

``record`` is a table with a row for each member and roll call: member_key, party, roll_id, choice, bill, title, kind,
roll_date, chamber, topics (array), and the columns of ``split.party_split``. It ranks votes, never people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .split import contention, party_split, side

MIN_DIVIDED = 5


def member_record(votes: DataFrame, members: DataFrame, rolls: DataFrame) -> DataFrame:
    """Join positions to members and roll calls with their splits. The split is made once a roll and joined back."""
    cast = votes.join(members.select("member_key", "party"), "member_key", "left")
    return cast.join(party_split(cast), "roll_id").join(rolls, "roll_id").withColumn("contention", contention(F.col("kind")))


def own_side() -> Column:
    d, r = (side(F.col(f"{p}_yes"), F.col(f"{p}_no")) for p in "dr")
    return F.when(F.col("party") == "D", d).when(F.col("party") == "R", r)


def divided(record: DataFrame) -> DataFrame:
    """Yes and no positions of D and R members on party-line and crossed votes in which their party had a side."""
    rows = record.where(F.col("split_kind").isin("party-line", "crossed") & F.col("choice").isin("yes", "no")).withColumn("party_side", own_side())
    return rows.where("party_side is not null").withColumn("broke", F.col("choice") != F.col("party_side"))


def standout(record: DataFrame, least: int = MIN_DIVIDED) -> DataFrame:
    """member_key, party, m (divided votes), n (against the party), and a sentence; members below ``least`` have no row."""
    out = divided(record).groupBy("member_key", "party").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("broke"), 1)).alias("n")).where(F.col("m") >= least)
    always = F.format_string("Voted with most of their party on all %d party-divided votes on file.", "m")
    some = F.format_string("Voted against most of their party on %d of %d party-divided votes on file.", "n", "m")
    return out.withColumn("sentence", F.when((F.col("n") == 0) & (F.col("m") >= 10), always).otherwise(some))


def standout_topics(record: DataFrame, least: int = MIN_DIVIDED, top: int = 3) -> DataFrame:
    """The ``top`` topics of a member's votes against the party, if at least ``least`` of those have a topic."""
    d = divided(record)
    ok = d.groupBy("member_key").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("broke") & (F.size("topics") > 0), 1)).alias("tagged")).where((F.col("m") >= least) & (F.col("tagged") >= least)).select("member_key")
    counts = d.where("broke").select("member_key", F.explode("topics").alias("topic")).groupBy("member_key", "topic").agg(F.count(F.lit(1)).alias("votes"))
    ranked = counts.join(ok, "member_key").withColumn("rank", F.row_number().over(W.partitionBy("member_key").orderBy(F.desc("votes"), "topic")))
    return ranked.where(F.col("rank") <= top)


def top_standout_votes(record: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` votes against the party, substantive ones first, then the newest."""
    order = W.partitionBy("member_key").orderBy((F.col("kind") != "substantive").cast("int"), F.desc("roll_date"), "roll_id")
    return divided(record).where("broke").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def contested(record: DataFrame, most: int = 8) -> DataFrame:
    """A member's most contested substantive votes, one a bill (or title where the bill is empty)."""
    rows = record.where(F.col("choice").isin("yes", "no") & (F.col("kind") == "substantive") & (F.col("contention") > 0))
    rows = rows.withColumn("subject", F.coalesce(F.nullif("bill", F.lit("")), "title"))
    order = [F.desc("contention"), F.desc("roll_date"), "roll_id"]
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("member_key", "subject").orderBy(*order))).where("r = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("member_key").orderBy(*order))).where(F.col("rank") <= most).drop("r")


def issue_rows(record: DataFrame) -> DataFrame:
    """Substantive, divided, tagged yes and no positions of members."""
    return record.where(F.col("choice").isin("yes", "no") & (F.col("kind") == "substantive") & F.col("is_split") & (F.size("topics") > 0)).withColumn("party_side", own_side())


def issue_rollup(record: DataFrame, least: int = MIN_DIVIDED) -> DataFrame:
    """For each member and topic: total, yes, no, with_party, against_party; members with fewer than ``least`` tagged
    votes have no rows. Votes without a party side count in the total only."""
    rows = issue_rows(record)
    enough = rows.groupBy("member_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("member_key")
    count = lambda t: F.count(F.when(t, 1))
    return rows.join(enough, "member_key", "left_semi").select("*", F.explode("topics").alias("topic")).groupBy("member_key", "topic").agg(
        F.count(F.lit(1)).alias("total"), count(F.col("choice") == "yes").alias("yes_votes"), count(F.col("choice") == "no").alias("no_votes"),
        count(F.col("choice") == F.col("party_side")).alias("with_party"), count(F.col("choice") != F.col("party_side")).alias("against_party"),
    )


def issue_examples(record: DataFrame, most: int = 3) -> DataFrame:
    """The most contested votes of each member and topic, one a bill."""
    rows = issue_rows(record).withColumn("subject", F.coalesce(F.nullif("bill", F.lit("")), "title")).select("*", F.explode("topics").alias("topic"))
    order = [F.desc("contention"), F.desc("roll_date"), "roll_id"]
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("member_key", "topic", "subject").orderBy(*order))).where("r = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("member_key", "topic").orderBy(*order))).where(F.col("rank") <= most)


def attendance(votes: DataFrame) -> DataFrame:
    """member_key, month, total (positions on file), attended (not absent), first_roll (smallest roll of the month)."""
    month = F.trunc("vote_date", "MM").alias("month")
    return votes.groupBy("member_key", month).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("choice") != "absent", 1)).alias("attended"), F.min("roll_id").alias("first_roll"))


def latest_vote(votes: DataFrame) -> DataFrame:
    """The newest position of each member (smallest roll among equals) and its verb, without a sort of the record."""
    newest = votes.groupBy("member_key").agg(F.max(F.struct("vote_date", (-F.col("roll_id")).alias("r"), "choice")).alias("m"))
    verb = F.when(F.col("m.choice") == "yes", "voted yes on").when(F.col("m.choice") == "no", "voted no on").when(F.col("m.choice") == "present", "was present for").otherwise("missed")
    return newest.select("member_key", F.col("m.vote_date").alias("vote_date"), (-F.col("m.r")).alias("roll_id"), F.col("m.choice").alias("choice"), verb.alias("verb"))
