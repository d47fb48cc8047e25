"""Queries on splits and members' records, over the civic view of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import members as M
from ..operators import split as S
from ..sources import driver_tables as T
from . import query

SIDE = "CASE WHEN {p}_yes + {p}_no >= 2 AND {p}_yes <> {p}_no THEN CASE WHEN {p}_yes > {p}_no THEN 'yes' ELSE 'no' END END"
#: Views that the queries below share: positions with party, splits, sides, and a record for each member and roll.
SPLITS = (
    T.VIEWS
    + """,
cast_votes AS (SELECT b.*, m.party FROM ballots b LEFT JOIN members m USING (member_key)),
tallies AS (
  SELECT roll_id, count(*) FILTER (choice = 'yes') AS yes, count(*) FILTER (choice = 'no') AS no,
         count(*) FILTER (choice = 'yes' AND party = 'D') AS d_yes, count(*) FILTER (choice = 'no' AND party = 'D') AS d_no,
         count(*) FILTER (choice = 'yes' AND party = 'R') AS r_yes, count(*) FILTER (choice = 'no' AND party = 'R') AS r_no
  FROM cast_votes GROUP BY roll_id),
sided AS (SELECT *, """
    + SIDE.format(p="d")
    + " AS d_side, "
    + SIDE.format(p="r")
    + """ AS r_side FROM tallies),
splits AS (
  SELECT *, yes > 0 AND no > 0 AS is_split, yes > 0 AND no > 0 AND (abs(yes - no) <= 2 OR 20 * abs(yes - no) <= yes + no) AS is_close,
    CASE WHEN NOT (yes > 0 AND no > 0) THEN 'unanimous' WHEN d_side IS NULL OR r_side IS NULL THEN 'unknown' WHEN d_side = r_side THEN 'bipartisan'
         WHEN 10 * greatest(d_yes, d_no) >= 9 * (d_yes + d_no) AND 10 * greatest(r_yes, r_no) >= 9 * (r_yes + r_no) THEN 'party-line' ELSE 'crossed' END AS split_kind
  FROM sided),
scored AS (
  SELECT s.*, r.bill, r.title, r.question, r.kind, r.chamber, r.roll_date,
    round(CASE WHEN yes = 0 OR no = 0 THEN 0.0 ELSE (1.0 - CAST(abs(yes - no) AS DOUBLE) / (yes + no)
      + CASE WHEN d_yes + d_no >= 2 AND r_yes + r_no >= 2 THEN abs(CAST(d_yes AS DOUBLE) / (d_yes + d_no) - CAST(r_yes AS DOUBLE) / (r_yes + r_no)) ELSE 0.0 END) / 2
      * CASE WHEN kind = 'procedural' THEN 0.5 ELSE 1.0 END END, 6) AS contention
  FROM splits s JOIN rolls r USING (roll_id)),
record AS (
  SELECT c.member_key, c.party, c.choice, c.vote_date, s.*, CASE c.party WHEN 'D' THEN d_side WHEN 'R' THEN r_side END AS party_side,
    list_filter([CASE WHEN title LIKE '%ring%' THEN 'health' END, CASE WHEN title LIKE '%blue%' THEN 'climate' END, CASE WHEN question = 'ECONOMY' THEN 'economy' END], lambda x: x IS NOT NULL) AS topics
  FROM cast_votes c JOIN scored s USING (roll_id)),
divided AS (SELECT *, choice <> party_side AS broke FROM record WHERE split_kind IN ('party-line', 'crossed') AND choice IN ('yes', 'no') AND party_side IS NOT NULL),
issue_rows AS (SELECT *, coalesce(nullif(bill, ''), title) AS subject FROM record WHERE choice IN ('yes', 'no') AND kind = 'substantive' AND is_split AND len(topics) > 0)"""
)


def cast_votes(spark: SparkSession, d: str) -> DataFrame:
    return T.ballots(spark, d).join(T.members(spark, d).select("member_key", "party"), "member_key", "left")


def record(spark: SparkSession, d: str) -> DataFrame:
    """A member's record with topics from words of the driver tables' part names and types."""
    topics = [F.when(F.contains("title", F.lit("ring")), "health"), F.when(F.contains("title", F.lit("blue")), "climate"), F.when(F.col("question") == "ECONOMY", "economy")]
    return M.member_record(T.ballots(spark, d), T.members(spark, d), T.rolls(spark, d)).withColumn("topics", F.array_compact(F.array(*topics)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return S.party_split(cast_votes(spark, d)).join(T.rolls(spark, d), "roll_id").withColumn("contention", S.contention(F.col("kind")))


@query(f"WITH {SPLITS} SELECT roll_id, yes, no, d_yes, d_no, r_yes, r_no, is_split, is_close, split_kind FROM splits")
def roll_split(spark: SparkSession, d: str) -> DataFrame:
    return S.party_split(cast_votes(spark, d))


@query(f"WITH {SPLITS} SELECT split_kind, count(*) AS rolls, count(*) FILTER (is_close) AS close_rolls FROM splits GROUP BY split_kind")
def split_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return roll_split(spark, d).groupBy("split_kind").agg(F.count(F.lit(1)).alias("rolls"), F.count(F.when(F.col("is_close"), 1)).alias("close_rolls"))


@query(f"WITH {SPLITS} SELECT roll_id, bill, title, kind, yes, no, split_kind, contention FROM scored WHERE contention > 0 ORDER BY contention DESC, roll_date DESC, roll_id LIMIT 100")
def contention_topk(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most contested roll calls (a top-k report)."""
    top = scored(spark, d).where(F.col("contention") > 0).orderBy(F.desc("contention"), F.desc("roll_date"), "roll_id").limit(100)
    return top.select("roll_id", "bill", "title", "kind", "yes", "no", "split_kind", "contention")


@query(
    f"""WITH {SPLITS}, t AS (SELECT roll_id, CASE WHEN party IN ('D', 'R') THEN party ELSE 'other' END AS bucket, choice FROM cast_votes)
SELECT roll_id, coalesce(bucket, 'total') AS bucket, count(*) FILTER (choice = 'yes') AS n_yes, count(*) FILTER (choice = 'no') AS n_no,
       count(*) FILTER (choice = 'present') AS n_present, count(*) FILTER (choice = 'absent') AS n_absent FROM t GROUP BY GROUPING SETS ((roll_id, bucket), (roll_id))"""
)
def roll_tally_by_party(spark: SparkSession, d: str) -> DataFrame:
    return S.roll_tally(cast_votes(spark, d))


@query(
    f"""WITH {SPLITS}, t AS (SELECT roll_id, choice, CASE party WHEN 'D' THEN 'D' WHEN 'I' THEN 'D' WHEN 'R' THEN 'R' END AS caucus FROM cast_votes),
g AS (SELECT roll_id, caucus, count(*) FILTER (choice = 'yes') AS yes, count(*) FILTER (choice = 'no') AS no, count(*) FILTER (choice NOT IN ('yes', 'no')) AS nv FROM t WHERE caucus IS NOT NULL GROUP BY 1, 2)
SELECT *, CASE WHEN yes > no THEN 'yes' WHEN no > yes THEN 'no' END AS majority FROM g"""
)
def roll_tally_by_caucus(spark: SparkSession, d: str) -> DataFrame:
    return S.caucus_tally(cast_votes(spark, d), {"D": "D", "R": "R", "I": "D", "ID": "D"})


@query(
    f"""WITH {SPLITS}, p AS (SELECT roll_id, party, count(*) FILTER (choice = 'yes') AS y, count(*) FILTER (choice = 'no') AS n FROM cast_votes GROUP BY 1, 2)
SELECT c.roll_id, c.member_key, c.party, c.choice, CASE WHEN y + n >= 2 AND y <> n THEN CASE WHEN y > n THEN 'yes' ELSE 'no' END END AS party_side,
       coalesce(CASE WHEN y + n >= 2 AND y <> n THEN (CASE WHEN y > n THEN 'yes' ELSE 'no' END) <> c.choice END, false) AS broke
FROM cast_votes c JOIN p USING (roll_id, party) WHERE choice IN ('yes', 'no')"""
)
def broke_with_party(spark: SparkSession, d: str) -> DataFrame:
    return S.broke_with_party(cast_votes(spark, d)).select("roll_id", "member_key", "party", "choice", "party_side", "broke")


@query(
    f"""WITH {SPLITS}, s AS (SELECT member_key, party, count(*) AS m, count(*) FILTER (broke) AS n FROM divided GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT *, CASE WHEN n = 0 AND m >= 10 THEN 'Voted with most of their party on all ' || m || ' party-divided votes on file.'
               ELSE 'Voted against most of their party on ' || n || ' of ' || m || ' party-divided votes on file.' END AS sentence FROM s"""
)
def standout(spark: SparkSession, d: str) -> DataFrame:
    return M.standout(record(spark, d))


@query(
    f"""WITH {SPLITS}, ok AS (SELECT member_key FROM divided GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (broke AND len(topics) > 0) >= 5),
c AS (SELECT member_key, topic, count(*) AS votes FROM (SELECT member_key, unnest(topics) AS topic FROM divided WHERE broke) GROUP BY 1, 2),
r AS (SELECT c.*, row_number() OVER (PARTITION BY member_key ORDER BY votes DESC, topic) AS rank FROM c JOIN ok USING (member_key))
SELECT member_key, topic, votes, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def standout_topics(spark: SparkSession, d: str) -> DataFrame:
    return M.standout_topics(record(spark, d))


@query(
    f"""WITH {SPLITS}, r AS (SELECT member_key, roll_id, kind, choice, party_side, row_number() OVER (PARTITION BY member_key ORDER BY CASE WHEN kind = 'substantive' THEN 0 ELSE 1 END, roll_date DESC, roll_id) AS rank FROM divided WHERE broke)
SELECT member_key, roll_id, kind, choice, party_side, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def standout_votes(spark: SparkSession, d: str) -> DataFrame:
    return M.top_standout_votes(record(spark, d)).select("member_key", "roll_id", "kind", "choice", "party_side", "rank")


@query(
    f"""WITH {SPLITS}, b AS (SELECT *, coalesce(nullif(bill, ''), title) AS subject FROM record WHERE choice IN ('yes', 'no') AND kind = 'substantive' AND contention > 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member_key, subject ORDER BY contention DESC, roll_date DESC, roll_id) AS q FROM b) WHERE q = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY member_key ORDER BY contention DESC, roll_date DESC, roll_id) AS rank FROM f)
SELECT member_key, roll_id, bill, contention, choice, party_side, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8"""
)
def contested_by_member(spark: SparkSession, d: str) -> DataFrame:
    return M.contested(record(spark, d)).withColumn("party_side", M.own_side()).select("member_key", "roll_id", "bill", "contention", "choice", "party_side", "rank")


@query(
    f"""WITH {SPLITS}, ok AS (SELECT member_key FROM issue_rows GROUP BY 1 HAVING count(*) >= 5)
SELECT member_key, topic, count(*) AS total, count(*) FILTER (choice = 'yes') AS yes_votes, count(*) FILTER (choice = 'no') AS no_votes,
       count(*) FILTER (choice = party_side) AS with_party, count(*) FILTER (choice <> party_side) AS against_party
FROM (SELECT *, unnest(topics) AS topic FROM issue_rows SEMI JOIN ok USING (member_key)) GROUP BY 1, 2"""
)
def issue_rollup(spark: SparkSession, d: str) -> DataFrame:
    return M.issue_rollup(record(spark, d))


@query(
    f"""WITH {SPLITS}, e AS (SELECT *, unnest(topics) AS topic FROM issue_rows),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member_key, topic, subject ORDER BY contention DESC, roll_date DESC, roll_id) AS q FROM e) WHERE q = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY member_key, topic ORDER BY contention DESC, roll_date DESC, roll_id) AS rank FROM f)
SELECT member_key, topic, roll_id, contention, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def issue_examples(spark: SparkSession, d: str) -> DataFrame:
    return M.issue_examples(record(spark, d)).select("member_key", "topic", "roll_id", "contention", "rank")


@query(
    f"""WITH {T.VIEWS} SELECT member_key, CAST(date_trunc('month', vote_date) AS DATE) AS month, count(*) AS total, count(*) FILTER (choice <> 'absent') AS attended, min(roll_id) AS first_roll,
  strftime(date_trunc('month', vote_date), '%B %Y') AS label FROM ballots GROUP BY ALL"""
)
def attendance_monthly(spark: SparkSession, d: str) -> DataFrame:
    return M.attendance(T.ballots(spark, d)).withColumn("label", F.date_format("month", "MMMM yyyy"))


@query(
    f"""WITH {T.VIEWS} SELECT member_key, vote_date, roll_id, choice, CASE choice WHEN 'yes' THEN 'voted yes on' WHEN 'no' THEN 'voted no on' WHEN 'present' THEN 'was present for' ELSE 'missed' END AS verb
FROM (SELECT *, row_number() OVER (PARTITION BY member_key ORDER BY vote_date DESC, roll_id) AS r FROM ballots) WHERE r = 1"""
)
def latest_vote(spark: SparkSession, d: str) -> DataFrame:
    return M.latest_vote(T.ballots(spark, d))


@query(f"WITH {SPLITS} SELECT roll_id, concat_ws(', ', CASE WHEN d_yes + d_no > 0 THEN 'Democrats ' || d_yes || '-' || d_no END, CASE WHEN r_yes + r_no > 0 THEN 'Republicans ' || r_yes || '-' || r_no END) AS breakdown FROM splits")
def split_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return roll_split(spark, d).select("roll_id", S.breakdown().alias("breakdown"))


@query(f"WITH {T.VIEWS} SELECT chamber, member_key, min(vote_date) AS first_vote, max(vote_date) AS last_vote, count(*) AS positions FROM ballots JOIN rolls USING (roll_id) GROUP BY ALL")
def member_span(spark: SparkSession, d: str) -> DataFrame:
    """Span of a member's positions in each chamber."""
    joined = T.ballots(spark, d).join(T.rolls(spark, d).select("roll_id", "chamber"), "roll_id")
    return joined.groupBy("chamber", "member_key").agg(F.min("vote_date").alias("first_vote"), F.max("vote_date").alias("last_vote"), F.count(F.lit(1)).alias("positions"))
