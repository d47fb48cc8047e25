"""Queries of the ingest operators: codec, merges, as-of joins, imputation, checks; over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import asof, impute, quality
from ..sources import driver_tables as T
from ..sources import snapshots as S
from . import query

V = T.VIEWS
DAY = "CAST('{0}' AS DATE)"


def ballot_files(spark: SparkSession, d: str) -> DataFrame:
    """Ballots in files of a hundred rolls, so that files and rosters stay as small as a session's, whatever the table's size."""
    return T.ballots(spark, d).select(F.floor(F.col("roll_id") / 100).alias("file"), "roll_id", "member_key", "choice")


@query(f"WITH {V} SELECT roll_id, CAST(member_key AS VARCHAR) AS member_key, choice FROM ballots")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Positions in the compact form and back."""
    return S.decode_files(*S.encode_files(ballot_files(spark, d))).select("roll_id", "member_key", "choice")


@query(f"WITH {V} SELECT roll_id, CAST(member_key AS VARCHAR) AS member_key, choice FROM ballots")
def codec_runs_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Positions in run lengths and back."""
    return S.decode_files(*S.encode_files(ballot_files(spark, d)), form="runs").select("roll_id", "member_key", "choice")


@query(
    f"""WITH {V}, b AS (SELECT roll_id // 100 AS file, * FROM ballots), m AS (SELECT file, member_key, row_number() OVER (PARTITION BY file ORDER BY member_key) AS place FROM (SELECT DISTINCT file, member_key FROM b)),
r AS (SELECT DISTINCT file, roll_id FROM b), x AS (SELECT r.file, r.roll_id, m.place, CASE b.choice WHEN 'yes' THEN 'Y' WHEN 'no' THEN 'N' WHEN 'absent' THEN 'A' ELSE '-' END AS letter FROM r JOIN m USING (file) LEFT JOIN b ON b.roll_id = r.roll_id AND b.member_key = m.member_key),
g AS (SELECT *, place - row_number() OVER (PARTITION BY roll_id, letter ORDER BY place) AS island FROM x),
n AS (SELECT file, roll_id, letter, min(place) AS place, count(*) AS n FROM g GROUP BY file, roll_id, letter, island)
SELECT file, roll_id, string_agg(repeat(letter, CAST(n AS INTEGER)), '' ORDER BY place) AS codes, string_agg(n || letter, '' ORDER BY place) AS runs FROM n GROUP BY file, roll_id"""
)
def codec_files(spark: SparkSession, d: str) -> DataFrame:
    """The compact forms themselves."""
    return S.encode_files(ballot_files(spark, d))[1]


@query(
    f"""WITH {V}, r AS (SELECT *, 'us' AS juris, CASE WHEN roll_id % 3 = 0 THEN 'on file' WHEN roll_id % 3 = 1 THEN title END AS summary FROM rolls),
notes AS (
  SELECT DISTINCT 'us:' || bill || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS k, title AS t, 'About ' || title AS note, DATE '1998-01-01' AS as_of FROM rolls WHERE length(title) % 2 = 0
  UNION ALL SELECT 'us:' || bill, min(title), 'As read: ' || bill, DATE '1998-06-01' FROM rolls GROUP BY bill),
j AS (SELECT r.*, coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN a.t ELSE b.t END AS nt, CASE WHEN a.k IS NOT NULL THEN a.note ELSE b.note END AS note, CASE WHEN a.k IS NOT NULL THEN a.as_of ELSE b.as_of END AS as_of
  FROM r LEFT JOIN notes a ON a.k = 'us:' || bill || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) LEFT JOIN notes b ON b.k = 'us:' || bill),
u AS (SELECT *, coalesce((summary IS NULL OR summary = title) AND trim(regexp_replace(lower(nt), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), false) AS use FROM j)
SELECT roll_id, CASE WHEN use THEN CASE WHEN as_of <> roll_date AND NOT starts_with(note, 'As ') THEN 'On the version voted ' || strftime(as_of, '%b %-d, %Y') || ': ' || note ELSE note END ELSE summary END AS summary, CASE WHEN use THEN 'ai' END AS summary_source FROM u"""
)
def summary_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    r = T.rolls(spark, d)
    rolls = r.withColumn("juris", F.lit("us")).withColumn("summary", F.when(F.col("roll_id") % 3 == 0, "on file").when(F.col("roll_id") % 3 == 1, F.col("title")))
    full = r.where(F.length("title") % 2 == 0).select(F.concat(F.lit("us:"), "bill", F.lit("|"), X.norm_title(F.col("title"))).alias("note_key"), F.col("title").alias("note_title"), F.concat(F.lit("About "), "title").alias("note"), F.lit("1998-01-01").cast("date").alias("as_of")).distinct()
    short = r.groupBy("bill").agg(F.min("title").alias("note_title")).select(F.concat(F.lit("us:"), "bill").alias("note_key"), "note_title", F.concat(F.lit("As read: "), "bill").alias("note"), F.lit("1998-06-01").cast("date").alias("as_of"))
    return S.add_summaries(rolls, full.unionByName(short)).select("roll_id", "summary", "summary_source")


@query(
    f"""WITH {V}, a AS (SELECT roll_id, bill, kind, roll_date, 'ingested' AS origin FROM rolls WHERE roll_id % 3 <> 0), b AS (SELECT roll_id, bill, kind, roll_date, 'curated' AS origin FROM rolls WHERE roll_id % 2 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.bill = b.bill AND a.kind = b.kind AND a.roll_date = b.roll_date)"""
)
def merged_votes_anti_union(spark: SparkSession, d: str) -> DataFrame:
    r = T.rolls(spark, d).select("roll_id", "bill", "kind", "roll_date")
    key = F.concat_ws("|", "bill", F.col("roll_date").cast("string"), "kind")
    return S.merged(r.where("roll_id % 3 <> 0").withColumn("origin", F.lit("ingested")), r.where("roll_id % 2 = 0").withColumn("origin", F.lit("curated")), key)


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def last_file_wins(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return S.last_file_wins(o, ["o_custkey"], "o_orderkey")


@query(
    f"""WITH {V} SELECT roll_id, CASE WHEN roll_id % 2 = 0 THEN title WHEN roll_id % 3 = 0 THEN 'old ' || title END AS summary, CASE WHEN roll_id % 2 = 0 THEN 'official' WHEN roll_id % 3 = 0 THEN 'ai' END AS summary_source FROM rolls"""
)
def carry_forward_summary(spark: SparkSession, d: str) -> DataFrame:
    r = T.rolls(spark, d)
    even = F.col("roll_id") % 2 == 0
    new = r.select("roll_id", F.when(even, F.col("title")).alias("summary"), F.when(even, "official").alias("summary_source"))
    old = r.where("roll_id % 3 = 0").select("roll_id", F.concat(F.lit("old "), "title").alias("summary"), F.lit("ai").alias("summary_source"))
    return S.carry_forward(new, old)


@query(f"WITH {V}, f AS (SELECT state, member_key, name, min(vote_date) AS start FROM ballots JOIN members USING (member_key) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY state ORDER BY start, name, member_key) AS INTEGER) AS seat FROM f")
def senator_seniority(spark: SparkSession, d: str) -> DataFrame:
    terms = T.ballots(spark, d).join(T.members(spark, d), "member_key").select("state", "member_key", "name", F.col("vote_date").alias("start"))
    return S.senator_seats(terms)


@query(
    f"""WITH {V}, v AS (SELECT bill, roll_date + CAST(roll_id % 5 AS INTEGER) AS d, min(title) AS title FROM rolls GROUP BY 1, 2)
SELECT roll_id, bill, roll_date, coalesce((SELECT v.title FROM v WHERE v.bill = r.bill AND v.d <= r.roll_date ORDER BY v.d DESC LIMIT 1), (SELECT v.title FROM v WHERE v.bill = r.bill AND v.d > r.roll_date ORDER BY v.d LIMIT 1)) AS as_of_title FROM rolls r"""
)
def asof_title(spark: SparkSession, d: str) -> DataFrame:
    r = T.rolls(spark, d)
    versions = r.select("bill", F.date_add("roll_date", (F.col("roll_id") % 5).cast("int")).alias("stamp"), F.col("title").alias("as_of_title"))
    return asof.as_of(r.select("roll_id", "bill", "roll_date"), versions, "bill", "roll_date", "stamp", "as_of_title")


@query(
    f"""WITH {V}, l AS (SELECT roll_id, bill, roll_date, lead(roll_date) OVER (PARTITION BY bill ORDER BY roll_date, roll_id) AS until FROM rolls),
s AS (SELECT bill, roll_date + CAST(roll_id % 5 AS INTEGER) AS stamp, 'S' || roll_id % 4 AS status FROM rolls)
SELECT l.*, (SELECT s.status FROM s WHERE s.bill = l.bill AND s.stamp >= l.roll_date AND (l.until IS NULL OR s.stamp < l.until) ORDER BY s.stamp, s.status LIMIT 1) AS status FROM l"""
)
def forward_asof_bounded(spark: SparkSession, d: str) -> DataFrame:
    r = T.rolls(spark, d)
    left = r.select("roll_id", "bill", "roll_date", F.lead("roll_date").over(W.partitionBy("bill").orderBy("roll_date", "roll_id")).alias("until"))
    right = r.select("bill", F.date_add("roll_date", (F.col("roll_id") % 5).cast("int")).alias("stamp"), F.concat(F.lit("S"), (F.col("roll_id") % 4).cast("string")).alias("status"))
    return asof.first_after(left, right, "bill", "roll_date", "stamp", "status", "until", lambda day: F.unix_date(F.last_day(day)))


@query(
    """WITH roles AS (SELECT 'n' || s_suppkey % 20 AS name_key, 'C' || s_suppkey % 3 AS chamber, s_suppkey AS member_key, DATE '1995-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) AS s,
  CASE WHEN s_suppkey % 7 <> 0 THEN DATE '1995-01-01' + CAST(s_suppkey * 37 % 1500 + 900 AS INTEGER) END AS e FROM supplier),
v AS (SELECT o_orderkey, 'n' || o_custkey % 22 AS name_key, 'C' || o_custkey % 3 AS chamber, CAST(o_orderdate AS DATE) AS vote_date FROM orders),
j AS (SELECT v.*, list_distinct(list(member_key) FILTER (vote_date >= s AND (e IS NULL OR vote_date <= e))) AS a, list_distinct(list(member_key) FILTER (member_key IS NOT NULL)) AS b, list_distinct(list(member_key) FILTER (member_key IS NOT NULL AND e IS NULL)) AS c
  FROM v LEFT JOIN roles USING (name_key, chamber) GROUP BY ALL),
k AS (SELECT *, CASE WHEN coalesce(len(a), 0) > 0 THEN a ELSE coalesce(b, []) END AS pool, coalesce(c, []) AS cur FROM j)
SELECT o_orderkey, name_key, chamber, vote_date, CASE WHEN len(pool) = 1 THEN pool[1] WHEN len(list_intersect(pool, cur)) = 1 THEN list_intersect(pool, cur)[1] END AS member_key,
  CASE WHEN len(pool) = 0 THEN 'unknown' WHEN len(pool) = 1 OR len(list_intersect(pool, cur)) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM k"""
)
def interval_membership(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") * 37 % 1500).cast("int"))
    roles = T.read(spark, d, "supplier").select(F.concat(F.lit("n"), (F.col("s_suppkey") % 20).cast("string")).alias("name_key"), F.concat(F.lit("C"), (F.col("s_suppkey") % 3).cast("string")).alias("chamber"), F.col("s_suppkey").alias("member_key"), start.alias("start"), F.when(F.col("s_suppkey") % 7 != 0, F.date_add(start, 900)).alias("end"))
    votes = T.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("n"), (F.col("o_custkey") % 22).cast("string")).alias("name_key"), F.concat(F.lit("C"), (F.col("o_custkey") % 3).cast("string")).alias("chamber"), F.to_date("o_orderdate").alias("vote_date"))
    return asof.members_at(votes, roles)


def events(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "ts")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS occurrence FROM events")
def nth_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return asof.nth_occurrence(events(spark, d), ["user_id"], "event_type", ["ts", "event_id"]).select("event_id", "occurrence")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events")
def heading_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return asof.under_heading(events(spark, d), "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id"))).select("event_id", "heading")


@query(
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS v FROM events),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT event_id, coalesce(v, CASE WHEN a = b THEN a END) AS filled FROM n"""
)
def neighbour_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return asof.fill_agreed(rows, "user_id", "event_id", "v").select("event_id", "filled")


@query(
    """WITH e AS (SELECT event_id, user_id, event_id % 2 AS n, CASE WHEN event_id % 5 <> 0 THEN event_type END AS v FROM events)
SELECT event_id, coalesce(v, CASE WHEN lag(n) OVER w = n THEN lag(v) OVER w END) AS carried FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
)
def same_as_previous(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumns({"n": F.col("event_id") % 2, "v": F.when(F.col("event_id") % 5 != 0, F.col("event_type"))})
    return asof.same_as_previous(rows, "user_id", ["event_id"], ["n"], "v").select("event_id", "carried")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS INTEGER) AS sequence FROM events")
def day_sequence(spark: SparkSession, d: str) -> DataFrame:
    return asof.day_sequence(events(spark, d), ["event_type", "day"], ["event_id"]).select("event_id", "sequence")


@query(
    """WITH e AS (SELECT event_id, 'HF ' || event_id % 3 AS printed, last_value(CASE WHEN event_type = 'view' THEN 'SF ' || event_id % 3 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM events)
SELECT event_id, printed, CASE WHEN regexp_extract(s, '([0-9]+)$', 1) = regexp_extract(printed, '([0-9]+)$', 1) AND s <> printed THEN s ELSE printed END AS bill_repaired FROM e"""
)
def subject_repair(spark: SparkSession, d: str) -> DataFrame:
    number = (F.col("event_id") % 3).cast("string")
    rows = events(spark, d).withColumns({"printed": F.concat(F.lit("HF "), number), "taken": F.when(F.col("event_type") == "view", F.concat(F.lit("SF "), number))})
    return asof.subject_repair(rows, "user_id", "event_id", "printed", "taken").select("event_id", "printed", "bill_repaired")


@query(
    """WITH r AS (SELECT o_orderkey, o_custkey AS vote_id, CAST(o_orderdate AS DATE) AS roll_date, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS tally FROM orders)
SELECT * FROM r a WHERE tally IS NOT NULL OR NOT EXISTS (SELECT 1 FROM r b WHERE b.vote_id = a.vote_id AND b.tally IS NOT NULL AND b.roll_date <> a.roll_date)"""
)
def reused_vote_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("vote_id"), F.to_date("o_orderdate").alias("roll_date"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("tally"))
    return asof.reused_ids(rows)


@query(
    """WITH RECURSIVE v AS (SELECT user_id AS bill, event_id AS version, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_id % 5 = 0),
h AS (SELECT user_id AS bill, event_id AS position, event_type AS action FROM events WHERE event_id % 5 IN (1, 2)),
s AS (
  SELECT v.bill, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS at, CAST(NULL AS BIGINT) AS version, CAST(NULL AS BIGINT) AS hit FROM v GROUP BY v.bill
  UNION ALL
  SELECT v.bill, v.k, coalesce((SELECT min(position) FROM h WHERE h.bill = v.bill AND h.action = v.action AND h.position >= s.at), s.at), v.version, (SELECT min(position) FROM h WHERE h.bill = v.bill AND h.action = v.action AND h.position >= s.at)
  FROM s JOIN v ON v.bill = s.bill AND v.k = s.k + 1)
SELECT bill, version, hit AS linked_position FROM s WHERE k > 0"""
)
def version_linking(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    versions = e.where("event_id % 5 = 0").select(F.col("user_id").alias("bill"), F.col("event_id").alias("version"), F.col("event_type").alias("action"))
    history = e.where("event_id % 5 in (1, 2)").select(F.col("user_id").alias("bill"), F.col("event_id").alias("position"), F.col("event_type").alias("action"))
    return asof.link_versions(versions, history)


@query(
    """WITH a AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 0),
b AS (SELECT event_id AS source_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 1)
SELECT a.event_id, b.source_id FROM a LEFT JOIN b USING (user_id, event_type, n)"""
)
def consume_once(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    left, right = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").select(F.col("event_id").alias("source_id"), "user_id", "event_type")
    return asof.pair_once(left, right, ["user_id", "event_type"], ["event_id"], ["source_id"]).select("event_id", "source_id")


CAST = f"WITH {V}, v AS (SELECT r.chamber, b.roll_id, member_key, choice, roll_date FROM ballots b JOIN rolls r USING (roll_id) WHERE choice <> 'absent')"


def chamber_votes(spark: SparkSession, d: str) -> DataFrame:
    return T.ballots(spark, d).where("choice <> 'absent'").join(T.rolls(spark, d).select("roll_id", "chamber", "roll_date"), "roll_id").select("chamber", "roll_id", "member_key", "choice", "roll_date")


def chamber_rolls(spark: SparkSession, d: str) -> DataFrame:
    return T.rolls(spark, d).select("chamber", "roll_id", "roll_date")


COUNTED = "SELECT roll_id, count(*) AS positions, count(*) FILTER (imputed) AS imputed FROM ({0}) GROUP BY roll_id"


@query(
    CAST
    + ", s AS (SELECT chamber, member_key, min(roll_date) AS a, max(roll_date) AS b FROM v GROUP BY 1, 2) "
    + COUNTED.format("SELECT roll_id, false AS imputed FROM v UNION ALL SELECT r.roll_id, true FROM rolls r JOIN s ON s.chamber = r.chamber AND r.roll_date BETWEEN a AND b ANTI JOIN v ON v.roll_id = r.roll_id AND v.member_key = s.member_key")
)
def absence_impute(spark: SparkSession, d: str) -> DataFrame:
    v = chamber_votes(spark, d)
    return impute.imputed_counts(chamber_rolls(spark, d), impute.spans(v), v)


@query(
    CAST
    + """, s0 AS (SELECT chamber, member_key, min(roll_date) AS a, max(roll_date) AS b FROM v GROUP BY 1, 2), e AS (SELECT chamber, min(a) AS lo, max(b) AS hi FROM s0 GROUP BY 1),
s AS (SELECT chamber, member_key, CASE WHEN a <= lo + 14 THEN DATE '0001-01-01' ELSE a END AS a, CASE WHEN b >= hi - 14 THEN DATE '9999-12-31' ELSE b END AS b FROM s0 JOIN e USING (chamber)) """
    + COUNTED.format("SELECT roll_id, false AS imputed FROM v UNION ALL SELECT r.roll_id, true FROM rolls r JOIN s ON s.chamber = r.chamber AND r.roll_date BETWEEN a AND b ANTI JOIN v ON v.roll_id = r.roll_id AND v.member_key = s.member_key")
)
def absence_impute_open_ended(spark: SparkSession, d: str) -> DataFrame:
    v = chamber_votes(spark, d)
    return impute.imputed_counts(chamber_rolls(spark, d), impute.spans(v, 14), v)


ROSTER = "SELECT 'CHAMBER ' || s_suppkey % 5 AS chamber, s_suppkey AS member_key, DATE '1996-01-01' AS a, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1998-12-31' END AS b FROM supplier"


def roster(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return T.read(spark, d, "supplier").select(F.concat(F.lit("CHAMBER "), (s % 5).cast("string")).alias("chamber"), s.alias("member_key"), F.lit("1996-01-01").cast("date").alias("start"), F.when(s % 3 == 0, F.lit("1998-12-31").cast("date")).alias("end"))


@query(
    CAST
    + f", s AS ({ROSTER}) "
    + COUNTED.format("SELECT roll_id, false AS imputed FROM v UNION ALL SELECT r.roll_id, true FROM rolls r JOIN s ON s.chamber = r.chamber AND r.roll_date >= a AND (b IS NULL OR r.roll_date <= b) ANTI JOIN v ON v.roll_id = r.roll_id AND v.member_key = s.member_key")
)
def absence_seated_roster(spark: SparkSession, d: str) -> DataFrame:
    return impute.imputed_counts(chamber_rolls(spark, d), roster(spark, d), chamber_votes(spark, d))


@query(
    CAST
    + f""", s AS ({ROSTER}), n AS (SELECT * FROM v WHERE choice = 'no' OR roll_id % 2 = 0),
silent AS (SELECT r.chamber, r.roll_id, r.roll_date, CASE WHEN r.roll_id % 3 = 0 THEN 0 ELSE (SELECT count(*) FROM s WHERE s.chamber = r.chamber AND r.roll_date >= a AND (b IS NULL OR r.roll_date <= b)) - 1 END AS printed_yes
  FROM rolls r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.roll_id = r.roll_id AND choice = 'yes')),
filled AS (SELECT r.roll_id, s.member_key, 'yes' AS choice, true AS imputed FROM silent r JOIN s ON s.chamber = r.chamber AND r.roll_date >= a AND (b IS NULL OR r.roll_date <= b) ANTI JOIN n ON n.roll_id = r.roll_id AND n.member_key = s.member_key),
good AS (SELECT roll_id FROM filled JOIN silent USING (roll_id) GROUP BY roll_id, printed_yes HAVING count(*) = printed_yes) """
    + COUNTED.format("SELECT roll_id, false AS imputed FROM n WHERE roll_id NOT IN (SELECT roll_id FROM silent) UNION ALL SELECT roll_id, false FROM n WHERE roll_id IN (SELECT roll_id FROM good) UNION ALL SELECT roll_id, imputed FROM filled WHERE roll_id IN (SELECT roll_id FROM good)")
)
def complement_inference(spark: SparkSession, d: str) -> DataFrame:
    """Odd rolls here print no yes list; their printed count is that of the seated members less one."""
    votes = chamber_votes(spark, d).where("choice = 'no' or roll_id % 2 = 0")
    seats = impute.covering(chamber_rolls(spark, d), roster(spark, d), ["chamber"])
    printed = F.when(F.col("roll_id") % 3 == 0, 0).otherwise(F.col("seats") - 1)
    rolls = chamber_rolls(spark, d).join(seats, ["chamber", "roll_date"]).select("chamber", "roll_id", "roll_date", printed.alias("printed_yes"))
    return impute.complement_counts(rolls, roster(spark, d), votes)


@query(CAST + ", y AS (SELECT DISTINCT chamber, member_key, roll_date FROM v) " + COUNTED.format("SELECT roll_id, false AS imputed FROM v UNION ALL SELECT r.roll_id, true FROM rolls r JOIN y ON y.chamber = r.chamber AND y.roll_date = r.roll_date ANTI JOIN v ON v.roll_id = r.roll_id AND v.member_key = y.member_key"))
def absence_same_day(spark: SparkSession, d: str) -> DataFrame:
    v = chamber_votes(spark, d)
    return impute.imputed_counts(chamber_rolls(spark, d), impute.same_day_roster(v), v)


@query(
    f"""WITH {V}, n AS (SELECT roll_id, 'C' || member_key % 3 AS chamber, list(DISTINCT choice) AS m FROM ballots GROUP BY 1, 2), k AS (SELECT ['absent', 'no', 'yes'] AS p)
SELECT roll_id, chamber, CASE WHEN len(list_filter(p, lambda x: NOT list_contains(m, x))) = 1 THEN list_filter(p, lambda x: NOT list_contains(m, x))[1] END AS presider FROM n, k"""
)
def presiding_officer(spark: SparkSession, d: str) -> DataFrame:
    """Names here are the positions taken in a third of the members: the one position that nobody took presides."""
    chamber = F.concat(F.lit("C"), (F.col("member_key") % 3).cast("string")).alias("chamber")
    named = T.ballots(spark, d).groupBy("roll_id", chamber).agg(F.collect_set("choice").alias("members"))
    known = spark.range(3).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("chamber"), F.array(*map(F.lit, ("absent", "no", "yes"))).alias("members"))
    return impute.presiding(named, known)


TALLY = ", t AS (SELECT roll_id, count(*) FILTER (choice = 'yes') AS yes, count(*) FILTER (choice = 'no') AS no FROM ballots GROUP BY 1)"


def tallies(spark: SparkSession, d: str) -> DataFrame:
    return T.ballots(spark, d).groupBy("roll_id").agg(F.count(F.when(F.col("choice") == "yes", 1)).alias("yes"), F.count(F.when(F.col("choice") == "no", 1)).alias("no"))


@query(f"WITH {V}{TALLY} SELECT roll_id, yes + CASE WHEN roll_id % 10 = 0 THEN 1 ELSE 0 END AS printed_yes, no AS printed_no, yes, no, roll_id % 10 <> 0 AS agrees FROM t WHERE roll_id % 10 <> 0")
def tally_reconcile(spark: SparkSession, d: str) -> DataFrame:
    printed = tallies(spark, d).select("roll_id", (F.col("yes") + F.when(F.col("roll_id") % 10 == 0, 1).otherwise(0)).alias("printed_yes"), F.col("no").alias("printed_no"))
    return quality.reconcile(printed, T.ballots(spark, d))


@query(f"WITH {V} SELECT roll_id, count(*) + roll_id % 3 AS tallied, count(*) AS identified FROM ballots GROUP BY 1 HAVING 100 * count(*) >= 97 * (count(*) + roll_id % 3)")
def completeness_97(spark: SparkSession, d: str) -> DataFrame:
    b = T.ballots(spark, d)
    return quality.complete_lists(b.groupBy("roll_id").agg((F.count(F.lit(1)) + F.col("roll_id") % 3).alias("tallied")), b)


@query(
    f"""WITH {V}, b AS (SELECT roll_id, CASE WHEN roll_id % 4 = 0 AND member_key % 10 = 3 THEN NULL WHEN roll_id % 4 = 1 AND member_key % 10 = 4 THEN 5 ELSE member_key END AS member_key, choice FROM ballots),
g AS (SELECT roll_id FROM b GROUP BY 1 HAVING count(*) = count(member_key) AND count(*) = count(DISTINCT member_key)) SELECT b.* FROM b SEMI JOIN g USING (roll_id)"""
)
def all_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("roll_id") % 4, F.col("member_key") % 10
    b = T.ballots(spark, d).select("roll_id", F.when((k == 0) & (m == 3), F.lit(None)).when((k == 1) & (m == 4), F.lit(5)).otherwise(F.col("member_key")).cast("long").alias("member_key"), "choice")
    return quality.all_or_nothing(b)


@query(f"WITH {V}{TALLY} SELECT roll_id, (roll_id % 2 = 0 AND yes < no) OR (roll_id % 2 = 1 AND yes > no AND roll_id % 5 <> 0) AS conflict FROM t")
def outcome_conflict(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("roll_id")
    return tallies(spark, d).select("roll_id", quality.outcome_conflict(r % 2 == 0, F.col("yes"), F.col("no"), r % 5 == 0).alias("conflict"))


@query(
    f"""WITH {V}{TALLY} SELECT roll_id, CASE WHEN roll_id % 9 = 0 THEN 'Withdrawn' WHEN (CASE roll_id % 3 WHEN 0 THEN yes > no WHEN 1 THEN 3 * yes >= 2 * (yes + no) ELSE 2 * yes >= 1 * 20 END) THEN 'Passed' ELSE 'Failed' END AS outcome FROM t"""
)
def outcome_threshold(spark: SparkSession, d: str) -> DataFrame:
    """A plain majority, two thirds of those voting, or half of twenty seats, unless the official result is stated."""
    k = F.col("roll_id") % 3
    none = F.lit(None).cast("int")
    return tallies(spark, d).select("roll_id", quality.outcome(F.when(F.col("roll_id") % 9 == 0, "Withdrawn"), F.col("yes"), F.col("no"), F.lit(20), F.when(k == 1, 2).when(k == 2, 1), F.when(k == 1, 3).when(k == 2, 2).otherwise(none), k == 2).alias("outcome"))


@query(
    """SELECT rule, o_orderkey FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'known status' END, CASE WHEN NOT o_totalprice > 1000 THEN 'price' END, CASE WHEN NOT CAST(o_orderdate AS DATE) <= DATE '1998-06-01' THEN 'not in the future' END], lambda x: x IS NOT NULL)) AS rule FROM orders)"""
)
def validate_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = {"known status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 1000, "not in the future": F.to_date("o_orderdate") <= F.lit("1998-06-01").cast("date")}
    return quality.violations(T.read(spark, d, "orders"), "o_orderkey", rules)


@query("SELECT doc_id, quality, toxic FROM labels WHERE (CASE WHEN quality = 1 THEN 0 ELSE 1 END) IS DISTINCT FROM toxic")
def raw_vs_normalized(spark: SparkSession, d: str) -> DataFrame:
    return quality.raw_agreement(T.read(spark, d, "labels").select("doc_id", "quality", "toxic"), F.when(F.col("quality") == 1, 0).otherwise(1), F.col("toxic"))


@query("SELECT coalesce(CASE WHEN o_orderstatus = 'P' THEN 'not final' WHEN o_totalprice < 50000 THEN 'small' WHEN o_custkey % 7 = 0 THEN 'no source' END, 'kept') AS reason, count(*) AS orders FROM orders GROUP BY 1")
def skip_reason_hist(spark: SparkSession, d: str) -> DataFrame:
    chain = [("not final", F.col("o_orderstatus") == "P"), ("small", F.col("o_totalprice") < 50000), ("no source", F.col("o_custkey") % 7 == 0)]
    return quality.skip_reasons(T.read(spark, d, "orders"), chain).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    f"""WITH {V}{TALLY}, a AS (SELECT * FROM t WHERE roll_id % 11 <> 0), b AS (SELECT roll_id, yes + CASE WHEN roll_id % 13 = 0 THEN 1 ELSE 0 END AS yes, no FROM t WHERE roll_id % 17 <> 0)
SELECT roll_id, CASE WHEN a.yes IS NULL THEN 'missing in first' WHEN b.yes IS NULL THEN 'missing in second' ELSE 'different' END AS status FROM a FULL JOIN b USING (roll_id) WHERE a.yes IS DISTINCT FROM b.yes OR a.no IS DISTINCT FROM b.no"""
)
def cross_source_reconcile(spark: SparkSession, d: str) -> DataFrame:
    t = tallies(spark, d)
    second = t.where("roll_id % 17 <> 0").withColumn("yes", F.col("yes") + F.when(F.col("roll_id") % 13 == 0, 1).otherwise(0))
    return quality.sources_differ(t.where("roll_id % 11 <> 0"), second, "roll_id", ["yes", "no"])


@query("SELECT doc_id, source FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) > 1)")
def twin_documents(spark: SparkSession, d: str) -> DataFrame:
    return quality.twin_documents(T.read(spark, d, "documents").select("doc_id", "source", "text"), "text", "source").select("doc_id", "source")


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, min(o_orderstatus) AS word FROM orders GROUP BY 1, 2 HAVING min(o_orderstatus) = max(o_orderstatus)")
def agreed_result(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("word"))
    return quality.agreed_result(o, ["o_custkey", "day"], "word")


@query(
    """SELECT n_name AS state, o_orderpriority AS category, count(*) FILTER (o_orderstatus = 'F') AS pass, count(*) FILTER (o_orderstatus = 'O') AS fail, count(*) FILTER (o_orderstatus = 'P') AS skip
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((), (n_name), (o_orderpriority))"""
)
def oracle_report_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (T.read(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    status = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail").otherwise("skip")
    return quality.report(rows.select(F.col("n_name").alias("state"), F.col("o_orderpriority").alias("category"), status.alias("status")), ("state", "category"), "status")
