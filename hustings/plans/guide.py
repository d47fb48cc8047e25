"""Queries of the guide, over the civic view: candidates are suppliers, races their nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guide as G
from ..operators import split
from ..sources import driver_tables as T
from . import query
from .votes import SPLITS, cast_votes

V = T.VIEWS


def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part")
    yes = F.when(F.col("p_size") % 3 == 0, "supports").when(F.col("p_size") % 3 == 1, "opposes")
    return p.select(F.col("p_partkey").alias("vote_id"), F.lower("p_type").alias("issue"), yes.alias("yes_means"), F.when(F.col("p_size") % 4 == 0, F.lit("on record")).alias("why"))


def key_votes(spark: SparkSession, d: str) -> DataFrame:
    b = T.ballots(spark, d)
    m = T.members(spark, d).select("member_key", F.col("state").alias("race_id"), "name")
    return b.join(m, "member_key").select("race_id", F.col("member_key").alias("cand_id"), "name", F.col("roll_id").alias("vote_id"), F.col("choice").alias("vote"))


def statements(spark: SparkSession, d: str) -> DataFrame:
    m = T.members(spark, d)
    issue = F.explode(F.array(F.lit("economy"), F.lit("small"), F.lit("promo")))
    rows = m.select(F.col("state").alias("race_id"), F.col("member_key").alias("cand_id"), issue.alias("issue"))
    k = (F.col("cand_id") + F.length("issue")) % 4
    return rows.withColumn("stance", F.when(k == 0, "supports").when(k == 1, "opposes").when(k == 2, "mixed").otherwise("not_inferred")).withColumn("basis", F.lit("statements"))


KEYED = f"""WITH {V}, kv AS (SELECT state AS race_id, member_key AS cand_id, name, roll_id AS vote_id, choice AS vote FROM ballots JOIN members USING (member_key)),
cw AS (SELECT p_partkey AS vote_id, lower(p_type) AS issue, CASE p_size % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'opposes' END AS yes_means, CASE WHEN p_size % 4 = 0 THEN 'on record' END AS why FROM part),
st AS (SELECT race_id, cand_id, issue, CASE (cand_id + length(issue)) % 4 WHEN 0 THEN 'supports' WHEN 1 THEN 'opposes' WHEN 2 THEN 'mixed' ELSE 'not_inferred' END AS stance FROM (SELECT state AS race_id, member_key AS cand_id, unnest(['economy', 'small', 'promo']) AS issue FROM members))"""


@query(
    KEYED
    + """, c AS (SELECT * FROM kv JOIN cw USING (vote_id) JOIN (SELECT roll_id AS vote_id, bill, title, roll_date FROM rolls) USING (vote_id) WHERE vote IN ('yes', 'no')),
l AS (SELECT race_id, cand_id, issue, bill, vote, arg_min(title, (roll_date, vote_id)) AS title, arg_min(coalesce(why, ''), (roll_date, vote_id)) AS why, min(roll_date) AS d, list_sort(list_distinct(list(CAST(roll_date AS VARCHAR)))) AS dates, list(DISTINCT 'kv-' || vote_id) AS ids FROM c GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT race_id, cand_id, issue, count(*) AS recorded, array_to_string(list_sort(list_distinct(flatten(list(ids)))), ',') AS sources,
  string_agg('Voted ' || vote || ' on ' || title || ' (' || bill || ', ' || array_to_string(dates, '; ') || ')' || CASE WHEN why <> '' THEN ', ' || why ELSE '' END || '.', ' ' ORDER BY d, bill, vote) AS summary FROM l GROUP BY 1, 2, 3)
SELECT s.*, st.stance AS stated FROM s LEFT JOIN st USING (race_id, cand_id, issue)"""
)
def vote_positions(spark: SparkSession, d: str) -> DataFrame:
    votes = T.rolls(spark, d).select(F.col("roll_id").alias("vote_id"), "bill", "title", F.col("roll_date").alias("vote_date"))
    got = G.vote_positions(key_votes(spark, d).drop("name"), votes, crosswalk(spark, d), statements(spark, d))
    return got.select("race_id", "cand_id", "issue", "recorded", F.array_join("sources", ",").alias("sources"), "summary", "stated")


@query(
    f"""WITH {V}, sp AS (SELECT state AS race_id, member_key AS cand_id, 'b' || member_key % 9 AS bill FROM members UNION SELECT state, member_key, 'b' || member_key % 7 FROM members),
bi AS (SELECT 'b' || i AS bill, CASE WHEN i % 2 = 0 THEN 'economy' ELSE 'health' END AS issue, i % 3 <> 0 AS supports FROM range(9) t(i)),
po AS (SELECT state AS race_id, member_key AS cand_id, 'economy' AS issue FROM members WHERE member_key % 4 = 0)
SELECT race_id, cand_id, issue, CASE WHEN bool_and(supports) <> bool_or(supports) THEN 'mixed' WHEN bool_and(supports) THEN 'supports' ELSE 'opposes' END AS stance, array_to_string(list_sort(list_distinct(list('bill-' || bill))), ',') AS sources
FROM sp JOIN bi USING (bill) ANTI JOIN po USING (race_id, cand_id, issue) GROUP BY 1, 2, 3"""
)
def bill_positions(spark: SparkSession, d: str) -> DataFrame:
    m = T.members(spark, d).select(F.col("state").alias("race_id"), F.col("member_key").alias("cand_id"))
    both = F.explode(F.array(F.col("cand_id") % 9, F.col("cand_id") % 7))
    sponsors = m.select("race_id", "cand_id", both.alias("i")).select("race_id", "cand_id", F.concat(F.lit("b"), F.col("i").cast("string")).alias("bill"))
    i = F.col("id")
    bills = spark.range(9).select(F.concat(F.lit("b"), i.cast("string")).alias("bill"), F.when(i % 2 == 0, "economy").otherwise("health").alias("issue"), (i % 3 != 0).alias("supports"))
    spoken = m.where("cand_id % 4 = 0").select("race_id", "cand_id", F.lit("economy").alias("issue"), F.lit("statements").alias("basis"))
    return G.bill_positions(sponsors, bills, spoken).withColumn("sources", F.array_join("sources", ","))


CAUCUS = "CASE party WHEN 'D' THEN 'D' WHEN 'I' THEN 'D' WHEN 'R' THEN 'R' END"


@query(
    f"""WITH {SPLITS}, t AS (SELECT roll_id, member_key, choice, {CAUCUS} AS caucus FROM cast_votes),
g AS (SELECT roll_id, caucus, CASE WHEN count(*) FILTER (choice = 'yes') > count(*) FILTER (choice = 'no') THEN 'yes' WHEN count(*) FILTER (choice = 'no') > count(*) FILTER (choice = 'yes') THEN 'no' END AS majority FROM t GROUP BY 1, 2),
v AS (SELECT t.*, roll_date, CASE WHEN choice = majority THEN 'with' ELSE 'against' END AS verdict FROM t JOIN g USING (roll_id, caucus) JOIN rolls USING (roll_id) WHERE choice IN ('yes', 'no') AND majority IS NOT NULL)
SELECT member_key, count(*) FILTER (verdict = 'with') AS with_party, count(*) FILTER (verdict = 'against') AS against_party,
  array_to_string((list(roll_id ORDER BY roll_date DESC, roll_id DESC) FILTER (verdict = 'against'))[1:4], ',') AS latest_against FROM v GROUP BY 1"""
)
def party_line_verdict(spark: SparkSession, d: str) -> DataFrame:
    caucus = {"D": "D", "R": "R", "I": "D"}
    cast = cast_votes(spark, d)
    named = cast.withColumn("caucus", F.element_at(F.create_map(*[F.lit(x) for kv in caucus.items() for x in kv]), F.col("party"))).join(T.rolls(spark, d).select("roll_id", "roll_date"), "roll_id")
    verdicts = G.party_line(named, split.caucus_tally(cast, caucus))
    return G.party_line_summary(verdicts).withColumn("latest_against", F.array_join(F.col("latest_against").cast("array<string>"), ","))


@query(
    """WITH g AS (SELECT o_custkey % 100 AS cand_id, o_custkey AS committee, sum(CASE WHEN o_orderkey % 9 = 0 THEN -o_totalprice ELSE o_totalprice END) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' GROUP BY 1, 2 HAVING total > 0)
SELECT cand_id, committee, round(total, 2) AS total, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY total DESC, committee) AS rank FROM g) WHERE rank <= 10"""
)
def top_donors(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "24K").when(F.col("o_orderstatus") == "O", "24Z").otherwise("10")
    gifts = o.select((F.col("o_custkey") % 100).alias("cand_id"), F.col("o_custkey").alias("committee"), kind.alias("kind"), F.when(F.col("o_orderpriority") == "5-LOW", "X").alias("memo"), F.when(F.col("o_orderkey") % 9 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"))
    return G.top_donors(gifts).withColumn("total", F.round("total", 2))


@query(
    """WITH a AS (SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) - 2 AS p FROM orders GROUP BY 1),
k AS (SELECT o_custkey, f, o, greatest(p, 0) AS p FROM a)
SELECT o_custkey, CASE WHEN f + o + p > 0 THEN CAST(floor(100.0 * f / (f + o + p) + 0.5) AS BIGINT) END AS f_pct, CASE WHEN f + o + p > 0 THEN CAST(floor(100.0 * o / (f + o + p) + 0.5) AS BIGINT) END AS o_pct, CASE WHEN f + o + p > 0 THEN CAST(floor(100.0 * p / (f + o + p) + 0.5) AS BIGINT) END AS p_pct FROM k"""
)
def donor_shares(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    a = T.read(spark, d, "orders").groupBy("o_custkey").agg(n("F").alias("f"), n("O").alias("o"), (n("P") - 2).alias("p"))
    return G.money_shares(a, "o_custkey", ["f", "o", "p"])


@query(
    KEYED
    + """, sd AS (SELECT 'economy' AS issue, 'agree' AS answer UNION ALL SELECT 'small', 'disagree' UNION ALL SELECT 'standard', 'agree'),
i AS (SELECT state AS race_id, member_key AS cand_id, issue, answer FROM members, sd),
cv AS (SELECT race_id, cand_id, issue, count(*) AS n, count(*) FILTER (yes_means IS NOT NULL AND ((vote = 'yes') = (yes_means = 'supports')) = (answer = 'agree')) AS in_line,
  count(*) FILTER (yes_means IS NOT NULL AND ((vote = 'yes') = (yes_means = 'supports')) <> (answer = 'agree')) AS not_in_line FROM kv JOIN cw USING (vote_id) JOIN sd USING (issue) WHERE vote IN ('yes', 'no') GROUP BY 1, 2, 3),
b AS (SELECT i.*, coalesce(in_line, 0) AS il, coalesce(not_in_line, 0) AS nl, CASE WHEN stance IS NOT NULL THEN CASE WHEN stance = 'mixed' THEN 'mixed' WHEN (stance = 'supports') = (answer = 'agree') THEN 'same' ELSE 'different' END WHEN n > 0 THEN 'votes_only' ELSE 'none' END AS o
  FROM i LEFT JOIN (SELECT * FROM st WHERE stance <> 'not_inferred') s USING (race_id, cand_id, issue) LEFT JOIN cv USING (race_id, cand_id, issue))
SELECT race_id, cand_id, count(*) AS answered, count(*) FILTER (o = 'same') AS same, count(*) FILTER (o = 'different') AS different, count(*) FILTER (o = 'mixed') AS mixed, count(*) FILTER (o = 'votes_only') AS votes_only,
  count(*) FILTER (o = 'none') AS none, CAST(sum(il) AS BIGINT) AS in_line, CAST(sum(nl) AS BIGINT) AS not_in_line FROM b GROUP BY 1, 2"""
)
def alignment_counts(spark: SparkSession, d: str) -> DataFrame:
    answers = [("economy", "agree"), ("small", "disagree"), ("standard", "agree")]
    stand = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("issue"), F.lit(a).alias("answer")) for i, a in answers])))
    candidates = T.members(spark, d).select(F.col("state").alias("race_id"), F.col("member_key").alias("cand_id"))
    votes = key_votes(spark, d).where(F.col("vote").isin("yes", "no")).join(crosswalk(spark, d), "vote_id")
    return G.alignment_counts(candidates, stand, statements(spark, d), votes.select("race_id", "cand_id", "issue", "vote", "yes_means"))


@query(KEYED + ", x AS (SELECT race_id || '/' || issue AS issue, cand_id, stance FROM st) SELECT issue, min(stance) FILTER (cand_id % 3 = 0) AS a, min(stance) FILTER (cand_id % 3 = 1) AS b, min(stance) FILTER (cand_id % 3 = 2) AS c FROM x GROUP BY issue")
def comparison_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = statements(spark, d)
    side = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("cand_id") % 3 + 1).cast("int"))
    return G.comparison_pivot(s.select(F.concat_ws("/", "race_id", "issue").alias("issue"), side.alias("cand_id"), "stance"), ["a", "b", "c"])


@query(KEYED + ", x AS (SELECT race_id || '/' || vote_id AS vote_id, CASE cand_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS k, vote FROM kv) SELECT vote_id, min(vote) FILTER (k = 'a') AS a, min(vote) FILTER (k = 'b') AS b, min(vote) FILTER (k = 'c') AS c FROM x GROUP BY vote_id HAVING count(DISTINCT k) >= 2")
def vote_pivot(spark: SparkSession, d: str) -> DataFrame:
    side = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("cand_id") % 3 + 1).cast("int"))
    return G.vote_pivot(key_votes(spark, d).select(F.concat_ws("/", "race_id", F.col("vote_id").cast("string")).alias("vote_id"), side.alias("cand_id"), "vote"), ["a", "b", "c"])


@query(KEYED + " SELECT vote_id, vote, string_agg(DISTINCT name, ', ' ORDER BY name) AS names, count(*) AS voters FROM kv GROUP BY 1, 2")
def key_vote_board(spark: SparkSession, d: str) -> DataFrame:
    return G.vote_board(key_votes(spark, d))


@query(
    """WITH r AS (SELECT c_custkey AS race_id, c_mktsegment AS office FROM customer), w AS (SELECT c_custkey AS race_id, CASE c_nationkey % 4 WHEN 0 THEN 'Democratic' WHEN 1 THEN 'Republican' ELSE 'Working Families' END AS party FROM customer WHERE c_acctbal > 0)
SELECT office, count(*) FILTER (party LIKE 'D%') AS d, count(*) FILTER (party LIKE 'R%') AS r, count(*) FILTER (party LIKE 'W%') AS other, count(*) FILTER (party IS NULL) AS uncalled FROM r LEFT JOIN w USING (race_id) GROUP BY 1"""
)
def results_by_office(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "customer")
    party = F.when(F.col("c_nationkey") % 4 == 0, "Democratic").when(F.col("c_nationkey") % 4 == 1, "Republican").otherwise("Working Families")
    return G.results_by_office(c.select(F.col("c_custkey").alias("race_id"), F.col("c_mktsegment").alias("office")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("race_id"), party.alias("party")))


FEED = """WITH l AS (SELECT s_nationkey AS race_id, s_suppkey AS cand_id, ['ann', 'al', 'bo'][s_suppkey % 3 + 1] AS f, CASE WHEN s_suppkey % 2 = 0 THEN 'j' END AS m, ['lee', 'fox'][s_suppkey // 7 % 2 + 1] AS x FROM supplier),
e AS (SELECT c_nationkey AS race_id, c_custkey AS position, ['ann', 'al', 'cy'][c_custkey % 3 + 1] AS f, CASE WHEN c_custkey % 5 = 0 THEN 'j' WHEN c_custkey % 5 = 1 THEN 'k' END AS m, ['lee', 'fox', 'roe'][c_custkey % 7 % 3 + 1] AS x FROM customer)"""


@query(
    FEED
    + """, s AS (SELECT race_id, position, cand_id, CASE WHEN e.f = l.f AND e.m IS NOT DISTINCT FROM l.m THEN 100 ELSE CASE WHEN e.f = l.f THEN 2 WHEN e.f[1] = l.f[1] THEN 1 ELSE 0 END + CASE WHEN e.m IS NULL OR l.m IS NULL THEN 0 WHEN e.m = l.m THEN 3 ELSE -5 END END AS sc FROM e JOIN l USING (race_id, x)),
b AS (SELECT race_id, position, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY race_id, position ORDER BY sc DESC, cand_id) AS r FROM s) WHERE r = 1),
o AS (SELECT race_id, cand_id, min(position) AS position FROM b GROUP BY 1, 2) SELECT e.race_id, e.position, o.cand_id FROM e LEFT JOIN o USING (race_id, position)"""
)
def result_matching(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda v, i: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    listed = T.read(spark, d, "supplier").select(F.col("s_nationkey").alias("race_id"), s.alias("cand_id"), pick(["ann", "al", "bo"], s % 3).alias("first"), F.when(s % 2 == 0, "j").alias("middle"), pick(["lee", "fox"], F.floor(s / 7) % 2).alias("last"))
    feed = T.read(spark, d, "customer").select(F.col("c_nationkey").alias("race_id"), c.alias("position"), pick(["ann", "al", "cy"], c % 3).alias("first"), F.when(c % 5 == 0, "j").when(c % 5 == 1, "k").alias("middle"), pick(["lee", "fox", "roe"], c % 7 % 3).alias("last"))
    return G.match_results(listed, feed).select("race_id", "position", "cand_id")


OFFICE_SQL = "['us-senate', 'governor', 'us-house', 'state-senate', 'ballot-measure', 'secretary-of-state'][c_custkey % 6 + 1]"


def races(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    office = F.element_at(F.array(*map(F.lit, ("us-senate", "governor", "us-house", "state-senate", "ballot-measure", "secretary-of-state"))), (k % 6 + 1).cast("int"))
    state = F.concat(F.lit("s"), (F.col("c_nationkey") % 5).cast("string"))
    number = (k % 12).cast("string")
    rid = F.when(office == "us-house", F.concat(F.lit("us-house-"), state, F.lit("-"), number)).when(office == "state-senate", F.concat(state, F.lit("-sd-"), number)).when((office == "ballot-measure") & (k % 4 == 0), F.concat(F.lit("nyc-prop-"), k.cast("string"))).otherwise(F.concat(office, F.lit("-"), k.cast("string")))
    return T.read(spark, d, "customer").select(rid.alias("race_id"), state.alias("state"), office.alias("office"), F.when(office.isin("us-house", "state-senate"), number).alias("district")).distinct()


RACES = f"""r0 AS (SELECT c_custkey AS k, 's' || c_nationkey % 5 AS state, {OFFICE_SQL} AS office, CAST(c_custkey % 12 AS VARCHAR) AS num FROM customer),
races AS (SELECT DISTINCT CASE WHEN office = 'us-house' THEN 'us-house-' || state || '-' || num WHEN office = 'state-senate' THEN state || '-sd-' || num WHEN office = 'ballot-measure' AND k % 4 = 0 THEN 'nyc-prop-' || k ELSE office || '-' || k END AS race_id, state, office, CASE WHEN office IN ('us-house', 'state-senate') THEN num END AS district FROM r0)"""


@query(
    f"""WITH {RACES}, a AS (SELECT s_suppkey AS address_id, 's' || s_nationkey % 5 AS state, CAST(s_suppkey % 12 AS VARCHAR) AS cd, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 10 AS VARCHAR) END AS sd, s_suppkey % 3 = 0 AS in_city FROM supplier)
SELECT address_id, race_id FROM a JOIN races r ON a.state = r.state AND CASE WHEN office IN ('us-senate', 'governor', 'secretary-of-state') THEN true WHEN office = 'us-house' THEN race_id = 'us-house-' || a.state || '-' || CASE WHEN cd IN ('0', '98') THEN 'al' ELSE cd END
  WHEN office = 'state-senate' THEN race_id = a.state || '-sd-' || sd WHEN office = 'ballot-measure' THEN NOT starts_with(race_id, 'nyc-') OR in_city END"""
)
def races_for_districts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    addresses = T.read(spark, d, "supplier").select(s.alias("address_id"), F.concat(F.lit("s"), text(F.col("s_nationkey") % 5)).alias("state"), text(s % 12).alias("cd"), F.when(s % 2 == 0, text(s % 10)).alias("sd"), F.lit(None).cast("string").alias("ad"), (s % 3 == 0).alias("in_city"))
    return G.races_for(addresses, races(spark, d).where(~F.col("office").isin("other")))


@query(f"WITH {RACES}, o AS (SELECT *, coalesce(list_position(['governor', 'comptroller', 'attorney-general', 'us-senate', 'us-house', 'state-senate', 'state-assembly', 'ballot-measure', 'other'], office), 0) AS place FROM races) SELECT race_id, CAST(row_number() OVER (ORDER BY state, place, coalesce(CAST(district AS INTEGER), 0), race_id) AS INTEGER) AS position FROM o ORDER BY position LIMIT 60")
def race_order(spark: SparkSession, d: str) -> DataFrame:
    """The first sixty races of the guide in its order (a top-k report)."""
    from pyspark.sql import Window as W

    first = races(spark, d).orderBy(*G.race_order()).limit(60)
    return first.select("race_id", F.row_number().over(W.orderBy(*G.race_order())).alias("position"))


@query(f"WITH {RACES}, o AS (SELECT *, coalesce(list_position(['governor', 'comptroller', 'attorney-general', 'us-senate', 'us-house', 'state-senate', 'state-assembly', 'ballot-measure', 'other'], office), 0) AS place FROM races) SELECT race_id, CAST(row_number() OVER (ORDER BY state, place, coalesce(CAST(district AS INTEGER), 0), race_id) AS INTEGER) AS position FROM o")
def race_order_all(spark: SparkSession, d: str) -> DataFrame:
    """Every race of the guide with its position: its place within the state, after the races of the states before."""
    from pyspark.sql import Window as W

    every = races(spark, d)
    within = every.select("race_id", "state", F.row_number().over(W.partitionBy("state").orderBy(*G.race_order())).alias("place"))
    counts = every.groupBy("state").agg(F.count(F.lit(1)).alias("n"))  # one row a state
    before = counts.select(F.col("state").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("state").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    return within.join(F.broadcast(before), F.col("state").eqNullSafe(F.col("of"))).select("race_id", (F.col("place") + F.col("skip")).cast("int").alias("position"))


@query("SELECT s_nationkey % 3 AS chamber, CAST(sum(coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 END, 1)) AS BIGINT) AS seats, count(*) AS contests, count(DISTINCT s_nationkey) AS states FROM supplier GROUP BY 1")
def slate_stats(spark: SparkSession, d: str) -> DataFrame:
    s = T.read(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("chamber"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 5).alias("seats"), F.col("s_nationkey").alias("state"))
    return G.slate_stats(s)


@query("SELECT c_nationkey AS seat, c_custkey % 20 AS name, array_to_string(list_distinct_in_order, ',') AS parties, incumbent FROM (SELECT c_nationkey, c_custkey % 20 AS n, list(p ORDER BY first) AS list_distinct_in_order, bool_or(i) AS incumbent, any_value(c_custkey) AS c_custkey FROM (SELECT c_nationkey, c_custkey % 20 AS n2, c_mktsegment AS p, min(c_custkey) AS first, bool_or(c_custkey % 50 = 0) AS i, any_value(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2, 3) GROUP BY c_nationkey, n2, n)")
def fusion_merge(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "customer").select(F.col("c_nationkey").alias("seat"), (F.col("c_custkey") % 20).alias("name"), F.col("c_mktsegment").alias("party"), F.col("c_custkey").alias("position"), (F.col("c_custkey") % 50 == 0).alias("incumbent"))
    return G.merge_fusion(c)


@query(f"WITH {V}, r AS (SELECT *, row_number() OVER (PARTITION BY member_key ORDER BY vote_date DESC, roll_id) AS rank FROM ballots WHERE choice <> 'absent') SELECT member_key, roll_id, vote_date, choice, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 25")
def per_group_topk_25(spark: SparkSession, d: str) -> DataFrame:
    """The newest 25 positions of each member."""
    from pyspark.sql import Window as W

    w = W.partitionBy("member_key").orderBy(F.desc("vote_date"), "roll_id")
    return T.ballots(spark, d).where("choice <> 'absent'").withColumn("rank", F.row_number().over(w)).where("rank <= 25")


@query(
    """SELECT count(*) AS all_rows, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS either,
(SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS both_of, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS beyond FROM orders WHERE o_orderstatus IN ('F', 'O')"""
)
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select("o_custkey", "o_orderstatus")
    f, n = (o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FO")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = count(f.unionByName(n), "all_rows")
    for df, name in ((f.union(n).distinct(), "either"), (f.intersect(n), "both_of"), (f.exceptAll(n), "beyond")):
        out = out.join(F.broadcast(count(df, name)))
    return out


@query(
    KEYED
    + """, v AS (SELECT race_id, cand_id, issue, count(*) FILTER (yes_means IS NOT NULL) AS n, count(*) FILTER (yes_means IS NOT NULL AND (vote = 'yes') = (yes_means = 'supports')) AS s FROM kv JOIN cw USING (vote_id) WHERE vote IN ('yes', 'no') GROUP BY ALL)
SELECT race_id, cand_id, issue, stance, CASE WHEN stance IN ('supports', 'opposes') THEN coalesce(n, 0) ELSE 0 END AS comparable, CASE stance WHEN 'supports' THEN coalesce(s, 0) WHEN 'opposes' THEN coalesce(n - s, 0) ELSE 0 END AS same
FROM st LEFT JOIN v USING (race_id, cand_id, issue)"""
)
def said_vs_did(spark: SparkSession, d: str) -> DataFrame:
    """What candidates said beside how they voted, by issue."""
    votes = key_votes(spark, d).join(crosswalk(spark, d), "vote_id")
    return G.said_vs_did(statements(spark, d), votes)
