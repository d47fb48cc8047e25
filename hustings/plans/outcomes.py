"""Outcomes by state, the queue of sources, numbered citations and addresses of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import outcomes, serving
from ..sources import driver_tables as T
from ..streaming import incremental
from . import query

STATES = [*outcomes.SEATS, "tx"]
QUESTIONS = ["Final Passage", "THIRD READING - FINAL PASSAGE", "Third Reading: Bill", "Third Reading: Concurrent Resolution", "Suspend the Rules", "Consider override of veto", "Final Action", "Adopt as amended", "Effective from passage", "Constitutional rule dispensed with", "OTPA", "Passed notwithstanding the objections", "Agree to Senate amendment"]
BILLS = ["HB 1", "SB 2", "HCR 3", "CACR 4", "SCR 5"]


def _of(values: list[str], at):
    return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))


def _rules() -> str:
    return ", ".join(f"({i}, '{r.state}', {r.num}, {r.den}, '{r.of}', '{r.question}', '{r.bill}', '{r.unless}', '{r.chamber}', {r.beats})" for i, r in enumerate(outcomes.THRESHOLDS))


SQL = f"""
WITH seats(state, lo, up) AS (VALUES {", ".join(f"('{s}', {a}, {b})" for s, (a, b) in outcomes.SEATS.items())}),
rules(i, state, num, den, of_, q, b, u, c, beats) AS (VALUES {_rules()}),
r AS (SELECT o_orderkey AS roll_id, {STATES}[o_orderkey % {len(STATES)} + 1] AS state, CASE WHEN o_orderkey % 7 = 0 THEN 'joint' WHEN o_orderkey // 10 % 2 = 0 THEN 'lower' ELSE 'upper' END AS chamber, {BILLS}[o_custkey % {len(BILLS)} + 1] AS bill,
  {QUESTIONS}[o_orderkey // 20 % {len(QUESTIONS)} + 1] AS question, CASE WHEN o_orderkey % 11 = 0 THEN 'Passed' END AS official, o_custkey % 130 AS yes, o_custkey * 7 % 60 AS no FROM orders),
m AS (SELECT r.*, lo, up, num, den, of_, beats, row_number() OVER (PARTITION BY roll_id ORDER BY i) AS o FROM r LEFT JOIN rules ON rules.state = r.state AND regexp_matches(question, q) AND regexp_matches(bill, b) AND (u = '' OR NOT regexp_matches(question, u)) AND (c = '' OR c = chamber) AND (of_ = 'voting' OR chamber <> 'joint') LEFT JOIN seats ON seats.state = r.state),
n AS (SELECT *, CASE WHEN of_ = 'voting' THEN yes + no WHEN chamber = 'lower' THEN lo ELSE up END AS base FROM m WHERE o = 1),
k AS (SELECT *, CASE WHEN num IS NULL THEN no + 1 WHEN beats THEN greatest(part, no + 1) ELSE part END AS needed FROM (SELECT *, CASE WHEN den = 2 THEN base // 2 + 1 ELSE (base * num + den - 1) // den END AS part FROM n))
SELECT roll_id, state, chamber, yes, no, CAST(needed AS BIGINT) AS needed, coalesce(official, CASE WHEN yes >= needed THEN 'Passed' ELSE 'Failed' END) AS outcome FROM k
"""


@query(SQL)
def state_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A roll for each order: its state's rule decides where no result is stated."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    chamber = F.when(o % 7 == 0, "joint").when(F.floor(o / 10) % 2 == 0, "lower").otherwise(F.lit("upper"))
    rolls = T.read(spark, d, "orders").select(
        o.alias("roll_id"), _of(STATES, o).alias("state"), chamber.alias("chamber"), _of(BILLS, c).alias("bill"), _of(QUESTIONS, F.floor(o / 20)).alias("question"), F.when(o % 11 == 0, "Passed").alias("official"), (c % 130).alias("yes"), (c * 7 % 60).alias("no"),
    )
    return outcomes.outcomes(rolls).select("roll_id", "state", "chamber", "yes", "no", "needed", "outcome")


@query(
    """WITH s AS (SELECT c_custkey AS source, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS last_run, c_custkey % 6 AS pages FROM customer WHERE NOT (c_custkey % 3 <> 0 AND c_acctbal >= 9000)),
q AS (SELECT *, row_number() OVER w AS place, coalesce(sum(least(greatest(pages, 1), 4)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM s WINDOW w AS (ORDER BY last_run NULLS FIRST, source))
SELECT source, CAST(place AS INTEGER) AS place, CAST(spent AS BIGINT) AS spent FROM q WHERE spent + 4 <= 300"""
)
def resumed_queue(spark: SparkSession, d: str) -> DataFrame:
    """Sources that three hundred requests reach, up to four each, without those done since the run began (a top-k)."""
    k = F.col("c_custkey")
    sources = T.read(spark, d, "customer").select(k.alias("source"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("last_run"), (k % 6).alias("pages"))
    return incremental.work_queue(sources, 300, 4, 9000).select("source", "place", "spent")


@query(
    """WITH s AS (SELECT l_orderkey, list('s' || l_suppkey % 20 ORDER BY l_linenumber, l_suppkey, l_partkey) AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey AS race, list_filter(list_transform(['s' || l_orderkey % 20, ids[1], 's99'], lambda c: coalesce(list_position(ids, c), 0)), lambda n: n > 0) AS cites FROM s"""
)
def numbered_citations(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of three citations among the sources of each race."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))), lambda x: F.concat(F.lit("s"), (x["l_suppkey"] % 20).cast("string")))
    races = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("race")).agg(ids.alias("ids"))
    cited = F.array(F.concat(F.lit("s"), (F.col("race") % 20).cast("string")), F.col("ids")[0], F.lit("s99"))
    return races.select("race", X.cite_numbers(cited, F.col("ids")).alias("cites"))


@query(
    """SELECT 'roll' AS kind, CAST(o_orderkey AS VARCHAR) AS key, '/vote/f' || o_custkey % 7 || '/a%20b%2F' || o_orderkey || '%3A(x)!%C3%A9' AS href FROM orders
UNION ALL SELECT 'person', c_custkey::VARCHAR, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN '/people/p-' || c_custkey ELSE '/official/' || c_custkey END FROM customer"""
)
def record_links(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of every roll call and of every official's page."""
    o = F.col("o_orderkey").cast("string")
    href = X.roll_call_href(F.concat(F.lit("f"), (F.col("o_custkey") % 7).cast("string")), F.concat(F.lit("a b/"), o, F.lit(":(x)!é")))
    rolls = T.read(spark, d, "orders").select(F.lit("roll").alias("kind"), o.alias("key"), href.alias("href"))
    people = T.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("official_id"), F.concat(F.lit("p-"), F.col("s_suppkey").cast("string")).alias("slug"))
    officials = serving.person_hrefs(T.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("official_id")), people)
    return rolls.unionByName(officials.select(F.lit("person").alias("kind"), F.col("official_id").alias("key"), "href"))
