"""A civic view of generic star-schema tables: roll calls are parts, members are suppliers, positions are line items.

The operators take any tables with these columns; this view lets them run on TPC-H-like data of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roll_id, member_key, choice (yes / no / absent), vote_date: one row for each roll and member.

    A member's first line item decides, by day, order, line and flag. These are packed into one long (16, 42, 3 and 2
    bits), whose minimum is aggregated by hashing; a minimum of structs would sort every partition. Ship dates are whole
    days, and no two items share member, roll, day, order and line.
    """
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    packed = F.shiftleft(F.unix_date(F.to_date("l_shipdate")).cast("long"), 47) + F.shiftleft(F.col("l_orderkey").cast("long"), 5) + F.col("l_linenumber") * 4 + flag
    first = line.groupBy(F.col("l_partkey").alias("roll_id"), F.col("l_suppkey").alias("member_key")).agg(F.min(packed).alias("f"))
    choice = F.col("f").bitwiseAND(3)
    return first.select("roll_id", "member_key", F.when(choice == 0, "yes").when(choice == 1, "no").otherwise("absent").alias("choice"), F.date_from_unix_date(F.shiftright("f", 47).cast("int")).alias("vote_date"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member_key, name, party, state, chamber."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    party = F.when(F.col("n_regionkey") <= 1, "D").when(F.col("n_regionkey") <= 3, "R").otherwise("I")
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("member_key"), F.col("s_name").alias("name"), party.alias("party"), F.col("n_name").alias("state"), F.col("r_name").alias("chamber"))


def rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roll_id, bill, title, question, kind, chamber, roll_date."""
    last = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("roll_id")).agg(F.to_date(F.max("l_shipdate")).alias("roll_date"))
    p = read(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "procedural").otherwise("substantive")
    chamber = F.concat(F.lit("CHAMBER "), (F.col("p_size") % 5).cast("string"))
    named = p.select(F.col("p_partkey").alias("roll_id"), F.col("p_brand").alias("bill"), F.col("p_name").alias("title"), F.col("p_type").alias("question"), kind.alias("kind"), chamber.alias("chamber"))
    return named.join(last, "roll_id")


#: The same view as the start of a DuckDB query.
VIEWS = """
ballots AS (
  SELECT l_partkey AS roll_id, l_suppkey AS member_key, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'absent' END AS choice, CAST(l_shipdate AS DATE) AS vote_date
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_returnflag) AS rn FROM lineitem) WHERE rn = 1),
members AS (
  SELECT s_suppkey AS member_key, s_name AS name, CASE WHEN n_regionkey <= 1 THEN 'D' WHEN n_regionkey <= 3 THEN 'R' ELSE 'I' END AS party, n_name AS state, r_name AS chamber
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rolls AS (
  SELECT p_partkey AS roll_id, p_brand AS bill, p_name AS title, p_type AS question, CASE WHEN p_size % 2 = 0 THEN 'procedural' ELSE 'substantive' END AS kind,
         'CHAMBER ' || CAST(p_size % 5 AS VARCHAR) AS chamber, roll_date
  FROM part JOIN (SELECT l_partkey, CAST(max(l_shipdate) AS DATE) AS roll_date FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""
