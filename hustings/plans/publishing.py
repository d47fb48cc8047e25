"""Snapshots made from orders (a roll call each) and their line items (positions), with faults by the keys' remainders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import driver_tables as T
from ..sources import snapshots
from . import query


def roll_files(spark: SparkSession, d: str) -> DataFrame:
    """Rolls of five files; an order's status is its file's chamber, every 40th shares the id of the order before."""
    o = F.col("o_orderkey")
    votes = T.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "no").otherwise("absent")).alias("votes"))
    rows = T.read(spark, d, "orders").join(votes, o == F.col("l_orderkey"), "left")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return rows.select(
        F.concat(F.lit("f"), (F.floor(o / 40) % 5).cast("string")).alias("file"), F.lit("CHAMBER").alias("chamber"), F.when(o % 301 > 0, "Clerk").alias("source_label"), F.when(o % 211 > 0, "1998-06-01T00:00:00Z").otherwise(F.lit("soon")).alias("generated_at"),
        F.when(o % 2 == 0, "openstates").alias("key_by"), F.when(o % 97 > 0, (o - (o % 40 == 1).cast("int")).cast("string")).alias("roll_id"), F.when(o % 53 == 0, F.concat(F.substring(day, 1, 7), F.lit("-31"))).when(o % 59 == 0, F.lit("June 1")).otherwise(day).alias("roll_date"),
        F.when(o % 61 > 0, "Title").otherwise(F.lit("")).alias("title"), F.lit("HB 1").alias("bill"), F.when(o % 67 > 0, "Passed").alias("outcome"), F.when(o % 3 == 0, "procedural").when(o % 3 == 1, "substantive").otherwise(F.when(o % 37 > 0, "substantive").otherwise(F.lit("other"))).alias("kind"),
        F.when(o % 41 == 0, "https://house.gov.example.com/1").when(o % 43 == 0, "http://www.house.gov/1").when(o % 2 == 0, "https://www.legis.example.org/1").when(o % 47 == 0, "https://www.legis.example.org/1").otherwise(F.lit("https://clerk.house.gov/1")).alias("source_url"),
        F.when(o % 29 == 0, F.array_append("votes", F.lit("maybe"))).when(o % 31 > 0, F.col("votes")).alias("votes"), F.when(o % 4 == 0, "It does this.").alias("summary"), F.when(o % 8 == 0, "ai").when(o % 12 == 0, "hearsay").alias("summary_source"),
    )


SQL = """
WITH v AS (SELECT DISTINCT l_orderkey AS o FROM lineitem),
r AS (
  SELECT o_orderkey AS o, 'f' || CAST(o_orderkey // 40 % 5 AS VARCHAR) AS file, CASE WHEN o_orderkey % 97 > 0 THEN CAST(o_orderkey - CASE WHEN o_orderkey % 40 = 1 THEN 1 ELSE 0 END AS VARCHAR) END AS roll_id,
         CASE WHEN o_orderkey % 211 > 0 THEN '1998-06-01' ELSE 'soon' END AS today, v.o IS NOT NULL AS voted,
         CASE WHEN o_orderkey % 53 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m') || '-31' WHEN o_orderkey % 59 = 0 THEN 'June 1' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day
  FROM orders LEFT JOIN v ON v.o = o_orderkey)
SELECT file, roll_id, unnest(list_filter([
  CASE WHEN o % 301 = 0 OR o % 211 = 0 THEN 'snapshot metadata' END, CASE WHEN roll_id IS NULL THEN 'roll-call id' END, CASE WHEN TRY_CAST(day AS DATE) IS NULL THEN 'real date' END, CASE WHEN day > today THEN 'date not in the future' END,
  CASE WHEN o % 61 = 0 OR o % 67 = 0 THEN 'title, bill and outcome' END, CASE WHEN o % 3 = 2 AND o % 37 = 0 THEN 'kind' END,
  CASE WHEN (o % 41 = 0 AND o % 2 = 1) OR (o % 41 > 0 AND o % 43 = 0) OR (o % 41 > 0 AND o % 43 > 0 AND o % 2 = 1 AND o % 47 = 0) THEN 'official source' END,
  CASE WHEN NOT voted OR o % 29 = 0 OR o % 31 = 0 THEN 'legal positions' END, CASE WHEN o % 4 = 0 AND o % 8 > 0 THEN 'summary provenance' END], lambda z: z IS NOT NULL)) AS rule FROM r
UNION ALL SELECT file, roll_id, 'unique id' FROM r WHERE roll_id IS NOT NULL GROUP BY file, roll_id HAVING count(*) > 1
"""


@query(SQL)
def snapshot_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that a roll call of the files breaks; a snapshot with any can't be published."""
    return snapshots.snapshot_violations(roll_files(spark, d))
