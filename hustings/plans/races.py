"""Race files made from orders (a race each), their line items (candidates and sources) and suppliers (people, members and
biographies), with faults wherever the data's remainders put them, and the rules that they break."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import races as R
from ..sources import driver_tables as T
from . import query

#: Letters in place of digits, so that names differ in their words.
DIGITS, LETTERS = "0123456789", "abcdefghij"
_OFFICES = [*R.OFFICES, "mayor"]
_ISSUES = [*R.ISSUES, "parking"]
_STANCES = [*R.STANCES, "unsure"]
_KINDS = [*R.SOURCE_KINDS, "blog"]
_RECORDS = [*R.RECORD_KINDS, "rumor"]


def _named(key):
    return F.translate(key.cast("string"), DIGITS, LETTERS)


def _of(values: list[str], at):
    return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))


def race_files(spark: SparkSession, d: str) -> DataFrame:
    """A nested race for each order; a race has at most seven candidates, as an order has lines."""
    # Lines are dealt by order as keys; candidates are made after it in a projection, as an aggregate makes its arguments without code.
    line = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    p, s, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    cite = F.array(F.concat(F.lit("s"), F.when(p % 9 == 0, F.lit(99)).otherwise(k).cast("string")))
    some = F.when(p % 8 == 0, F.array().cast("array<string>")).otherwise(cite)
    said = F.concat(F.lit("Voted on "), p.cast("string"), F.when(p % 6 == 0, F.lit(", a Radical change")).otherwise(F.lit("")))
    claim = F.struct(F.when(p % 7 == 0, F.lit(" ")).otherwise(said).alias("text"), some.alias("sources"))
    position = F.struct(
        _of(_ISSUES, p).alias("issue"), _of(_STANCES, s).alias("stance"), said.alias("summary"), cite.alias("sources"), F.when(p % 5 == 0, "votes").when(p % 5 == 1, "rumors").alias("basis"),
        F.when(p % 4 == 0, F.struct(_of(_STANCES, p + s).alias("stance"), said.alias("summary"), some.alias("sources"))).alias("stated"),
    )
    candidate = F.struct(
        F.concat(F.lit("c"), (s % 9).cast("string")).alias("id"), F.concat(F.lit("Pat "), _named(s + p % 2), F.when(p % 3 == 0, F.lit(", Jr.")).otherwise(F.lit(""))).alias("name"), F.array(F.lit("D")).alias("parties"),
        F.when(s % 10 > 0, _of([*R.DEPTHS, "deep"], s)).alias("researchDepth"), F.when(p % 13 > 0, p % 2 == 0).alias("incumbent"), F.when(s % 4 > 0, F.concat(F.lit("B"), s.cast("string"))).alias("bioguideId"),
        F.when(p % 11 == 0, "ftp://x").when(p % 11 == 1, "https://x").alias("website"), F.when(p % 17 == 0, "old").alias("summary"), F.lit(None).cast("string").alias("background"),
        F.when(p % 19 > 0, F.array(claim)).alias("priorities"), F.array(F.struct(_of(_ISSUES, s).alias("issue"), F.when(s % 12 > 0, said).alias("quote"), cite.alias("sources"))).alias("statements"),
        F.array(position, position).alias("positions"), F.array(F.struct(_of(_RECORDS, p).alias("kind"), said.alias("text"), cite.alias("sources"))).alias("record"),
    )
    source = F.struct(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.when(s % 14 == 0, "gopher://x").otherwise(F.lit("https://x")).alias("url"), F.when(s % 15 > 0, "A page").alias("title"), F.lit("P").alias("publisher"), _of(_KINDS, p).alias("kind"))
    made = line.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", candidate.alias("candidate"), source.alias("source")).alias("line"))
    lines = made.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    o = F.col("o_orderkey")
    joined = T.read(spark, d, "orders").select("o_orderkey").join(lines, o == F.col("l_orderkey"), "left")
    yes = F.struct(F.lit("Shall it pass?").alias("text"), F.array(F.lit("s1")).alias("sources"))
    bare = F.lit(None).cast(R.CLAIM)
    measure = F.struct(
        yes.alias("question"), F.when(o % 6 == 0, yes).alias("summary"), F.lit("It passes").alias("yesMeans"), F.when(o % 9 > 0, "It fails").alias("noMeans"), F.array(yes, bare).alias("argumentsFor"), F.lit(None).cast(f"array<{R.CLAIM}>").alias("argumentsAgainst"),
        F.when(o % 12 == 0, yes).alias("currentLaw"), bare.alias("fiscalImpact"), bare.alias("campaignFinance"), F.array(yes).alias("supporters"), F.array().cast(f"array<{R.CLAIM}>").alias("opponents"), F.when(o % 2 == 0, "http://x").alias("fullTextUrl"),
    )
    return joined.select(
        F.concat(F.lit("races/r"), (o + (o % 20 == 0).cast("int")).cast("string"), F.lit(".json")).alias("file"), F.concat(F.lit("r"), o.cast("string")).alias("id"), F.when(o % 16 > 0, "NY").alias("state"), _of(_OFFICES, o).alias("officeType"),
        F.lit("Office").alias("office"), F.lit("Title").alias("title"), F.when(o % 18 > 0, "Area").otherwise(F.lit("")).alias("area"), F.lit("2026-11-03").alias("electionDate"), F.when(o % 5 > 0, o % 2 == 0).alias("inNYC"), F.lit("2026-10-01").alias("researchedAt"),
        F.when(o % 22 > 0, F.array(yes)).alias("context"), F.col("lines.source").alias("sources"), F.col("lines.candidate").alias("candidates"), F.when(o % 3 == 0, measure).alias("measure"),
    )


def _case(values: list[str], at: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({at} AS BIGINT) % {len(values)} + 1]"


def _in(values: list[str]) -> str:
    return f"({', '.join(repr(v) for v in values)})"


SAID = "'Voted on ' || p || CASE WHEN p % 6 = 0 THEN ', a Radical change' ELSE '' END"
NAMED = f"translate(CAST({{}} AS VARCHAR), '{DIGITS}', '{LETTERS}')"

SQL = f"""
WITH r AS (SELECT o_orderkey AS o, 'races/r' || (o_orderkey + CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END) || '.json' AS file, {_case(_OFFICES, "o_orderkey")} AS office FROM orders),
n AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1),
l AS (
  SELECT r.o, file, l_partkey AS p, l_suppkey AS s, l_linenumber AS k, row_number() OVER (PARTITION BY r.o ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, 'candidate c' || (l_suppkey % 9) AS c,
         CASE WHEN l_partkey % 9 = 0 THEN 's99' ELSE 's' || l_linenumber END AS cite
  FROM lineitem JOIN r ON l_orderkey = r.o),
x AS (SELECT *, {SAID} AS said, {_case(_ISSUES, "p")} AS issue, {_case(_ISSUES, "s")} AS s_issue, {_case(_STANCES, "s")} AS stance, {_case(_STANCES, "p + s")} AS stated, {_case(_KINDS, "p")} AS kind, {_case(_RECORDS, "p")} AS record,
  CASE WHEN s % 10 > 0 THEN {_case([*R.DEPTHS, "deep"], "s")} END AS depth FROM l),
claims AS (
  SELECT o, file, c || '.priorities[0]' AS place, CASE WHEN p % 7 = 0 THEN ' ' ELSE said END AS text, CASE WHEN p % 8 > 0 THEN cite END AS cite FROM x WHERE p % 19 > 0
  UNION ALL SELECT o, file, c || '.statements[0]', CASE WHEN s % 12 > 0 THEN said END, cite FROM x
  UNION ALL SELECT o, file, c || '.positions[' || j || ']', said, cite FROM x CROSS JOIN (SELECT unnest([0, 1]) AS j)
  UNION ALL SELECT o, file, c || '.positions[' || j || '].stated', said, CASE WHEN p % 8 > 0 THEN cite END FROM x CROSS JOIN (SELECT unnest([0, 1]) AS j) WHERE p % 4 = 0
  UNION ALL SELECT o, file, c || '.record[0]', said, cite FROM x
  UNION ALL SELECT o, file, 'context[0]', 'Shall it pass?', 's1' FROM r WHERE o % 22 > 0
  UNION ALL SELECT o, file, unnest(['measure.question', 'measure.argumentsFor[0]', 'measure.supporters[0]']), 'Shall it pass?', 's1' FROM r WHERE o % 3 = 0
  UNION ALL SELECT o, file, 'measure.argumentsFor[1]', NULL, NULL FROM r WHERE o % 3 = 0
  UNION ALL SELECT o, file, 'measure.summary', CASE WHEN o % 6 = 0 THEN 'Shall it pass?' END, 's1' FROM r WHERE o % 3 = 0
  UNION ALL SELECT o, file, 'measure.currentLaw', 'Shall it pass?', 's1' FROM r WHERE o % 12 = 0),
ids AS (SELECT DISTINCT o, 's' || k AS id FROM x),
errors AS (
  SELECT file, 'race' AS place, unnest(list_filter([
    CASE WHEN o % 16 = 0 THEN 'missing state' END, CASE WHEN o % 18 = 0 THEN 'missing area' END, CASE WHEN n IS NULL THEN 'missing candidates' END, CASE WHEN n IS NULL THEN 'missing sources' END, CASE WHEN o % 22 = 0 THEN 'missing context' END,
    CASE WHEN o % 5 = 0 THEN 'inNYC must be boolean' END, CASE WHEN o % 20 = 0 THEN 'id does not match the file''s name' END, CASE WHEN office NOT IN {_in(R.OFFICES)} THEN 'bad officeType ' || office END], lambda z: z IS NOT NULL)) AS rule
  FROM r LEFT JOIN n USING (o)
  UNION ALL SELECT file, 'source s' || k, unnest(list_filter([CASE WHEN s % 15 = 0 THEN 'missing title' END, CASE WHEN s % 14 = 0 THEN 'bad url' END, CASE WHEN kind NOT IN {_in(R.SOURCE_KINDS)} THEN 'bad kind ' || kind END], lambda z: z IS NOT NULL)) FROM x
  UNION ALL SELECT file, 'source s' || k, 'duplicate id' FROM (SELECT *, row_number() OVER (PARTITION BY o, k ORDER BY i) AS nth FROM x) WHERE nth > 1
  UNION ALL SELECT file, c, 'duplicate id' FROM (SELECT *, row_number() OVER (PARTITION BY o, c ORDER BY i) AS nth FROM x) WHERE nth > 1
  UNION ALL SELECT file, c, unnest(list_filter([CASE WHEN depth IS NULL THEN 'missing researchDepth' END, CASE WHEN p % 17 = 0 THEN 'summary and background belong to the biography' END, CASE WHEN p % 13 = 0 THEN 'incumbent must be boolean' END,
    CASE WHEN coalesce(depth, '') NOT IN {_in(R.DEPTHS)} THEN 'bad researchDepth' END, CASE WHEN p % 19 = 0 THEN 'priorities must be an array' END, CASE WHEN p % 11 = 0 THEN 'bad website' END], lambda z: z IS NOT NULL)) FROM x
  UNION ALL SELECT file, c || '.statements[0]', unnest(list_filter([CASE WHEN s_issue NOT IN {_in(R.ISSUES)} THEN 'bad issue ' || s_issue END, CASE WHEN s % 12 = 0 THEN 'quote required' END], lambda z: z IS NOT NULL)) FROM x
  UNION ALL SELECT file, c || '.positions[' || j || ']', unnest(list_filter([CASE WHEN issue NOT IN {_in(R.ISSUES)} THEN 'bad issue ' || issue END, CASE WHEN stance NOT IN {_in(R.STANCES)} THEN 'bad stance' END, CASE WHEN p % 5 = 1 THEN 'bad basis' END], lambda z: z IS NOT NULL))
    FROM x CROSS JOIN (SELECT unnest([0, 1]) AS j)
  UNION ALL SELECT file, c || '.positions[' || j || '].stated', 'bad stance' FROM x CROSS JOIN (SELECT unnest([0, 1]) AS j) WHERE p % 4 = 0 AND stated NOT IN {_in(R.STANCES)}
  UNION ALL SELECT file, c || '.record[0]', 'bad kind ' || record FROM x WHERE record NOT IN {_in(R.RECORD_KINDS)}
  UNION ALL SELECT file, 'measure', 'missing noMeans' FROM r WHERE o % 3 = 0 AND o % 9 = 0
  UNION ALL SELECT file, 'measure', 'fullTextUrl must be https' FROM r WHERE o % 3 = 0 AND o % 2 = 0
  UNION ALL SELECT file, place, 'missing text' FROM claims WHERE trim(coalesce(text, '')) = ''
  UNION ALL SELECT file, place, 'no sources' FROM claims WHERE trim(coalesce(text, '')) <> '' AND cite IS NULL
  UNION ALL SELECT file, place, 'unknown source ' || cite FROM claims WHERE trim(coalesce(text, '')) <> '' AND cite IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.o = claims.o AND ids.id = claims.cite)
  UNION ALL SELECT file, c, 'not among the people' FROM x WHERE (o + s % 9) % 7 = 0
  UNION ALL SELECT file, c, 'no biography slug-' || s % 9 FROM x WHERE (o + s % 9) % 7 > 0 AND s % 9 NOT IN (SELECT s_suppkey % 9 FROM supplier WHERE s_suppkey % 9 NOT IN (2, 5))
  UNION ALL SELECT file, c, 'bioguideId belongs to Ann ' || {NAMED.format("s")} FROM x
    WHERE s % 4 > 0 AND s IN (SELECT s_suppkey FROM supplier) AND {NAMED.format("s")} <> {NAMED.format("s + p % 2")} AND NOT contains(lower('Pat ' || {NAMED.format("s + p % 2")} || CASE WHEN p % 3 = 0 THEN ', Jr.' ELSE '' END), {NAMED.format("s")})),
warnings AS (
  SELECT file, place, 'loaded language' AS rule FROM claims WHERE regexp_matches(coalesce(text, ''), 'Radical')
  UNION ALL SELECT file, c, 'issue ' || issue || ' listed twice' FROM x
  UNION ALL SELECT r.file, 'source ' || ids.id, 'never cited' FROM ids JOIN r USING (o) WHERE NOT EXISTS (SELECT 1 FROM claims q WHERE q.o = ids.o AND q.cite = ids.id AND trim(coalesce(q.text, '')) <> ''))
SELECT file, 'error' AS severity, place, rule FROM errors UNION ALL SELECT file, 'warning', place, rule FROM warnings
"""


@query(SQL)
def race_violations(spark: SparkSession, d: str) -> DataFrame:
    """All broken rules of a race for each order."""
    races = race_files(spark, d)
    lines = T.read(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 9).alias("c")).distinct().where((F.col("l_orderkey") + F.col("c")) % 7 > 0)
    people = lines.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("race_id"), F.concat(F.lit("c"), F.col("c").cast("string")).alias("candidate_id"), F.concat(F.lit("slug-"), F.col("c").cast("string")).alias("slug"))
    key = F.col("s_suppkey")
    supplier = T.read(spark, d, "supplier").select("s_suppkey")
    biographies = supplier.select((key % 9).alias("c")).distinct().where("c not in (2, 5)").select(F.concat(F.lit("slug-"), F.col("c").cast("string")).alias("slug"))
    members = supplier.select(F.concat(F.lit("B"), key.cast("string")).alias("bioguide_id"), F.concat(F.lit("Ann "), _named(key)).alias("member_name"))
    return R.race_violations(races, people, biographies, members)
