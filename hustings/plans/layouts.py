"""Official files as their sources lay them out, made from the tables: tables on every page, votes as XML, rosters and floor
votes as pages, members' votes as delimited files. A file holds one roll call, or the rolls and members of one page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import driver_tables as T
from ..sources import markup
from . import query

V = T.VIEWS


def _t(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query(
    """WITH u AS (SELECT page_id, unnest(string_split(html, '<ul>')[2:]) AS part, unnest(range(len(string_split(html, '<ul>')) - 1)) AS t FROM pages),
l AS (SELECT page_id, t, string_split(split_part(part, '</ul>', 1), '<li>')[2:] AS items FROM u),
r AS (SELECT page_id, t, unnest(items) AS item, unnest(range(len(items))) AS r FROM l),
c AS (SELECT page_id, t, r, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(item, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS text FROM r)
SELECT page_id, CAST(t AS INTEGER) AS "table", CAST(r AS INTEGER) AS "row", CASE WHEN r % 2 = 1 THEN 1 ELSE 0 END AS col, 2 AS rowspan, 1 AS colspan, true AS header, 'item' AS text FROM c
UNION ALL SELECT page_id, t, r, CASE WHEN r = 0 THEN 1 ELSE 2 END, 1, 3, false, text FROM c"""
)
def page_table_cells(spark: SparkSession, d: str) -> DataFrame:
    """The lists of every page as tables whose first cells reach into the next row."""
    html = F.col("html")
    for old, new in (("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", '<tr><th rowspan="2">item<td colspan=3>'), ("</li>", "")):
        html = F.replace(html, F.lit(old), F.lit(new))
    pages = T.read(spark, d, "pages").select("page_id", html.alias("html"))
    return markup.table_cells(pages, "page_id", "html").drop("parent")


WORDS = "CASE choice WHEN 'yes' THEN 'Yea' WHEN 'no' THEN 'Nay' ELSE 'Not Voting' END"


def _raw():
    return F.when(F.col("choice") == "yes", "Yea").when(F.col("choice") == "no", "Nay").otherwise(F.lit("Not Voting"))


def _files(spark: SparkSession, d: str, line, head, tail) -> DataFrame:
    """roll_id and body: a file for each roll, a line for each of its positions."""
    lines = T.ballots(spark, d).groupBy("roll_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_key", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return lines.select("roll_id", _t(head, F.col("lines"), tail).alias("body"))


@query(f"WITH {V} SELECT roll_id, 'H R ' || roll_id AS bill, roll_id % 400 AS printed_yes, 'L' || lpad(CAST(member_key AS VARCHAR), 6, '0') AS name, {WORDS} AS raw FROM ballots WHERE roll_id % 9 > 0")
def house_files(spark: SparkSession, d: str) -> DataFrame:
    """The clerk's XML; every ninth roll is an election. Parties' totals come before the whole vote's."""
    k = F.col("roll_id")
    n = F.lpad(F.col("member_key").cast("string"), 6, "0")
    line = _t('<recorded-vote><legislator name-id="L', n, '" party="R" state="NY" role="legislator">A &amp; B</legislator><vote>', _raw(), "</vote></recorded-vote>")
    kind = F.when(k % 9 > 0, "YEA-AND-NAY").otherwise(F.lit("Election"))
    head = _t(
        "<rollcall-vote><vote-metadata><congress>119</congress><rollcall-num>", k.cast("string"), "</rollcall-num><legis-num>H R ", k.cast("string"), "</legis-num><vote-question>On Passage</vote-question><vote-type>", kind,
        "</vote-type><vote-result>Passed</vote-result><action-date>24-Jun-2026</action-date><vote-desc>To amend &lt;all&gt;</vote-desc><vote-totals><totals-by-party><party>R</party><yea-total>7</yea-total><nay-total>7</nay-total></totals-by-party><totals-by-vote><yea-total>",
        (k % 400).cast("string"), "</yea-total><nay-total>0</nay-total></totals-by-vote></vote-totals></vote-metadata><vote-data>",
    )
    return markup.us_house_lines(_files(spark, d, line, head, "</vote-data></rollcall-vote>")).select("roll_id", "name", "raw", "bill", "printed_yes")


@query(f"WITH {V} SELECT roll_id, 'S. ' || roll_id AS bill, DATE '2026-06-01' + CAST(roll_id % 28 AS INTEGER) AS roll_date, roll_id % 100 AS printed_yes, 'S' || member_key AS name, {WORDS} AS raw FROM ballots WHERE roll_id % 7 > 0")
def senate_files(spark: SparkSession, d: str) -> DataFrame:
    """A vote's XML; every seventh has no readable date."""
    k = F.col("roll_id")
    line = _t("<member><member_full>A (R-NY)</member_full><vote_cast>", _raw(), "</vote_cast><lis_member_id>S", F.col("member_key").cast("string"), "</lis_member_id></member>")
    day = F.when(k % 7 > 0, _t("June ", (k % 28 + 1).cast("string"), ", 2026, 05:31 PM")).otherwise(F.lit("24-Jun"))
    head = _t("<roll_call_vote><vote_number>", k.cast("string"), "</vote_number><vote_date>", day, "</vote_date><vote_question_text>On the Bill</vote_question_text><document><document_name>S. ", k.cast("string"), "</document_name></document><vote_result>Passed</vote_result><count><yeas>", (k % 100).cast("string"), "</yeas><nays>0</nays></count><members>")
    return markup.us_senate_lines(_files(spark, d, line, head, "</members></roll_call_vote>")).select("roll_id", "name", "raw", "bill", "roll_date", "printed_yes")


@query(
    """SELECT s_nationkey AS page_id, 'ny-senate' AS source, CAST(s_suppkey AS VARCHAR) AS district, 'Ann & ' || s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'D' ELSE 'R' END AS party, '/senators/s' || s_suppkey AS path FROM supplier
UNION ALL SELECT s_nationkey, 'ny-assembly', CAST(s_suppkey AS VARCHAR), s_name, NULL, '/mem/M' || s_suppkey FROM supplier"""
)
def roster_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page of each chamber for each nation's suppliers."""
    k = F.col("s_suppkey")
    ordinal = F.when((k % 100).between(11, 13), "th").when(k % 10 == 1, "st").when(k % 10 == 2, "nd").when(k % 10 == 3, "rd").otherwise(F.lit("th"))
    senate = _t('<a class="card" href="/senators/s', k.cast("string"), '"><div><img src="x"><h2 class="nys-senator--name">Ann &amp; ', F.col("s_name"), '</h2><span class="nys-senator--party">\n (', F.when(k % 2 == 0, "D, WF").otherwise(F.lit("R")), ") </span> ", k.cast("string"), ordinal, " District</div></a>")
    house = _t('<div class="mem-item"><h3 class="mem-name"><a title="x" href="/mem/M', k.cast("string"), '">', F.col("s_name"), " <span>District ", k.cast("string"), "</span></a></h3></div>")
    pages = T.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_join(F.collect_list(senate), "\n").alias("a"), F.array_join(F.collect_list(house), "\n").alias("b"))
    each = lambda c, source: markup.ny_roster(pages.select("page_id", F.col(c).alias("body")), source).withColumn("source", F.lit(source))
    return each("a", "ny-senate").unionByName(each("b", "ny-assembly"))


@query(
    f"""WITH {V}, b AS (SELECT *, roll_id // 5 AS page_id FROM ballots), n AS (SELECT page_id, roll_id, row_number() OVER (PARTITION BY page_id ORDER BY roll_id) - 1 AS roll FROM (SELECT DISTINCT page_id, roll_id FROM b))
SELECT page_id, CAST(roll AS INTEGER) AS roll, DATE '2026-03-01' + CAST(roll_id % 28 AS INTEGER) AS roll_date, roll_id % 150 AS printed_yes, 0 AS printed_no, roll_id % 2 = 0 AS assembly, 'M. O''Neil-' || member_key AS name,
  CASE choice WHEN 'yes' THEN 'Y' WHEN 'no' THEN 'NO' ELSE 'ER' END AS raw FROM b JOIN n USING (page_id, roll_id)"""
)
def floor_vote_pages(spark: SparkSession, d: str) -> DataFrame:
    """A bill's page for every five rolls: captions with date and tally, then marks and names."""
    k = F.col("roll_id")
    mark = F.when(F.col("choice") == "yes", "Y").when(F.col("choice") == "no", "NO").otherwise(F.lit("ER"))
    line = _t("<div class='vote-name'><div class='vote'>", mark, "</div><div class='name'>M. O&#39;Neil-", F.col("member_key").cast("string"), "</div></div>")
    head = _t("<table><caption><span>", F.when(k % 2 == 0, "Assembly  Vote").otherwise(F.lit("Senate Vote")), " DATE:</span><span>03/", F.lpad((k % 28 + 1).cast("string"), 2, "0"), "/2026</span> YEA/NAY: ", (k % 150).cast("string"), "/0</caption></table>")
    files = _files(spark, d, line, head, "").groupBy(F.floor(k / 5).alias("page_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("roll_id", "body"))), lambda x: x["body"]).alias("b"))
    pages = files.select("page_id", _t("<h3>Text:</h3><div class='vote'>X</div><h3>Floor&nbspVotes:</h3>", F.array_join("b", "\n"), "<h3>Memo:</h3><div class='vote'>Y</div><div class='name'>Nobody</div>").alias("body"))
    return markup.floor_votes(pages)


@query(f"WITH {V} SELECT roll_id, row_number() OVER (PARTITION BY roll_id ORDER BY member_key) AS line, 'Berg, \"A\"' || chr(10) || member_key AS name, choice AS vote FROM ballots WHERE member_key % 11 > 0")
def csv_vote_lines(spark: SparkSession, d: str) -> DataFrame:
    """Members' votes as delimited files with quotes and newlines in names; lines that are too short go."""
    k = F.col("member_key")
    line = F.when(k % 11 > 0, _t('x,"Berg, ""A""\n', k.cast("string"), '",', F.col("choice"))).otherwise(F.lit("x,short"))
    files = _files(spark, d, line, F.lit("﻿id,name,vote\n"), "\n")
    kept = markup.csv_lines(files, ["name", "vote"], "roll_id")
    return kept.withColumn("line", F.row_number().over(W.partitionBy("roll_id").orderBy("line")).cast("long"))
