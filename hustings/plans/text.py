"""Queries of the scalar functions, over texts and names of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import driver_tables as T
from . import query

LINE = "coalesce(text, '')"


def whole_text():
    return F.coalesce("text", F.lit(""))


@query(f"SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({LINE})), '[''’`]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'person') AS slug FROM documents")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", X.slugify(whole_text()).alias("slug"))


@query(
    f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(strip_accents({LINE})), '\\([^)]*\\)|"[^"]*"|“[^”]*”', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +'),
  lambda x: x <> '' AND x NOT IN ('jr', 'sr', 'ii', 'iii', 'iv')) AS w FROM documents)
SELECT doc_id, array_to_string(w, ' ') AS name, coalesce(w[-1], '') AS surname FROM w"""
)
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    line = whole_text()
    return T.read(spark, d, "documents").select("doc_id", X.norm_name(line).alias("name"), X.surname(line).alias("surname"))


DISTRICT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\b(state (senate|house|legislative)( sub)?|senatorial|delegate|assembly|house)\\b', ' ', 'g'), '\\b(sub)?district\\b', ' ', 'g'), '\\band\\b', ' ', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'), '[^a-z0-9]+', '', 'g')"
CENSUS = "'State House District ' || p_name || ' and ' || lpad(CAST(p_size AS VARCHAR), 3, '0')"


@query(f"SELECT DISTINCT {CENSUS} AS label, {DISTRICT.format(CENSUS)} AS district FROM part")
def district_normalize(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit("State House District "), F.col("p_name"), F.lit(" and "), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    return T.read(spark, d, "part").select(label.alias("label")).distinct().select("label", X.norm_district(F.col("label")).alias("district"))


@query(
    """SELECT page_id, i - 1 AS position, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label
FROM (SELECT page_id, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?i)<a href="[^"]*">[^<]*</a>') AS l FROM pages))"""
)
def html_table_extract(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of every page as rows."""
    rows = T.read(spark, d, "pages").select("page_id", F.posexplode(X.links(F.col("html"))).alias("position", "a"))
    return rows.select("page_id", F.col("position").cast("long").alias("position"), "a.href", F.col("a.text").alias("label"))


@query(
    r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g') AS s FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')) AS text FROM s"""
)
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query(
    r"""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n\f]+', ' ', 'g')) AS s FROM documents),
c AS (SELECT *, left(s, 600) AS cut, strpos(reverse(left(s, 600)), ' .') AS back FROM s)
SELECT doc_id, CASE WHEN s = '' THEN NULL WHEN length(s) > 600 THEN CASE WHEN back > 0 AND 600 - back - 1 > 200 THEN left(cut, 600 - back) ELSE regexp_replace(cut, ' +[^ ]*$', '') || '…' END ELSE s END AS summary FROM c"""
)
def bill_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", X.bill_summary(F.col("text"), F.lit("")).alias("summary"))


@query("SELECT event_id, CASE WHEN st BETWEEN 200 AND 399 THEN 'ok' WHEN st IN (404, 410) OR er IN ('ENOTFOUND', 'ECONNREFUSED') THEN 'dead' ELSE 'inconclusive' END AS status FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 410 WHEN 4 THEN 503 END AS st, CASE event_id % 7 WHEN 5 THEN 'ENOTFOUND' WHEN 6 THEN 'ETIMEDOUT' END AS er FROM events)")
def link_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    status = F.when(k == 0, 200).when(k == 1, 301).when(k == 2, 404).when(k == 3, 410).when(k == 4, 503)
    error = F.when(k == 5, "ENOTFOUND").when(k == 6, "ETIMEDOUT")
    return T.read(spark, d, "events").select("event_id", X.link_status(status, error).alias("status"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, strftime(o_orderdate, '%b %-d, %Y') AS label FROM orders")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in five ways are read back to the same days."""
    k, day = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "d-MMM-yyyy")).when(k == 1, F.date_format(day, "MMMM d, yyyy")).when(k == 2, F.date_format(day, "MMM d, yyyy")).when(k == 3, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return T.read(spark, d, "orders").select("o_orderkey", X.parse_date(text).alias("parsed"), X.date_label(day).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' WHEN 'R' THEN 'absent' END AS choice FROM lineitem")
def vote_codes(spark: SparkSession, d: str) -> DataFrame:
    """A source's own words for positions, unknown ones failing the query."""
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.vote_code(F.col("l_returnflag"), {"A": "yes", "N": "no", "R": "absent"}, strict=True).alias("choice"))


@query("SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN s_suppkey % 10 = 1 THEN 'st' WHEN s_suppkey % 10 = 2 THEN 'nd' WHEN s_suppkey % 10 = 3 THEN 'rd' ELSE 'th' END || ' ave n' AS street FROM supplier")
def street_tokens(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("s_suppkey").cast("string"), F.lit(" Avenue North."))
    return T.read(spark, d, "supplier").select("s_suppkey", F.array_join(X.street_tokens(text), " ").alias("street"))


@query("SELECT page_id, url, regexp_matches(lower(regexp_extract(url, '^https://([^/:?#]+)', 1)), '(\\.gov|\\.us)$|leg|senate|house|assembly|capitol|congress') AS official FROM pages")
def official_source(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "pages").select("page_id", "url", X.is_official_source(F.col("url")).alias("official"))


@query("SELECT item_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)journal|previous question|adjourn|recess|\\btable\\b|tabled|recommit|\\brefer\\b|referred|call of the (house|senate)|quorum|point of order|reconsider|rules? suspension|suspend the rules|\\bcalendar\\b') THEN 'procedural' ELSE 'substantive' END AS kind FROM benchmark")
def motion_kind(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "benchmark").select("item_id", X.motion_kind(F.col("text")).alias("kind"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'sen-aa-1' WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey AS VARCHAR) END AS member_key FROM nation")
def member_key_for(spark: SparkSession, d: str) -> DataFrame:
    """District keys of three grammars looked up in snapshots of three chambers."""
    k = F.col("n_nationkey") % 3
    key = F.when(k == 0, F.lit("us-sen-aa-1")).when(k == 1, F.concat(F.lit("ny-sd-"), F.col("n_nationkey").cast("string"))).otherwise(F.lit("ny-ad-7"))
    chamber = F.when(k == 0, "U.S. SENATE").when(k == 1, "NY SENATE").otherwise("NYC COUNCIL")
    keys = F.create_map(F.lit("sen-aa-1"), F.lit("sen-aa-1"))
    none = F.lit(None).cast("string")
    return T.read(spark, d, "nation").select("n_nationkey", X.member_key_for(key, chamber, keys, none, none, none).alias("member_key"))


@query(
    """WITH p AS (SELECT a.p_partkey AS k, a.p_name AS title, b.p_name AS caption FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(caption), '[^a-z0-9]+'), lambda x: length(x) > 2) AS cw, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: length(x) > 2) AS tw FROM p)
SELECT k AS p_partkey, CASE WHEN len(cw) < 2 THEN 1.0 ELSE CAST(len(list_filter(cw, lambda c: len(list_filter(tw, lambda t: t = c OR (length(c) > 4 AND starts_with(t, c)))) > 0)) AS DOUBLE) / len(cw) END AS fit FROM w"""
)
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part")
    pairs = p.select(F.col("p_partkey"), F.col("p_name").alias("title")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("caption")), "p_partkey")
    return pairs.select("p_partkey", X.title_fit(F.col("title"), F.col("caption"), ()).alias("fit"))
