"""Queries of operators that pages, feeds and audits use: identity repairs, precedence, seats, orders, lints, delimited
lines, merges that keep provenance, and whole responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guide as G
from ..operators import identity as I
from ..operators import impute
from ..operators import ranking
from ..operators import serving as V
from ..sources import content, snapshots
from ..sources import driver_tables as T
from ..streaming import incremental
from . import query

VIEWS = T.VIEWS


def _text(prefix: str, k: Column) -> Column:
    return F.concat(F.lit(prefix), k.cast("string"))


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


@query("SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name || ', ' || p_type END AS label, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part")
def csv_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Lines with quoted commas; short ones are padded with empty texts."""
    p = T.read(spark, d, "part")
    whole = F.concat(F.col("p_brand"), F.lit(',"'), "p_name", F.lit(", "), "p_type", F.lit('",'), F.col("p_size").cast("string"))
    lines = p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(whole).alias("line"))
    return snapshots.delimited(lines, "line", ["brand", "label", "size"])


@query("SELECT p_partkey, p_brand AS brand, p_name || ', ' || p_type AS label, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_size % 3 <> 0")
def csv_strict(spark: SparkSession, d: str) -> DataFrame:
    """The same lines; those of another width than the header go."""
    p = T.read(spark, d, "part")
    whole = F.concat(F.col("p_brand"), F.lit(',"'), "p_name", F.lit(", "), "p_type", F.lit('",'), F.col("p_size").cast("string"))
    lines = p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(whole).alias("line"))
    return snapshots.delimited(lines, "line", ["brand", "label", "size"], strict=True)


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority, o_clerk AS clerk FROM (SELECT *, 'Clerk' || chr(9) || o_custkey AS o_clerk FROM orders)")
def dat_lines(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated lines in backticks, with NULL for null."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    o = T.read(spark, d, "orders")
    priority = F.when(F.col("o_orderkey") % 4 == 0, F.lit("NULL")).otherwise(tick(F.col("o_orderpriority")))
    lines = o.select("o_orderkey", F.concat_ws("\t", tick(F.col("o_orderstatus")), priority, tick(_text("Clerk\t", F.col("o_custkey")))).alias("line"))
    return snapshots.delimited(lines, "line", ["status", "priority", "clerk"], pad=None, sep="\t", quote="`", nullValue="NULL")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS committee, o_orderpriority AS kind, CAST(o_orderkey AS VARCHAR) AS amount FROM orders")
def pipe_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pipe-delimited lines without a header; quotes mean nothing."""
    o = T.read(spark, d, "orders")
    lines = o.select("o_orderkey", F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority", F.col("o_orderkey").cast("string")).alias("line"))
    return snapshots.delimited(lines, "line", ["committee", "kind", "amount"], sep="|", quote="")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) > TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 30 DAY AND CAST(o_orderdate AS TIMESTAMP) <= TIMESTAMP '1998-01-01 00:00:00'")
def fresh_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cached rows that are not yet too old at a stated moment."""
    o = T.read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("loaded_at"))
    return incremental.fresh(o, "1998-01-01 00:00:00", 30 * 24 * 3600).select("o_orderkey")


SURNAMES = ["Longsurnamefieldsmith", "Longsurnamefieldstone", "Adams", "Baker", "Clark", "Davis"]


@query(
    f"""WITH r AS (SELECT s_suppkey AS member_key, 'C' || s_suppkey // 10 AS chamber, {SURNAMES}[s_suppkey % 6 + 1] AS last, ['Ann', 'Bob'][s_suppkey // 6 % 2 + 1] AS first FROM supplier),
n AS (SELECT DISTINCT c_custkey % 50 AS roll_id, 'C' || c_custkey % (SELECT max(s_suppkey) // 10 + 1 FROM supplier) AS chamber, substr({SURNAMES}[c_custkey % 6 + 1], 1, 15) || CASE WHEN c_custkey % 3 = 0 THEN ', A.' ELSE '' END AS printed, substr({SURNAMES}[c_custkey % 6 + 1], 1, 15) AS l, CASE WHEN c_custkey % 3 = 0 THEN 'a' END AS i FROM customer),
h AS (SELECT roll_id, n.chamber, printed, list_sort(list(DISTINCT member_key)) AS hits FROM n JOIN r ON r.chamber = n.chamber AND lower(substr(r.last, 1, 15)) = lower(n.l) AND (i IS NULL OR starts_with(lower(r.first), i)) GROUP BY ALL),
s AS (SELECT roll_id, list(DISTINCT hits[1]) AS found FROM h WHERE len(hits) = 1 GROUP BY 1),
k AS (SELECT roll_id, chamber, printed, CASE WHEN len(hits) = 1 THEN hits[1] WHEN len(list_filter(hits, lambda x: NOT list_contains(coalesce(found, []), x))) = 1 THEN list_filter(hits, lambda x: NOT list_contains(coalesce(found, []), x))[1] END AS member_key FROM h LEFT JOIN s USING (roll_id))
SELECT n.roll_id, n.chamber, n.printed, member_key FROM n LEFT JOIN k USING (roll_id, chamber, printed)"""
)
def truncated_names(spark: SparkSession, d: str) -> DataFrame:
    """Printed surnames of fifteen letters, resolved by initials and elimination; a chamber for every ten members."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    chambers = T.read(spark, d, "supplier").agg(F.max(F.floor(s / 10)) + 1).first()[0]
    roster = T.read(spark, d, "supplier").select(s.alias("member_key"), _text("C", F.floor(s / 10)).alias("chamber"), _pick(SURNAMES, s % 6).alias("last"), _pick(["Ann", "Bob"], F.floor(s / 6) % 2).alias("first"))
    printed = F.concat(F.substring(_pick(SURNAMES, c % 6), 1, 15), F.when(c % 3 == 0, ", A.").otherwise(""))
    names = T.read(spark, d, "customer").select((c % 50).alias("roll_id"), _text("C", c % chambers).alias("chamber"), printed.alias("printed")).distinct()
    return I.resolve_truncated(names, roster).select("roll_id", "chamber", "printed", "member_key")


PEOPLE = ["Ann Lee", "Bob Ray Fox", "Cy Young", "Dee Fox", "Eve Stone"]


@query(
    f"""WITH g AS (SELECT DISTINCT 'PN' || s_suppkey % 60 AS number, {PEOPLE}[s_suppkey % 60 % 5 + 1] || ' ' || chr(CAST(97 + s_suppkey % 60 // 5 AS INTEGER)) AS nominee FROM supplier),
r AS (SELECT c_custkey AS roll_id, 'PN' || c_custkey % 60 AS number, {PEOPLE}[c_custkey % 7 % 5 + 1] || ' ' || chr(CAST(97 + c_custkey % 60 // 5 AS INTEGER)) AS nominee FROM customer),
o AS (SELECT lower(nominee) AS n, min(number) AS other FROM g GROUP BY 1 HAVING count(DISTINCT number) = 1)
SELECT roll_id, r.nominee, CASE WHEN g.nominee IS NULL OR lower(split_part(r.nominee, ' ', 1)) = lower(split_part(g.nominee, ' ', 1)) OR lower(split_part(r.nominee, ' ', -1)) = lower(split_part(g.nominee, ' ', -1)) THEN r.number ELSE coalesce(other, r.number) END AS number
FROM r LEFT JOIN g USING (number) LEFT JOIN o ON o.n = lower(r.nominee)"""
)
def nomination_repair(spark: SparkSession, d: str) -> DataFrame:
    """Votes whose nomination number names another person move to the one number of theirs."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    tail = lambda k: F.char((97 + F.floor(k % 60 / 5)).cast("int"))
    registry = T.read(spark, d, "supplier").select(_text("PN", s % 60).alias("number"), F.concat_ws(" ", _pick(PEOPLE, s % 60 % 5), tail(s)).alias("nominee")).distinct()
    rows = T.read(spark, d, "customer").select(c.alias("roll_id"), _text("PN", c % 60).alias("number"), F.concat_ws(" ", _pick(PEOPLE, c % 7 % 5), tail(c)).alias("nominee"))
    return I.fix_subjects(rows, registry)


@query("SELECT c_custkey AS cand_key, 'seat-' || c_custkey % 70 AS seat FROM customer WHERE c_custkey % 70 NOT IN (SELECT s_suppkey * 2 % 90 FROM supplier)")
def slate_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Slate seats that no race of the guide covers."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    slates = T.read(spark, d, "customer").select(c.alias("cand_key"), _text("seat-", c % 70).alias("seat"))
    return G.uncovered(slates, T.read(spark, d, "supplier").select(_text("seat-", s * 2 % 90).alias("seat"))).select("cand_key", "seat")


@query("WITH s AS (SELECT l_orderkey AS bill, l_suppkey AS member_key, CASE WHEN l_linenumber = 1 THEN 'sponsor' ELSE 'cosponsor' END AS role FROM lineitem WHERE l_returnflag <> 'R') SELECT bill, member_key, max(role) AS role FROM s GROUP BY 1, 2")
def sponsor_membership(spark: SparkSession, d: str) -> DataFrame:
    line = T.read(spark, d, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("bill"), F.col("l_suppkey").alias("member_key"), F.when(F.col("l_linenumber") == 1, "sponsor").otherwise("cosponsor").alias("role"), (F.col("l_returnflag") == "R").alias("withdrawn"))
    return G.sponsor_roles(rows)


@query(
    """WITH c AS (SELECT c_custkey AS cand_key, 'Pat ' || ['Lee', 'Fox', 'Roe'][c_custkey % 3 + 1] AS name, ['lee', 'fox', 'roe'][c_custkey % 3 + 1] AS l, 's' || c_custkey % 30 AS seat, CASE WHEN c_custkey % 4 = 0 THEN 'B' || c_custkey % 200 END AS bioguide, c_custkey % 2 = 0 AS incumbent FROM customer),
m AS (SELECT s_suppkey AS member_key, ['lee', 'fox', 'roe'][s_suppkey % 3 + 1] AS l, 's' || s_suppkey % 30 AS seat, CASE WHEN s_suppkey % 5 <> 0 THEN 'B' || s_suppkey END AS bioguide FROM supplier)
SELECT cand_key, member_key FROM c JOIN m USING (bioguide) UNION SELECT cand_key, member_key FROM c JOIN m USING (seat, l) WHERE c.bioguide IS NULL AND incumbent"""
)
def incumbent_match(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda k: F.concat(F.lit("Pat "), _pick(["Lee", "Fox", "Roe"], k % 3))
    candidates = T.read(spark, d, "customer").select(c.alias("cand_key"), name(c).alias("name"), _text("s", c % 30).alias("seat"), F.when(c % 4 == 0, _text("B", c % 200)).alias("bioguide"), (c % 2 == 0).alias("incumbent"))
    members = T.read(spark, d, "supplier").select(s.alias("member_key"), name(s).alias("name"), _text("s", s % 30).alias("seat"), F.when(s % 5 != 0, _text("B", s)).alias("bioguide"))
    return V.incumbent_members(candidates, members)


@query("SELECT count(*) AS races, CAST(sum(c_custkey % 4) AS BIGINT) AS candidates, CAST(sum(c_custkey % 3) AS BIGINT) AS sources, CAST(sum(CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS official_sources, count(DISTINCT c_nationkey) AS states FROM customer")
def guide_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Races, candidates, sources and official ones; the first source of each race is official here."""
    k = F.col("c_custkey")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    sources = F.transform(upto(k % 3), lambda i: F.struct(i.cast("string").alias("id"), F.when(i == 1, "official").otherwise("news").alias("kind")))
    return V.guide_stats(T.read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("state"), upto(k % 4).alias("candidates"), sources.alias("sources")))


@query("SELECT count(*) AS races, CAST(sum(o_orderkey % 7) AS BIGINT) AS claimsChecked, CAST(sum(o_custkey % 3) AS BIGINT) AS corrected, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS removed, CAST(sum(o_shippriority) AS BIGINT) AS unverifiable FROM (SELECT *, 1 AS o_shippriority FROM orders)")
def verification_totals(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders")
    return content.verification_totals(o.select((F.col("o_orderkey") % 7).alias("claimsChecked"), (F.col("o_custkey") % 3).alias("corrected"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("removed"), F.lit(1).alias("unverifiable")))


@query("SELECT o_custkey AS cand_id, count(DISTINCT s) AS cited FROM (SELECT o_custkey, unnest(['p' || o_orderpriority, 's' || o_orderstatus, 'k' || o_orderkey % 5]) AS s FROM orders) GROUP BY 1")
def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    sources = F.array(F.concat(F.lit("p"), "o_orderpriority"), F.concat(F.lit("s"), "o_orderstatus"), _text("k", F.col("o_orderkey") % 5))
    return V.cited(T.read(spark, d, "orders").select(F.col("o_custkey").alias("cand_id"), sources.alias("sources")))


@query("WITH o AS (SELECT DISTINCT CASE WHEN s_suppkey % 9 < 4 THEN ['U.S. SENATE', 'NYC COUNCIL', 'U.S. HOUSE', 'NY SENATE'][s_suppkey % 9 + 1] ELSE 'STATE ' || s_nationkey END AS label FROM supplier) SELECT label, CAST(row_number() OVER (ORDER BY coalesce(list_position(['U.S. HOUSE', 'U.S. SENATE', 'NY SENATE', 'NY ASSEMBLY', 'NYC COUNCIL', 'DC COUNCIL'], label), 7), label) AS INTEGER) AS place FROM o")
def option_places(spark: SparkSession, d: str) -> DataFrame:
    """Options of a list, a row for each chamber: the pinned ones first."""
    from pyspark.sql import Window as W

    k = F.col("s_suppkey") % 9
    label = F.when(k < 4, _pick(["U.S. SENATE", "NYC COUNCIL", "U.S. HOUSE", "NY SENATE"], k)).otherwise(_text("STATE ", F.col("s_nationkey")))
    options = T.read(spark, d, "supplier").select(label.alias("label")).distinct()
    return options.select("label", F.row_number().over(W.orderBy(*V.option_order("label"))).alias("place"))


@query(
    f"""WITH {VIEWS}, b AS (SELECT roll_id, member_key, CASE WHEN member_key % 3 <> 0 THEN name ELSE 'Former member' END AS name, member_key % 3 = 0 AS unnamed FROM ballots JOIN members USING (member_key))
SELECT roll_id, member_key, name, CAST(row_number() OVER (PARTITION BY roll_id ORDER BY unnamed, name, member_key) AS INTEGER) AS place FROM b"""
)
def roll_member_order(spark: SparkSession, d: str) -> DataFrame:
    """Members of each roll call in the order of its page: unnamed ones last."""
    from pyspark.sql import Window as W

    m = T.members(spark, d)
    named = V.who_is(T.ballots(spark, d), m.where("member_key % 3 <> 0").select("member_key", "name", F.lit(None).cast("string").alias("official_id")), m.where("false").select("member_key", "name"))
    known = named.join(m.select("member_key"), "member_key", "left_semi")
    return known.select("roll_id", "member_key", "name", F.row_number().over(W.partitionBy("roll_id").orderBy(*V.member_order(), "member_key")).alias("place"))


@query(r"SELECT doc_id, regexp_matches(coalesce(text, ''), '\b(common[- ]sense|extreme|radical|controversial|far-left|far-right|disgraced|hypocrit\w*|flip-flop\w*|beloved|tireless|champion of|staunch)\b') AS in_bio, regexp_matches(coalesce(text, ''), '(?i)\b(extreme|radical|common[- ]sense|controversial|far-left|far-right|disgraced|hypocrit\w*|flip-flop\w*)\b') AS in_guide FROM documents")
def loaded_words(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", content.loaded(F.col("text")).alias("in_bio"), content.loaded(F.col("text"), content.GUIDE_LOADED).alias("in_guide"))


@query(
    """WITH b AS (SELECT s_suppkey AS k, s_suppkey % 5 AS sentences, s_suppkey % 10 AS paragraphs FROM supplier)
SELECT 'p' || k AS slug, unnest(list_filter([CASE WHEN k % 7 = 0 THEN 'slug is the file''s name' END, CASE WHEN NOT sentences BETWEEN 1 AND 3 THEN 'one to three summary sentences' END, CASE WHEN paragraphs > 8 THEN 'at most eight paragraphs' END,
  CASE WHEN k % 4 = 0 AND sentences > 0 THEN 'no loaded language' END, CASE WHEN k % 6 = 0 AND sentences > 0 THEN 'citations exist' END, CASE WHEN k % 6 = 0 OR sentences + paragraphs = 0 THEN 'sources are cited' END,
  CASE WHEN k % 11 = 0 THEN 'no banned host' END, CASE WHEN k % 3 = 0 THEN 'research day' END], lambda x: x IS NOT NULL)) AS rule FROM b"""
)
def biography_rules(spark: SparkSession, d: str) -> DataFrame:
    """Biographies built from the suppliers, and the rules they break."""
    k = F.col("s_suppkey")
    cites = F.array(F.when(k % 6 == 0, "other").otherwise("s1"))
    said = lambda loaded: F.struct(F.when(loaded, "A tireless one.").otherwise("A plain one.").alias("text"), cites.alias("sources"))
    times = lambda n, x: F.array_repeat(x, n.cast("int"))
    one = times(F.lit(1), F.struct(F.lit("s1").alias("id"), F.when(k % 11 == 0, "https://ballotbrief.example").otherwise("https://a.example").alias("url"), F.lit("t").alias("title"), F.lit("p").alias("publisher"), F.lit("news").alias("kind"), F.lit(None).cast("string").alias("date")))
    bios = T.read(spark, d, "supplier").select(
        _text("p", k).alias("slug"), F.when(k % 7 == 0, "else").otherwise(_text("p", k)).alias("file"), times(k % 5, said(k % 4 == 0)).alias("summary"), times(k % 10, F.array(said(F.lit(False)))).alias("paragraphs"),
        one.alias("sources"), F.when(k % 3 == 0, "soon").otherwise("2026-01-02").alias("researchedAt"),
    )
    return content.bio_violations(bios).select("slug", "rule")


@query("WITH t AS (SELECT c_custkey AS cand_id, unnest(['H.R.' || c_custkey % 20, 'S.' || c_custkey % 15]) AS bill FROM customer), s AS (SELECT DISTINCT o_custkey AS cand_id, CASE WHEN o_orderkey % 2 = 0 THEN 'H.R.' || o_custkey % 20 ELSE 'S.' || o_custkey % 10 END AS bill FROM orders) SELECT DISTINCT t.* FROM t ANTI JOIN s USING (cand_id, bill)")
def sponsorship_audit(spark: SparkSession, d: str) -> DataFrame:
    """Claims of sponsorship in texts that the official list lacks."""
    c, o = F.col("c_custkey"), F.col("o_custkey")
    texts = T.read(spark, d, "customer").select(c.alias("cand_id"), F.concat(F.lit("They sponsored "), _text("H.R. ", c % 20), F.lit(" and cosponsored the "), _text("S. ", c % 15), F.lit(".")).alias("text"))
    listed = T.read(spark, d, "orders").select(o.alias("cand_id"), F.when(F.col("o_orderkey") % 2 == 0, _text("H.R. ", o % 20)).otherwise(_text("S. ", o % 10)).alias("bill"))
    return V.unsupported_claims(texts, listed)


@query(
    f"""WITH {VIEWS}, n AS (SELECT roll_id, title, CASE WHEN roll_id % 3 = 0 THEN 'New ' || title END AS summary, CASE WHEN roll_id % 3 = 0 THEN 'official' END AS src FROM rolls WHERE roll_id % 5 <> 0),
o AS (SELECT roll_id, title, 'Old ' || title AS summary, 'ai' AS src FROM rolls WHERE roll_id % 2 = 0)
SELECT coalesce(n.roll_id, o.roll_id) AS roll_id, coalesce(n.title, o.title) AS title, coalesce(n.summary, o.summary) AS summary, CASE WHEN n.summary IS NOT NULL THEN n.src ELSE o.src END AS summary_source FROM n FULL JOIN o USING (roll_id)"""
)
def provenance_merge(spark: SparkSession, d: str) -> DataFrame:
    """A refresh over what is published: new rows win, but keep an old summary with its source where they have none."""
    r = T.rolls(spark, d).select("roll_id", "title")
    third = F.col("roll_id") % 3 == 0
    new = r.where("roll_id % 5 <> 0").select("*", F.when(third, F.concat(F.lit("New "), "title")).alias("summary"), F.when(third, "official").alias("summary_source"))
    old = r.where("roll_id % 2 = 0").select("*", F.concat(F.lit("Old "), "title").alias("summary"), F.lit("ai").alias("summary_source"))
    return incremental.upsert(old, snapshots.carry_forward(new, old), ["roll_id"])


@query("SELECT p_partkey AS roll_id, CASE WHEN p_partkey % 13 = 0 THEN 'Checked ' || p_partkey ELSE p_name END AS title FROM part")
def hand_checked(spark: SparkSession, d: str) -> DataFrame:
    """Hand-checked titles win over computed ones."""
    k = F.col("p_partkey")
    rows = T.read(spark, d, "part").select(k.alias("roll_id"), F.col("p_name").alias("title"))
    checked = T.read(spark, d, "part").where("p_partkey % 13 = 0").select(k.alias("roll_id"), _text("Checked ", k).alias("title"))
    return impute.overridden(rows, checked, "roll_id", "title").select("roll_id", "title")


@query(f"WITH {VIEWS} SELECT roll_id, title, CASE WHEN roll_id % 4 = 0 THEN 'Means ' || bill END AS meaning FROM rolls")
def added_meanings(spark: SparkSession, d: str) -> DataFrame:
    """Meanings by file and id beside the rolls that have them (a left equi-join)."""
    r = T.rolls(spark, d).select("roll_id", "title", "bill")
    meanings = r.where("roll_id % 4 = 0").select("roll_id", F.concat(F.lit("Means "), "bill").alias("meaning"))
    return r.drop("bill").join(meanings, "roll_id", "left").select("roll_id", "title", "meaning")


@query(
    f"""WITH {VIEWS} SELECT member_key, m.name, m.party, count(*) AS total, count(*) FILTER (choice = 'yes') AS yes, count(*) FILTER (choice = 'no') AS no, count(*) FILTER (choice = 'absent') AS absent,
  array_to_string(list(title ORDER BY roll_date DESC, roll_id)[1:10], '|') AS first_page FROM ballots JOIN members m USING (member_key) JOIN rolls USING (roll_id) GROUP BY ALL"""
)
def member_response(spark: SparkSession, d: str) -> DataFrame:
    """The whole response of a member's page, for every member: name, tallies and the first page of votes, newest first."""
    return V.member_pages(T.ballots(spark, d), T.members(spark, d), T.rolls(spark, d))


@query("SELECT c_custkey, c_custkey % 60 <> 7 AND c_custkey % 3 <> 1 AS complete FROM customer")
def complete_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Which typed addresses look complete: a house number, a street and a place after it."""
    k = F.col("c_custkey")
    typed = F.concat(F.when(k % 60 != 7, F.concat((k % 90 + 1).cast("string"), F.lit(" "))).otherwise(F.lit("")), F.lit("Main St"), F.when(k % 3 == 0, ", Albany NY").when(k % 3 == 2, " 12207").otherwise(""))
    return T.read(spark, d, "customer").select("c_custkey", ranking.looks_complete(typed).alias("complete"))
