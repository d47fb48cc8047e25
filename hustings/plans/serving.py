"""Queries of the serving views and of the connectors, over the civic view of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import serving as V
from ..session import settled
from ..sources import connectors
from ..sources import driver_tables as T
from . import query
from .votes import SPLITS, record, scored

VIEWS = T.VIEWS


@query(f"WITH {SPLITS}, r AS (SELECT roll_id, title, kind, roll_date, choice FROM record WHERE member_key = 3 AND kind = 'substantive' AND split_kind <> 'unanimous') SELECT *, (SELECT count(*) FROM r) AS total FROM r ORDER BY roll_date DESC, roll_id LIMIT 10 OFFSET 10")
def member_vote_list(spark: SparkSession, d: str) -> DataFrame:
    """Page two of a member's votes."""
    return V.vote_list(record(spark, d), 3, "substantive", page=2).select("roll_id", "title", "kind", "roll_date", "choice", "total")


@query(f"WITH {VIEWS} SELECT roll_id, t AS title, roll_date FROM (SELECT *, CASE WHEN roll_id % 3 = 0 THEN 'On ' || title ELSE title END AS t, CASE WHEN roll_id % 2 = 0 THEN 'm' END AS meaning FROM rolls) WHERE roll_date >= DATE '1998-12-01' - 90 AND (NOT starts_with(t, 'On ') OR meaning IS NOT NULL)")
def named_titles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("roll_id")
    r = T.rolls(spark, d).withColumns({"title": F.when(k % 3 == 0, F.concat(F.lit("On "), "title")).otherwise(F.col("title")), "meaning": F.when(k % 2 == 0, "m")})
    return V.named_titles(r, "1998-12-01").select("roll_id", "title", "roll_date")


@query(f"WITH {SPLITS} SELECT roll_id, yes, no FROM splits WHERE least(yes, no) >= 5")
def both_sides(spark: SparkSession, d: str) -> DataFrame:
    return V.both_sides(scored(spark, d)).select("roll_id", "yes", "no")


@query(f"WITH {VIEWS} SELECT DISTINCT roll_id FROM ballots WHERE choice = 'no' UNION SELECT roll_id FROM rolls WHERE kind = 'substantive'")
def kept_rolls(spark: SparkSession, d: str) -> DataFrame:
    return V.kept_rolls(T.ballots(spark, d), T.rolls(spark, d).where("kind = 'substantive'"))


@query(
    f"""WITH {VIEWS}, r AS (SELECT member_key, name, 'o' || member_key AS official_id FROM members WHERE member_key % 3 <> 0), s AS (SELECT member_key, CASE WHEN member_key % 5 = 0 THEN 'Somebody Else' ELSE name END AS name FROM members WHERE member_key % 4 <> 0)
SELECT b.roll_id, b.member_key, coalesce(CASE WHEN s.name IS NULL OR s.name = r.name THEN r.name END, s.name, 'Former member') AS name, CASE WHEN s.name IS NULL OR s.name = r.name THEN official_id END AS official_id, r.name IS NULL AND s.name IS NULL AS unnamed
FROM ballots b LEFT JOIN r USING (member_key) LEFT JOIN s USING (member_key)"""
)
def roll_call_detail(spark: SparkSession, d: str) -> DataFrame:
    m = T.members(spark, d)
    roster = m.where("member_key % 3 <> 0").select("member_key", "name", F.concat(F.lit("o"), F.col("member_key").cast("string")).alias("official_id"))
    snap = m.where("member_key % 4 <> 0").select("member_key", F.when(F.col("member_key") % 5 == 0, "Somebody Else").otherwise(F.col("name")).alias("name"))
    return V.who_is(T.ballots(spark, d), roster, snap).select("roll_id", "member_key", "name", "official_id", "unnamed")


@query(
    """WITH s AS (SELECT s_suppkey AS seat, s_suppkey % 40 AS member_key, CASE WHEN s_suppkey % 3 = 0 THEN 2027 + s_suppkey % 4 END AS term_end FROM supplier),
i AS (SELECT c_custkey // 3 AS member_key, min(CASE WHEN c_custkey % 9 < 6 THEN 2026 + c_custkey % 2 END) AS y FROM customer GROUP BY 1), l AS (SELECT s_suppkey AS seat, 2026 AS y FROM supplier WHERE s_suppkey % 2 = 0)
SELECT seat, coalesce(i.y, term_end - 1, l.y, 2029) AS election_year, CASE WHEN i.y IS NOT NULL THEN 'incumbent' WHEN term_end IS NOT NULL THEN 'term' WHEN l.y IS NOT NULL THEN 'slate' ELSE 'default' END AS rule FROM s LEFT JOIN i USING (member_key) LEFT JOIN l USING (seat)"""
)
def next_election(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    seats = T.read(spark, d, "supplier").select(k.alias("seat"), (k % 40).alias("member_key"), F.when(k % 3 == 0, 2027 + k % 4).alias("term_end"))
    c = F.col("c_custkey")
    inc = T.read(spark, d, "customer").select(F.floor(c / 3).alias("member_key"), F.when(c % 9 < 6, 2026 + c % 2).alias("year"))
    return V.next_election(seats, inc, seats.where("seat % 2 = 0").select("seat", F.lit(2026).alias("year")), 2029)


@query("SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def best_by_receipts(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders")
    return V.best_by(o.select("o_custkey").distinct(), o, ["o_custkey"], "o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT s_nationkey AS seat, arg_min(p, s_suppkey) AS party FROM (SELECT s_nationkey, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' END AS p FROM supplier) WHERE p IS NOT NULL GROUP BY 1")
def stated_party(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return V.stated_party(T.read(spark, d, "supplier").select(F.col("s_nationkey").alias("seat"), k.alias("file_ordinal"), F.when(k % 3 == 0, "D").when(k % 3 == 1, "R").otherwise("X").alias("party")))


@query(
    """WITH r AS (SELECT o_orderkey AS roll_id, o_custkey % 50 AS bill, CAST(o_orderdate AS DATE) AS day, o_orderkey % 20 AS rn, o_orderkey % 7 AS pn FROM orders WHERE o_orderkey % 2 = 0),
l AS (SELECT o_custkey % 50 AS bill, CAST(o_orderdate AS DATE) AS day, o_orderkey % 7 AS number, 'Roll no. ' || o_orderkey % 20 AS text FROM orders WHERE o_orderkey % 2 = 1),
a AS (SELECT roll_id, min(number) AS a FROM r JOIN l USING (bill, day) WHERE regexp_matches(text, '\\b' || rn || '\\b') GROUP BY 1), b AS (SELECT roll_id, min(number) AS b FROM r JOIN l USING (bill, day) WHERE pn = number GROUP BY 1)
SELECT roll_id, coalesce(a, b) AS number, CASE WHEN a IS NOT NULL THEN 'text' WHEN b IS NOT NULL THEN 'print' END AS how FROM r LEFT JOIN a USING (roll_id) LEFT JOIN b USING (roll_id)"""
)
def amendment_match(spark: SparkSession, d: str) -> DataFrame:
    o, k = T.read(spark, d, "orders"), F.col("o_orderkey")
    base = [(F.col("o_custkey") % 50).alias("bill")]
    rolls = o.where(k % 2 == 0).select(k.alias("roll_id"), *base, F.to_date("o_orderdate").alias("roll_date"), (k % 20).alias("roll_number"), (k % 7).alias("printed_number"))
    listed = o.where(k % 2 == 1).select(*base, F.to_date("o_orderdate").alias("day"), (k % 7).alias("number"), F.concat(F.lit("Roll no. "), (k % 20).cast("string")).alias("text"))
    return V.match_amendments(rolls, listed)


@query("SELECT o_orderkey AS vote_id, b AS bill, o_orderkey || '-' || b AS roll_id FROM (SELECT o_orderkey, unnest(['A' || o_custkey % 9, 'B' || o_custkey % 5]) AS b FROM orders)")
def en_bloc(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    bills = F.array(F.concat(F.lit("A"), (c % 9).cast("string")), F.concat(F.lit("B"), (c % 5).cast("string")))
    return V.en_bloc(T.read(spark, d, "orders").select(F.col("o_orderkey").alias("vote_id"), bills.alias("bills"))).select("vote_id", "bill", "roll_id")


FIT = "(len(list_filter(string_split(caption, ' '), lambda c: list_contains(string_split({0}, ' '), c) OR (length(c) > 4 AND len(list_filter(string_split({0}, ' '), lambda t: starts_with(t, c))) > 0))) / 2.0 >= 0.5)"


@query(
    f"""WITH {VIEWS}, c AS (SELECT roll_id, bill, title, lead(title) OVER (ORDER BY roll_id) AS caption FROM rolls), k AS (SELECT * FROM c WHERE caption IS NOT NULL),
t AS (SELECT DISTINCT bill, roll_id AS priority, title AS alternative FROM rolls),
o AS (SELECT roll_id, arg_min(alternative, priority) AS alt FROM k JOIN t USING (bill) WHERE NOT {FIT.format('title')} AND {FIT.format('alternative')} GROUP BY 1)
SELECT roll_id, bill, CASE WHEN {FIT.format('title')} THEN title ELSE coalesce(alt, title) END AS title, NOT {FIT.format('title')} AND alt IS NULL AS doubtful FROM k LEFT JOIN o USING (roll_id)"""
)
def title_repair(spark: SparkSession, d: str) -> DataFrame:
    """A roll's caption here is the title of the next roll; part names are two words of three letters or more."""
    r = T.rolls(spark, d).select("roll_id", "bill", "title")
    captions = r.select((F.col("roll_id") - 1).alias("roll_id"), F.col("title").alias("caption"))
    return V.repaired_titles(r.join(captions, "roll_id"), r.select("bill", F.col("roll_id").alias("priority"), F.col("title").alias("alternative")))


@query(f"WITH {VIEWS} SELECT roll_id, CASE WHEN roll_id % 5 <> 0 AND roll_id % 2 = 0 AND roll_id % 3 = 0 THEN 'next' WHEN roll_id % 5 <> 0 AND roll_id % 2 = 0 THEN CASE WHEN roll_id % 4 = 0 THEN 'act' ELSE title END ELSE title END AS phase_title FROM rolls")
def phase_title(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("roll_id")
    r = T.rolls(spark, d).withColumns({"passage": k % 2 == 0, "failed": k % 5 == 0, "first": k % 3 == 0, "after": F.lit("next"), "enacted": F.when(k % 4 == 0, "act")})
    return V.phase_titles(r, "title", "after", "enacted").select("roll_id", "phase_title")


@query(
    """WITH h AS (SELECT o_custkey % 5 AS chamber, CAST(o_orderdate AS DATE) AS day, list_aggregate(list_sort(list_distinct([o_orderkey % 3, o_orderkey % 4])), 'string_agg', ',') AS k, o_orderkey AS bill FROM orders WHERE o_orderkey % 2 = 0),
u AS (SELECT chamber, day, k, min(bill) AS b FROM h GROUP BY ALL HAVING count(DISTINCT bill) = 1),
r AS (SELECT o_orderkey AS roll_id, o_custkey % 5 AS chamber, CAST(o_orderdate AS DATE) AS day, list_aggregate(list_sort(list_distinct([o_orderkey % 4, o_orderkey % 3])), 'string_agg', ',') AS k, CASE WHEN o_orderkey % 3 = 0 THEN -1 END AS bill FROM orders WHERE o_orderkey % 2 = 1)
SELECT roll_id, coalesce(r.bill, u.b) AS bill FROM r LEFT JOIN u USING (chamber, day, k)"""
)
def set_equality_relink(spark: SparkSession, d: str) -> DataFrame:
    o, k = T.read(spark, d, "orders"), F.col("o_orderkey")
    common = [(F.col("o_custkey") % 5).alias("chamber"), F.to_date("o_orderdate").alias("day")]
    history = o.where(k % 2 == 0).select(*common, F.array(k % 3, k % 4).alias("items"), k.alias("bill"))
    rolls = o.where(k % 2 == 1).select(k.alias("roll_id"), *common, F.array(k % 4, k % 3).alias("items"), F.when(k % 3 == 0, F.lit(-1)).cast("long").alias("bill"))
    return V.relink_by_items(rolls, history).select("roll_id", "bill")


@query("WITH m AS (SELECT c_nationkey AS page, c_custkey AS mark_id, c_acctbal AS x FROM customer), h AS (SELECT s_nationkey AS page, s_suppkey AS col, s_acctbal AS hx FROM supplier) SELECT page, mark_id, arg_min(col, (abs(x - hx), col)) AS col FROM m JOIN h USING (page) GROUP BY 1, 2")
def nearest_column(spark: SparkSession, d: str) -> DataFrame:
    marks = T.read(spark, d, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("mark_id"), F.col("c_acctbal").alias("x"))
    headers = T.read(spark, d, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("column"), F.col("s_acctbal").alias("hx"))
    return V.nearest_column(marks, headers, 500.0).withColumnRenamed("column", "col")


@query(f"WITH {VIEWS}, r AS (SELECT roll_id, chamber, row_number() OVER (PARTITION BY chamber ORDER BY roll_date DESC, roll_id) AS rank FROM rolls) SELECT roll_id, chamber, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 300")
def newest_per_chamber(spark: SparkSession, d: str) -> DataFrame:
    """The newest 300 rolls of each chamber (the cap is the feature)."""
    return V.newest_per_chamber(T.rolls(spark, d)).select("roll_id", "chamber", "rank")


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def last_listed(spark: SparkSession, d: str) -> DataFrame:
    return V.last_listed(T.read(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT s_nationkey AS seat, CAST(sum(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE s_suppkey % 4 END) AS BIGINT) AS seats, string_agg(s_name, ',' ORDER BY s_suppkey) AS candidates FROM supplier GROUP BY 1")
def seat_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = T.read(spark, d, "supplier").select(F.col("s_nationkey").alias("seat"), F.when(k % 3 != 0, k % 4).alias("seats"), k.alias("position"), F.array("s_name").alias("candidates"))
    return V.seat_merge(rows).withColumn("candidates", F.array_join("candidates", ","))


@query("SELECT l_returnflag AS file, count(CASE WHEN s % 3 = 0 THEN 1 END) AS matched, count(*) AS keys FROM (SELECT DISTINCT l_returnflag, l_suppkey AS s FROM lineitem) GROUP BY 1")
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    keys = T.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_suppkey").alias("member_key"))
    return V.coverage_ratio(keys, T.read(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("member_key")))


@query(f"WITH {VIEWS}, e AS (SELECT roll_id, roll_id % 50 AS member_key, 'yes' AS expected FROM rolls) SELECT e.*, choice FROM e LEFT JOIN ballots USING (roll_id, member_key) WHERE choice IS DISTINCT FROM expected")
def known_answers(spark: SparkSession, d: str) -> DataFrame:
    expected = T.rolls(spark, d).select("roll_id", (F.col("roll_id") % 50).alias("member_key"), F.lit("yes").alias("expected"))
    return V.known_answers(T.ballots(spark, d), expected)


@query(f"WITH {VIEWS} SELECT chamber, count(*) AS members FROM members GROUP BY 1 HAVING count(*) < CASE WHEN chamber = 'ASIA' THEN 1000 ELSE 18 END")
def small_rosters(spark: SparkSession, d: str) -> DataFrame:
    regions = [r["r_name"] for r in T.read(spark, d, "region").collect()]  # five rows
    return V.small_rosters(T.members(spark, d), {r: 1000 if r == "ASIA" else 18 for r in regions})


@query(f"WITH {VIEWS} SELECT roll_id, count(*) AS positions, roll_id % 30 AS seated FROM ballots GROUP BY 1 HAVING count(*) > roll_id % 30")
def seat_count_check(spark: SparkSession, d: str) -> DataFrame:
    return V.seat_counts(T.ballots(spark, d), T.rolls(spark, d).select("roll_id", (F.col("roll_id") % 30).alias("seated")))


@query("WITH h AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 = 0) SELECT page_id, h.url IS NOT NULL AS dead FROM pages LEFT JOIN h USING (url)")
def dead_links(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "pages").select("page_id", "url")
    health = p.where("page_id % 4 = 0").select("url", F.lit("dead").alias("status"), F.lit(None).cast("string").alias("archived_url")).distinct()
    return V.dead_links(p, health).select("page_id", "dead")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), 'then|ring') ")
def any_token(spark: SparkSession, d: str) -> DataFrame:
    """Rows that any token of a query highlights."""
    return T.read(spark, d, "documents").where(V.any_token(F.coalesce("text", F.lit("")), "then ring")).select("doc_id")


#: Sources of the query below, of every kind and policy; the roll call's number chooses one.
FORMATS = ["us-house", "us-senate", "wa", "va", "nj", "az", "al", "mn", "ut", "mi", "ga", "tn"]


@query(
    f"""WITH {VIEWS}, t AS (SELECT roll_id, {FORMATS}[roll_id % 12 + 1] AS source, count(*) FILTER (choice = 'yes') AS yes, count(*) FILTER (choice = 'no') AS no, count(*) FILTER (choice = 'absent') AS a FROM ballots GROUP BY 1),
p AS (SELECT *, roll_id % 24 < 12 AS wrong FROM t)
SELECT source, roll_id, yes, no, CASE WHEN source IN ('mn', 'tn') THEN 0 ELSE a END AS absent, CASE WHEN source IN ('us-house', 'us-senate', 'nj') THEN NULL ELSE NOT wrong END AS agrees FROM p
WHERE NOT (wrong AND source IN ('va', 'al', 'mn', 'mi', 'tn'))"""
)
def connector_formats(spark: SparkSession, d: str) -> DataFrame:
    """Roll calls printed in XML, CSV, JSON and HTML as twelve sources do, parsed, resolved and counted; every second
    dozen prints a wrong tally."""
    b = T.ballots(spark, d)
    roster = T.members(spark, d).select(F.concat(F.lit("Lee & Fox, "), F.col("member_key").cast("string")).alias("name"), "member_key")
    of = F.col("roll_id") % 12
    by_source = lambda values: F.get(F.array(*map(F.lit, values)), of.cast("int"))
    says = [{c: w for w, c in reversed(connectors.SOURCES[s].codes.items()) if w} for s in FORMATS]
    word = F.when(F.col("choice") == "yes", by_source([x["yes"] for x in says])).when(F.col("choice") == "no", by_source([x["no"] for x in says])).otherwise(by_source([x.get("absent", "no position") for x in says]))
    named = b.join(roster, "member_key").select("roll_id", F.col("name").alias("n"), word.alias("w"), by_source([connectors.SOURCES[s].kind for s in FORMATS]).alias("kind"))
    safe, is_ = F.replace("n", F.lit("&"), F.lit("&amp;")), lambda k: F.col("kind") == k
    line = F.when(is_("JSON"), F.to_json(F.struct(F.col("n").alias("name"), F.col("w").alias("vote")))).when(is_("CSV"), F.concat(F.lit('"'), "n", F.lit('",'), "w"))
    line = line.when(is_("XML"), F.concat(F.lit("<member><name>"), safe, F.lit("</name><vote>"), "w", F.lit("</vote></member>"))).otherwise(F.concat(F.lit("<tr><td>"), safe, F.lit("</td><td><b>"), "w", F.lit("</b></td></tr>")))
    lines = named.groupBy("roll_id", "kind").agg(F.collect_list(line).alias("lines"))
    frame = {"JSON": ("[", ",", "]"), "CSV": ("name,vote\r\n", "\r\n", "\r\n"), "XML": ("<roll>", "", "</roll>"), "HTML": ("<table>", "\n", "</table>")}
    body = F.coalesce(*[F.when(is_(k), F.concat(F.lit(start), F.array_join("lines", between), F.lit(end))) for k, (start, between, end) in frame.items()])
    source = by_source(FORMATS).alias("source")
    printed = settled(connectors.printed_positions(lines.select(source, "roll_id", "kind", body.alias("body")), F.col("kind"), keys=("source", "roll_id")))
    count = lambda c: F.count(F.when(F.col("choice") == c, 1))
    tally = b.groupBy("roll_id").agg((count("yes") + F.when(F.col("roll_id") % 24 < 12, 1).otherwise(0)).alias("printed_yes"), count("no").alias("printed_no")).select(source, "*")
    rolls, votes = connectors.ingest_all(tally, printed, roster.crossJoin(F.broadcast(spark.range(1).select(F.explode(F.array(*map(F.lit, FORMATS))).alias("source")))))
    counts = votes.groupBy("source", "roll_id").agg(count("yes").alias("yes"), count("no").alias("no"), count("absent").alias("absent"))
    return rolls.select("source", "roll_id", "agrees").join(counts, ["source", "roll_id"]).select("source", "roll_id", "yes", "no", "absent", "agrees")


@query(
    f"""WITH {VIEWS}, p AS (SELECT roll_id, member_key, CASE choice WHEN 'yes' THEN 'Y' WHEN 'no' THEN 'N' ELSE 'X' END AS raw FROM ballots),
t AS (SELECT roll_id, count(*) FILTER (raw = 'Y') AS yes, count(*) FILTER (raw = 'N') AS no FROM p GROUP BY 1)
SELECT roll_id, yes, no FROM t WHERE roll_id % 8 <> 0"""
)
def connector_ingest(spark: SparkSession, d: str) -> DataFrame:
    """One source's rolls, coded and counted; those whose printed tally differs are dropped."""
    b = T.ballots(spark, d)
    raw = F.when(F.col("choice") == "yes", "Y").when(F.col("choice") == "no", "N").otherwise("X")
    printed = b.select("roll_id", F.col("member_key").cast("string").alias("name"), raw.alias("raw"))
    roster = T.members(spark, d).select(F.col("member_key").cast("string").alias("name"), "member_key")
    tally = b.groupBy("roll_id").agg((F.count(F.when(F.col("choice") == "yes", 1)) + F.when(F.col("roll_id") % 8 == 0, 1).otherwise(0)).alias("printed_yes"), F.count(F.when(F.col("choice") == "no", 1)).alias("printed_no"))
    rolls, _ = connectors.ingest(tally, printed, roster, "va")
    return rolls.select("roll_id", "yes", "no")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'H.R. ' || p_size WHEN 1 THEN 'S.Con.Res. ' || p_size WHEN 2 THEN 'S. ' || p_size ELSE 'X ' || p_size END AS bill FROM part")
def bill_format(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size")
    raw = F.concat(F.when(k % 4 == 0, "H R ").when(k % 4 == 1, "S CON RES ").when(k % 4 == 2, "S ").otherwise("X "), k.cast("string"))
    return T.read(spark, d, "part").select("p_partkey", X.format_bill(raw).alias("bill"))
