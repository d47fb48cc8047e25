"""Queries of the identity and ranking operators: names are built from the keys of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import ranking
from ..sources import driver_tables as T
from . import query

FIRST = ["Alexander", "Maria", "José", "Ann", "Thomas", "Alex", "Tom", "Zoë", "Li", "Mar"]
LAST = ["Smith", "Núñez", "O'Neil", "Garcia Lopez", "Young", "King", "Stone", "Wood", "Hill", "Lake", "Ford", "Bell", "Cole"]
SQL_FIRST, SQL_LAST = ("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]" for v in (FIRST, LAST))


def _name(k, first_step: int, last_step: int):
    pick = lambda v, i: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    return F.concat(pick(FIRST, F.floor(k / first_step)), F.when(k % 4 == 0, " B. ").otherwise(" "), pick(LAST, F.floor(k / last_step)), F.when(k % 6 == 0, F.lit(", Jr.")).otherwise(F.lit("")))


def _sql_name(k: str, first_step: int, last_step: int) -> str:
    return f"{SQL_FIRST}[{k} // {first_step} % {len(FIRST)} + 1] || CASE WHEN {k} % 4 = 0 THEN ' B. ' ELSE ' ' END || {SQL_LAST}[{k} // {last_step} % {len(LAST)} + 1] || CASE WHEN {k} % 6 = 0 THEN ', Jr.' ELSE '' END"


def officials(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return T.read(spark, d, "supplier").select(k.alias("official_key"), _name(k, 1, 3).alias("name"), (F.col("s_nationkey") % 5).alias("state"), F.when(k % 11 == 0, F.concat(F.lit("B"), k.cast("string"))).alias("bioguide"), F.array(F.concat(F.lit("seat-"), (k % 40).cast("string"))).alias("seats"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    seats = F.array(F.concat(F.lit("seat-"), (k % 45).cast("string")), F.concat(F.lit("seat-"), (k % 38).cast("string")))
    return T.read(spark, d, "customer").select(k.alias("cand_key"), _name(k, 2, 5).alias("name"), (F.col("c_nationkey") % 5).alias("state"), F.when(k % 50 == 0, F.concat(F.lit("B"), (k % 200).cast("string"))).alias("bioguide"), (k % 3 == 0).alias("incumbent"), seats.alias("seats"))


WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents({0})), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda x: x <> '' AND x NOT IN ('jr', 'sr', 'ii', 'iii', 'iv'))"
PEOPLE = f"""
o AS (SELECT s_suppkey AS official_key, {WORDS.format(_sql_name('s_suppkey', 1, 3))} AS w, s_nationkey % 5 AS state, CASE WHEN s_suppkey % 11 = 0 THEN 'B' || s_suppkey END AS bioguide, 'seat-' || s_suppkey % 40 AS seat FROM supplier),
c AS (SELECT c_custkey AS cand_key, {WORDS.format(_sql_name('c_custkey', 2, 5))} AS w, c_nationkey % 5 AS state, CASE WHEN c_custkey % 50 = 0 THEN 'B' || c_custkey % 200 END AS bioguide, c_custkey % 3 = 0 AS incumbent, ['seat-' || c_custkey % 45, 'seat-' || c_custkey % 38] AS seats FROM customer),
t1 AS (SELECT cand_key, official_key AS a FROM c JOIN o USING (bioguide)),
t2 AS (SELECT cand_key, arg_min(m, pos) AS a FROM (
  SELECT cand_key, pos, min(official_key) AS m FROM (SELECT cand_key, w, unnest(seats) AS seat, unnest([0, 1]) AS pos FROM c WHERE incumbent) s JOIN o ON o.seat = s.seat AND o.w[-1] = s.w[-1] GROUP BY cand_key, pos HAVING count(DISTINCT official_key) = 1) GROUP BY cand_key),
t3 AS (SELECT cand_key, count(DISTINCT official_key) AS n, min(official_key) AS a FROM c JOIN o ON c.state = o.state AND c.w = o.w GROUP BY 1),
t4 AS (SELECT cand_key, count(DISTINCT official_key) AS n, min(official_key) AS a FROM c JOIN o ON c.state = o.state AND c.w[-1] = o.w[-1] AND c.w[2:] = o.w[2:]
  AND least(length(c.w[1]), length(o.w[1])) >= 3 AND (starts_with(c.w[1], o.w[1]) OR starts_with(o.w[1], c.w[1])) GROUP BY 1),
m AS (SELECT c.cand_key, coalesce(t1.a, t2.a, CASE WHEN t3.n = 1 THEN t3.a END, CASE WHEN t3.n IS NULL AND t4.n = 1 THEN t4.a END) AS official_key,
  CASE WHEN t1.a IS NOT NULL THEN 'id' WHEN t2.a IS NOT NULL THEN 'seat' WHEN t3.n = 1 THEN 'name' WHEN t3.n > 1 THEN 'ambiguous' WHEN t4.n = 1 THEN 'short' ELSE 'none' END AS tier
  FROM c LEFT JOIN t1 USING (cand_key) LEFT JOIN t2 USING (cand_key) LEFT JOIN t3 USING (cand_key) LEFT JOIN t4 USING (cand_key))"""


@query(f"WITH {PEOPLE} SELECT * FROM m")
def unique_match_cascade(spark: SparkSession, d: str) -> DataFrame:
    return I.match_officials(candidates(spark, d), officials(spark, d))


@query(f"WITH {PEOPLE} SELECT cand_key, cand_key % 10 AS race_id, CASE WHEN row_number() OVER (PARTITION BY official_key, cand_key % 10 ORDER BY cand_key) = 1 THEN official_key END AS official_key, tier FROM m")
def one_per_race(spark: SparkSession, d: str) -> DataFrame:
    races = candidates(spark, d).select("cand_key", (F.col("cand_key") % 10).alias("race_id"))
    return I.one_per_race(I.match_officials(candidates(spark, d), officials(spark, d)), races)


SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '[''’`]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'person')"


@query(
    f"""WITH p AS (SELECT c_custkey AS key, {_sql_name('c_custkey', 2, 5)} AS name, c_nationkey AS state, c_mktsegment AS tag FROM customer),
l AS (SELECT key, {SLUG.format("name")} AS s1, {SLUG.format("name || ' ' || state")} AS s2, {SLUG.format("name || ' ' || state || ' ' || tag")} AS s3 FROM p WHERE key % 97 <> 0),
old AS (SELECT key, 'kept-' || key AS slug FROM p WHERE key % 97 = 0),
a AS (SELECT * FROM l), f1 AS (SELECT min(key) AS key, s1 AS slug FROM a GROUP BY s1 HAVING count(*) = 1 AND s1 NOT IN ('maria-smith')),
b AS (SELECT * FROM a ANTI JOIN f1 USING (key)), f2 AS (SELECT min(key) AS key, s2 AS slug FROM b GROUP BY s2 HAVING count(*) = 1 AND s2 NOT IN (SELECT slug FROM f1)),
e AS (SELECT * FROM b ANTI JOIN f2 USING (key)), f3 AS (SELECT min(key) AS key, s3 AS slug FROM e GROUP BY s3 HAVING count(*) = 1 AND s3 NOT IN (SELECT slug FROM f1 UNION ALL SELECT slug FROM f2)),
g AS (SELECT key, s3, row_number() OVER (PARTITION BY s3 ORDER BY key) AS n FROM e ANTI JOIN f3 USING (key))
SELECT * FROM old UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT key, CASE WHEN n = 1 THEN s3 ELSE s3 || '-' || n END FROM g"""
)
def slug_assign(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    people = T.read(spark, d, "customer").select(k.alias("key"), _name(k, 2, 5).alias("name"), F.col("c_nationkey").alias("state"), F.col("c_mktsegment").alias("tag"))
    old = people.where("key % 97 = 0").select(F.concat(F.lit("kept-"), F.col("key").cast("string")).alias("slug"), "key")
    gone = spark.range(1).select(F.lit("maria-smith").alias("slug"), F.lit(None).cast("long").alias("key"))
    return I.assign_slugs(people, old.unionByName(gone))


@query(
    """WITH m AS (SELECT s_suppkey AS member_key, 'n' || s_suppkey % 60 AS surname, 'C' || s_suppkey % 2 AS chamber, s_suppkey % 3 <> 0 AS cur FROM supplier),
n AS (SELECT c_custkey AS name_id, 'n' || c_custkey % 70 AS surname, 'C' || c_custkey % 2 AS chamber FROM customer),
h AS (SELECT name_id, CASE WHEN n.chamber = m.chamber AND cur THEN 1 WHEN n.chamber = m.chamber THEN 2 WHEN cur THEN 3 END AS stage, member_key FROM n JOIN m USING (surname)),
g AS (SELECT name_id, stage, count(DISTINCT member_key) AS k, min(member_key) AS a FROM h WHERE stage IS NOT NULL GROUP BY 1, 2),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY stage) AS r FROM g) WHERE r = 1)
SELECT n.name_id, CASE WHEN k = 1 THEN a END AS member_key, stage, CASE WHEN stage IS NULL THEN 'unknown' WHEN k = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM n LEFT JOIN f USING (name_id)"""
)
def staged_resolution(spark: SparkSession, d: str) -> DataFrame:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    members = T.read(spark, d, "supplier").select(s.alias("member_key"), text("n", s % 60).alias("surname"), text("C", s % 2).alias("chamber"), (s % 3 != 0).alias("current"))
    names = T.read(spark, d, "customer").select(c.alias("name_id"), text("n", c % 70).alias("surname"), text("C", c % 2).alias("chamber"))
    return I.staged(names, members)


DISTRICT_SQL = "regexp_replace(regexp_replace(lower({0}), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'), '[^a-z0-9]+', '', 'g')"


@query(
    f"""WITH c AS (SELECT n_nationkey AS census_id, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS basename FROM nation),
l AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 30 AS VARCHAR) ELSE CAST(s_suppkey % 30 AS VARCHAR) || chr(CAST(65 + s_suppkey % 3 AS INTEGER)) END AS label FROM supplier UNION SELECT 'At-Large'),
k AS (SELECT label, {DISTRICT_SQL.format('label')} AS k FROM l), x AS (SELECT census_id, {DISTRICT_SQL.format('basename')} AS k FROM c),
e AS (SELECT DISTINCT census_id, label FROM x JOIN k USING (k)),
r AS (SELECT * FROM x ANTI JOIN e USING (census_id)),
f AS (SELECT census_id, label FROM r JOIN k ON k.k = r.k || 'a' OR k.k = r.k || 'b' OR k.k = r.k || 'c')
SELECT * FROM e UNION SELECT * FROM f UNION SELECT census_id, 'At-Large' FROM c"""
)
def district_match(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    census = T.read(spark, d, "nation").select(n.alias("census_id"), F.lpad(n.cast("string"), 3, "0").alias("basename"), F.lit(None).cast("string").alias("name"))
    number = (s % 30).cast("string")
    label = F.when(s % 2 == 0, number).otherwise(F.concat(number, F.char((65 + s % 3).cast("long"))))
    labels = T.read(spark, d, "supplier").select(label.alias("label")).unionByName(spark.range(1).select(F.lit("At-Large").alias("label")))
    return I.match_chamber(census, labels)


@query("WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 4 <> 0) SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN a.k IS NULL THEN 'no district' ELSE 'no member' END AS gap FROM a FULL JOIN b USING (k) WHERE a.k IS NULL OR b.k IS NULL")
def coverage_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = T.read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("custkey"))
    b = T.read(spark, d, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("custkey"))
    return I.seat_coverage(a, b, "custkey")


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'N') SELECT k AS l_orderkey, 'missing' AS status FROM a ANTI JOIN b USING (k) UNION ALL SELECT k, 'extra' FROM b ANTI JOIN a USING (k)")
def set_differences(spark: SparkSession, d: str) -> DataFrame:
    line = T.read(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    return I.set_differences(line.where("l_returnflag <> 'R'"), line.where("l_returnflag <> 'N'"), ["l_orderkey"])


@query(
    """WITH c AS (SELECT c_custkey AS position, c_custkey % 60 = 12 AS number, ['st', 'ave', 'pl'][c_custkey % 3 + 1] AS kind, ['albany', 'troy', 'alba'][c_custkey % 3 + 1] AS city, [4, 3, 0][c_custkey % 3 + 1] AS bonus,
  CASE WHEN c_custkey % 150 = 12 THEN 'exact' WHEN starts_with(CAST(c_custkey % 150 AS VARCHAR), '12') THEN 'prefix' ELSE 'none' END AS house_match FROM customer),
p AS (SELECT *, CASE house_match WHEN 'exact' THEN 40 WHEN 'prefix' THEN 12 ELSE -50 END + CASE WHEN number THEN 10 ELSE -10 END + CASE WHEN kind = 'st' THEN 10 ELSE -10 END + CASE WHEN starts_with(city, 'alb') THEN 6 ELSE -8 END + bonus AS score,
  (CASE WHEN number THEN 1 ELSE 0 END + CASE WHEN kind = 'st' THEN 1 ELSE 0 END + CASE WHEN starts_with(city, 'alb') THEN 1 ELSE 0 END) / 3.0 AS coverage FROM c)
SELECT position, score, coverage, house_match, house_match <> 'none' AND number AND kind = 'st' AND starts_with(city, 'alb') AND coverage >= 0.5 AS keep FROM p"""
)
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """How every address built from the customers scores against '12 12th St, Alb'."""
    k = F.col("c_custkey")
    street = F.concat((k % 60).cast("string"), F.when(k % 3 == 0, " Street").when(k % 3 == 1, " Avenue").otherwise(" Place"))
    city = F.element_at(F.array(*map(F.lit, ("Albany", "Troy", "Alba"))), (k % 3 + 1).cast("int"))
    rows = T.read(spark, d, "customer").select(k.alias("position"), (k % 150).cast("string").alias("house"), street.alias("street"), city.alias("city"), F.lit("NY").alias("state"), (12200 + k % 9).cast("string").alias("zip"), F.lit(None).cast("string").alias("detail"), F.element_at(F.array(*map(F.lit, ("nyc", "nys", "osm"))), (k % 3 + 1).cast("int")).alias("source"))
    return ranking.score(rows, ranking.Typed("12", ("12th", "st", "alb"), "", "NY")).select("position", "score", "coverage", "house_match", "keep")


@query(
    """WITH RECURSIVE c AS (SELECT c_custkey, 'a' || (c_custkey * 7 + c_nationkey) % (SELECT count(*) // 2 + 1 FROM customer) AS address, CASE WHEN c_custkey % 4 > 0 THEN 'p' || (c_custkey * 13) % (SELECT count(*) // 2 + 1 FROM customer) END AS point, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer),
f AS (SELECT 0 AS n, CAST(NULL AS BIGINT) AS custkey, CAST([] AS VARCHAR[]) AS seen
  UNION ALL SELECT c.n, CASE WHEN NOT list_has_any(f.seen, [address, coalesce(point, address)]) THEN c_custkey END, CASE WHEN list_has_any(f.seen, [address, coalesce(point, address)]) THEN f.seen ELSE f.seen || [address, coalesce(point, address)] END
  FROM f JOIN c ON c.n = f.n + 1)
SELECT custkey FROM f WHERE custkey IS NOT NULL"""
)
def distinct_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Customers by balance, without those who share an address or a point with one before who stays."""
    c, k = T.read(spark, d, "customer"), F.col("c_custkey")
    n = c.count() // 2 + 1
    address, point = F.concat(F.lit("a"), ((k * 7 + F.col("c_nationkey")) % n).cast("string")), F.when(k % 4 > 0, F.concat(F.lit("p"), (k * 13 % n).cast("string")))
    rows = c.select(k.alias("custkey"), F.col("c_acctbal").alias("balance"), address.alias("address"), point.alias("point"))
    return ranking.distinct_by_any(rows, F.struct((-F.col("balance")).alias("b"), "custkey"), ["address", "point"]).select("custkey")


@query("SELECT file, member_key, arg_min(party, (ordinal, party)) AS party FROM (SELECT s_suppkey % 4 AS file, s_suppkey AS member_key, s_nationkey % 3 AS ordinal, CASE WHEN s_nationkey % 2 = 0 THEN 'D' ELSE 'R' END AS party FROM supplier UNION ALL SELECT s_suppkey % 4, s_suppkey, 4 - s_nationkey % 2 * 2, 'I' FROM supplier) JOIN (SELECT DISTINCT l_suppkey AS member_key FROM lineitem WHERE l_suppkey % 5 <> 0) USING (member_key) GROUP BY ALL")
def party_roster(spark: SparkSession, d: str) -> DataFrame:
    s = T.read(spark, d, "supplier")
    file = (F.col("s_suppkey") % 4).alias("file")
    one = s.select(file, F.col("s_suppkey").alias("member_key"), (F.col("s_nationkey") % 3).alias("ordinal"), F.when(F.col("s_nationkey") % 2 == 0, "D").otherwise("R").alias("party"))
    two = s.select(file, F.col("s_suppkey").alias("member_key"), (4 - F.col("s_nationkey") % 2 * 2).alias("ordinal"), F.lit("I").alias("party"))
    votes = T.read(spark, d, "lineitem").where("l_suppkey % 5 <> 0").select((F.col("l_suppkey") % 4).alias("file"), F.col("l_suppkey").alias("member_key"))
    return I.party_roster(one.unionByName(two), votes)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['ann lee', 'king', 'van der berg'] WHEN doc_id % 3 = 1 THEN ['king', 'king'] END AS names FROM documents")
def name_segmentation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    text = F.when(k == 0, "Ann Lee King  Van der Berg").when(k == 1, "KING King").otherwise("King Nobody")
    known = F.array(*map(F.lit, ("ann lee", "ann", "king", "van der berg")))
    return T.read(spark, d, "documents").select("doc_id", I.segment_names(text, known).alias("names"))


_LETTERS = "translate(CAST({0} AS VARCHAR), '0123456789', 'abcdefghij')"


def _letters(key):
    return F.translate(key.cast("string"), "0123456789", "abcdefghij")


def _capital(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 99))


@query(
    f"""WITH RECURSIVE n AS (SELECT s_suppkey AS member_key, CASE WHEN s_suppkey % 4 = 0 THEN {_LETTERS.format("s_suppkey")} || ' ' || {_LETTERS.format("s_suppkey // 4")} ELSE {_LETTERS.format("s_suppkey")} END AS raw FROM supplier),
m AS (SELECT member_key, array_to_string(list_transform(string_split(raw, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM n),
k AS (SELECT regexp_replace(lower(name), '[^a-z]', '', 'g') AS k, min(member_key) AS member_key FROM m GROUP BY 1 HAVING count(DISTINCT member_key) = 1),
b AS (SELECT l_orderkey AS block_id, replace(string_agg(name, '|' ORDER BY l_suppkey), '|', CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE ' ' END) AS text, CAST(count(*) AS INTEGER) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS n
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN m ON member_key = l_suppkey GROUP BY l_orderkey),
w AS (SELECT block_id, n, string_split(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ') AS w FROM b),
c AS (SELECT block_id, n, w, 0 AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS INTEGER[]) AS cut FROM w
  UNION ALL SELECT c.block_id, n, w, i + j, used || [k.member_key], cut || [j] FROM c CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS j)
  JOIN k ON k.k = regexp_replace(lower(array_to_string(w[i + 1:i + j], '')), '[^a-z]', '', 'g') WHERE i + j <= len(w) AND len(used) < n AND NOT list_contains(used, k.member_key)),
d AS (SELECT block_id, arg_max(used, cut) AS members FROM c WHERE i = len(w) AND len(used) = n GROUP BY block_id)
SELECT block_id, members FROM w LEFT JOIN d USING (block_id)"""
)
def name_partition(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers of each order, printed one after the other, at times without spaces, and cut apart again."""
    s = F.col("s_suppkey")
    name = F.when(s % 4 == 0, F.concat(_capital(_letters(s)), F.lit(" "), _capital(_letters(F.floor(s / 4))))).otherwise(_capital(_letters(s)))
    roster = T.read(spark, d, "supplier").select(F.lit("c").alias("chamber"), name.alias("name"), s.alias("member_key"))
    cast = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_suppkey").alias("member_key")).join(roster, "member_key")
    names = F.sort_array(F.collect_set(F.struct("member_key", "name"))).getField("name")
    text = F.when(F.col("block_id") % 3 == 0, F.array_join("names", "")).otherwise(F.array_join("names", " "))
    blocks = cast.groupBy("block_id").agg(names.alias("names")).select("block_id", F.lit("c").alias("chamber"), text.alias("text"), (F.size("names") + (F.col("block_id") % 10 == 0).cast("int")).alias("count"))
    return I.partition_blocks(blocks, roster)


GIVEN = ["Tom", "Ann", "William", "Bo", "Mike", "Elizabeth", "Kate", "Thomas"]
_FORMAL = "CASE {0} WHEN 'tom' THEN 'thomas' WHEN 'bill' THEN 'william' WHEN 'mike' THEN 'michael' WHEN 'kate' THEN 'katherine' ELSE {0} END"


@query(
    f"""WITH m AS (SELECT s_suppkey AS member_key, lower({GIVEN!r}[s_suppkey % 8 + 1]) AS known, {_LETTERS.format("s_suppkey % 50")} AS last, CASE WHEN s_suppkey % 7 = 0 THEN 'van' ELSE '' END AS van,
  CASE WHEN s_nationkey % 2 = 0 THEN 'D' WHEN s_nationkey % 5 > 0 THEN 'R' END AS of_party, CASE WHEN s_suppkey % 3 < 2 THEN 'C' || s_suppkey % 3 END AS c FROM supplier),
k AS (SELECT member_key, known, of_party, c, unnest(list_distinct([van || last, last])) AS surname FROM m),
a AS (SELECT c_custkey AS name_id, 'C' || c_custkey % 2 AS chamber, CASE WHEN c_nationkey % 2 = 0 THEN 'D' ELSE 'R' END AS party, {_LETTERS.format("c_custkey % 60")} AS surname,
  CASE c_custkey % 5 WHEN 2 THEN 'bill' WHEN 4 THEN 'zed' END AS given, CASE c_custkey % 5 WHEN 1 THEN 't' WHEN 3 THEN 'w' WHEN 2 THEN 'b' WHEN 4 THEN 'z' END AS initial FROM customer),
h AS (SELECT name_id, member_key, given IS NOT NULL AS is_full, CASE WHEN c = chamber THEN 1 WHEN c IS NULL THEN 2 ELSE 3 END AS stage, coalesce(party = of_party, of_party IS NULL) AS own,
  CASE WHEN given IS NOT NULL THEN starts_with(known, given) OR starts_with(given, known) OR {_FORMAL.format("given")} = {_FORMAL.format("known")} WHEN initial IS NOT NULL THEN initial IN (known[1], ({_FORMAL.format("known")})[1]) ELSE true END AS fits FROM a JOIN k USING (surname)),
t AS (SELECT name_id, fits, stage, count(DISTINCT member_key) AS n, min(member_key) AS m, count(DISTINCT member_key) FILTER (own) AS own_n, min(member_key) FILTER (own) AS own_m FROM h WHERE fits OR (is_full AND stage = 1) GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY fits DESC, stage) AS o FROM t) WHERE o = 1),
r AS (SELECT a.name_id, f.stage, f.n IS NULL OR (NOT f.fits AND f.n > 1) AS gone, CASE WHEN f.n = 1 THEN f.m WHEN f.fits AND f.own_n = 1 THEN f.own_m END AS member_key FROM a LEFT JOIN f USING (name_id))
SELECT name_id, member_key, CASE WHEN NOT gone THEN stage END AS stage, CASE WHEN gone THEN 'unknown' WHEN member_key IS NOT NULL THEN 'found' ELSE 'ambiguous' END AS status FROM r"""
)
def name_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as names printed in five ways, suppliers as members."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    family = F.concat(F.when(s % 7 == 0, "Van ").otherwise(F.lit("")), _capital(_letters(s % 50)))
    members = T.read(spark, d, "supplier").select(s.alias("member_key"), F.get(F.array(*map(F.lit, GIVEN)), (s % 8).cast("int")).alias("given"), family.alias("family"), F.when(F.col("s_nationkey") % 2 == 0, "D").when(F.col("s_nationkey") % 5 > 0, "R").alias("party"), F.when(s % 3 < 2, F.concat(F.lit("C"), (s % 3).cast("string"))).alias("chamber"))
    last, k = _capital(_letters(c % 60)), c % 5
    printed = F.when(k == 0, last).when(k == 1, F.concat(last, F.lit(", T."))).when(k == 2, F.concat(F.lit('Bill "Buddy" '), last)).when(k == 3, F.concat(F.lit("W. "), last, F.lit(", Jr."))).otherwise(F.concat(F.lit("Zed Q. "), last))
    names = T.read(spark, d, "customer").select(c.alias("name_id"), F.concat(F.lit("C"), (c % 2).cast("string")).alias("chamber"), printed.alias("printed"), F.when(F.col("c_nationkey") % 2 == 0, "D").otherwise(F.lit("R")).alias("party"))
    return I.resolve_names(names, members)
