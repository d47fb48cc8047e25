"""Queries of state slates, of the members that district keys name, and of all sources in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import slates as S
from ..sources import connectors
from ..sources import driver_tables as T
from . import query
from .labels import STATES_SQL, of, text

PLACES = ["MA", "WA", "VT", "TX"]
ENDS = ["1st Essex", "2nd Essex and Middlesex", "Bennigton", "007", "Windham", "9th Norfolk & Suffolk"]

BARE = "regexp_replace(regexp_replace(regexp_replace(CASE WHEN state = 'WA' THEN regexp_replace(office, '-Position [0-9]+$', '') ELSE office END, '(?i)^District[: ]+', ''), '(?i) District$', ''), '^0+([0-9])', '\\1')"
CANON = "regexp_replace(replace(lower({0}), '&', 'and'), '[^a-z0-9]+', '', 'g')"
SHAPE = "regexp_replace(regexp_replace({0}, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '#', 'g')"


@query(
    f"""WITH o AS (SELECT c_custkey AS office_id, {PLACES}[c_custkey % 4 + 1] AS state, CASE WHEN c_custkey % 3 = 0 THEN 'upper' ELSE 'lower' END AS chamber,
  CASE c_custkey % 5 WHEN 0 THEN 'District ' || lpad(CAST(c_custkey % 90 AS VARCHAR), 3, '0') WHEN 1 THEN 'District ' || c_custkey % 90 || '-Position 2' ELSE {ENDS}[c_custkey // 5 % 6 + 1] || CASE WHEN c_custkey % 5 = 2 THEN ' District' ELSE '' END END AS office FROM customer),
k AS (SELECT DISTINCT {PLACES}[s_suppkey % 4 + 1] AS state, CASE WHEN s_suppkey % 3 = 0 THEN 'upper' ELSE 'lower' END AS chamber, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 90 AS VARCHAR) ELSE ['First Essex', 'Second Essex and Middlesex', 'Bennington', '7', 'WINDHAM', '9th Norfolk and Suffolk'][s_suppkey // 2 % 6 + 1] END AS label FROM supplier),
b AS (SELECT *, {BARE} AS bare FROM o),
r AS (SELECT *, CASE state WHEN 'MA' THEN regexp_replace(regexp_replace(regexp_replace(bare, '^1(st|nd|rd|th) ', 'First '), '^2(st|nd|rd|th) ', 'Second '), '^3(st|nd|rd|th) ', 'Third ') WHEN 'VT' THEN replace(bare, 'Bennigton', 'Bennington') ELSE bare END AS fixed FROM b),
f AS (SELECT office_id, state, chamber, unnest([bare, office, fixed]) AS t, unnest([0, 1, 2]) AS place FROM r),
h AS (SELECT office_id, place * 2 AS rank, label FROM f JOIN k USING (state, chamber) WHERE k.label = t UNION ALL SELECT office_id, place * 2 + 1, min(label) FROM f JOIN k USING (state, chamber) WHERE {CANON.format("k.label")} = {CANON.format("t")} GROUP BY ALL),
g AS (SELECT office_id, arg_min(label, rank) AS found FROM h GROUP BY 1),
v AS (SELECT r.*, found, found IS NULL AND regexp_matches(bare, '[0-9]') AND EXISTS (SELECT 1 FROM k WHERE k.state = r.state AND k.chamber = r.chamber AND {SHAPE.format("k.label")} = {SHAPE.format("r.bare")}) AS vacant FROM r LEFT JOIN g USING (office_id))
SELECT office_id, CASE WHEN vacant THEN bare ELSE found END AS label, vacant FROM v"""
)
def slate_districts(spark: SparkSession, d: str) -> DataFrame:
    """Offices of a slate as districts, vacant seats by their shape."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    chamber = lambda k: F.when(k % 3 == 0, "upper").otherwise("lower")
    number = (c % 90).cast("string")
    office = F.when(c % 5 == 0, F.concat(F.lit("District "), F.lpad(number, 3, "0"))).when(c % 5 == 1, F.concat(F.lit("District "), number, F.lit("-Position 2"))).otherwise(F.concat(of(ENDS, F.floor(c / 5)), F.when(c % 5 == 2, " District").otherwise("")))
    offices = T.read(spark, d, "customer").select(c.alias("office_id"), of(PLACES, c).alias("state"), chamber(c).alias("chamber"), office.alias("office"))
    label = F.when(s % 2 == 0, (s % 90).cast("string")).otherwise(of(["First Essex", "Second Essex and Middlesex", "Bennington", "7", "WINDHAM", "9th Norfolk and Suffolk"], F.floor(s / 2)))
    return S.slate_districts(offices, T.read(spark, d, "supplier").select(of(PLACES, s).alias("state"), chamber(s).alias("chamber"), label.alias("label")), vacancies=True)


@query(
    f"""WITH {STATES_SQL}, v AS (SELECT c_custkey AS voter_id, ['tx', 'va', 'ne'][c_custkey % 3 + 1] AS state, unnest(['upper', 'lower']) AS side, CAST(c_custkey // 10 AS VARCHAR) AS n FROM customer),
s AS (SELECT o_orderkey AS cand_id, ['tx', 'va', 'ne'][o_orderkey % 3 + 1] AS state, CASE WHEN o_orderkey % 3 = 2 THEN 'legislature' WHEN o_orderkey // 3 % 2 = 0 THEN 'upper' ELSE 'lower' END AS chamber, CAST(o_custkey // 10 AS VARCHAR) || CASE WHEN o_custkey // 10 % 8 = 0 THEN 'AB'[o_orderkey % 2 + 1] ELSE '' END AS label, 'Pat L' || o_custkey % 5 AS name, o_orderkey % 4 = 0 AS incumbent FROM orders),
r AS (SELECT s_suppkey AS official_id, ['tx', 'va', 'ne'][s_suppkey % 3 + 1] AS state, CASE WHEN s_suppkey % 3 = 2 THEN 'legislature' WHEN s_suppkey // 3 % 2 = 0 THEN 'upper' ELSE 'lower' END AS chamber, CAST(s_suppkey AS VARCHAR) AS label, 'l' || s_suppkey % 5 AS last FROM supplier),
h AS (SELECT state, chamber, label, last, min(official_id) AS official_id FROM r GROUP BY ALL),
f AS (SELECT s.*, official_id, CASE WHEN s.chamber = 'lower' THEN 'lower' ELSE 'upper' END AS side FROM s LEFT JOIN h ON h.state = s.state AND h.chamber = s.chamber AND h.label = s.label AND incumbent AND h.last = lower(split_part(s.name, ' ', 2))),
m AS (SELECT DISTINCT state, side, n FROM v), e AS (SELECT DISTINCT m.*, f.label FROM m JOIN f ON f.state = m.state AND f.side = m.side AND f.label = m.n),
g AS (SELECT DISTINCT m.*, f.label FROM m JOIN f ON f.state = m.state AND f.side = m.side AND f.label IN (m.n || 'A', m.n || 'B') WHERE (m.state, m.side, m.n) NOT IN (SELECT (state, side, n) FROM e)),
a AS (SELECT * FROM e UNION SELECT * FROM g)
SELECT DISTINCT voter_id, f.state || '-' || chamber || '-' || label AS seat, o.office, state_name || ' ' || regexp_replace(o.office, '^State ', '') || ' District ' || label AS title, cand_id, official_id
FROM v JOIN a USING (state, side, n) JOIN f USING (state, side, label) JOIN states ON code = upper(f.state), LATERAL (SELECT CASE WHEN chamber = 'legislature' THEN 'Unicameral Legislature' WHEN chamber = 'upper' THEN 'State Senate' WHEN f.state = 'va' THEN 'House of Delegates' ELSE 'State House' END AS office) o"""
)
def state_seats(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for the state seats of every voter's two districts (ten voters each); seats lettered within a district too."""
    c, o, s = F.col("c_custkey"), F.col("o_orderkey"), F.col("s_suppkey")
    state = lambda k: of(["tx", "va", "ne"], k)
    chamber = lambda k: F.when(k % 3 == 2, "legislature").when(F.floor(k / 3) % 2 == 0, "upper").otherwise("lower")
    districts = T.read(spark, d, "customer").select(c.alias("voter_id"), F.upper(state(c)).alias("state"), F.explode(F.array(F.lit("upper"), F.lit("lower"))).alias("side"), F.lpad(F.floor(c / 10).cast("string"), 12, "0").alias("basename"), F.lit(None).cast("string").alias("name"))
    at = F.floor(F.col("o_custkey") / 10)
    label = F.concat(at.cast("string"), F.when(at % 8 == 0, of(["A", "B"], o)).otherwise(""))
    slates = T.read(spark, d, "orders").select(F.concat_ws("-", state(o), chamber(o), label).alias("seat"), o.alias("cand_id"), text("Pat L", F.col("o_custkey") % 5).alias("name"), (o % 4 == 0).alias("incumbent"))
    roster = T.read(spark, d, "supplier").select(s.alias("official_id"), state(s).alias("state"), chamber(s).alias("chamber"), s.cast("string").alias("label"), text("Sam L", s % 5).alias("name"))
    return S.state_seats(districts, slates, roster)


@query(
    """WITH k AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 36, '0') AS id FROM customer), s AS (SELECT 'f' || i AS file, ['U.S. HOUSE', 'U.S. SENATE', 'NY SENATE', 'NYC COUNCIL', NULL, NULL][i + 1] AS chamber, ['tx', 'ny'][i - 3] AS jurisdiction FROM range(6) t(i)),
h AS (SELECT 'f' || s_suppkey % 2 AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'tx-' || s_suppkey % 60 ELSE 'sen-tx-' || (s_suppkey % 4 // 2 + 1) END AS code, min(s_suppkey) AS m FROM supplier GROUP BY 1, 2)
SELECT 'us-house-tx-' || k AS district_key, file, 'M' || m AS member_key FROM k JOIN h ON file = 'f0' AND code = 'tx-' || k WHERE k % 7 = 0
UNION ALL SELECT DISTINCT 'us-sen-tx-' || (k % 3), file, 'M' || m FROM k JOIN h ON file = 'f1' AND code = 'sen-tx-' || (k % 3) WHERE k % 7 = 1
UNION ALL SELECT 'ny-sd-' || k, 'f2', CAST(k AS VARCHAR) FROM k WHERE k % 7 = 2 UNION ALL SELECT 'nyc-council-' || k, 'f3', CAST(k AS VARCHAR) FROM k WHERE k % 7 = 3
UNION ALL SELECT 'tx-lower-' || id, 'f4', 'ocd-person/' || id FROM k WHERE k % 7 = 5"""
)
def district_member_keys(spark: SparkSession, d: str) -> DataFrame:
    """Who the keys of districts name in the snapshots of their chambers; two grammars have no snapshot here."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    ocd = F.lpad(c.cast("string"), 36, "0")
    grammars = [text("us-house-tx-", c), text("us-sen-tx-", c % 3), text("ny-sd-", c), text("nyc-council-", c), text("ny-ad-", c), F.concat(F.lit("tx-lower-"), ocd)]
    key = F.coalesce(*[F.when(c % 7 == i, g) for i, g in enumerate(grammars)], F.concat(F.lit("ny-upper-"), ocd))
    keys = T.read(spark, d, "customer").select(key.alias("district_key"))
    held = T.read(spark, d, "supplier")
    code = F.when(s % 2 == 0, text("tx-", s % 60)).otherwise(text("sen-tx-", F.floor(s % 4 / 2) + 1))
    members = held.groupBy(text("f", s % 2).alias("file"), code.alias("code")).agg(text("M", F.min("s_suppkey")).alias("member_key"))
    rows = [("f0", "U.S. HOUSE", None, None), ("f1", "U.S. SENATE", None, None), ("f2", "NY SENATE", None, None), ("f3", "NYC COUNCIL", None, None), ("f4", "TX HOUSE", "tx", "lower"), ("f5", "NY SENATE", "ny", "upper")]
    snapshots = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("file", "chamber", "jurisdiction", "legislative_chamber"), r)]) for r in rows])))
    return S.district_member_keys(keys, snapshots, members)


NAMES = list(connectors.SOURCES)
#: What each source prints for a choice, in its own order; the fallbacks of the sources that list no word for it.
SAID = {(s, c): [w for w, x in connectors.SOURCES[s].codes.items() if x == c and w] for s in NAMES for c in ("yes", "no", "absent", "present")}
NO_WORD = {"nh": "Not Voting/Excused"}
WORDS = [(s, c, i, w) for (s, c), words in SAID.items() for i, w in enumerate(words)]
HAS_PRESENT = [s for s in NAMES if SAID[s, "present"]]
NO_ABSENT = [s for s in NAMES if not SAID[s, "absent"] and not connectors.SOURCES[s].other and s not in NO_WORD]


def _policy(p: str) -> str:
    return ", ".join(f"'{s}'" for s in NAMES if connectors.SOURCES[s].policy == p) or "''"


@query(
    f"""WITH {T.VIEWS}, p AS (SELECT roll_id, {NAMES}[roll_id % {len(NAMES)} + 1] AS source, member_key, choice FROM ballots JOIN members USING (member_key)),
c AS (SELECT roll_id, source, member_key, CASE WHEN choice = 'absent' AND member_key % 4 = 0 AND source IN ({", ".join(f"'{s}'" for s in HAS_PRESENT)}) THEN 'present' ELSE choice END AS choice FROM p),
k AS (SELECT * FROM c WHERE NOT (choice = 'absent' AND source IN ({", ".join(f"'{s}'" for s in NO_ABSENT)}))),
t AS (SELECT source, roll_id, count(*) FILTER (choice = 'yes') AS yes, count(*) FILTER (choice = 'no') AS no, count(*) FILTER (choice = 'absent') AS absent, count(*) FILTER (choice = 'present') AS present, count(*) FILTER (member_key % 9 <> 0) AS resolved FROM k GROUP BY 1, 2),
b AS (SELECT DISTINCT roll_id FROM c WHERE source = 'ct' AND choice = 'absent' AND member_key % 5 = 0)
SELECT source, roll_id, yes, no, absent, present, resolved, CASE WHEN source IN ({_policy("none")}) THEN NULL ELSE roll_id // {len(NAMES)} % 2 = 1 END AS agrees FROM t
WHERE NOT (source IN ({_policy("drop")}) AND roll_id // {len(NAMES)} % 2 = 0) AND roll_id NOT IN (SELECT roll_id FROM b)"""
)
def all_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every roll call printed by one of all sources in each of its words, coded, resolved and counted in one pass; every
    other round of sources prints a wrong tally."""
    m, r = F.col("member_key"), F.col("roll_id")
    source = of(NAMES, r)
    p = T.ballots(spark, d).join(T.members(spark, d).select("member_key"), "member_key").select("roll_id", source.alias("source"), "member_key", "choice")
    p = p.withColumn("said", F.when((F.col("choice") == "absent") & (m % 4 == 0) & F.col("source").isin(HAS_PRESENT), "present").otherwise(F.col("choice")))
    words = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(c).alias("said"), F.array(*map(F.lit, w)).alias("words")) for (s, c), w in SAID.items() if w])))
    fallback: Column = F.when(F.col("source") == "nh", NO_WORD["nh"]).otherwise("no position")
    odd = (F.col("source") == "ct") & (F.col("said") == "absent") & (m % 5 == 0)
    raw = F.when(odd, "?").otherwise(F.coalesce(F.get("words", (m % F.size("words")).cast("int")), fallback))
    name = text("Lee & Fox, ", m)
    printed = p.join(F.broadcast(words), ["source", "said"], "left").select("source", "roll_id", name.alias("name"), raw.alias("raw"))
    count = lambda c: F.count(F.when(F.col("choice") == c, 1))
    tally = p.groupBy("source", "roll_id").agg((count("yes") + F.when(F.floor(r / len(NAMES)) % 2 == 0, 1).otherwise(0)).alias("printed_yes"), count("no").alias("printed_no"))
    roster = T.members(spark, d).where("member_key % 9 <> 0").select(F.explode(F.array(*map(F.lit, NAMES))).alias("source"), name.alias("name"), "member_key")
    rolls, votes = connectors.ingest_all(tally, printed, roster)
    counts = votes.groupBy("source", "roll_id").agg(count("absent").alias("absent"), count("present").alias("present"), F.count("member_key").alias("resolved"))
    return rolls.join(counts, ["source", "roll_id"]).select("source", "roll_id", "yes", "no", "absent", "present", "resolved", "agrees")
