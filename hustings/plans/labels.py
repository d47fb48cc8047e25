"""Queries of the names and sentences that pages show, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import guide as G
from ..operators import split as S
from ..sources import driver_tables as T
from . import ORACLES, query
from .guide import alignment_counts
from .votes import SPLITS, roll_split

CODES = ["TX", "VA", "NJ", "CA", "NE", "DC", "NY", "WI", "WV", "zz"]
CHAMBERS = ["upper", "lower", "legislature"]
STATES_SQL = "states(code, state_name) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.STATES.items()) + ")"
LOWER_SQL = "lowers(code, body) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.LOWER_CHAMBERS.items()) + ")"


def of(values: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))


def text(prefix: str, k: Column) -> Column:
    return F.concat(F.lit(prefix), k.cast("string"))


@query(
    f"""WITH {SPLITS} SELECT roll_id, CASE WHEN s = '' THEN '' ELSE upper(s[1]) || s[2:] END AS sides
FROM (SELECT roll_id, concat_ws('; ', 'most Democrats voted ' || d_side, 'most Republicans voted ' || r_side) AS s FROM splits)"""
)
def roll_sides(spark: SparkSession, d: str) -> DataFrame:
    """One sentence on how most of each party voted, for every roll call."""
    return roll_split(spark, d).select("roll_id", S.sides_sentence().alias("sides"))


@query(
    f"""WITH a AS ({ORACLES["alignment_counts"]})
SELECT race_id, cand_id, concat_ws(' · ', 'Statements: same as you on ' || same || ', different on ' || different || CASE WHEN mixed > 0 THEN ', mixed on ' || mixed ELSE '' END,
  CASE WHEN in_line + not_in_line > 0 THEN 'Recorded votes: ' || in_line || CASE WHEN in_line = 1 THEN ' vote' ELSE ' votes' END || ' in line with your answers, ' || not_in_line || ' not' END,
  'No record on ' || none || ' of the ' || answered || CASE WHEN answered = 1 THEN ' topic' ELSE ' topics' END || ' you answered') AS sentence FROM a"""
)
def alignment_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Plain tallies of each candidate in one line."""
    return alignment_counts(spark, d).select("race_id", "cand_id", L.counts_sentence().alias("sentence"))


STATUS = ["called", "runoff", "uncalled", "measure", "called"]


@query(
    f"""WITH o AS (SELECT o_orderkey AS race_id, {STATUS}[o_orderkey % 5 + 1] AS s, o_orderkey % 3 = 0 AS unconfirmed, CASE WHEN o_custkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS outcome, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey ELSE -1 END AS winner, o_custkey FROM orders)
SELECT race_id, CASE s WHEN 'runoff' THEN 'Goes to a runoff' WHEN 'uncalled' THEN CASE WHEN unconfirmed THEN 'Result not confirmed yet' ELSE 'Not yet called' END WHEN 'measure' THEN CASE WHEN outcome = 'approved' THEN 'Approved' ELSE 'Rejected' END
  ELSE coalesce(c_name || ', projected winner', 'Winner projected') END AS headline FROM o LEFT JOIN customer ON c_custkey = winner"""
)
def result_headlines(spark: SparkSession, d: str) -> DataFrame:
    """A line on each race's result: races are orders, their candidates the customers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = T.read(spark, d, "orders")
    status = of(STATUS, k)
    results = o.select(k.alias("race_id"), F.when(status == "measure", "called").otherwise(status).alias("status"), (k % 3 == 0).alias("unconfirmed"), F.when(status == "measure", F.when(c % 2 == 0, "approved").otherwise("rejected")).alias("outcome"), F.when(k % 7 > 0, c).otherwise(-1).alias("winner"))
    candidates = o.join(T.read(spark, d, "customer"), c == F.col("c_custkey")).select(k.alias("race_id"), c.alias("cand_id"), F.col("c_name").alias("name"))
    return G.result_lines(o.select(k.alias("race_id")), candidates, results)


@query(
    f"""WITH {STATES_SQL}, {LOWER_SQL}, c AS (SELECT c_custkey, {CODES}[c_custkey % 10 + 1] AS st, {CHAMBERS}[c_custkey // 10 % 3 + 1] AS ch FROM customer),
n AS (SELECT c_custkey, upper(st) AS st, ch, coalesce(body, 'State House') AS low, coalesce(state_name, upper(st)) AS state_name FROM c LEFT JOIN states ON states.code = upper(st) LEFT JOIN lowers ON lowers.code = upper(st)),
m AS (SELECT *, CASE WHEN st = 'DC' THEN 'D.C. Council' WHEN ch = 'legislature' THEN 'Unicameral Legislature' WHEN ch = 'upper' THEN 'State Senate' ELSE low END AS name FROM n),
k AS (SELECT *, CASE WHEN st = 'DC' THEN 'DC COUNCIL' WHEN ch = 'legislature' THEN st || ' LEGISLATURE' ELSE st || ' ' || upper(regexp_replace(name, '^State ', '')) END AS stored FROM m)
SELECT c_custkey, name, stored, CASE low WHEN 'State Assembly' THEN 'Assembly Member' WHEN 'General Assembly' THEN 'General Assembly Member' WHEN 'House of Delegates' THEN 'Delegate' ELSE 'State Representative' END AS title,
  CASE WHEN st = 'DC' THEN 'D.C. Council' WHEN ch = 'legislature' THEN state_name || ' Legislature' ELSE state_name || ' ' || regexp_replace(name, '^State ', '') END AS label, lower(st) AS state FROM k"""
)
def chamber_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of chambers and their members, as stored and as readers see them."""
    k = F.col("c_custkey")
    st, ch = of(CODES, k), of(CHAMBERS, F.floor(k / 10))
    stored = L.snapshot_chamber(st, ch)
    return T.read(spark, d, "customer").select(k, L.chamber_name(st, ch).alias("name"), stored.alias("stored"), L.lower_title(st).alias("title"), L.chamber_label(stored).alias("label"), X.chamber_state(stored).alias("state"))


@query(
    """WITH k AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'us-house-tx-' || c_custkey WHEN 1 THEN 'us-house-ak-al' WHEN 2 THEN 'ny-sd-' || c_custkey WHEN 3 THEN 'ny-ad-' || c_custkey WHEN 4 THEN 'ma-' || CASE WHEN c_custkey % 4 = 0 THEN 'upper' ELSE 'lower' END || '-Second Essex ' || c_custkey ELSE 'mayor-' || c_custkey END AS seat FROM customer)
SELECT seat, CASE k % 6 WHEN 0 THEN 'tx' WHEN 1 THEN 'ak' WHEN 2 THEN 'ny' WHEN 3 THEN 'ny' WHEN 4 THEN 'ma' END AS state, CASE k % 6 WHEN 0 THEN 'U.S. House' WHEN 1 THEN 'U.S. House' WHEN 2 THEN 'State Senate' WHEN 3 THEN 'State Assembly' WHEN 4 THEN CASE WHEN k % 4 = 0 THEN 'State Senate' ELSE 'State House' END END AS office,
  CASE WHEN k % 6 = 1 THEN 'AL' WHEN k % 6 < 4 THEN CAST(k AS VARCHAR) WHEN k % 6 = 4 THEN 'Second Essex ' || k END AS district,
  CASE k % 6 WHEN 0 THEN 'house-' || k WHEN 1 THEN 'house-al' WHEN 2 THEN 'senate-' || k WHEN 3 THEN 'assembly-' || k WHEN 4 THEN CASE WHEN k % 4 = 0 THEN 'senate' ELSE 'house' END || '-second-essex-' || k END AS tag,
  CASE k % 6 WHEN 0 THEN 'U.S. House · TX-' || k WHEN 1 THEN 'U.S. House · AK-AL' WHEN 2 THEN 'New York Senate District ' || k WHEN 3 THEN 'New York Assembly District ' || k WHEN 4 THEN 'Massachusetts ' || CASE WHEN k % 4 = 0 THEN 'Senate' ELSE 'House' END || ' Second Essex ' || k END AS label FROM k"""
)
def slate_offices(spark: SparkSession, d: str) -> DataFrame:
    """Office, district and label of the keys of seats; other keys have none."""
    k = F.col("c_custkey")
    keys = [text("us-house-tx-", k), F.lit("us-house-ak-al"), text("ny-sd-", k), text("ny-ad-", k), F.concat(F.lit("ma-"), F.when(k % 4 == 0, "upper").otherwise("lower"), text("-Second Essex ", k))]
    seat = F.coalesce(*[F.when(k % 6 == i, key) for i, key in enumerate(keys)], text("mayor-", k))
    rows = T.read(spark, d, "customer").select(seat.alias("seat")).withColumn("o", L.slate_office(F.col("seat")))
    return rows.select("seat", "o.state", "o.office", "o.district", "o.tag", L.ballot_label(F.col("o.office"), F.col("o.district"), F.upper("o.state")).alias("label"))


BILLS = [*L.FEDERAL_BILLS, "PN", "HR", "A."]


@query(
    f"""WITH o AS (SELECT o_orderkey, {BILLS}[o_orderkey % {len(BILLS)} + 1] AS p FROM orders)
SELECT o_orderkey, CASE WHEN p = 'PN' THEN 'nomination' WHEN p NOT IN ('HR', 'A.') THEN 'bill' END AS kind, CASE WHEN p NOT IN ('PN', 'HR', 'A.') THEN lower(replace(p, '.', '')) END AS type, CASE WHEN p NOT IN ('HR', 'A.') THEN CAST(o_orderkey AS VARCHAR) END AS number FROM o"""
)
def federal_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Bills and nominations as displayed, parsed."""
    k = F.col("o_orderkey")
    p = of(BILLS, k)
    shown = F.when(p == "PN", F.concat(p, k.cast("string"), F.when(k % 2 == 0, "-1").otherwise(""))).otherwise(F.concat_ws(" ", p, k.cast("string")))
    rows = T.read(spark, d, "orders").select(k, L.federal_subject(shown).alias("s"))
    return rows.select(k, "s.kind", "s.type", "s.number")


UNSHOUT = r"""CASE WHEN length(regexp_replace({0}, '[^a-zA-Z]+', '', 'g')) > 20 AND 5 * length(regexp_replace({0}, '[^A-Z]+', '', 'g')) > 4 * length(regexp_replace({0}, '[^a-zA-Z]+', '', 'g'))
THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}[1] || lower({0}[2:]), '\bnew york\b', 'New York', 'g'), '\bfy\b', 'FY', 'g'), '\bmn\b', 'MN', 'g'), '\blu\b', 'LU', 'g'), '\bnyc\b', 'NYC', 'g') ELSE {0} END"""
FIRST = r"coalesce(nullif(regexp_extract({0}, '(?s)^(.*?[.!?])( |$)', 1), ''), {0})"


@query(
    rf"""WITH a AS (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(coalesce(text, ''), '[^a-zA-Z.!? ]', ' ', 'g') ELSE coalesce(text, '') END, '[ \t\r\n\f]+', ' ', 'g'), ' ') AS t0 FROM documents),
b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(t0) ELSE t0 END AS t, 'Title ' || doc_id AS title FROM a),
c AS (SELECT *, {UNSHOUT.format("t")} AS u, CASE WHEN t = '' OR length({FIRST.format("t")}) > 240 THEN title ELSE t END AS src FROM b),
e AS (SELECT *, {FIRST.format("(" + UNSHOUT.format("src") + ")")} AS f FROM c)
SELECT doc_id, CASE WHEN length(u) > 120 THEN regexp_replace(u[1:120], '[,;: ]+[^ ]*$', '') || '…' ELSE u END AS card, CASE WHEN regexp_matches(f, '[.!?]$') THEN f ELSE f || '.' END AS sentence FROM e"""
)
def agenda_titles(spark: SparkSession, d: str) -> DataFrame:
    """Card titles and summary sentences of whole texts, every other one shouted."""
    k = F.col("doc_id")
    plain = F.coalesce("text", F.lit(""))
    t = F.when(k % 2 == 0, F.upper(F.regexp_replace(plain, "[^a-zA-Z.!? ]", " "))).otherwise(plain)
    rows = T.read(spark, d, "documents").select(k, t.alias("t"))
    return rows.select(k, L.card_title(F.col("t")).alias("card"), L.summary_sentence(F.col("t"), text("Title ", k)).alias("sentence"))


@query(
    f"""WITH n AS (SELECT p_partkey, upper(p_name) || ' PAC OF ' || upper(p_type) || '-' || upper(p_brand) || ' (THE) FOR USA/' || upper(p_name) AS name FROM part),
w AS (SELECT p_partkey, unnest(string_split(name, ' ')) AS w, generate_subscripts(string_split(name, ' '), 1) AS i FROM n),
k AS (SELECT *, regexp_replace(w, '[^A-Z-]', '', 'g') AS bare FROM w),
m AS (SELECT p_partkey, i, CASE WHEN bare IN ({", ".join(f"'{c}'" for c in L.COMMITTEE_CAPITALS)}) OR (starts_with(w, '(') AND length(bare) <= 5) THEN w WHEN i > 1 AND lower(w) IN ({", ".join(f"'{c}'" for c in L.COMMITTEE_SMALL)}) THEN lower(w)
  ELSE regexp_replace(array_to_string(list_transform(string_split(regexp_replace(lower(w), '([-(/])', '\\1 ', 'g'), ' '), lambda x: upper(x[1]) || x[2:]), ' '), '([-(/]) ', '\\1', 'g') END AS w FROM k)
SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS name FROM m GROUP BY 1"""
)
def committee_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of committees in capitals, as titles."""
    up = F.upper
    name = F.concat(up("p_name"), F.lit(" PAC OF "), up("p_type"), F.lit("-"), up("p_brand"), F.lit(" (THE) FOR USA/"), up("p_name"))
    return T.read(spark, d, "part").select("p_partkey", L.committee_name(name).alias("name"))


@query(
    r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]+')) AS s, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]+'), 1) AS i FROM documents),
c AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s),
e AS (SELECT doc_id, min(i) FILTER (i > 1 AND upto > 320) AS over, min(i) FILTER (upto > 180) AS enough FROM c GROUP BY 1),
t AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS out FROM c JOIN e USING (doc_id) WHERE i < coalesce(over, i + 1) AND i <= coalesce(enough, i) GROUP BY 1)
SELECT doc_id, trim(coalesce(out, text, ''), ' ') AS condensed FROM documents LEFT JOIN t USING (doc_id)"""
)
def condensed(spark: SparkSession, d: str) -> DataFrame:
    """The first sentences of every whole text, as far as a card holds."""
    return T.read(spark, d, "documents").select("doc_id", X.condense(F.coalesce("text", F.lit(""))).alias("condensed"))


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ann b lee' || c_custkey WHEN 1 THEN 'bo customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS nominee, CASE WHEN c_custkey % 99 IN (0, 98) THEN 'al' ELSE CAST(c_custkey % 99 AS VARCHAR) END AS seat,
CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS unpadded, c_custkey % 3 = 0 AS at_large FROM customer"""
)
def nominees_and_seats(spark: SparkSession, d: str) -> DataFrame:
    """Nominees in titles of votes, seats of Congress, numbers without padding and labels that mean at large."""
    k = F.col("c_custkey")
    n = k.cast("string")
    title = F.when(k % 5 == 0, F.concat(F.lit("Confirmation: Ann B. Lee"), n, F.lit(", of Utah, to be Consul"))).when(k % 5 == 1, F.concat(F.lit("Motion to Invoke Cloture: Bo "), F.col("c_name"), F.lit(" to be Judge"))).when(k % 5 == 2, F.concat(F.lit("Confirmation: Executive Calendar "), n, F.lit(", to be Judge"))).otherwise(F.concat(F.lit("On Passage: "), n))
    label = F.when(k % 3 == 0, of(["At-Large", "at large ", "Chairman"], F.floor(k / 3))).otherwise(F.concat(F.lit("Ward "), n))
    return T.read(spark, d, "customer").select(k, X.nominee(title).alias("nominee"), X.congress_seat((k % 99).cast("string")).alias("seat"), X.unpad(F.when(k % 2 == 0, F.lpad(n, 12, "0")).otherwise(F.concat(n, F.lit("A")))).alias("unpadded"), X.is_at_large(label).alias("at_large"))
