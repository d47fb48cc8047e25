"""Queries of the issue explorer, over the civic view of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explorer as X
from ..operators import topics
from ..sources import driver_tables as T
from . import query
from .votes import SPLITS, scored

TOPIC_LIST = "list_filter([CASE WHEN title LIKE '%ring%' THEN 'health' END, CASE WHEN title LIKE '%blue%' THEN 'climate' END], lambda x: x IS NOT NULL)"
RECORDS = SPLITS + f", records AS (SELECT *, {TOPIC_LIST} AS topics FROM scored)"


def records(spark: SparkSession, d: str) -> DataFrame:
    found = [F.when(F.contains("title", F.lit("ring")), "health"), F.when(F.contains("title", F.lit("blue")), "climate")]
    return scored(spark, d).withColumn("topics", F.array_compact(F.array(*found)))


SHOWN = ["roll_id", "bill", "title", "kind", "chamber", "roll_date", "split_kind", "is_close", "contention"]


@query(f"WITH {RECORDS} SELECT {', '.join(SHOWN)} FROM records WHERE (list_contains(topics, 'health') OR len(topics) = 0) AND chamber = 'CHAMBER 1' AND kind = 'substantive' AND is_split")
def explorer_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.filter_records(records(spark, d), X.Filters(topics=["health", "other"], chamber="CHAMBER 1", kind="substantive")).select(*SHOWN)


@query(f"WITH {RECORDS} SELECT {', '.join(SHOWN)} FROM records WHERE regexp_replace(lower(bill), '[\\s.-]+', '', 'g') = 'brand#12'")
def explorer_bill_search(spark: SparkSession, d: str) -> DataFrame:
    """Bills here are brands; '#' keeps them from reading as bill numbers, so the query is looked for in the text."""
    return X.filter_records(records(spark, d), X.Filters(query=" Brand#12 ")).where(X.norm_bill(F.col("bill")) == "brand#12").select(*SHOWN)


@query(f"WITH {RECORDS}, b AS (SELECT *, replace(bill, 'Brand#', 'H.R. ') AS number FROM records) SELECT roll_id, number AS bill FROM b WHERE regexp_replace(lower(number), '[\\s.-]+', '', 'g') = 'hr1'")
def explorer_bill_number(spark: SparkSession, d: str) -> DataFrame:
    """A bill number finds its bill only, whatever longer numbers start with it."""
    named = records(spark, d).withColumn("bill", F.replace("bill", F.lit("Brand#"), F.lit("H.R. ")))
    return X.filter_records(named, X.Filters(query="hr-1")).select("roll_id", "bill")


@query(f"WITH {RECORDS} SELECT {', '.join(SHOWN)} FROM records WHERE is_close AND contains(lower(concat_ws(' ', bill, title, '', question)), 'widget')")
def explorer_text_search(spark: SparkSession, d: str) -> DataFrame:
    return X.filter_records(records(spark, d), X.Filters(query="Widget", show="close")).select(*SHOWN)


@query(f"WITH {RECORDS} SELECT topic, count(*) AS records FROM (SELECT unnest(CASE WHEN len(topics) = 0 THEN ['other'] ELSE topics END) AS topic FROM records WHERE kind = 'substantive' AND split_kind = 'crossed') GROUP BY 1")
def explorer_facets(spark: SparkSession, d: str) -> DataFrame:
    return X.topic_facets(records(spark, d), X.Filters(topics=["health"], kind="substantive", show="crossed"))


@query(f"WITH {RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY chamber, coalesce(nullif(bill, ''), title) ORDER BY contention DESC, roll_date DESC, roll_id) AS q FROM records WHERE contention > 0) SELECT {', '.join(SHOWN)} FROM r WHERE q = 1 ORDER BY contention DESC, roll_date DESC, roll_id LIMIT 14")
def top_contested(spark: SparkSession, d: str) -> DataFrame:
    named = records(spark, d).withColumn("subject", F.coalesce(F.nullif("bill", F.lit("")), "title"))
    return X.top_contested(named, 14, ["chamber", "subject"]).select(*SHOWN)


@query(f"WITH {T.VIEWS} SELECT roll_id, title, roll_date, (SELECT count(*) FROM rolls) AS total FROM rolls ORDER BY roll_date DESC, roll_id LIMIT 10 OFFSET 20")
def paginate_with_total(spark: SparkSession, d: str) -> DataFrame:
    """Page three of a list, ten a page."""
    return X.paginate(T.rolls(spark, d).select("roll_id", "title", "roll_date"), [F.desc("roll_date"), "roll_id"], 3)


@query(f"WITH {T.VIEWS} SELECT chamber, count(*) AS rolls, min(roll_date) AS first_date, max(roll_date) AS last_date FROM rolls GROUP BY 1")
def coverage_by_chamber(spark: SparkSession, d: str) -> DataFrame:
    return X.coverage(T.rolls(spark, d))


@query(
    f"""WITH {RECORDS}, o AS (SELECT member_key, name FROM members WHERE state = 'NATION_3'),
reps AS (SELECT roll_id, count(*) AS n_reps, bool_or(choice = 'yes') AND bool_or(choice = 'no') AS local_split FROM ballots JOIN o USING (member_key) GROUP BY 1)
SELECT roll_id, contention, n_reps, local_split FROM records JOIN reps USING (roll_id)"""
)
def local_positions(spark: SparkSession, d: str) -> DataFrame:
    """Records on which the members of one state are on file, and whether these were on both sides."""
    chosen = T.members(spark, d).where("state = 'NATION_3'")
    got = X.local_positions(records(spark, d), T.ballots(spark, d), chosen)
    return got.select("roll_id", "contention", F.size("reps").cast("long").alias("n_reps"), X.reps_split(F.col("reps")).alias("local_split"))


def _topic_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(t, ' ({'|'.join(w)}) ') THEN '{k}' END" for k, w in topics.TOPICS.items())
    return f"""WITH x AS (SELECT doc_id, regexp_replace(lower(' ' || coalesce(text, '') || ' '), '[^a-z0-9]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS topics FROM x"""


@query(_topic_sql())
def topic_classify(spark: SparkSession, d: str) -> DataFrame:
    """Topics of every document's whole text."""
    return T.read(spark, d, "documents").select("doc_id", F.array_join(topics.classify(F.col("text")), ",").alias("topics"))


@query("SELECT doc_id, array_to_string(CASE WHEN doc_id % 3 = 0 THEN ['health'] WHEN doc_id % 3 = 1 THEN CAST([] AS VARCHAR[]) ELSE list_filter([CASE WHEN regexp_matches(regexp_replace(lower(' ' || coalesce(text, '') || ' '), '[^a-z0-9]+', ' ', 'g'), ' (rail|railroad|road) ') THEN 'transport' END], lambda x: x IS NOT NULL) END, ',') AS topics FROM documents")
def topics_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Topics on file, unknown ones dropped and an empty list kept, else keywords (here one topic's)."""
    known = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("health"), F.lit("unknown"))).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>"))
    words = topics.classify(F.col("text"), topics={"transport": ["rail", "railroad", "road"]})
    allowed = F.array(*[F.lit(t) for t in topics.TOPICS])
    return T.read(spark, d, "documents").select("doc_id", F.array_join(F.coalesce(F.array_intersect(known, allowed), words), ",").alias("topics"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 30 AND list_aggregate(list_transform(['re', 'ing'], lambda t: contains(lower(p_name), t)), 'bool_and')")
def people_search(spark: SparkSession, d: str) -> DataFrame:
    """Every token of the query is part of the folded name; a filter narrows by level (here size)."""
    tokens = F.array(F.lit("re"), F.lit("ing"))
    return T.read(spark, d, "part").where("p_size between 10 and 30").where(F.forall(tokens, lambda t: F.contains(F.lower("p_name"), t))).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type, p_size)), 'ring') AND regexp_matches(lower(concat_ws(' ', p_name, p_type, p_size)), '\\b7\\b')")
def guide_search(spark: SparkSession, d: str) -> DataFrame:
    """A numeric token matches whole numbers only, any other token any part of the text."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")))
    tests = [text.rlike(rf"\b{t}\b") if t.isdigit() else F.contains(text, F.lit(t)) for t in ("ring", "7")]
    return T.read(spark, d, "part").where(tests[0] & tests[1]).select("p_partkey", "p_name", "p_size")
