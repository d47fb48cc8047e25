"""The issue explorer: faceted filter, bill search, facets, sorting, top-k per group, pages with a true total."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """What the explorer can narrow by. ``show``: all, split, close, reps-split or a kind of split."""

    topics: list[str] = field(default_factory=list)
    state: str = ""
    chamber: str = ""
    kind: str = ""
    show: str = ""
    query: str = ""


def norm_bill(bill: Column) -> Column:
    """'H.R. 1', 'hr-1' and 'HR1' are all 'hr1'."""
    return F.regexp_replace(F.lower(bill), r"[\s.-]+", "")


def reps_split(reps: Column) -> Column:
    return F.exists(reps, lambda r: r["vote"] == "yes") & F.exists(reps, lambda r: r["vote"] == "no")


def filter_records(records: DataFrame, f: Filters) -> DataFrame:
    """Records that pass all filters. A query that reads as a bill number and is one of a record's finds that bill
    only; any other is looked for in bill, title, summary and question. A query widens the default from split to all.

    Whether some record has the bill is one scalar subquery over a pushed-down filter, not a pass on the driver.
    """
    query = f.query.strip().lower()
    show = "all" if query and f.show in ("", "split") else f.show or "split"
    out = records
    if f.topics:
        other = (F.size("topics") == 0) if "other" in f.topics else F.lit(False)
        out = out.where(F.arrays_overlap("topics", F.array(*map(F.lit, f.topics))) | other)
    for name in ("state", "chamber", "kind"):
        if getattr(f, name):
            out = out.where(F.col(name) == getattr(f, name))
    if show == "split":
        out = out.where("is_split")
    elif show == "close":
        out = out.where("is_close")
    elif show == "reps-split":
        out = out.where(reps_split(F.col("reps")))
    elif show != "all":
        out = out.where(F.col("split_kind") == show)
    if not query:
        return out
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("")
    text = F.lower(F.concat_ws(" ", *map(blank, ("bill", "title", "summary", "question"))))
    within = F.contains(text, F.lit(query))
    import re

    bill = re.sub(r"[\s.-]+", "", query)
    if not re.fullmatch(r"[a-z]+\d+[a-z]?", bill):
        return out.where(within)
    known = records.where(norm_bill(F.col("bill")) == bill).agg((F.count(F.lit(1)) > 0).alias("__known"))
    matched = F.when(F.col("__known"), norm_bill(F.col("bill")) == bill).otherwise(within)
    return out.join(F.broadcast(known)).where(matched).drop("__known")


def sort_records(records: DataFrame, by: str = "contested") -> DataFrame:
    return records.orderBy(F.desc("roll_date"), "roll_id") if by == "newest" else records.orderBy(F.desc("contention"), F.desc("roll_date"), "roll_id")


def topic_facets(records: DataFrame, f: Filters) -> DataFrame:
    """Records for each topic (``other`` for none), with every filter but the topics applied."""
    rest = filter_records(records, Filters([], f.state, f.chamber, f.kind, f.show, f.query))
    topic = F.explode(F.when(F.size("topics") == 0, F.array(F.lit("other"))).otherwise(F.col("topics"))).alias("topic")
    return rest.select(topic).groupBy("topic").agg(F.count(F.lit(1)).alias("records"))


def top_contested(records: DataFrame, most: int, subject: list[str]) -> DataFrame:
    """The ``most`` contested records, the first of each ``subject`` only."""
    order = [F.desc("contention"), F.desc("roll_date"), "roll_id"]
    first = records.where(F.col("contention") > 0).withColumn("r", F.row_number().over(W.partitionBy(*subject).orderBy(*order))).where("r = 1").drop("r")
    return first.orderBy(*order).limit(most)


def paginate(rows: DataFrame, order: list, page: int, size: int = 10, clamp: bool = False) -> DataFrame:
    """Rows of a page with ``total``, the number of all rows. ``clamp`` shows the last page beyond it.

    Only the rows up to the page's end are sorted (top-k); the total is an aggregate, never a window over one task.
    """
    size, page = max(1, min(size, 50)), max(1, page)
    counted = rows.agg(F.count(F.lit(1)).alias("total"))
    if clamp:
        total = counted.first()["total"]
        page = min(page, max(1, -(-total // size)))
    return rows.orderBy(*order).limit(page * size).offset((page - 1) * size).join(F.broadcast(counted))


def coverage(rolls: DataFrame, by: str = "chamber") -> DataFrame:
    return rolls.groupBy(by).agg(F.count(F.lit(1)).alias("rolls"), F.min("roll_date").alias("first_date"), F.max("roll_date").alias("last_date"))


def local_positions(records: DataFrame, votes: DataFrame, officials: DataFrame) -> DataFrame:
    """``records`` with the positions of the chosen ``officials`` (member_key, name) as ``reps``; only records that at
    least one of them voted on."""
    seen = votes.join(officials.select("member_key", "name"), "member_key")
    reps = seen.groupBy("roll_id").agg(F.array_sort(F.collect_list(F.struct("member_key", "name", F.col("choice").alias("vote")))).alias("reps"))
    return records.join(reps, "roll_id")
