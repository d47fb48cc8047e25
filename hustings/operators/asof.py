"""As-of, interval and neighbour operators on ordered records.

They are equi-joins or windows on a subject key (a bill, a person, a chamber), so rows meet only their own subject's; nearest
rows come from one ordered merge of both tables, never from the product of a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, stamp: str, value: str, forward: bool = True) -> DataFrame:
    """``left`` with the ``value`` of the newest row of ``right`` before or at ``at``; failing that, with ``forward``,
    the oldest one after it. Ties go to the smaller value.

    One sort of both tables by (key, time): each left row takes the last right value seen, then the first one to come.
    The windows' frames end at the current row, so a key's rows stream through.
    """
    cols = left.columns
    l = left.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*cols).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    best = right.groupBy(key, stamp).agg(F.min(value).alias(value))
    r = best.select(F.col(key).alias("__k"), F.col(stamp).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = W.partitionBy("__k").orderBy("__t", "__side")
    both = l.unionByName(r)
    seen = F.last("__v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    found = seen
    if forward:
        later = F.last("__v", ignorenulls=True).over(W.partitionBy("__k").orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(W.unboundedPreceding, 0))
        found = F.coalesce(seen, later)
    return both.withColumn(value, found).where("__side = 1").select("__row.*", value)


def neighbours(left: DataFrame, right: DataFrame, key: str, at: str, stamp: str, value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """``left`` with ``prev`` and ``next``: structs (s, v) of the nearest row of ``right`` at or before and at or after ``at``.

    One ordered merge of both tables in each direction; nothing is multiplied. ``bucket`` maps a stamp to the piece of its
    key's axis that one task sorts (a month, a thousand units), in ascending order of stamps; the nearest values of the
    pieces beside it come from a table of a row a piece. Without it a key is one piece. Of equal stamps the smaller value
    counts; rows with a null key or ``at`` find nothing; columns of ``left`` may have any names but prev and next.
    """
    piece = bucket or (lambda c: F.lit(0))
    best = right.where(F.col(key).isNotNull() & F.col(stamp).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(stamp).alias("__t")).agg(F.min(value).alias("__m"))
    pair = F.struct(F.col("__t").alias("s"), F.col("__m").alias("v"))
    r = best.select("__k", "__t", piece(F.col("__t")).cast("long").alias("__b"), F.lit(None).cast(left.schema).alias("__row"), pair.alias("__v"))
    l = left.select(F.col(key).alias("__k"), F.col(at).cast(right.schema[stamp].dataType).alias("__t"), piece(F.col(at)).cast("long").alias("__b"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"))
    both = l.unionByName(r)
    up, down = W.partitionBy("__k", "__b").orderBy("__t", F.col("__row").isNotNull()), W.partitionBy("__k", "__b").orderBy(F.desc("__t"), F.col("__row").isNotNull())
    seen = lambda w: F.last("__v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    each = both.withColumns({"prev": seen(up), "next": seen(down)}).where("__row is not null")
    if bucket:
        edges = both.groupBy("__k", "__b").agg(F.min("__v").alias("low"), F.max("__v").alias("high"))
        over = lambda order: W.partitionBy("__k").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        beside = edges.select("__k", "__b", F.last("high", ignorenulls=True).over(over(F.asc("__b"))).alias("__p"), F.last("low", ignorenulls=True).over(over(F.desc("__b"))).alias("__n"))
        each = each.join(beside, ["__k", "__b"], "left").withColumns({"prev": F.coalesce("prev", "__p"), "next": F.coalesce("next", "__n")})
    known = F.col("__k").isNotNull() & F.col("__t").isNotNull()
    return each.select("__row.*", F.when(known, F.col("prev")).alias("prev"), F.when(known, F.col("next")).alias("next"))


def first_after(left: DataFrame, right: DataFrame, key: str, at: str, stamp: str, value: str, until: str | None = None, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """``left`` with the first ``value`` at or after ``at``, before ``until`` (exclusive) if that is set and not null."""
    inside = F.col("next.s") < F.col(until) if until else F.lit(True)
    hit = F.when(inside | F.col(until).isNull() if until else inside, F.col("next.v"))
    return neighbours(left, right, key, at, stamp, value, bucket).withColumn(value, hit).drop("prev", "next")


def members_at(votes: DataFrame, roles: DataFrame, name: str = "name_key") -> DataFrame:
    """Resolve names to members by dated roles (name, chamber, member_key, start, end): one member whose role covers the
    vote's day; failing any, the one such member of any day; several are ambiguous unless one of them is current."""
    keys = [name, "chamber"]
    asked = votes.select(*keys, "vote_date").distinct()
    near = asked.join(roles, keys).withColumn("dated", F.col("vote_date").between(F.col("start"), F.coalesce("end", F.lit("9999-12-31").cast("date"))))
    picked = near.groupBy(*keys, "vote_date").agg(
        F.collect_set(F.when(F.col("dated"), F.col("member_key"))).alias("on_day"),
        F.collect_set("member_key").alias("any_day"),
        F.collect_set(F.when(F.col("end").isNull(), F.col("member_key"))).alias("current"),
    )
    pool = F.when(F.size("on_day") > 0, F.col("on_day")).otherwise(F.col("any_day"))
    now = F.array_intersect(pool, F.col("current"))
    one = F.when(F.size(pool) == 1, pool[0]).when(F.size(now) == 1, now[0])
    status = F.when(one.isNotNull(), "resolved").otherwise("ambiguous")
    found = picked.select(*keys, "vote_date", one.alias("member_key"), status.alias("status"))
    return votes.join(found, [*keys, "vote_date"], "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def nth_occurrence(rows: DataFrame, group: list[str], item: str, order: list[str]) -> DataFrame:
    """The n-th appearance of an item in a group belongs to the group's n-th list."""
    return rows.withColumn("occurrence", F.row_number().over(W.partitionBy(*group, item).orderBy(*order)))


def under_heading(rows: DataFrame, group: str, order: str, heading: Column) -> DataFrame:
    """The nearest heading at or before each row."""
    return rows.withColumn("heading", F.last(heading, ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def fill_agreed(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """A missing value is its neighbours' where the nearest one before and the nearest one after agree."""
    before = F.last(value, ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    after = F.last(value, ignorenulls=True).over(W.partitionBy(group).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumns({"__b": before, "__a": after}).withColumn("filled", F.coalesce(F.col(value), F.when(F.col("__b") == F.col("__a"), F.col("__b")))).drop("__b", "__a")


def same_as_previous(rows: DataFrame, group: str, order: list[str], counts: list[str], value: str) -> DataFrame:
    """A missing list of votes is the previous roll's where the printed counts are equal."""
    w = W.partitionBy(group).orderBy(*order)
    equal = F.lit(True)
    for c in counts:
        equal = equal & (F.lag(c).over(w) == F.col(c))
    return rows.withColumn("carried", F.coalesce(F.col(value), F.when(equal, F.lag(value).over(w))))


def day_sequence(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The n-th row of a group's day, counted before any filter so that ids stay."""
    return rows.withColumn("sequence", F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def subject_repair(rows: DataFrame, group: str, order: str, printed: str, subject: str) -> DataFrame:
    """The bill last taken up replaces a printed bill whose number is the same under another prefix."""
    taken = F.last(subject, ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1)
    return rows.withColumn("__s", taken).withColumn("bill_repaired", F.when((number(F.col("__s")) == number(F.col(printed))) & (F.col("__s") != F.col(printed)), F.col("__s")).otherwise(F.col(printed))).drop("__s")


def reused_ids(rolls: DataFrame) -> DataFrame:
    """Rows without a printed tally whose id carries a tally on another date go. ``rolls``: vote_id, roll_date, tally."""
    with_tally = rolls.where("tally is not null").select("vote_id", F.col("roll_date").alias("__d")).distinct()
    bad = rolls.where("tally is null").select("vote_id", "roll_date").distinct().join(with_tally, "vote_id").where(F.col("__d") != F.col("roll_date")).select("vote_id", "roll_date").distinct()
    gone = bad.withColumn("tally_missing", F.lit(True))
    return rolls.withColumn("tally_missing", F.col("tally").isNull()).join(gone, ["vote_id", "roll_date", "tally_missing"], "left_anti").drop("tally_missing")


def link_versions(versions: DataFrame, history: DataFrame) -> DataFrame:
    """Tie each bill version, in order, to the first history row of its action at or after the previous version's row.

    Order within a bill decides step by step, so both tables are sorted by bill, history first, and streamed: a task keeps
    the positions of one bill by action (eight bytes each) and a pointer, versions pass by. versions: bill, version,
    action; history: bill, position, action. Returns bill, version, linked_position (null where no row is left).

    Versions of equal number go by action; repeated rows stay; null bills and null actions match nothing and link to
    nothing; rows without a version or position are left out; empty tables give no or only unlinked rows.
    """
    from array import array
    from bisect import bisect_left
    from itertools import groupby

    import pyarrow as pa

    side = lambda rows, at, n: rows.where(F.col(at).isNotNull()).select(F.col("bill"), F.lit(n).alias("side"), F.col(at).cast("long").alias("at"), F.col("action").cast("string").alias("action"))
    dealt = side(history, "position", 0).where("bill is not null and action is not null").unionByName(side(versions, "version", 1))
    ordered = dealt.repartition("bill").sortWithinPartitions("bill", "side", "at", "action")

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bill", "side", "at", "action"))))
        out: list[tuple] = []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), *[pa.array([r[i] for r in out], pa.int64()) for i in (1, 2)]], names=["bill", "version", "linked_position"])
        for bill, of in groupby(rows, key=lambda r: r[0]):
            places: dict[str, array] = {}
            pointer = None
            for _, is_version, at, action in of:
                if not is_version:
                    places.setdefault(action, array("q")).append(at)
                    continue
                held = places.get(action, ())
                k = bisect_left(held, pointer) if pointer is not None else 0
                hit = held[k] if k < len(held) else None
                pointer = pointer if hit is None else hit
                out.append((bill, at, hit))
                if len(out) == 10_000:
                    yield emit()
                    out = []
        if out:
            yield emit()

    of = versions.schema["bill"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(of)
    return ordered.mapInArrow(run, f"bill {of.simpleString()}, version long, linked_position long")


def pair_once(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Each right row serves one left row: the n-th of a key meets the n-th. Left rows without one stay."""
    n = lambda order: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return left.withColumn("__n", n(left_order)).join(right.withColumn("__n", n(right_order)), [*keys, "__n"], "left").drop("__n")
