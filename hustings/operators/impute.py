"""Positions that a source doesn't print: absences, complements, presiding officers, overrides.

``votes`` has chamber, roll_id, member_key, choice, roll_date (those of its roll); ``rolls`` has a row a roll: chamber,
roll_id, roll_date. A roster has chamber, member_key, start and end, null for open. Who is absent is never written out to
be counted: seats are running counts of the starts and ends of spans, less the positions that are there. ``complete``
writes the absences themselves, for whoever wants them.

Cases: a null start or end is open; spans of a member that overlap count each for itself; a null member in a roster is a
seat, in votes nobody's; repeated positions count each but fill a seat once; rolls without seats or positions are left
out; empty tables give no rows; further columns are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tasks that the rolls of one chamber are dealt to.
SALTS = 16
FAR_PAST, FAR_FUTURE = "0001-01-01", "9999-12-31"


def spans(votes: DataFrame, open_days: int | None = None) -> DataFrame:
    """chamber, member_key, start, end: the first and last recorded position of a member. With ``open_days`` a span that
    starts (ends) so near to the chamber's first (last) day is open on that side."""
    s = votes.groupBy("chamber", "member_key").agg(F.min("roll_date").alias("start"), F.max("roll_date").alias("end"))
    if open_days is None:
        return s
    edge = s.groupBy("chamber").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    start = F.when(F.col("start") <= F.date_add("first", open_days), F.lit(FAR_PAST).cast("date")).otherwise(F.col("start"))
    end = F.when(F.col("end") >= F.date_sub("last", open_days), F.lit(FAR_FUTURE).cast("date")).otherwise(F.col("end"))
    return s.join(edge, "chamber").select("chamber", "member_key", start.alias("start"), end.alias("end"))


def seated(rolls: DataFrame, roster: DataFrame) -> DataFrame:
    """Roll calls with each member of the chamber seated that day (roster: chamber, member_key, start, end)."""
    # A chamber is few keys for many rolls: rolls are dealt out, and the roster of a chamber goes to each of its tasks.
    salt = F.pmod(F.xxhash64("roll_id"), F.lit(SALTS)).cast("int")
    dealt, each = rolls.withColumn("__salt", salt), roster.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("roll_date").between(F.coalesce("start", F.lit(FAR_PAST).cast("date")), F.coalesce("end", F.lit(FAR_FUTURE).cast("date")))
    return dealt.join(each, ["chamber", "__salt"]).where(on).select("chamber", "roll_id", "roll_date", "member_key")


def complete(rolls: DataFrame, roster: DataFrame, votes: DataFrame, choice: str = "absent") -> DataFrame:
    """``votes`` and a position ``choice`` for each seated member without one, marked ``imputed``."""
    missing = seated(rolls, roster).join(votes.select("roll_id", "member_key"), ["roll_id", "member_key"], "left_anti")
    filled = missing.select("chamber", "roll_id", "member_key", F.lit(choice).alias("choice"), "roll_date", F.lit(True).alias("imputed"))
    return votes.select("chamber", "roll_id", "member_key", "choice", "roll_date", F.lit(False).alias("imputed")).unionByName(filled)


def covering(points: DataFrame, roster: DataFrame, keys: list[str], day: str = "roll_date") -> DataFrame:
    """keys, ``day`` and ``seats``, the number of spans of the keys that cover the day, for each day of ``points``.

    Starts count up and the days after ends count down; both are summed by day before a running sum over a key's days, so
    the work is linear in points and spans however many of them meet.
    """
    start, end = F.coalesce("start", F.lit(FAR_PAST).cast("date")), F.coalesce("end", F.lit(FAR_FUTURE).cast("date"))
    turn = lambda d, n: F.struct(d.alias("d"), F.lit(n).alias("n"))
    turns = F.when(start <= end, F.array(turn(start, 1), turn(F.date_add(end, 1), -1)))
    changes = roster.select(*keys, F.explode(turns).alias("t")).groupBy(*keys, F.col("t.d").alias(day)).agg(F.sum("t.n").alias("n"), F.lit(0).alias("asked"))
    asked = points.select(*keys, day).distinct().withColumns({"n": F.lit(0).cast("long"), "asked": F.lit(1)})
    days = changes.unionByName(asked).groupBy(*keys, day).agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    running = F.sum("n").over(W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0))
    return days.withColumn("seats", running).where("asked = 1").select(*keys, day, "seats")


def imputed_counts(rolls: DataFrame, roster: DataFrame, votes: DataFrame) -> DataFrame:
    """roll_id, positions and imputed: how many rows ``complete`` has for each roll, and how many of them it makes."""
    seats = rolls.select("roll_id", "chamber", "roll_date").join(covering(rolls, roster, ["chamber"]), ["chamber", "roll_date"]).select("roll_id", "seats")
    own = ["chamber", "member_key", "roll_date"]
    named = votes.groupBy("roll_id", *own).agg(F.count(F.lit(1)).alias("rows"))
    filled = named.join(covering(votes.where("member_key is not null"), roster, own[:2]), own, "left")
    there = filled.groupBy("roll_id").agg(F.sum("rows").alias("rows"), F.sum(F.coalesce("seats", F.lit(0))).alias("filled"))
    imputed = F.when(F.col("seats").isNull(), F.lit(0)).otherwise(F.col("seats") - F.coalesce("filled", F.lit(0))).cast("long")
    counts = seats.join(there, "roll_id", "full").select("roll_id", (F.coalesce("rows", F.lit(0)) + imputed).alias("positions"), imputed.alias("imputed"))
    return counts.where("positions > 0")


def _silent(rolls: DataFrame, votes: DataFrame) -> DataFrame:
    """Rolls that print no yes list."""
    lists = votes.where("choice = 'yes'").select("roll_id").distinct()
    return rolls.join(lists, "roll_id", "left_anti").select("chamber", "roll_id", "roll_date", "printed_yes")


def _made_whole(silent: DataFrame, roster: DataFrame, votes: DataFrame) -> DataFrame:
    """Silent rolls (roll_id, positions, imputed) whose missing members are as many as the printed yes votes."""
    counts = imputed_counts(silent, roster, votes.join(silent.select("roll_id"), "roll_id", "left_semi"))
    return counts.join(silent.select("roll_id", "printed_yes"), "roll_id").where("imputed > 0 and imputed = printed_yes").drop("printed_yes")


def complement_counts(rolls: DataFrame, roster: DataFrame, votes: DataFrame) -> DataFrame:
    """roll_id, positions and imputed of the rows of ``complement``, without making them."""
    silent = _silent(rolls, votes)
    kept = votes.join(silent.select("roll_id"), "roll_id", "left_anti").groupBy("roll_id").agg(F.count(F.lit(1)).alias("positions"), F.lit(0).cast("long").alias("imputed"))
    return kept.unionByName(_made_whole(silent, roster, votes))


def complement(rolls: DataFrame, roster: DataFrame, votes: DataFrame) -> DataFrame:
    """Rolls that print no yes list (rolls: printed_yes): every seated member not named voted yes, if that gives the
    printed count; other rolls of the kind are dropped, and rolls with a list stay as they are. Only rolls that come out
    right are written out."""
    silent = _silent(rolls, votes)
    right = silent.join(_made_whole(silent, roster, votes).select("roll_id"), "roll_id", "left_semi")
    full = complete(right, roster, votes.join(right.select("roll_id"), "roll_id", "left_semi"), "yes")
    kept = votes.join(silent.select("roll_id"), "roll_id", "left_anti").select("chamber", "roll_id", "member_key", "choice", "roll_date", F.lit(False).alias("imputed"))
    return kept.unionByName(full)


def same_day_roster(votes: DataFrame) -> DataFrame:
    """chamber, member_key, start, end: a member named anywhere on a day is seated that day."""
    return votes.select("chamber", "member_key", F.col("roll_date").alias("start"), F.col("roll_date").alias("end")).distinct()


def presiding(named: DataFrame, presiders: DataFrame) -> DataFrame:
    """The one known presider of the chamber not named on a roll; rolls with none or several get null.
    ``named``: chamber, roll_id, members (array); ``presiders``: chamber, members (array)."""
    rest = F.array_except(F.col("__p"), F.col("members"))
    return named.join(presiders.select("chamber", F.col("members").alias("__p")), "chamber", "left").select("chamber", "roll_id", F.when(F.size(rest) == 1, rest[0]).alias("presider"))


def overridden(rows: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """A hand-checked value wins over a computed one."""
    o = overrides.select(key, F.col(value).alias("__o"))
    return rows.join(o, key, "left").withColumn(value, F.coalesce("__o", value)).drop("__o")
