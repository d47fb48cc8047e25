"""Checks of rolls and records: rules, tallies, completeness, outcomes, reconciliation of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rule, key for each broken rule: one pass whatever the number of rules."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), F.col(key))


def require(found: DataFrame) -> None:
    """Raise on the first violation."""
    first = found.first()
    if first is not None:
        raise ValueError(f"{first[0]}: {first[1]}")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or " + key + " is null")


def reconcile(rolls: DataFrame, votes: DataFrame, policy: str = "drop") -> DataFrame:
    """Recount yes and no against the printed tally (rolls: roll_id, printed_yes, printed_no). Policies: ``drop`` the
    rolls that differ, ``warn`` (keep, flagged), ``count`` (rolls and mismatches only)."""
    if policy not in ("drop", "warn", "count"):
        raise ValueError(f"unknown policy {policy}")
    n = votes.groupBy("roll_id").agg(F.count(F.when(F.col("choice") == "yes", 1)).alias("yes"), F.count(F.when(F.col("choice") == "no", 1)).alias("no"))
    both = rolls.join(n, "roll_id", "left").fillna(0, ["yes", "no"]).withColumn("agrees", (F.col("yes") == F.col("printed_yes")) & (F.col("no") == F.col("printed_no")))
    if policy == "drop":
        return both.where("agrees")
    return both if policy == "warn" else both.agg(F.count(F.lit(1)).alias("rolls"), F.count(F.when(~F.col("agrees"), 1)).alias("mismatches"))


def complete_lists(rolls: DataFrame, votes: DataFrame, percent: int = 97) -> DataFrame:
    """Rolls whose identified voters are at least ``percent`` of those tallied (rolls: roll_id, tallied)."""
    n = votes.where("member_key is not null").groupBy("roll_id").agg(F.count(F.lit(1)).alias("identified"))
    both = rolls.join(n, "roll_id", "left").fillna(0, ["identified"])
    return both.where((F.col("tallied") <= 0) | (100 * F.col("identified") >= percent * F.col("tallied")))


def all_or_nothing(votes: DataFrame) -> DataFrame:
    """Positions of the rolls all of whose voters are resolved, each to another member."""
    good = votes.groupBy("roll_id").agg(F.count(F.lit(1)).alias("n"), F.count("member_key").alias("known"), F.count_distinct("member_key").alias("distinct")).where("n = known and n = distinct").select("roll_id")
    return votes.join(good, "roll_id", "left_semi")


def outcome_conflict(passed: Column, yes: Column, no: Column, supermajority: Column) -> Column:
    """A stated pass with fewer yes than no, or a stated failure with more, unless a supermajority was needed."""
    return (passed & (yes < no)) | (~passed & (yes > no) & ~supermajority)


def outcome(official: Column, yes: Column, no: Column, seats: Column, numerator: Column, denominator: Column, of_seats: Column) -> Column:
    """The official result if any; else yes against numerator / denominator of the seats or of those voting; without a
    threshold, yes against no."""
    base = F.when(of_seats, seats).otherwise(yes + no)
    enough = F.when(denominator.isNull(), yes > no).otherwise(denominator * yes >= numerator * base)
    return F.coalesce(official, F.when(enough, "Passed").otherwise("Failed"))


def sources_differ(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys that one source lacks or on which the two differ."""
    x = a.select(key, F.struct(*values).alias("__a"))
    y = b.select(key, F.struct(*values).alias("__b"))
    status = F.when(F.col("__a").isNull(), "missing in first").when(F.col("__b").isNull(), "missing in second").when(~F.col("__a").eqNullSafe(F.col("__b")), "different")
    return x.join(y, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def skip_reasons(rows: DataFrame, chain: list[tuple[str, Column]]) -> DataFrame:
    """``rows`` with the first reason of the chain that holds; null for rows to keep."""
    return rows.withColumn("skip_reason", F.coalesce(*[F.when(test, F.lit(name)) for name, test in chain]))


def raw_agreement(rows: DataFrame, raw: Column, value: Column) -> DataFrame:
    return rows.where(~raw.eqNullSafe(value))


def twin_documents(rows: DataFrame, text: str, subject: str) -> DataFrame:
    """Rows whose text another row has under another subject; texts meet by digest, and only those that repeat."""
    marked = rows.withColumn("__d", F.sha2(F.col(text), 256))
    repeated = marked.groupBy("__d").agg(F.count_distinct(subject).alias("n")).where("n > 1").select("__d")
    return marked.join(repeated, "__d", "left_semi").drop("__d")


def agreed_result(results: DataFrame, keys: list[str], word: str) -> DataFrame:
    """keys and the one word that all rows of a key have; keys with several words conflict and are left out."""
    return results.groupBy(*keys).agg(F.min(word).alias("lo"), F.max(word).alias("hi")).where("lo = hi").select(*keys, F.col("lo").alias(word))


def report(rows: DataFrame, by: tuple[str, str], status: str) -> DataFrame:
    """Counts of each status for all, by the first and by the second column (grouping sets)."""
    a, b = by
    counts = [F.count(F.when(F.col(status) == s, 1)).alias(s) for s in ("pass", "fail", "skip")]
    return rows.groupingSets([[], [F.col(a)], [F.col(b)]], a, b).agg(*counts)
