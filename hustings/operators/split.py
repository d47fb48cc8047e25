"""Party splits of roll calls: tallies, kind of split, contention, who broke with their party.

Positions other than yes and no count nowhere here. Members without a party count in the totals only. Thresholds are
compared in whole numbers, so every engine agrees on the edge cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def side(yes: Column, no: Column, least: int = 2) -> Column:
    """The side most of a party took; null below ``least`` voters or in a tie."""
    return F.when((yes + no >= least) & (yes != no), F.when(yes > no, "yes").otherwise("no"))


def split_columns(yes: Column, no: Column, d_yes: Column, d_no: Column, r_yes: Column, r_no: Column) -> dict[str, Column]:
    """is_split, is_close (within two votes or 5 %) and split_kind (unanimous, unknown, bipartisan, party-line, crossed)."""
    d, r = side(d_yes, d_no), side(r_yes, r_no)
    both = (yes > 0) & (no > 0)
    apart = F.abs(yes - no)
    whole = lambda a, b: 10 * F.greatest(a, b) >= 9 * (a + b)
    kind = F.when(~both, "unanimous").when(d.isNull() | r.isNull(), "unknown").when(d == r, "bipartisan").when(whole(d_yes, d_no) & whole(r_yes, r_no), "party-line").otherwise("crossed")
    return {"is_split": both, "is_close": both & ((apart <= 2) | (20 * apart <= yes + no)), "split_kind": kind}


def party_split(votes: DataFrame, keys: list[str] | tuple[str, ...] = ("roll_id",)) -> DataFrame:
    """One row a roll call of ``votes`` (keys, party, choice): yes, no, d_yes, d_no, r_yes, r_no and the split."""
    y, n = F.col("choice") == "yes", F.col("choice") == "no"
    named = {"yes": y, "no": n, **{f"{p.lower()}_{c}": (F.col("party") == p) & t for p in ("D", "R") for c, t in (("yes", y), ("no", n))}}
    out = votes.groupBy(*keys).agg(*[_count(t).alias(c) for c, t in named.items()])
    return out.withColumns(split_columns(*[F.col(c) for c in named]))


def contention(kind: Column) -> Column:
    """Mean of closeness and of the gap between the parties' yes shares, halved for procedural votes; 0 if unanimous."""
    yes, no, dy, dn, ry, rn = (F.col(c).cast("double") for c in ("yes", "no", "d_yes", "d_no", "r_yes", "r_no"))
    close = F.lit(1.0) - F.abs(yes - no) / (yes + no)
    gap = F.when((dy + dn >= 2) & (ry + rn >= 2), F.abs(dy / (dy + dn) - ry / (ry + rn))).otherwise(F.lit(0.0))
    return F.round(F.when((yes == 0) | (no == 0), F.lit(0.0)).otherwise((close + gap) / 2 * F.when(kind == "procedural", 0.5).otherwise(1.0)), 6)


def party_sides(votes: DataFrame, keys: list[str] | tuple[str, ...] = ("roll_id",)) -> DataFrame:
    """keys, party, party_side for any party with a clear side."""
    y, n = _count(F.col("choice") == "yes"), _count(F.col("choice") == "no")
    return votes.where(F.col("party").isNotNull()).groupBy(*keys, "party").agg(side(y, n).alias("party_side"))


def broke_with_party(votes: DataFrame, keys: list[str] | tuple[str, ...] = ("roll_id",)) -> DataFrame:
    """The yes and no positions of ``votes`` with party_side and broke; null sides mean not broken.

    One shuffle by roll call: the sides come from the same partitioning as the positions.
    """
    cast = votes.where(F.col("choice").isin("yes", "no"))
    joined = cast.join(party_sides(votes, keys), [*keys, "party"], "left")
    return joined.withColumn("broke", F.coalesce(F.col("party_side") != F.col("choice"), F.lit(False)))


def roll_tally(votes: DataFrame, keys: list[str] | tuple[str, ...] = ("roll_id",)) -> DataFrame:
    """D, R, other and total rows with the count of each choice.

    Positions are dealt by roll call before they are counted, and each roll call is one row of counters until its rows
    are written: a task holds its roll calls, not its positions, and none is counted twice.
    """
    p = F.col("party")
    parts = {"D": F.coalesce(p == "D", F.lit(False)), "R": F.coalesce(p == "R", F.lit(False)), "other": ~F.coalesce(p.isin("D", "R"), F.lit(False)), "total": F.lit(True)}
    choices = ("yes", "no", "present", "absent")
    counts = [c for b, t in parts.items() for c in (_count(t).alias(f"{b}_all"), *[_count(t & (F.col("choice") == c)).alias(f"{b}_{c}") for c in choices])]
    wide = votes.select(*keys, "party", "choice").repartition(*keys).groupBy(*keys).agg(*counts)
    row = lambda b: F.when(F.col(f"{b}_all") > 0, F.struct(F.lit(b).alias("bucket"), *[F.col(f"{b}_{c}").alias(f"n_{c}") for c in choices]))
    return wide.select(*keys, F.inline(F.array_compact(F.array(*map(row, parts)))))


def caucus_tally(votes: DataFrame, caucus: dict[str, str], keys: list[str] | tuple[str, ...] = ("roll_id",)) -> DataFrame:
    """Tally by caucus (independents join one by ``caucus``); here a majority needs no least number of voters."""
    named = F.create_map(*[F.lit(x) for kv in caucus.items() for x in kv])
    y, n = _count(F.col("choice") == "yes"), _count(F.col("choice") == "no")
    out = votes.withColumn("caucus", F.element_at(named, F.col("party"))).where("caucus is not null").groupBy(*keys, "caucus")
    return out.agg(y.alias("yes"), n.alias("no"), _count(~F.col("choice").isin("yes", "no")).alias("nv")).withColumn("majority", side(F.col("yes"), F.col("no"), 1))


def breakdown() -> Column:
    """'Democrats 210-2, Republicans 3-215' for the parties that voted."""
    part = lambda name, p: F.when(F.col(f"{p}_yes") + F.col(f"{p}_no") > 0, F.format_string(name + " %d-%d", f"{p}_yes", f"{p}_no"))
    return F.concat_ws(", ", part("Democrats", "d"), part("Republicans", "r"))


def sides_sentence() -> Column:
    """'Most Democrats voted no; most Republicans voted yes' for the parties with a clear side; empty if neither has one."""
    part = lambda name, p: F.concat(F.lit(f"most {name} voted "), side(F.col(f"{p}_yes"), F.col(f"{p}_no")))
    return F.regexp_replace(F.concat_ws("; ", part("Democrats", "d"), part("Republicans", "r")), "^most", "Most")
