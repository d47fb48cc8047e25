"""Whether a motion carried: what the source states, else the majority that its state asks for.

Thresholds are a small table of rules, each for the motions of one state that match it; they are read as one expression
beside each roll, so a table of any size is scored in one pass without a join.

Cases: an official result wins, whatever the count; null counts are 0; a motion that no rule of its state matches, and a
state without rules, need more yes than no; null bills and questions match no rule that asks for one; chambers other than
lower and upper have no seats, so rules of elected members don't apply there; an empty table stays empty; columns of the
rolls are kept, but those named as the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Threshold:
    """``num`` / ``den`` of the members ``elected`` or of those ``voting``, for motions of a state whose bill and question
    match, and don't match ``unless``. One half means more than half; ``beats`` asks for more yes than no besides."""

    state: str
    num: int
    den: int
    of: str
    question: str = ""
    bill: str = ""
    unless: str = ""
    chamber: str = ""
    beats: bool = True


# Seats of the lower and upper chamber, and what motions need.
SEATS = {"nj": (80, 40), "az": (60, 30), "ga": (180, 56), "ks": (125, 40), "co": (65, 35), "ky": (100, 38), "wv": (100, 34), "nh": (400, 24), "md": (141, 47)}
THRESHOLDS = [
    Threshold("nj", 1, 2, "elected", question="FINAL PASSAGE|CONCUR", beats=False),
    Threshold("az", 1, 2, "elected"),
    Threshold("ga", 1, 2, "elected", question="(?i)passage|^agree|agree to (house|senate)|conference committee report|local( consent)? calendar"),
    Threshold("ks", 2, 3, "elected", question="(?i)veto", beats=False),
    Threshold("ks", 2, 3, "elected", question="(?i)final action|adopt", bill="^[HS]CR", unless="(?i)amend|ccr|conference|concur", beats=False),
    Threshold("co", 1, 2, "elected", question="(?i)third reading: bill$"),
    Threshold("co", 2, 3, "elected", question="(?i)third reading: concurrent resolution$"),
    Threshold("ky", 1, 2, "elected", question="(?i)^(final passage|passage|consent passage|override)", bill="^(HB|SB)\\b"),
    Threshold("ky", 1, 2, "elected", question="(?i)^suspend the rules", chamber="lower"),
    Threshold("wv", 4, 5, "voting", question="(?i)constitutional rule|dispensed with", unless="(?i)reference"),
    Threshold("wv", 2, 3, "elected", question="(?i)^Effective\\b|concurred in Senate effective date"),
    Threshold("nh", 3, 5, "elected", question="(?i)^(OTPA?|Ought to Pass)\\b", bill="^CACR\\b"),
    Threshold("nh", 2, 3, "voting", question="(?i)veto|rules? suspension|suspend|become law", beats=False),
    Threshold("md", 3, 5, "voting", question="(?i)notwithstanding the objections", beats=False),
]
FAILED = r"(?i)\b(failed|rejected|not adopted|not passed|lost)\b|veto\b.*\bsustained"
CARRIED = r"(?i)\b(prevailed|passed|adopted|overridden|concurred|carried|sustained)\b"


def stated_result(question: Column) -> Column:
    """Passed or Failed as the first clause of a question tells; null if it doesn't."""
    first = F.split_part(question, F.lit(";"), F.lit(1))
    return F.when(first.rlike(FAILED), "Failed").when(first.rlike(CARRIED), "Passed")


def outcomes(rolls: DataFrame, rules: list[Threshold] = THRESHOLDS, seats: dict[str, tuple[int, int]] = SEATS) -> DataFrame:
    """``rolls`` (state, chamber, bill, question, official, yes, no) with ``needed``, the yes votes that carry the motion,
    and ``outcome``. The first rule of a state that matches counts."""
    yes, no = F.coalesce("yes", F.lit(0)), F.coalesce("no", F.lit(0))
    own = lambda c: F.coalesce(F.col(c), F.lit(""))
    needs, match = [], lambda c, p: own(c).rlike(p) if p else F.lit(True)
    for r in rules:
        applies = (F.col("state") == r.state) & match("question", r.question) & match("bill", r.bill)
        applies = applies & ~own("question").rlike(r.unless) if r.unless else applies
        applies = applies & (F.col("chamber") == r.chamber) if r.chamber else applies
        of = F.when(F.col("chamber") == "lower", seats[r.state][0]).when(F.col("chamber") == "upper", seats[r.state][1]) if r.of == "elected" else yes + no
        part = F.floor(of * r.num / r.den) + 1 if (r.num, r.den) == (1, 2) else F.ceil(of * r.num / r.den)
        needs.append(F.when(applies & of.isNotNull(), F.greatest(part, no + 1) if r.beats else part))
    needed = F.coalesce(*needs, no + 1).cast("long")
    scored = rolls.withColumn("needed", needed)
    return scored.withColumn("outcome", F.coalesce("official", F.when(yes >= F.col("needed"), "Passed").otherwise("Failed")))
