"""One pipeline for all legislatures: positions printed by a source are coded, resolved, counted against the printed
tally under the source's policy, and published. A source is a row of data, not a program.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FEDERAL, OPEN_STATES, vote_code
from ..operators import quality


@dataclass(frozen=True)
class Source:
    """Codes of a source's words, the policy for rolls whose count differs (drop, warn, count; none: no tally is
    printed), whether an unknown word fails the run (strict) or drops its roll (whole), what a word that is not listed
    means otherwise, and prefixes of words that share a meaning."""

    codes: dict[str, str] = field(default_factory=dict)
    policy: str = "none"
    kind: str = "HTML"
    strict: bool = False
    other: str | None = None
    whole: bool = False
    prefixes: dict[str, str] = field(default_factory=dict)


def _codes(yes: str = "", no: str = "", absent: str = "", present: str = "") -> dict[str, str]:
    """Codes from lists separated by '|'."""
    return {w: c for c, words in (("yes", yes), ("no", no), ("absent", absent), ("present", present)) for w in words.split("|") if words}


# What each official source prints for a position, and how its printed tally is treated.
SOURCES: dict[str, Source] = {
    "us-house": Source(FEDERAL, "none", "XML", strict=True),
    "us-senate": Source(FEDERAL, "none", "XML", strict=True),
    "ny-senate": Source(_codes("AYE|AYEWR", "NAY", "EXC|ABS|ABD"), "drop", "JSON"),
    "ny-assembly": Source(_codes("yes|aye|yea", "no|nay", "er|ab|exc|absent|nv"), "drop", "HTML"),
    "nyc-council": Source(_codes("Affirmative", "Negative", "Absent|Excused|Non-voting", "Abstain"), "warn", "HTML"),
    "open-states": Source(OPEN_STATES, "none", "JSON"),
    "ca": Source(_codes("AYE", "NOE", "ABS"), "count", "DAT"),
    "va": Source(_codes("Y", "N", "X", "A"), "drop", "CSV"),
    "nj": Source({**_codes("Y", "N", "A"), "": "absent"}, "none", "CSV"),
    "or": Source(_codes("Aye", "Nay", "Excused|Absent|Excused for Business"), "count", "JSON"),
    "wa": Source(_codes("Yea", "Nay", "Absent|Excused"), "count", "XML"),
    "ut": Source(_codes("Yeas", "Nays", "Absent or not voting"), "count", "HTML"),
    "az": Source(_codes("Y", "N", "NV|X|E|A", "P"), "count", "JSON"),
    "oh": Source(_codes("Yeas", "Nays"), "count", "HTML", other="absent"),
    "ga": Source(_codes("0", "1", "2|3"), "count", "JSON"),
    "co": Source(_codes("Yes", "No", "Absent|Excused"), "count", "HTML"),
    "ks": Source(_codes("yea", "nay", "absent|not-voting", "present"), "drop", "HTML"),
    "nm": Source(_codes("YEA|YES", "NAY|NO", "EXC|ABSENT|ABS|REC", "PNV"), "drop", "PDF"),
    "me": Source(_codes("Y", "N", "X|E|P"), "drop", "PDF"),
    "mo": Source(_codes("YEAS|AYES", "NAYS|NOES", "Absent|Absent with leave", "Present"), "drop", "PDF"),
    "nv": Source(_codes("yea", "nay", "excused|not voting|absent"), "drop", "HTML"),
    "ar": Source(_codes("Yeas", "Nays", "Non Voting|Excused", "Present"), "drop", "HTML"),
    "ak": Source(_codes("yeas", "nays", "excused|absent"), "drop", "HTML"),
    "al": Source(_codes("Y", "N", "A|P|E", "X"), "drop", "JSON", strict=True),
    "wi": Source(_codes("Y|AYES", "N|NAYS"), "drop", "HTML", other="absent"),
    "mi": Source(_codes("Yeas", "Nays", "Excused|Not Voting", "Present"), "drop", "HTML"),
    "nc": Source(_codes("Ayes", "Noes", "Not Voting|Excused Absence|Excused Vote"), "drop", "HTML"),
    "tx": Source(_codes("Yeas", "Nays", "Absent|Absent, Excused", "Present, not voting"), "drop", "HTML"),
    "mn": Source(_codes("yes", "no"), "drop", "JSON"),
    "ia": Source(_codes("ayes|yeas", "nays", "absent|absent or not voting", "present"), "drop", "PDF"),
    "sc": Source(_codes("YEAS|AYES", "NAYS", "EXCUSED ABSENCE|NOT VOTING", "PRESENT|ABSTAIN/RECUSED|ABSTAIN|RECUSED"), "drop", "PDF"),
    "ky": Source(_codes("YEAS", "NAYS", "NOT VOTING", "ABSTAINED|PASSES"), "drop", "PDF"),
    "ma": Source(_codes("Y", "N", "X", "P"), "drop", "PDF"),
    "md": Source(_codes("Voting Yea", "Voting Nay", "Not Voting|Excused from Voting|Excused (Absent)"), "drop", "PDF"),
    "ct": Source(_codes("Y", "N", "X|A"), "drop", "PDF", whole=True),
    "wv": Source(_codes("Y", "N", "A|E|P"), "drop", "PDF"),
    "tn": Source(_codes("ayes", "noes", "", "present"), "drop", "HTML"),
    "nh": Source(_codes("Yea", "Nay"), "drop", "HTML", prefixes={"Not Voting": "absent"}),
}


def coded(raw: Column, source: str) -> Column:
    """A source's word as a choice; null where it is no position."""
    s = SOURCES[source]
    found = vote_code(raw, s.codes, s.strict and not s.prefixes)
    for prefix, choice in s.prefixes.items():
        found = F.coalesce(found, F.when(F.startswith(raw, F.lit(prefix)), F.lit(choice)))
    return found if s.other is None else F.coalesce(found, F.lit(s.other))


def code_table(spark) -> DataFrame:
    """source, raw, choice for all sources."""
    rows = [F.struct(F.lit(s).alias("source"), F.lit(r).alias("raw"), F.lit(c).alias("choice")) for s, x in SOURCES.items() for r, c in x.codes.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def ingest(rolls: DataFrame, printed: DataFrame, roster: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Roll calls and positions of one source, checked.

    ``rolls``: roll_id, printed_yes, printed_no; ``printed``: roll_id, name, raw; ``roster``: name, member_key. Under
    ``drop`` a roll whose recount differs goes with its positions; under ``warn`` and ``count`` all stay, ``agrees``
    telling which differ; without a printed tally ``agrees`` is null.
    """
    marked = printed.withColumn("choice", coded(F.col("raw"), source))
    if SOURCES[source].whole:
        broken = marked.where("choice is null").select("roll_id").distinct()
        marked, rolls = marked.join(broken, "roll_id", "left_anti"), rolls.join(broken, "roll_id", "left_anti")
    votes = marked.where("choice is not null").join(roster, "name", "left")
    policy = SOURCES[source].policy
    if policy == "none":
        return rolls.withColumn("agrees", F.lit(None).cast("boolean")), votes.select("roll_id", "member_key", "choice")
    checked = quality.reconcile(rolls, votes, "drop" if policy == "drop" else "warn")
    return checked, votes.join(checked.select("roll_id"), "roll_id", "left_semi").select("roll_id", "member_key", "choice")


def rule_table(spark) -> DataFrame:
    """source, policy, other, strict, whole for all sources."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(x.policy).alias("policy"), F.lit(x.other).cast("string").alias("other"), F.lit(x.strict and not x.prefixes).alias("strict"), F.lit(x.whole).alias("whole")) for s, x in SOURCES.items()])))


def ingest_all(rolls: DataFrame, printed: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roll calls and positions of any number of sources, coded and checked in one pass: sources are rows, not branches.

    ``rolls``: source, roll_id, printed_yes, printed_no; ``printed``: source, roll_id, name, raw; ``roster``: source, name,
    member_key (one row a source and name; a repeated one repeats positions). Codes and policies are tables of fixed size
    (``SOURCES``), so they are broadcast; positions meet them in place and are counted before they are shuffled.

    Each source keeps its policy as in ``ingest``: under ``drop`` rolls whose recount differs go, ``agrees`` is null without a
    printed tally, an unknown word fails a strict source, drops the roll of a whole one, and is no position elsewhere. Null
    words and names, positions of unlisted sources and of rolls that are not in ``rolls`` have no code, member or roll: they
    are left out (names: a null member). Rolls without positions count 0; further columns are not returned.
    """
    spark = rolls.sparkSession
    words, rules = code_table(spark).distinct(), rule_table(spark)
    marked = printed.select("source", "roll_id", "name", "raw").join(F.broadcast(rules), "source").join(F.broadcast(words), ["source", "raw"], "left")
    starts = [F.when((F.col("source") == s) & F.startswith("raw", F.lit(p)), F.lit(c)) for s, x in SOURCES.items() for p, c in x.prefixes.items()]
    unknown = F.raise_error(F.concat_ws(" ", F.lit("unknown vote:"), "source", F.coalesce("raw", F.lit("null")))).cast("string")
    choice = F.coalesce("choice", *starts, "other", F.when(F.col("strict"), unknown))
    marked = marked.select("source", "roll_id", "name", "whole", choice.alias("choice"))
    count = lambda test: F.count(F.when(test, 1))
    n = marked.groupBy("source", "roll_id").agg(count(F.col("choice") == "yes").alias("yes"), count(F.col("choice") == "no").alias("no"), count(F.col("whole") & F.col("choice").isNull()).alias("broken"))
    both = rolls.select("source", "roll_id", "printed_yes", "printed_no").join(F.broadcast(rules.select("source", "policy")), "source").join(n, ["source", "roll_id"], "left").fillna(0, ["yes", "no", "broken"])
    agrees = F.when(F.col("policy") != "none", F.col("yes").eqNullSafe(F.col("printed_yes")) & F.col("no").eqNullSafe(F.col("printed_no")))
    kept = both.withColumn("agrees", agrees).where((F.col("broken") == 0) & (F.col("agrees") | F.col("agrees").isNull() | (F.col("policy") != "drop"))).drop("policy", "broken")
    votes = marked.where("choice is not null").drop("whole").join(kept.select("source", "roll_id"), ["source", "roll_id"], "left_semi")
    return kept, votes.join(roster.select("source", "name", "member_key"), ["source", "name"], "left").select("source", "roll_id", "member_key", "choice")


def printed_positions(bodies: DataFrame, kind: str | Column, name: str = "name", vote: str = "vote", row: str = "member", keys: tuple[str, ...] = ("roll_id",)) -> DataFrame:
    """``keys``, name, raw of the positions in official files (keys, body), by kind; a column tells each file's own kind, so
    files of all kinds are read in one pass.

    JSON: an array of objects, or one below ``row``; CSV: a header, then a line a member; XML: elements ``row`` with
    elements ``name`` and ``vote``; HTML: table rows of two cells. One row a position leaves the parser, so a large file
    is read by one task but never grows into one.
    """
    if isinstance(kind, str):
        found = _found(kind, name, vote, row)
    else:
        found = F.when(kind == "JSON", _found("JSON", name, vote, row))
        for k in ("CSV", "HTML"):
            found = found.when(kind == k, _found(k, name, vote, row))
        found = found.otherwise(_found("XML", name, vote, row))
    return bodies.select(*keys, F.explode(found).alias("p")).select(*keys, F.trim("p.name").alias("name"), F.trim("p.raw").alias("raw"))


def _found(kind: str, name: str, vote: str, row: str) -> Column:
    """The positions of a body as an array of name and raw."""
    if kind == "JSON":
        each = F.from_json("body", f"array<struct<`{name}`: string, `{vote}`: string>>")
        found = F.transform(each, lambda x: F.struct(x[name].alias("name"), x[vote].alias("raw")))
    elif kind == "CSV":
        lines = F.filter(F.split(F.regexp_replace("body", "^\\ufeff", ""), "\\r\\n|\\r|\\n"), lambda x: F.trim(x) != "")
        head = F.transform(F.split(lines[0], ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
        cells = lambda x: F.transform(F.split(x, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))
        at = lambda c: F.array_position(head, c).cast("int")
        found = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.struct(F.try_element_at(cells(x), at(name)).alias("name"), F.try_element_at(cells(x), at(vote)).alias("raw")))
    else:
        cell = r"<td[^>]*>(.*?)</td>"
        outer, inner = (rf"(?is)<tr[^>]*>\s*{cell}\s*{cell}\s*</tr>",) * 2 if kind == "HTML" else (rf"(?is)<{row}(?:\s[^>]*)?>(.*?)</{row}>", None)
        blocks = F.regexp_extract_all("body", F.lit(outer), F.lit(0))
        if inner:
            found = F.transform(blocks, lambda x: F.struct(F.regexp_extract(x, inner, 1).alias("name"), F.regexp_extract(x, inner, 2).alias("raw")))
        else:
            field = lambda x, f: F.regexp_extract(x, rf"(?is)<{f}(?:\s[^>]*)?>(.*?)</{f}>", 1)
            found = F.transform(blocks, lambda x: F.struct(field(x, name).alias("name"), field(x, vote).alias("raw")))
        found = F.transform(found, lambda p: F.struct(plain_text(p["name"]).alias("name"), plain_text(p["raw"]).alias("raw")))
    return found


def plain_text(markup: Column) -> Column:
    """Text of a cell: tags go, the five entities of XML are characters again."""
    out = F.regexp_replace(markup, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out
