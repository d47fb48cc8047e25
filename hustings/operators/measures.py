"""Which measure a printed roll call is on, read from the text of a journal.

A journal is a long text in which headings name the measure taken up, formulas tell what happens to it (introduced,
read again, closed) and roll calls follow. Its marks are found in one pass of one pattern, numbered in order, and folded
by windows: each roll takes the last heading before it, unless that measure was only being introduced, its item was
closed in between, or the heading is out of reach. Each state has its own rules (``JOURNALS``).

Cases: null and empty texts have no rolls; very long texts are matched whole, their marks are rows; of marks that could
start at one place the first of the rules counts, and the leftmost mark goes first; rows that repeat a key are folded
apart; an empty table gives no rows; further columns, whatever their names, are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Journal:
    """Patterns of the marks of one kind of journal; kinds that it lacks are null.

    ``heading`` names a measure, ``roll`` is a roll call. Between them ``introduced`` makes the measure wait until one
    of ``resumed``, and ``closed`` ends it. ``numbered`` tells the number of a petition that later headings of the
    pattern ``unnumbered`` leave out. ``reach`` bounds the characters from a heading to the end of a roll. ``leads`` are the
    letters, in either case, one of which every match of every pattern begins with; places with other letters are passed by
    in the search. Without them all patterns are tried at each place.
    """

    heading: str
    roll: str
    introduced: str | None = None
    resumed: str | None = None
    closed: str | None = None
    numbered: str | None = None
    unnumbered: str | None = None
    reach: int | None = None
    leads: tuple[str, ...] = ()

    def kinds(self) -> dict[str, str]:
        names = ("heading", "unnumbered", "numbered", "introduced", "resumed", "closed", "roll")
        return {k: getattr(self, k) for k in names if getattr(self, k)}

    def search(self) -> str:
        """One pattern for all marks. Its first letters are tested by a class for each place, as far as the shortest lead goes."""
        classes = ("".join(sorted({x for c in at for x in (c.lower(), c.upper())})) for at in zip(*self.leads))
        ahead = "".join(f"[{c}]" for c in classes)
        any_ = "|".join(f"(?:{p})" for p in self.kinds().values())
        return f"(?={ahead})(?:{any_})" if ahead else any_


# How the journals of Michigan, Missouri and Texas print headings, formulas and rolls.
JOURNALS = {
    "mi": Journal(
        heading=r"(?i:\b(?:House|Senate)\s+(?:Joint\s+|Concurrent\s+)?(?:Bill|Resolution)\s+(?:No\.\s*)?(?:\d+[a-z]?|[A-Z])\s*(?:,?\s*entitled|[.,]\s*A (?:joint|concurrent) resolution\b))",
        roll=r"\bRoll Call No\.\s*\d+",
        introduced=r"(?i:read a first time)",
        resumed=r"(?i:read a (?:second|third) time|Third Reading|question being|onference report|concurring)",
        numbered=r"(?i:Initiative Petition No\.\s*\d+)",
        unnumbered=r"INITIATIVE PETITION\s*An initiation of legislation",
        leads=("Hous", "Sena", "Roll", "read", "Thir", "ques", "onfe", "conc", "Init"),
    ),
    "mo": Journal(
        heading=r"(?i:\b(?:HB|SB|HJR|SJR|HCR|SCR)s?\s+(?:No\.\s*)?\d+[^.]{0,80}?,\s*entitled:)|\b(?:HB|SB|HJR|SJR|HCR|SCR) \d+(?:(?!\. [A-Z])[^\n])*?\bwas (?:again )?taken up by (?:Representative|Senator)\b",
        roll=r"(?i:Was read the 3 ?rd time and (?:finally )?passed by the following vote:)",
        closed=r"Vacancies|VACANCIES|(?i:On motion of)",
        reach=6000,
        leads=("HB", "SB", "HJ", "SJ", "HC", "SC", "Wa", "Va", "On"),
    ),
    "tx": Journal(
        heading=r"(?m:^(?:COMMITTEE\s+SUBSTITUTE|CONFERENCE COMMITTEE ON )?(?:SENATE|HOUSE)(?: JOINT| CONCURRENT)? (?:BILL|RESOLUTION) \d+)",
        roll=r"\bYeas \d+, Nays \d+",
        leads=("COMM", "CONF", "SENA", "HOUS", "Yeas"),
    ),
}


def measure_code(said: Column) -> Column:
    """'HJR 5' for a heading that spells a measure out or abbreviates it: its first words' initials and its number."""
    spelt = r"(?i)(house|senate)\s+(joint|concurrent)?\s*(bill|resolution)\s+(?:no\.\s*)?([0-9]+[a-z]?|[a-z])"
    short = r"(?i)\b(HB|SB|HJR|SJR|HCR|SCR)s?\s+(?:No\.\s*)?([0-9]+)"
    initials = F.concat(*[F.substring(F.regexp_extract(said, spelt, i), 1, 1) for i in (1, 2, 3)])
    long = F.concat(initials, F.lit(" "), F.regexp_extract(said, spelt, 4))
    return F.upper(F.when(said.rlike(spelt), long).when(said.rlike(short), F.concat_ws(" ", F.regexp_extract(said, short, 1), F.regexp_extract(said, short, 2))))


#: Bounds of marks, and what stands for a bound that a text has itself: two characters that Unicode assigns to no use.
BOUND, NO_BOUND = "\uffff", "\ufffe"


def _found(texts: DataFrame, key: str, text: str, journal: Journal) -> DataFrame:
    """key, __row (the text), k, kind and said of each mark, and between: characters from the last mark's end to this one.

    One search sets bounds around the marks; cut at these, a text has its marks at the odd places.
    """
    bounded = F.regexp_replace(F.replace(F.col(text), F.lit(BOUND), F.lit(NO_BOUND)), journal.search(), f"{BOUND}$0{BOUND}")
    cut = texts.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("__row"), F.split(bounded, BOUND, -1).alias("parts"))
    each = cut.select("key", "__row", "parts", F.explode(F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 1, F.lit(2)))).alias("at"))
    rows = each.select("key", "__row", F.shiftright("at", 1).alias("k"), F.get("parts", F.col("at")).alias("said"), F.char_length(F.get("parts", F.col("at") - 1)).alias("between"))
    kind = F.coalesce(*[F.when(F.col("said").rlike(rf"\A(?:{p})\z"), F.lit(name)) for name, p in journal.kinds().items()])
    return rows.withColumn("kind", kind)


def _order():
    return W.partitionBy("__row").orderBy("k").rowsBetween(W.unboundedPreceding, 0)


def marks(texts: DataFrame, key: str, text: str, journal: Journal) -> DataFrame:
    """The marks of each text in order: key, __row (the text), k, kind, said and position (characters before it)."""
    upto = F.sum(F.col("between") + F.char_length("said")).over(_order())
    return _found(texts, key, text, journal).select("key", "__row", "k", "kind", "said", (upto - F.char_length("said")).alias("position"))


def measure_under_vote(texts: DataFrame, key: str, text: str, journal: Journal) -> DataFrame:
    """The rolls of each text: its key, nth (from 1), position and bill; bill is null where no measure is under vote.

    What is read out of a mark is read before the shuffle. Windows run over the marks of one text in one order, so these are
    sorted once, and hold no more than the current row and running values.
    """
    order = _order()
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    latest = lambda test, value: F.last(F.when(test, F.col(value)), ignorenulls=True).over(order)
    code, number = F.when(is_("heading"), measure_code(F.col("said"))), F.when(is_("numbered"), F.regexp_extract("said", "([0-9]+)$", 1))
    read = _found(texts, key, text, journal).select("key", "__row", "k", "kind", "between", F.char_length("said").alias("size"), code.alias("code"), number.alias("number"))
    ran = read.select("*", F.sum(F.col("between") + F.col("size")).over(order).alias("end"), F.last("number", ignorenulls=True).over(order).alias("petition"), latest(is_("resumed"), "k").alias("resumed_at"), latest(is_("closed"), "k").alias("closed_at"), F.count(F.when(is_("introduced"), 1)).over(order).alias("introductions"), F.count(F.when(is_("roll"), 1)).over(order).alias("nth"))
    named = ran.withColumn("bill", F.when(is_("heading"), F.col("code")).when(is_("unnumbered"), F.concat(F.lit("IP "), F.col("petition")))).withColumn("position", F.col("end") - F.col("size"))
    opens = F.col("bill").isNotNull()
    items = named.select("__row", "key", "k", "kind", "nth", "position", "end", "resumed_at", "closed_at", "introductions", latest(opens, "bill").alias("subject"), latest(opens, "position").alias("from"), latest(opens, "k").alias("opened_at"), latest(opens, "introductions").alias("before"))
    # The first introduction of the item under way; an item's own mark opens it, so none is as early.
    first = is_("introduced") & (F.col("introductions") == F.col("before") + 1)
    states = items.withColumn("introduced_at", latest(first, "k"))
    waiting = (F.coalesce("introduced_at", F.lit(-1)) > F.col("opened_at")) & (F.coalesce("resumed_at", F.lit(-1)) < F.col("introduced_at"))
    closed = F.coalesce("closed_at", F.lit(-1)) > F.col("opened_at")
    near = F.col("end") - F.col("from") <= journal.reach if journal.reach else F.lit(True)
    return states.where(is_("roll")).select(F.col("key").alias(key), F.col("nth").cast("int").alias("nth"), F.col("position").cast("long").alias("position"), F.when(~waiting & ~closed & near, F.col("subject")).alias("bill"))


def names_other_bill(heading: Column, bill: Column) -> Column:
    """Whether the heading of a block of votes names bills, but not ``bill``: then the block is another bill's, however
    well its tally fits. Null headings name none."""
    flat = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    found = F.regexp_extract_all(F.coalesce(heading, F.lit("")), F.lit(r"(?i)\b[A-Z]*?((?:HB|SB|HJR|SJR|HCR|SCR|HR|SR)\s*[0-9]+)"), F.lit(1))
    return (F.size(found) > 0) & ~F.coalesce(F.array_contains(F.transform(found, flat), flat(bill)), F.lit(False))


def blocks_by_tally(actions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Actions (action, page, bill, yes, no) with the printed block of votes (block, page, heading, yes, no) of their page
    that has their tally and whose heading doesn't name another bill; the first such block, null if there is none."""
    keys = ["page", "yes", "no"]
    hit = actions.select("action", "bill", *keys).join(blocks.select("block", "heading", *keys), keys).where(~names_other_bill(F.col("heading"), F.col("bill"))).groupBy("action").agg(F.min("block").alias("block"))
    return actions.join(hit, "action", "left")
