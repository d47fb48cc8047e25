"""Names and sentences that pages show: states, chambers, slate seats, federal bills, agenda titles, committees, tallies and
results, all as column expressions. A null argument gives null where nothing else is said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slugify

# Names of states and territories by postal code.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "PR": "Puerto Rico", "GU": "Guam", "VI": "U.S. Virgin Islands", "AS": "American Samoa", "MP": "Northern Mariana Islands",
}
# What lower chambers and their members are called where it isn't "State House" and "State Representative".
LOWER_CHAMBERS = {"CA": "State Assembly", "NV": "State Assembly", "WI": "State Assembly", "NJ": "General Assembly", "MD": "House of Delegates", "VA": "House of Delegates", "WV": "House of Delegates"}
LOWER_TITLES = {"State Assembly": "Assembly Member", "General Assembly": "General Assembly Member", "House of Delegates": "Delegate", "State House": "State Representative"}
# Labels of stored chambers that don't follow from state and body; files whose name doesn't tell the jurisdiction.
CHAMBER_LABELS = {"U.S. HOUSE": "U.S. House", "U.S. SENATE": "U.S. Senate", "NYC COUNCIL": "NYC Council", "DC COUNCIL": "D.C. Council"}
FILE_JURISDICTIONS = {"house": "us", "ussenate": "us", "senate-ny": "ny", "assembly-ny": "ny", "council": "nyc"}


def _named(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def state_name(code: Column) -> Column:
    """A state's name; a code that is none, in upper case."""
    return F.coalesce(_named(STATES, F.upper(code)), F.upper(code))


def chamber_name(state: Column, chamber: Column) -> Column:
    """'State Senate', 'House of Delegates' and so on for upper, lower and legislature."""
    st = F.upper(state)
    lower = F.coalesce(_named(LOWER_CHAMBERS, st), F.lit("State House"))
    return F.when(st == "DC", "D.C. Council").when(chamber == "legislature", "Unicameral Legislature").when(chamber == "upper", "State Senate").when(chamber == "lower", lower)


def lower_title(state: Column) -> Column:
    """The title of a member of a state's lower chamber."""
    return _named(LOWER_TITLES, F.coalesce(_named(LOWER_CHAMBERS, F.upper(state)), F.lit("State House")))


def snapshot_chamber(state: Column, chamber: Column) -> Column:
    """The name a chamber is stored under: 'VA HOUSE OF DELEGATES', 'TX SENATE', 'NE LEGISLATURE', 'DC COUNCIL'."""
    st = F.upper(state)
    body = F.upper(F.regexp_replace(chamber_name(state, chamber), "^State ", ""))
    return F.when(st == "DC", "DC COUNCIL").when(chamber == "legislature", F.concat(st, F.lit(" LEGISLATURE"))).otherwise(F.concat(st, F.lit(" "), body))


def chamber_label(stored: Column) -> Column:
    """A stored chamber as readers see it: 'VA HOUSE OF DELEGATES' is 'Virginia House of Delegates'."""
    words = F.split(stored, " ", 2)
    body = F.regexp_replace(F.initcap(words[1]), r"\bOf\b", "of")
    return F.coalesce(_named(CHAMBER_LABELS, stored), F.concat_ws(" ", state_name(words[0]), F.when(F.size(words) > 1, body)))


def file_jurisdiction(file: Column) -> Column:
    """The jurisdiction of a snapshot file: the second part of 'state-xx-...', a fixed one of the others, else null."""
    return F.when(F.startswith(file, F.lit("state-")), F.split_part(file, F.lit("-"), F.lit(2))).otherwise(_named(FILE_JURISDICTIONS, file))


def slate_key(key: Column) -> Column:
    """Struct state, chamber, label of 'tx-lower-12'; null for other keys."""
    p = r"^([a-z]{2})-(upper|lower|legislature)-(.+)$"
    return F.when(key.rlike(p), F.struct(F.regexp_extract(key, p, 1).alias("state"), F.regexp_extract(key, p, 2).alias("chamber"), F.regexp_extract(key, p, 3).alias("label")))


def slate_office(key: Column) -> Column:
    """Struct state, office, district, tag of a seat's key, federal, New York's or any state's; null for other keys."""
    house, ny = r"^us-house-([a-z]{2})-(.+)$", r"^ny-(sd|ad)-([0-9]+)$"
    h, n, s = (lambda i: F.regexp_extract(key, house, i)), (lambda i: F.regexp_extract(key, ny, i)), slate_key(key)
    made = lambda st, office, district, tag: F.struct(st.alias("state"), office.alias("office"), district.alias("district"), tag.alias("tag"))
    senate = n(1) == "sd"
    return (
        F.when(key.rlike(house), made(h(1), F.lit("U.S. House"), F.when(h(2) == "al", "AL").otherwise(h(2)), F.concat(F.lit("house-"), h(2))))
        .when(key.rlike(ny), made(F.lit("ny"), F.when(senate, "State Senate").otherwise("State Assembly"), n(2), F.concat(F.when(senate, "senate-").otherwise("assembly-"), n(2))))
        .when(s.isNotNull(), made(s["state"], chamber_name(s["state"], s["chamber"]), s["label"], F.concat(F.when(s["chamber"] == "lower", "house-").otherwise("senate-"), slugify(s["label"]))))
    )


# Federal bills as they are displayed.
FEDERAL_BILLS = ["H.R.", "H.Res.", "H.Con.Res.", "H.J.Res.", "S.Con.Res.", "S.J.Res.", "S.Res.", "S."]


def federal_subject(display: Column) -> Column:
    """Struct kind (bill, nomination), type (hr, sconres, ...; null for nominations), number of 'H.R. 12' or 'PN34-2'; null
    for anything else."""
    bill = "^(" + "|".join(b.replace(".", r"\.") for b in FEDERAL_BILLS) + r") +([0-9]+) *$"
    nomination = r"^PN([0-9]+)(-[0-9]+)?$"
    made = lambda kind, type_, number: F.struct(F.lit(kind).alias("kind"), type_.cast("string").alias("type"), number.alias("number"))
    type_ = F.lower(F.replace(F.regexp_extract(display, bill, 1), F.lit("."), F.lit("")))
    return F.when(display.rlike(bill), made("bill", type_, F.regexp_extract(display, bill, 2))).when(display.rlike(nomination), made("nomination", F.lit(None), F.regexp_extract(display, nomination, 1)))


# Short forms that keep their capitals where a shouted text is folded, and the name that gets them back.
SHORT_FORMS = ["fy", "mn", "lu", "nyc"]


def _made_once(value: Column, use) -> Column:
    """``use(value)``, for which ``value`` is made once however often it is named there."""
    return F.get(F.transform(F.array(value), use), 0)


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def unshout(text: Column) -> Column:
    """White space collapsed; a text of more than 20 letters, over four fifths of them capitals, in sentence case."""

    def of(t):
        letters, capitals = (F.length(F.regexp_replace(t, p, "")) for p in ("[^a-zA-Z]+", "[^A-Z]+"))
        folded = F.regexp_replace(F.concat(F.substring(t, 1, 1), F.lower(F.substring(t, F.lit(2), F.length(t)))), r"\bnew york\b", "New York")
        for s in SHORT_FORMS:
            folded = F.regexp_replace(folded, rf"\b{s}\b", s.upper())
        shouted = _made_once(letters, lambda n: (n > 20) & (5 * capitals > 4 * n))
        return F.when(shouted, folded).otherwise(t)

    return _made_once(_spaced(text), of)


def card_title(text: Column, most: int = 120) -> Column:
    """The unshouted text; beyond ``most`` characters cut before its last word, with an ellipsis."""
    cut = lambda t: F.concat(F.regexp_replace(F.substring(t, 1, most), "[,;: ]+[^ ]*$", ""), F.lit("…"))
    return _made_once(unshout(text), lambda t: F.when(F.length(t) > most, cut(t)).otherwise(t))


def _first_sentence(t: Column) -> Column:
    return _made_once(F.regexp_extract(t, r"(?s)^(.*?[.!?])( |$)", 1), lambda f: F.when(f != "", f).otherwise(t))


def summary_sentence(summary: Column, title: Column, most: int = 240) -> Column:
    """The first sentence of a summary, or of the title where that is missing or its first sentence passes ``most``
    characters; unshouted, with a full stop. A null title counts as empty."""
    source = lambda clean: F.when((clean == "") | (F.length(_first_sentence(clean)) > most), F.coalesce(title, F.lit(""))).otherwise(clean)
    first = _made_once(unshout(_made_once(_spaced(F.coalesce(summary, F.lit(""))), source)), _first_sentence)
    return _made_once(first, lambda f: F.when(f.rlike("[.!?]$"), f).otherwise(F.concat(f, F.lit("."))))


# Words of a committee's name that stay in capitals, and those in lower case within it.
COMMITTEE_CAPITALS = ["PAC", "AFL-CIO", "LLC", "USA", "US", "II", "III", "NEA", "SEIU", "COPE", "IBEW", "UAW", "AFSCME", "NRA", "DC", "NY"]
COMMITTEE_SMALL = ["of", "and", "on", "for", "the", "to", "in", "a", "an", "at", "by"]


def committee_name(name: Column) -> Column:
    """A name in capitals (of more than six characters) as a title: short forms and short words in brackets stay, small words
    are lower case, others begin with a capital, also after '-', '(' and '/'. Other names stay."""
    bare = lambda w: F.regexp_replace(w, "[^A-Z-]", "")
    kept = lambda w: bare(w).isin(COMMITTEE_CAPITALS) | (F.startswith(w, F.lit("(")) & (F.length(bare(w)) <= 5))
    parts = lambda w: F.regexp_replace(F.initcap(F.regexp_replace(w, "([-(/])", "$1 ")), "([-(/]) ", "$1")
    each = lambda w, i: F.when(kept(w), w).when((i > 0) & F.lower(w).isin(COMMITTEE_SMALL), F.lower(w)).otherwise(parts(w))
    return F.when((F.length(name) > 6) & (name == F.upper(name)), F.array_join(F.transform(F.split(name, " "), each), " ")).otherwise(name)


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def counts_sentence() -> Column:
    """One line of plain tallies from the columns of ``alignment_counts``: statements, then votes if there are any, then the
    topics without a record."""
    c = F.col
    said = F.concat(F.lit("Statements: same as you on "), c("same").cast("string"), F.lit(", different on "), c("different").cast("string"), F.when(c("mixed") > 0, F.concat(F.lit(", mixed on "), c("mixed").cast("string"))).otherwise(""))
    votes = F.when(c("in_line") + c("not_in_line") > 0, F.concat(F.lit("Recorded votes: "), counted(c("in_line"), "vote", "votes"), F.lit(" in line with your answers, "), c("not_in_line").cast("string"), F.lit(" not")))
    none = F.concat(F.lit("No record on "), c("none").cast("string"), F.lit(" of the "), counted(c("answered"), "topic", "topics"), F.lit(" you answered"))
    return F.concat_ws(" · ", said, votes, none)


def ballot_label(office: Column, district: Column, state: Column) -> Column:
    """'U.S. House · NY-14', 'Governor · Texas', 'Texas House District 49', 'Massachusetts Senate Second Essex'."""
    label = F.when(district.rlike("^[0-9]+[A-Za-z]?$"), F.concat(F.lit("District "), district)).otherwise(district)
    federal = F.concat(F.lit("U.S. House · "), state, F.lit("-"), F.coalesce(district, F.lit("")))
    wide = F.concat(office, F.lit(" · "), state_name(state))
    own = F.concat_ws(" ", state_name(state), F.regexp_replace(office, "^State ", ""), label)
    return F.when(office == "U.S. House", federal).when(F.coalesce(district, F.lit("")) == "", wide).otherwise(own)


def result_headline(status: Column, unconfirmed: Column, outcome: Column, winner: Column) -> Column:
    """One line on a race: a runoff, no call yet, a measure's outcome, or the projected winner by name where it is known."""
    return (
        F.when(status == "runoff", "Goes to a runoff")
        .when(status == "uncalled", F.when(F.coalesce(unconfirmed, F.lit(False)), "Result not confirmed yet").otherwise("Not yet called"))
        .when(outcome.isNotNull(), F.when(outcome == "approved", "Approved").otherwise("Rejected"))
        .otherwise(F.coalesce(F.concat(winner, F.lit(", projected winner")), F.lit("Winner projected")))
    )
