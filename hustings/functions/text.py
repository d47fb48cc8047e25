"""Scalar functions on names, bills, districts, markup, dates and vote codes, all as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters that decompose to one ASCII letter and marks, and that letter (Latin blocks, by Unicode's own rule)."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(cp):
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _folds()


def fold(text: Column) -> Column:
    """Accents removed: combining marks dropped, precomposed Latin letters to their base letters."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _BASE), "[\\u0300-\\u036f]", "")


def norm_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def slugify(name: Column) -> Column:
    """Letters and digits joined by hyphens; 'person' if none are left."""
    s = F.regexp_replace(F.lower(fold(name)), "['’`]", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("person"))


# Suffixes that are no part of a name.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]


def name_words(name: Column) -> Column:
    """Words of a name: folded, without nicknames in brackets or quotes, punctuation and suffixes; initials stay."""
    s = F.regexp_replace(F.lower(fold(F.coalesce(name, F.lit("")))), r"\([^)]*\)|\"[^\"]*\"|“[^”]*”", " ")
    words = F.split(F.regexp_replace(s, "[^a-z0-9 ]+", " "), " +")
    return F.filter(words, lambda w: (w != "") & ~w.isin(SUFFIXES))


def norm_name(name: Column) -> Column:
    return F.array_join(name_words(name), " ")


def surname(name: Column) -> Column:
    return F.coalesce(F.try_element_at(name_words(name), F.lit(-1)), F.lit(""))


# Words of a district's label that don't tell it apart, alone and after "state".
LABEL_WORDS = ["senatorial", "delegate", "assembly", "house", "district", "subdistrict", "and"]
STATE_WORDS = ["senate", "house", "legislative"]


def norm_district(label: Column) -> Column:
    """'Senatorial District Essex 007' and 'Essex and 7' are both 'essex7': the words of the label that are no office's,
    numbers without leading zeros, in one string. A null label is null."""
    words = F.split(F.lower(label), "[^a-z0-9]+")
    near = lambda i, k: F.coalesce(F.get(words, i + k), F.lit(""))
    of_state = lambda i: (near(i, -1) == "state") & near(i, 0).isin(STATE_WORDS)
    spare = lambda w, i: w.isin(LABEL_WORDS) | ((w == "state") & near(i, 1).isin(STATE_WORDS)) | of_state(i) | ((w == "sub") & of_state(i - 1))
    return F.array_join(F.transform(F.filter(words, lambda w, i: ~spare(w, i)), lambda w: F.regexp_replace(w, "(?<![0-9])0+(?=[0-9])", "")), "")


def congress_seat(code: Column) -> Column:
    return F.when(code.isin("0", "98"), "al").otherwise(code)


def is_at_large(label: Column) -> Column:
    return F.trim(label).rlike(r"(?i)^(at[- ]?large|chairman|chair)$")


def unpad(code: Column) -> Column:
    """A number without leading zeros; null for anything but digits."""
    return F.when(code.rlike("^[0-9]+$"), F.regexp_replace(code, "^0+(?=[0-9])", ""))


def bill_ref(bill: Column) -> Column:
    """Struct of prefix and number of a bill such as 'H.R. 12' or 'S 7A'; nulls if it doesn't read as one."""
    s = F.regexp_replace(F.lower(bill), r"[\s.-]+", "")
    whole = r"^([a-z]+)([0-9]+)([a-z]?)$"
    part = lambda i: F.nullif(F.regexp_extract(s, whole, i), F.lit(""))
    return F.struct(part(1).alias("prefix"), part(2).try_cast("int").alias("number"), part(3).alias("suffix"))


def strip_tags(html: Column) -> Column:
    """Text of markup: scripts and styles dropped, tags to spaces, named and numeric ASCII entities decoded, spaces
    collapsed. '&amp;' is decoded last, so what it hides stays as it is."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#x27", "'"), ("nbsp", " "), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(s, r"[ \t\r\n\f]+", " "))


def links(html: Column) -> Column:
    """Array of structs href, text of a page's anchors, in order."""
    whole = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a href="[^"]*">[^<]*</a>'), F.lit(0))
    return F.transform(whole, lambda a: F.struct(F.regexp_extract(a, r'(?i)href="([^"]*)"', 1).alias("href"), F.regexp_extract(a, r">([^<]*)<", 1).alias("text")))


def bill_summary(text: Column, title: Column, most: int = 600) -> Column:
    """White space collapsed; null if empty or the title; beyond ``most`` characters cut at the last sentence end in
    the last two thirds, else at a word with an ellipsis."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n\f]+", " "))
    cut = F.substring(s, 1, most)
    end = most - F.instr(F.reverse(cut), " .")  # characters before the last '. ' and its point
    short = F.when((F.instr(F.reverse(cut), " .") > 0) & (end - 1 > most / 3), F.substring(cut, F.lit(1), end)).otherwise(F.concat(F.regexp_replace(cut, r" +[^ ]*$", ""), F.lit("…")))
    return F.when((s == "") | (F.lower(s) == F.lower(F.coalesce(title, F.lit("")))), F.lit(None).cast("string")).when(F.length(s) > most, short).otherwise(s)


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"^(.*?[.!?])( |$)", 1)


def title_case(text: Column) -> Column:
    """First letter of each word in upper case, 'of' in lower case."""
    return F.regexp_replace(F.initcap(text), r"\bOf\b", "of")


# Street words and their postal short forms.
STREET_WORDS = {
    "street": "st", "str": "st", "avenue": "ave", "av": "ave", "avn": "ave", "road": "rd", "drive": "dr", "lane": "ln", "place": "pl",
    "boulevard": "blvd", "court": "ct", "parkway": "pkwy", "pky": "pkwy", "highway": "hwy", "square": "sq", "terrace": "ter",
    "circle": "cir", "turnpike": "tpke", "expressway": "expy", "plaza": "plz", "heights": "hts", "center": "ctr", "centre": "ctr",
    "trail": "trl", "route": "rte", "crescent": "cres", "alley": "aly", "extension": "ext", "north": "n", "south": "s", "east": "e",
    "west": "w", "mount": "mt", "fort": "ft", "saint": "st", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
}
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
STREET_TYPES = ["st", "ave", "rd", "dr", "ln", "pl", "blvd", "ct", "pkwy", "hwy", "sq", "ter", "cir", "tpke", "expy", "plz"]
DIRECTIONS = ["n", "s", "e", "w", "ne", "nw", "se", "sw"]


def ordinal_suffix(number: Column) -> Column:
    tens, ones = number % 100, number % 10
    return F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")


def _ordinal(n: int) -> str:
    return f"{n}{'th' if 11 <= n % 100 <= 13 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def street_tokens(text: Column) -> Column:
    """Canonical tokens: 'West 42 Street' and 'W. 42nd St' are both [w, 42nd, st]."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z0-9]+"), lambda w: w != "")
    forms = {**{w: _ordinal(i + 1) for i, w in enumerate(ORDINALS)}, **STREET_WORDS}
    named = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    number = lambda w: w.try_cast("long")
    return F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.concat(w, ordinal_suffix(number(w)))).otherwise(F.coalesce(F.try_element_at(named, w), w)))


STOP = ("the", "and", "for", "act", "resolve")


def title_words(title: Column, stop: tuple[str, ...] = STOP) -> Column:
    """The words of three letters and more of a title or caption, without the commonest."""
    return F.filter(F.split(F.lower(fold(title)), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(list(stop)))


def title_fit(title: Column, caption: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Share of the caption's words of three letters and more that the title has, whole or (beyond four letters) as a
    start; captions with fewer than two such words fit."""
    cw, tw = title_words(caption, stop), title_words(title, stop)
    hit = F.filter(cw, lambda w: F.exists(tw, lambda x: (x == w) | ((F.length(w) > 4) & F.startswith(x, w))))
    return F.when(F.size(cw) < 2, F.lit(1.0)).otherwise(F.size(hit) / F.size(cw))


def parse_date(text: Column) -> Column:
    """Dates written '30-Jun-2026', 'June 24, 2026', 'Jun 5, 2026', '6/24/2026' or '2026-06-24'; null if no such day."""
    return F.coalesce(*[F.try_to_date(text, f) for f in ("d-MMM-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy-MM-dd")])


def date_label(day: Column) -> Column:
    return F.date_format(day, "MMM d, yyyy")


def member_key_for(key: Column, chamber: Column, member_keys: Column, key_by: Column, jurisdiction: Column, legislative_chamber: Column) -> Column:
    """The member key of a district key within a snapshot; null where the key is not of that chamber."""
    ext = lambda p, i=1: F.regexp_extract(key, p, i)
    council, sd, ad = r"^nyc-council-([0-9]+)$", r"^ny-sd-([0-9]+)$", r"^ny-ad-([0-9]+)$"
    house, sen = r"^us-house-([a-z]{2})-([0-9]+|al)$", r"^us-sen-([a-z]{2})-([12])$"
    state = r"^([a-z]{2})-(upper|lower|legislature)-([0-9a-f-]{36})$"
    return (
        F.when(key.rlike(council) & (chamber == "NYC COUNCIL"), ext(council))
        .when(key.rlike(sd) & (chamber == "NY SENATE"), ext(sd))
        .when(key.rlike(ad) & (chamber == "NY ASSEMBLY"), ext(ad))
        .when(key.rlike(house) & (chamber == "U.S. HOUSE"), F.try_element_at(member_keys, F.concat(ext(house), F.lit("-"), ext(house, 2))))
        .when(key.rlike(sen) & (chamber == "U.S. SENATE"), F.try_element_at(member_keys, F.concat(F.lit("sen-"), ext(sen), F.lit("-"), ext(sen, 2))))
        .when(key.rlike(state) & (key_by == "openstates") & (jurisdiction == ext(state)) & (legislative_chamber == ext(state, 2)), F.concat(F.lit("ocd-person/"), ext(state, 3)))
    )


# How sources print a position.
FEDERAL = {"Yea": "yes", "Aye": "yes", "Guilty": "yes", "Nay": "no", "No": "no", "Not Guilty": "no", "Present": "present", "Not Voting": "absent", "Not voting": "absent"}
OPEN_STATES = {"yes": "yes", "no": "no", "absent": "absent", "not voting": "absent", "excused": "absent", "abstain": "present", "other": "present"}
PROCEDURAL = r"(?i)journal|previous question|adjourn|recess|\btable\b|tabled|recommit|\brefer\b|referred|call of the (house|senate)|quorum|point of order|reconsider|rules? suspension|suspend the rules|\bcalendar\b"


def vote_code(raw: Column, codes: dict[str, str], strict: bool = False) -> Column:
    """A source's word for a position as yes, no, absent or present. ``strict`` fails the query on an unknown word."""
    named = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    found = F.try_element_at(named, raw)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown vote: "), F.coalesce(raw, F.lit("null"))))) if strict else found


def motion_kind(text: Column, classes: Column | None = None) -> Column:
    """Procedural by its words, unless classified as a passage."""
    word = F.when(F.coalesce(text, F.lit("")).rlike(PROCEDURAL), "procedural").otherwise("substantive")
    return word if classes is None else F.when(F.exists(F.coalesce(classes, F.array().cast("array<string>")), lambda c: F.contains(c, F.lit("passage"))), "substantive").otherwise(word)


def is_official_source(url: Column) -> Column:
    """https at a .gov or .us host or one that names a legislature."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    return (host != "") & host.rlike(r"(\.gov|\.us)$|leg|senate|house|assembly|capitol|congress")


def link_status(status: Column, error: Column) -> Column:
    return F.when(status.between(200, 399), "ok").when(status.isin(404, 410) | error.isin("ENOTFOUND", "ECONNREFUSED"), "dead").otherwise("inconclusive")


def party_code(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return F.when(low.startswith("dem"), "D").when(low.startswith("rep"), "R").when(low.startswith("ind"), "I").otherwise(F.lit(None).cast("string"))


# Prefixes of federal bills as printed, and as written.
BILL_PREFIXES = {"H CON RES": "H.Con.Res.", "H J RES": "H.J.Res.", "H RES": "H.Res.", "H R": "H.R.", "S CON RES": "S.Con.Res.", "S J RES": "S.J.Res.", "S RES": "S.Res.", "S": "S."}


def format_bill(bill: Column) -> Column:
    """'H R 12' as 'H.R. 12', 'S CON RES 3' as 'S.Con.Res. 3'; others stay."""
    return F.coalesce(*[F.when(bill.rlike(f"^{old} [0-9]"), F.concat(F.lit(new), F.substring(bill, len(old) + 1, 1000))) for old, new in BILL_PREFIXES.items()], bill)


def condense(text: Column, enough: int = 180, most: int = 320) -> Column:
    """Sentences until more than ``enough`` characters are taken; one that would pass ``most`` is left out. The pattern takes
    a last part without an end too (it goes after), so a long text without any end is read once and not from each place."""
    sentences = F.filter(F.regexp_extract_all(text, F.lit("[^.!?]+(?:[.!?]+|$)"), F.lit(0)), lambda s: s.rlike("[.!?]$"))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        over = (a["out"] != "") & (F.length(a["out"]) + F.length(s) > most)
        out = F.when(a["done"] | over, a["out"]).otherwise(F.concat(a["out"], s))
        return F.struct(out.alias("out"), (a["done"] | over | (F.length(out) > enough)).alias("done"))

    return F.trim(F.when(F.size(sentences) == 0, text).otherwise(F.aggregate(sentences, start, step, lambda a: a["out"])))


# Questions that name a nominee, what ends the name, and what is in its place in votes on several.
NOMINATION_QUESTIONS = ["motion to invoke cloture", "confirmation"]
NAME_ENDS = ",|(?i: to be | to the )"
ON_SEVERAL = ["en bloc", "executive calendar"]


def nominee(title: Column) -> Column:
    """The nominee's name in the title of a vote, 'ann b lee' for 'Confirmation: Ann B. Lee, of Utah, to be Consul'; null for
    other titles, names without an end, and votes on several. The state that follows 'of' is no part of the name."""
    question = F.lower(F.trim(F.split_part(title, F.lit(":"), F.lit(1))))
    said = F.split(F.substring(title, F.instr(title, ":") + 1, F.length(title)), NAME_ENDS, 2)
    words = F.split(F.trim(F.get(F.split(said[0], r"\s+of\s+(?=[A-Z])"), F.lit(0))), r"\s+")
    name = F.lower(F.replace(F.array_join(words, " "), F.lit("."), F.lit("")))
    several = F.exists(F.array(*map(F.lit, ON_SEVERAL)), lambda x: F.contains(F.lower(said[0]), x))
    return F.when(question.isin(NOMINATION_QUESTIONS) & (F.size(said) == 2) & (name != "") & ~several, name)


def chamber_state(chamber: Column) -> Column:
    """'us' for Congress, else the postal code in lower case; a city's council counts as its state."""
    first = F.substring_index(chamber, " ", 1)
    return F.when(first == "U.S.", "us").when(first == "NYC", "ny").otherwise(F.lower(first))


def encoded(part: Column) -> Column:
    """A part of a path with everything but letters, digits and -_.!~*'() as percent signs and hexadecimal bytes."""
    out = F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def roll_call_href(file: Column, roll_id: Column) -> Column:
    """The address of a roll call's page; null for a null file or id."""
    return F.concat(F.lit("/vote/"), file, F.lit("/"), encoded(roll_id))


def cite_numbers(cited: Column, sources: Column) -> Column:
    """The numbers (from 1) of cited ids among an array of source ids, in the order cited; unknown and null ids have none."""
    return F.filter(F.transform(F.coalesce(cited, F.array().cast("array<string>")), lambda c: F.coalesce(F.array_position(sources, c), F.lit(0))), lambda n: n > 0)
