"""Slates of state seats: labels of offices as districts, and the seats on a voter's ballot with those who hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import surname
from .identity import match_districts

# Ordinals that one state spells out, and a name that one list misspells.
SPELLED = {"MA": {"1": "First", "2": "Second", "3": "Third", "4": "Fourth", "5": "Fifth"}}
MISSPELLED = {"VT": {"Bennigton": "Bennington"}}


def bare_label(state: Column, office: Column) -> Column:
    """'District 012' is '12', '1st Essex District' is '1st Essex'; Washington's positions share a district."""
    o = F.trim(F.regexp_replace(office, r"[ \t\r\n\f]+", " "))
    o = F.when(state == "WA", F.regexp_replace(o, "-Position [0-9]+$", "")).otherwise(o)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(o, "(?i)^District[: ]+", ""), "(?i) District$", ""), "^0+(?=[0-9])", "")


def reworded(state: Column, bare: Column) -> Column:
    """The label in the words of the other list: spelled ordinals and mended names of the states that need them."""
    out = bare
    for st, words in SPELLED.items():
        for digit, word in words.items():
            out = F.when(state == st, F.regexp_replace(out, f"^{digit}(st|nd|rd|th) ", f"{word} ")).otherwise(out)
    for st, names in MISSPELLED.items():
        for wrong, right in names.items():
            out = F.when(state == st, F.replace(out, F.lit(wrong), F.lit(right))).otherwise(out)
    return out


def _canonical(label: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(label), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "")


def _shape(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(label, "[A-Za-z]+", "a"), "[0-9]+", "#")


def slate_districts(offices: DataFrame, known: DataFrame, vacancies: bool = False) -> DataFrame:
    """office_id, label, vacant: the district that each office's label means.

    ``offices``: office_id, state, chamber, office; ``known``: state, chamber, label of the seats that are held. The bare
    label, the whole one and the reworded one are tried in this order, each as written and then by its letters and digits;
    the first that is known counts, of labels with equal letters and digits the smallest. With ``vacancies`` a bare label that
    has a digit and the shape of some known label of its chamber is taken as that of a vacant seat. Others, and null offices,
    have a null label. All forms of an office are looked up by one equi-join; known labels are one row a form.
    """
    at = ["state", "chamber"]
    held = known.where("label is not null").select(*at, "label").distinct()
    forms = held.select(*at, "label", F.explode(F.array(F.concat(F.lit("="), "label"), F.concat(F.lit("~"), _canonical(F.col("label"))))).alias("form")).groupBy(*at, "form").agg(F.min("label").alias("label"))
    own = offices.select("office_id", *at, "office", bare_label(F.col("state"), F.col("office")).alias("bare"))
    tried = [F.col("bare"), F.col("office"), reworded(F.col("state"), F.col("bare"))]
    each = own.select("office_id", *at, F.posexplode(F.array(*[f for t in tried for f in (F.concat(F.lit("="), t), F.concat(F.lit("~"), _canonical(t)))])).alias("place", "form"))
    first = each.join(forms, [*at, "form"]).groupBy("office_id").agg(F.min(F.struct("place", "label")).alias("f"))
    found = own.join(first, "office_id", "left").withColumn("found", F.col("f.label"))
    if not vacancies:
        return found.select("office_id", F.col("found").alias("label"), F.lit(False).alias("vacant"))
    shapes = held.select(*at, _shape(F.col("label")).alias("shape")).distinct().withColumn("alike", F.lit(True))
    near = found.withColumn("shape", _shape(F.col("bare"))).join(shapes, [*at, "shape"], "left")
    vacant = F.col("found").isNull() & F.col("bare").rlike("[0-9]") & F.coalesce("alike", F.lit(False))
    return near.select("office_id", F.when(F.coalesce(vacant, F.lit(False)), F.col("bare")).otherwise(F.col("found")).alias("label"), F.coalesce(vacant, F.lit(False)).alias("vacant"))


def state_seats(districts: DataFrame, slates: DataFrame, roster: DataFrame) -> DataFrame:
    """voter_id, seat, office, title, cand_id, official_id: candidates for the state seats of each voter's districts.

    ``districts``: voter_id, state, side (upper or lower), basename, name; ``slates``: seat (such as 'tx-lower-12'), cand_id,
    name, incumbent; ``roster``: official_id, state, chamber, label, name. A seat of the lower chamber belongs to the lower
    side, any other to the upper one; its label must mean the voter's district. An incumbent is the member of the same seat and
    surname, the smallest id of several; others have a null official_id. Seats with other keys, null districts and states
    without slates give no rows. Voters meet seats by district, so a district is normalised once however many live there.
    """
    at = ["state", "side"]
    key = L.slate_key(F.col("seat"))
    seats = slates.select("seat", "cand_id", "name", F.coalesce("incumbent", F.lit(False)).alias("incumbent"), key.alias("k")).where("k is not null")
    seats = seats.select("seat", "cand_id", "name", "incumbent", "k.state", "k.chamber", "k.label", F.when(F.col("k.chamber") == "lower", "lower").otherwise("upper").alias("side"))
    own = districts.where("basename is not null").select("voter_id", F.lower("state").alias("state"), "side", "basename", "name")
    named = own.select(*at, "basename", "name").distinct().withColumn("census_id", F.struct("basename", F.coalesce("name", F.lit("")).alias("name")))
    matched = match_districts(named, seats.select(*at, "label"), (*at,)).distinct()
    holders = roster.groupBy(F.lower("state").alias("state"), "chamber", "label", surname(F.col("name")).alias("last")).agg(F.min("official_id").alias("official_id"))
    full = seats.withColumn("last", F.when(F.col("incumbent"), surname(F.col("name")))).join(holders, ["state", "chamber", "label", "last"], "left")
    voters = own.select("voter_id", *at, F.struct("basename", F.coalesce("name", F.lit("")).alias("name")).alias("census_id"))
    label = F.when(F.col("label").rlike("^[0-9]"), F.concat(F.lit("District "), "label")).otherwise(F.col("label"))
    title = F.concat_ws(" ", L.state_name(F.col("state")), F.regexp_replace(L.chamber_name(F.col("state"), F.col("chamber")), "^State ", ""), label)
    return voters.join(matched, [*at, "census_id"]).join(full, [*at, "label"]).select("voter_id", "seat", L.chamber_name(F.col("state"), F.col("chamber")).alias("office"), title.alias("title"), "cand_id", "official_id").distinct()


def district_member_keys(keys: DataFrame, snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """district_key, file, member_key: who a district's key names in each snapshot of its chamber.

    ``keys``: district_key; ``snapshots``: file, chamber, jurisdiction, legislative_chamber (the last two where members are
    keyed by Open States ids, else null); ``members``: file, code, member_key, for chambers of Congress ('tx-12', 'sen-tx-1').
    A key's grammar tells its chamber: a city council's or New York seat is its own number, a seat of Congress is looked up,
    an id of Open States gets its prefix back. New York's chambers never resolve through Open States. Keys of no grammar, of
    chambers without a snapshot and of unknown seats are left out. Three equi-joins in place of a map for each snapshot.
    """
    k = F.col("district_key")
    part = lambda p, i: F.regexp_extract(k, p, i)
    numbered = r"^(nyc-council|ny-sd|ny-ad)-([0-9]+)$"
    house, senate, state = r"^us-house-([a-z]{2})-([0-9]+|al)$", r"^us-sen-([a-z]{2})-([12])$", r"^([a-z]{2})-(upper|lower|legislature)-([0-9a-f-]{36})$"
    chamber = F.when(part(numbered, 1) == "nyc-council", "NYC COUNCIL").when(part(numbered, 1) == "ny-sd", "NY SENATE").when(part(numbered, 1) == "ny-ad", "NY ASSEMBLY").when(k.rlike(house), "U.S. HOUSE").when(k.rlike(senate), "U.S. SENATE")
    code = F.when(k.rlike(house), F.concat(part(house, 1), F.lit("-"), part(house, 2))).when(k.rlike(senate), F.concat(F.lit("sen-"), part(senate, 1), F.lit("-"), part(senate, 2)))
    parsed = keys.select(k).distinct().select(k, chamber.alias("chamber"), code.alias("code"))
    plain = snapshots.where("jurisdiction is null").select("file", "chamber").distinct()
    seated = parsed.where("chamber is not null").join(plain, "chamber")
    own = seated.where("code is null").select("district_key", "file", part(numbered, 2).alias("member_key"))
    congress = seated.where("code is not null").join(members.groupBy("file", "code").agg(F.min("member_key").alias("member_key")), ["file", "code"]).select("district_key", "file", "member_key")
    keyed = snapshots.where("jurisdiction is not null and jurisdiction <> 'ny'").select("file", "jurisdiction", "legislative_chamber").distinct()
    ids = parsed.where(k.rlike(state)).select(k, part(state, 1).alias("jurisdiction"), part(state, 2).alias("legislative_chamber"))
    states = ids.join(keyed, ["jurisdiction", "legislative_chamber"]).select("district_key", "file", F.concat(F.lit("ocd-person/"), part(state, 3)).alias("member_key"))
    return own.unionByName(congress).unionByName(states)
