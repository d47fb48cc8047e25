"""Rules of a voter guide's race files: nested records whose citations must resolve within them, and whose candidates must
be known to other tables.

A race's nested arrays are dealt out within its task and its rules are expressions over those rows; only candidates that name
a person leave the race, as narrow rows, to meet the tables of people, biographies and members by their keys. Every broken rule is
a row (file, severity, place, rule). Errors forbid publishing, warnings don't.

Cases: null arrays are empty, except where a rule asks for them; a null or blank text is missing and its citations don't
count as uses; very long arrays are scanned whole; repeated ids are broken rules from the second on; a null id of a race,
source or candidate is missing and is not a duplicate; files that repeat are checked each for itself; an empty table
gives no rows; further columns, whatever their names, are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.content import GUIDE_LOADED, loaded

CLAIM = "struct<text: string, sources: array<string>>"
#: Columns of a race, beside ``file``.
RACE = f"""id string, state string, officeType string, office string, title string, area string, electionDate string, inNYC boolean, researchedAt string,
context array<{CLAIM}>, sources array<struct<id: string, url: string, title: string, publisher: string, kind: string>>,
candidates array<struct<id: string, name: string, parties: array<string>, researchDepth: string, incumbent: boolean, bioguideId: string, website: string, summary: string, background: string,
  priorities: array<{CLAIM}>, statements: array<struct<issue: string, quote: string, sources: array<string>>>,
  positions: array<struct<issue: string, stance: string, summary: string, sources: array<string>, basis: string, stated: struct<stance: string, summary: string, sources: array<string>>>>,
  record: array<struct<kind: string, text: string, sources: array<string>>>>>,
measure struct<question: {CLAIM}, summary: {CLAIM}, yesMeans: string, noMeans: string, argumentsFor: array<{CLAIM}>, argumentsAgainst: array<{CLAIM}>, currentLaw: {CLAIM}, fiscalImpact: {CLAIM},
  campaignFinance: {CLAIM}, supporters: array<{CLAIM}>, opponents: array<{CLAIM}>, fullTextUrl: string>"""

# What a race file may say.
ISSUES = """abortion guns immigration_enforcement rent_regulation housing_supply tax_wealthy healthcare_public climate police_funding school_choice congestion_pricing
minimum_wage israel_aid tariffs universal_childcare voter_citizenship_proof war_powers transgender_sports""".split()
OFFICES = "us-senate us-house governor attorney-general comptroller secretary-of-state state-senate state-assembly ballot-measure other".split()
SOURCE_KINDS = ["official", "candidate", "news", "reference"]
RECORD_KINDS = ["vote", "bill", "action", "finance", "legal"]
STANCES = ["supports", "opposes", "mixed"]
DEPTHS = ["full", "basic", "minimal"]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("?")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _item(place: Column, severity: Column | str | None, rule: Column | str | None, text: Column | None = None, sources: Column | None = None) -> Column:
    """A found rule or, with a null severity, a claim that is to be checked."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    none = F.lit(None).cast("array<string>")
    return F.struct(lit(severity).alias("severity"), place.alias("place"), lit(rule).alias("rule"), lit(text).alias("text"), (none if sources is None else sources).alias("sources"))


def _broken(test: Column, place: Column, rule: Column | str, severity: str = "error") -> Column:
    """A found rule where ``test`` holds; null elsewhere and for a null test."""
    return F.when(test, _item(place, severity, rule))


def _claim(here: Column, place: Column, of: Column, text: str = "text") -> Column:
    return F.when(here, _item(place, None, None, of[text], of["sources"]))


def _lacks(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("")) == ""


def _missing(of: dict[str, Column], place: Column, here: Column) -> list[Column]:
    return [_broken(here & v, place, f"missing {k}") for k, v in of.items()]


def _outside(value: Column, allowed: list[str]) -> Column:
    return ~F.coalesce(value.isin(allowed), F.lit(False))


def _size(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(-1))


# Arrays that are walked together: row j of a race has the j-th element of each, row k of a candidate the k-th.
LISTS = ("argumentsFor", "argumentsAgainst", "supporters", "opponents")
SINGLES = {"question": True, "summary": True, "currentLaw": False, "fiscalImpact": False, "campaignFinance": False}
PARTS = {"priorities": "text", "statements": "quote", "positions": "summary", "record": "text"}


def _zipped(rows: DataFrame, arrays: dict[str, str]) -> Column:
    """The arrays side by side; null ones are empty."""
    kind = rows.select(*[F.col(at).alias(name) for name, at in arrays.items()]).schema
    return F.arrays_zip(*[F.coalesce(F.col(at), F.array().cast(kind[name].dataType)).alias(name) for name, at in arrays.items()])


def _used() -> Column:
    """All sources that claims with a text cite."""
    m, of = F.col("measure"), lambda name: F.flatten(F.array_compact(F.col("candidates")[name]))
    claims = [(of(name), text) for name, text in PARTS.items()] + [(of("positions")["stated"], "summary"), (F.col("context"), "text"), (F.array(*[m[k] for k in SINGLES]), "text"), *[(m[k], "text") for k in LISTS]]
    said = lambda text: lambda x: (F.trim(x[text]) != "") & x["sources"].isNotNull()
    cited = [F.filter(c, said(text))["sources"] for c, text in claims]
    return F.flatten(F.concat(*[F.coalesce(c, F.array().cast("array<array<string>>")) for c in cited]))


def _race_items(here: Column) -> list[Column]:
    """What a race breaks by itself, and the single claims of its measure."""
    race, m, at = F.lit("race"), F.col("measure"), F.lit("measure")
    need = {k: _lacks(F.col(k)) for k in ("id", "state", "officeType", "office", "title", "area", "electionDate", "researchedAt")} | {k: F.col(f"n_{k}") < 0 for k in ("candidates", "sources", "context")}
    there = here & m.isNotNull()
    return [
        *_missing(need, race, here),
        _broken(here & F.col("inNYC").isNull(), race, "inNYC must be boolean"),
        _broken(here & ~_lacks(F.col("id")) & ~F.endswith("file", F.concat("id", F.lit(".json"))), race, "id does not match the file's name"),
        _broken(here & ~_lacks(F.col("officeType")) & _outside(F.col("officeType"), OFFICES), race, _text("bad officeType ", F.col("officeType"))),
        *_missing({k: _lacks(m[k]) for k in ("yesMeans", "noMeans")}, at, there),
        _broken(there & ~_lacks(m["fullTextUrl"]) & ~m["fullTextUrl"].rlike("^https://"), at, "fullTextUrl must be https"),
        *[_claim(there if wanted else there & m[k].isNotNull(), F.lit(f"measure.{k}"), m[k]) for k, wanted in SINGLES.items()],
    ]


def _row_items(first: Column) -> list[Column]:
    """What the j-th source breaks, and the j-th claims of the context and of the measure's lists."""
    j, s, at = F.col("j"), F.col("z.sources"), _text("source ", F.col("z.sources.id"))
    here, again = first & (j < F.col("n_sources")), F.array_position("all_ids", s["id"]) <= j
    return [
        *_missing({k: _lacks(s[k]) for k in ("id", "url", "title", "publisher", "kind")}, at, here),
        _broken(here & again, at, "duplicate id"),
        _broken(here & ~F.coalesce(s["url"], F.lit("")).rlike("^https?://"), at, "bad url"),
        _broken(here & _outside(s["kind"], SOURCE_KINDS), at, _text("bad kind ", s["kind"])),
        _broken(here & s["id"].isNotNull() & ~again & ~F.coalesce(F.array_contains("used", s["id"]), F.lit(False)), at, "never cited", "warning"),
        _claim(first & (j < F.col("n_context")), _text("context[", j, "]"), F.col("z.context")),
        *[_claim(first & (j < _size(F.col("measure")[k])), _text(f"measure.{k}[", j, "]"), F.col("z")[k]) for k in LISTS],
    ]


def _candidate_items(first: Column) -> list[Column]:
    """What the j-th candidate breaks by itself."""
    c, j, at = F.col("c"), F.col("j"), _text("candidate ", F.col("c.id"))
    here = first & (j < F.col("n_candidates"))
    return [
        *_missing({"id": _lacks(c["id"]), "name": _lacks(c["name"]), "parties": c["parties"].isNull(), "researchDepth": _lacks(c["researchDepth"])}, at, here),
        _broken(here & (c["summary"].isNotNull() | c["background"].isNotNull()), at, "summary and background belong to the biography"),
        _broken(here & (F.array_position("candidate_ids", c["id"]) <= j), at, "duplicate id"),
        _broken(here & c["incumbent"].isNull(), at, "incumbent must be boolean"),
        _broken(here & _outside(c["researchDepth"], DEPTHS), at, "bad researchDepth"),
        *[_broken(here & c[k].isNull(), at, f"{k} must be an array") for k in ("priorities", "positions", "record")],
        _broken(here & ~_lacks(c["website"]) & ~c["website"].rlike("^https?://"), at, "bad website"),
    ]


def _part_items() -> list[Column]:
    """What the k-th position, statement and record of a candidate break, and the k-th claims."""
    c, k, at = F.col("c"), F.col("k"), _text("candidate ", F.col("c.id"))
    there = {name: k < _size(c[name]) for name in PARTS}
    place = {name: _text(at, f".{name}[", k, "]") for name in PARTS}
    p, s, x = F.col("e.positions"), F.col("e.statements"), F.col("e.record")
    position, stated = there["positions"], there["positions"] & F.col("e.positions.stated").isNotNull()
    said = _text(place["positions"], ".stated")
    return [
        _broken(position & _outside(p["issue"], ISSUES), place["positions"], _text("bad issue ", p["issue"])),
        _broken(position & _outside(p["stance"], STANCES), place["positions"], "bad stance"),
        _broken(position & ~_lacks(p["basis"]) & _outside(p["basis"], ["votes", "statements"]), place["positions"], "bad basis"),
        _broken(stated & _outside(p["stated"]["stance"], STANCES), said, "bad stance"),
        _broken(position & (F.array_position(c["positions"]["issue"], p["issue"]) <= k), at, _text("issue ", p["issue"], " listed twice"), "warning"),
        _broken(there["statements"] & _outside(s["issue"], ISSUES), place["statements"], _text("bad issue ", s["issue"])),
        _broken(there["statements"] & _lacks(s["quote"]), place["statements"], "quote required"),
        _broken(there["record"] & _outside(x["kind"], RECORD_KINDS), place["record"], _text("bad kind ", x["kind"])),
        *[_claim(there[name], place[name], F.col("e")[name], text) for name, text in PARTS.items()],
        _claim(stated, said, p["stated"], "summary"),
    ]


def race_rules(races: DataFrame) -> DataFrame:
    """file, severity, place, rule of each rule that a race (file and the columns of ``RACE``) breaks within itself.

    A race's arrays are dealt out side by side, then a candidate's, so that rules are plain expressions of a row, for which
    Spark makes code; within ``transform`` it makes none. What is dealt out is a column of a projection before it, and
    the explode an outer one: else the expressions would be evaluated without code, and again in a filter below. No row
    leaves its task.
    """
    given = races.select("file", *[c.strip().split(" ")[0] for c in ("id", "state", "officeType", "office", "title", "area", "electionDate", "inNYC", "researchedAt", "context", "sources", "candidates", "measure")])
    own = ["file", "id", "state", "officeType", "office", "title", "area", "electionDate", "inNYC", "measure", "researchedAt", "n_candidates", "n_sources", "n_context", "all_ids", "source_ids", "candidate_ids", "used"]
    ids = F.col("sources")["id"]
    held = given.withColumns({
        **{f"n_{k}": _size(F.col(k)) for k in ("candidates", "sources", "context")}, "all_ids": ids, "source_ids": F.coalesce(F.array_compact(ids), F.array().cast("array<string>")), "candidate_ids": F.col("candidates")["id"], "used": _used(),
        "zipped": _zipped(given, {k: k for k in ("candidates", "sources", "context")} | {k: f"measure.{k}" for k in LISTS}),
    })
    rows = held.select(*own, F.posexplode_outer("zipped").alias("j", "z")).withColumns({"j": F.coalesce("j", F.lit(0)), "c": F.col("z.candidates")})
    deep = rows.withColumn("parts", _zipped(rows, {k: f"c.{k}" for k in PARTS})).select(*own, "j", "z", "c", F.posexplode_outer("parts").alias("k", "e")).withColumn("k", F.coalesce("k", F.lit(0)))
    first = F.col("k") == 0
    items = F.array(*_race_items(first & (F.col("j") == 0)), *_row_items(first), *_candidate_items(first), *_part_items())
    each = deep.select("file", "source_ids", items.alias("items")).select("file", "source_ids", F.explode_outer("items").alias("i")).where("i is not null").select("file", "source_ids", "i.*")
    claim, empty = F.col("severity").isNull(), F.trim(F.coalesce("text", F.lit(""))) == ""
    full = claim & ~empty
    rule = lambda test, severity, said: F.when(test, F.struct(F.lit(severity).alias("severity"), "place", F.lit(said).alias("rule")))
    unknown = F.transform(F.filter("sources", lambda s: s.isNull() | ~F.array_contains(F.col("source_ids"), s)), lambda s: F.struct(F.lit("error").alias("severity"), F.col("place"), _text("unknown source ", s).alias("rule")))
    found = F.array(
        F.when(~claim, F.struct("severity", "place", "rule")), rule(claim & empty, "error", "missing text"), rule(full & (F.coalesce(F.size("sources"), F.lit(0)) <= 0), "error", "no sources"),
        rule(full & loaded(F.col("text"), GUIDE_LOADED), "warning", "loaded language"),
    )
    # Most claims cite known sources only, which generated code can tell; the rest are gone through one by one.
    also = F.coalesce(F.when(full & (F.size(F.array_except("sources", "source_ids")) > 0), unknown), F.array().cast("array<struct<severity: string, place: string, rule: string>>"))
    checked = each.select("file", F.concat(found, also).alias("found")).select("file", F.explode_outer("found").alias("f"))
    return checked.where("f is not null").select("file", "f.severity", "f.place", "f.rule")


def last_word(name: Column) -> Column:
    """The last word of a name in lower case, without the suffix of a generation."""
    bare = F.regexp_replace(F.lower(name), r",?\s+(jr|sr|ii|iii|iv)\.?$", "")
    return F.element_at(F.split(F.trim(F.regexp_replace(bare, r"[^a-z\s-]", "")), r"\s+"), -1)


def people_rules(races: DataFrame, people: DataFrame, biographies: DataFrame, members: DataFrame) -> DataFrame:
    """file, severity, place, rule of candidates that other tables don't know, or know under another name.

    ``people``: race_id, candidate_id, slug; ``biographies``: slug; ``members``: bioguide_id, member_name. One row a key
    counts, the smallest. Rows without a key pass by the joins, so none is hot.
    """
    each = races.select("file", F.col("id").alias("race_id"), F.posexplode_outer("candidates").alias("at", "c")).where("at is not null").select("file", "race_id", F.col("c.id").alias("candidate_id"), F.col("c.name").alias("name"), F.col("c.bioguideId").alias("bioguide_id"))
    slugs = people.groupBy("race_id", "candidate_id").agg(F.min("slug").alias("slug"))
    described = slugs.join(biographies.select("slug", F.lit(True).alias("described")).distinct(), "slug", "left")
    known = each.join(described, ["race_id", "candidate_id"], "left")
    # Candidates without an id of a member are dealt out by their own keys; members have the key 0, which those never have.
    alone = F.when(F.col("bioguide_id").isNull() | F.col("name").isNull(), F.xxhash64("race_id", "candidate_id").bitwiseOR(F.lit(1)))
    named = members.groupBy("bioguide_id").agg(F.min("member_name").alias("member_name")).where("bioguide_id is not null").select(F.col("bioguide_id").alias("b"), F.lit(0).cast("long").alias("a"), "member_name", last_word(F.col("member_name")).alias("theirs"))
    met = known.withColumns({"b": F.coalesce("bioguide_id", F.lit("")), "a": F.coalesce(alone, F.lit(0).cast("long"))}).join(named, ["b", "a"], "left")
    theirs = F.col("theirs")
    found = F.array(
        F.when(F.col("slug").isNull(), "not among the people"), F.when(F.col("slug").isNotNull() & F.col("described").isNull(), F.concat(F.lit("no biography "), "slug")),
        F.when((theirs != last_word(F.col("name"))) & ~F.contains(F.lower("name"), theirs), F.concat(F.lit("bioguideId belongs to "), "member_name")),
    )
    place = _text("candidate ", F.col("candidate_id"))
    return met.select("file", place.alias("place"), found.alias("found")).select("file", F.lit("error").alias("severity"), "place", F.explode_outer("found").alias("rule")).where("rule is not null")


def race_violations(races: DataFrame, people: DataFrame, biographies: DataFrame, members: DataFrame) -> DataFrame:
    """All broken rules of all races; a race without a row of severity error may be published."""
    return race_rules(races).unionByName(people_rules(races, people, biographies, members))
