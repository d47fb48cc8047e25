"""Ranking of address suggestions against what was typed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DIRECTIONS, STREET_TYPES, street_tokens
from ..session import settled

LIMIT = 6
# What a source adds to a score.
SOURCE_BONUS = {"nyc": 4, "nys": 3, "census": 3, "osm": 0}


@dataclass(frozen=True)
class Typed:
    """A parsed query: house number, canonical words after it, ZIP and state."""

    house: str = ""
    words: tuple[str, ...] = ()
    zip: str = ""
    state: str = ""


# Postal codes of states.
STATES = """al ak az ar ca co ct de dc fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or
pa ri sc sd tn tx ut vt va wa wv wi wy""".split()


def looks_complete(typed: Column) -> Column:
    """A house number with three words after it, or with one and a ZIP; a state at the end is no word."""
    tokens = F.filter(F.split(F.lower(F.coalesce(typed, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    last = lambda t: F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(""))
    less = lambda t, test: F.when(test, F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t)
    house = F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit("")).rlike("^[0-9]+[a-z]?$")
    zipped = last(tokens).rlike("^[0-9]{5}$") & (F.size(tokens) > 1)
    words = less(tokens, zipped)
    n = F.size(less(words, last(words).isin(STATES))) - 1
    return house & ((n >= 3) | ((n >= 1) & zipped))


def _starts(tokens: Column, word: str) -> Column:
    return F.exists(tokens, lambda t: F.startswith(t, F.lit(word)))


def score(candidates: DataFrame, q: Typed) -> DataFrame:
    """``candidates`` (house, street, city, state, zip, detail, source) with score, coverage, house_match and keep."""
    street, city = street_tokens(F.col("street")), street_tokens(F.col("city"))
    rows = candidates.withColumns({"__s": street, "__c": F.concat(street, city)})
    house = F.regexp_replace(F.lower("house"), r"\s+", "")
    if q.house:
        match = F.when(house == q.house, "exact").when(F.startswith(house, F.lit(q.house)) | (F.regexp_replace(house, "[a-z]+$", "") == q.house), "prefix").otherwise("none")
        points = F.when(match == "exact", 40).when(match == "prefix", 12).otherwise(-50)
    else:
        match, points = F.lit("n/a"), F.lit(0)
    matched, named = F.lit(0), F.lit(not q.words)
    for i, w in enumerate(q.words):
        typing = i == len(q.words) - 1 and not q.zip and len(w) >= 2
        whole, part = F.array_contains("__c", w), _starts(F.col("__c"), w) if typing else F.lit(False)
        points = points + F.when(whole, 10).when(part, 6).otherwise(-8)
        matched = matched + F.when(whole | part, 1).otherwise(0)
        if w not in STREET_TYPES and w not in DIRECTIONS:
            named = named | F.array_contains("__s", w) | (_starts(F.col("__s"), w) if typing else F.lit(False))
    said = F.array(*map(F.lit, q.words)) if q.words else F.array().cast("array<string>")
    extra = F.size(F.filter("__s", lambda t: ~(F.array_contains(said, t) | F.exists(said, lambda w: (F.length(w) >= 2) & F.startswith(t, w)))))
    points = points - 2 * extra
    kinds = [w for w in (q.words[1:] if q.zip else q.words[1:-1]) if w in STREET_TYPES]
    own_kinds = F.filter("__s", lambda t: t.isin(STREET_TYPES))
    conflict = ((F.size(own_kinds) > 0) & ~F.arrays_overlap(own_kinds, F.array(*map(F.lit, kinds)))) if kinds else F.lit(False)
    if len(q.words) > 1 and q.words[0] in DIRECTIONS:
        conflict = conflict | ~F.array_contains("__s", q.words[0])
    at = next((i for i, w in enumerate(q.words) if 0 < i < len(q.words) - 1 and w in STREET_TYPES), -1)
    if at > 0:
        for w in q.words[:at]:
            if w not in DIRECTIONS:
                conflict = conflict | ~F.array_contains("__s", w)
        rest = " ".join(w for w in q.words[at + 1 :] if w not in DIRECTIONS)
        if q.house and rest:
            begins = lambda c: F.startswith(F.array_join(street_tokens(F.coalesce(F.col(c), F.lit(""))), " "), F.lit(rest))
            conflict = conflict | ~(begins("city") | begins("detail"))
    if q.state:
        conflict = conflict | (F.col("state") != q.state)
    if q.zip:
        points = points + F.when(F.coalesce(F.col("zip"), F.lit("")) == q.zip, 20).otherwise(-15)
    bonus = F.create_map(*[F.lit(x) for kv in SOURCE_BONUS.items() for x in kv])
    points = points + F.coalesce(F.try_element_at(bonus, F.col("source")), F.lit(0))
    coverage = matched / len(q.words) if q.words else F.lit(1.0)
    enough = (coverage > 0 if q.words else F.lit(True)) if len(q.words) < 2 else coverage >= 0.5
    keep = (match != "none") & named & ~conflict & enough
    return rows.withColumns({"score": points, "coverage": coverage, "house_match": match, "keep": keep}).drop("__s", "__c")


def distinct_by_any(rows: DataFrame, order: Column, keys: list[str], most: int | None = None) -> DataFrame:
    """The rows that stay if they are taken in ``order`` and each is left out that shares a key with one taken before; a
    row left out blocks nothing. Null keys are shared with none. ``order`` must tell any two rows apart.

    Rounds of joins stand for the sequential pass: a row that comes first under all its keys is taken, all that share a
    key with it go, and what is left plays again. Rows that agree in all keys are reduced to their first beforehand. With
    ``most``, only the first so many are asked for, and rounds end once no open row can come before them. The number of
    rounds is the length of the longest chain of rows that block each other in turn, not the number of rows.
    """
    one = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    at = [f"__k{i}" for i in range(len(keys))]
    named = rows.select(order.alias("__o"), one.alias("__row"), *[F.col(f"`{k}`").cast("string").alias(a) for k, a in zip(keys, at)])
    alone = named.where(F.coalesce(*at).isNull())
    shared = named.where(F.coalesce(*at).isNotNull()).groupBy(*at).agg(F.min_by("__row", "__o").alias("__row"), F.min("__o").alias("__o"))
    left, taken = settled(shared), [alone.select("__o", "__row")]
    while not left.isEmpty():
        open_, firsts = left, F.lit(True)
        for a in at:
            first = left.where(F.col(a).isNotNull()).groupBy(a).agg(F.min("__o").alias(f"__f{a}"))
            open_ = open_.join(first, a, "left")
            firsts = firsts & (F.col(a).isNull() | (F.col("__o") == F.col(f"__f{a}")))
        won = settled(open_.where(firsts).select("__o", "__row", *at))
        taken.append(won.select("__o", "__row"))
        for a in at:
            left = left.join(won.select(a).where(F.col(a).isNotNull()), a, "left_anti")
        left = settled(left.select("__o", "__row", *at))
        if most is not None:
            best = _all(taken).orderBy("__o").limit(most).agg(F.count(F.lit(1)), F.max("__o")).first()
            first_open = left.agg(F.min("__o")).first()[0]
            if best[0] == most and (first_open is None or first_open > best[1]):
                break
    out = _all(taken)
    return (out if most is None else out.orderBy("__o").limit(most)).select("__row.*")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def rank(candidates: DataFrame, q: Typed, most: int = LIMIT) -> DataFrame:
    """The best ``most`` candidates (with ``position``, the order given): once a house number fits exactly, those that
    only start with it go; of those that share an address or a point with a better one that stays, none does."""
    kept = score(candidates, q).where("keep")
    exact = kept.agg(F.coalesce(F.max((F.col("house_match") == "exact").cast("int")), F.lit(0)).alias("__exact")).first()[0]
    kept = kept.where("house_match <> 'prefix'") if exact else kept
    same = F.concat_ws("|", F.regexp_replace(F.lower("house"), r"\s+", ""), F.array_join(street_tokens(F.col("street")), " "), F.array_join(street_tokens(F.col("city")), " "))
    best = distinct_by_any(kept.withColumn("__address", same), F.struct((-F.col("score")).alias("s"), "position"), ["__address", "point_key"], most)
    return best.drop("__address").orderBy(F.desc("score"), "position")


def name_score(first: Column, middle: Column, last: Column, other_first: Column, other_middle: Column, other_last: Column) -> Column:
    """Likeness of two names with one surname: 100 for all equal, else 2 for the first name or 1 for its initial, and
    3 more or 5 less for middle names that agree or differ; null for other surnames."""
    same = (first == other_first) & middle.eqNullSafe(other_middle)
    by_first = F.when(first == other_first, 2).when(F.substring(first, 1, 1) == F.substring(other_first, 1, 1), 1).otherwise(0)
    by_middle = F.when(middle.isNull() | other_middle.isNull(), 0).when(middle == other_middle, 3).otherwise(-5)
    return F.when(last == other_last, F.when(same, F.lit(100)).otherwise(by_first + by_middle))
