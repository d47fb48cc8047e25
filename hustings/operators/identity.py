"""Who is who: matching candidates to officials, stable slugs, staged resolution of printed names, district labels.

Every match is an equi-join on a selective key (an id, a seat, state and name) with a residual test, and counts its
hits by aggregation, so uniqueness never needs a list of pairs on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, is_at_large, name_words, norm_district, norm_name, slugify, surname


def _range(officials: DataFrame, by: list[str]) -> DataFrame:
    """The least and the largest official of each ``by``: one official is both."""
    return officials.groupBy(*by).agg(F.min("official_key").alias("least"), F.max("official_key").alias("most"))


def _only(pairs: DataFrame, by: list[str], tier: str) -> DataFrame:
    """The least official of each ``by``; ``n`` is 1 if there was no other, else 2."""
    least, most = F.min("least"), F.max("most")
    return pairs.groupBy(*by).agg(F.when(least == most, 1).when(least < most, 2).alias(f"n_{tier}"), least.alias(tier))


def first_and_rest(name: Column) -> tuple[Column, Column]:
    words = name_words(name)
    return F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")


def match_officials(candidates: DataFrame, officials: DataFrame) -> DataFrame:
    """cand_key, official_key (null: nobody), tier. Candidates: cand_key, name, state, bioguide, incumbent, seats;
    officials: official_key, name, state, bioguide, seats.

    Tiers: the same biographical id; an incumbent's seat and surname if one official has both (the first such seat);
    state and full name if one official has them (several end the search); state, surname, other names and a first
    name of three letters or more that starts the other's, if one official fits.

    Officials who agree in a tier's keys are one row, so a candidate meets first names, never all officials of a name.
    """
    c = candidates.withColumns({"n_name": norm_name(F.col("name")), "n_last": surname(F.col("name"))})
    o = officials.withColumns({"n_name": norm_name(F.col("name")), "n_last": surname(F.col("name"))})
    by_id = c.where("bioguide is not null").join(o.where("bioguide is not null").groupBy("bioguide").agg(F.max("official_key").alias("official_key")), "bioguide").select("cand_key", F.col("official_key").alias("by_id"))
    seats = c.where("incumbent").select("cand_key", "n_last", F.posexplode("seats").alias("at", "seat"))
    held = o.select("official_key", "n_last", F.explode("seats").alias("seat"))
    seat = _only(seats.join(_range(held, ["seat", "n_last"]), ["seat", "n_last"]), ["cand_key", "at"], "by_seat").where("n_by_seat = 1").groupBy("cand_key").agg(F.min_by("by_seat", "at").alias("by_seat"))
    name = _only(c.select("cand_key", "state", "n_name").join(_range(o, ["state", "n_name"]), ["state", "n_name"]), ["cand_key"], "by_name")
    cf, cr = first_and_rest(F.col("name"))
    short = lambda df, key, first: df.select(key, "state", "n_last", cr.alias("rest"), cf.alias(first))
    near = short(c, "cand_key", "c_first").join(_range(short(o, "official_key", "o_first"), ["state", "n_last", "rest", "o_first"]), ["state", "n_last", "rest"])
    less, more = F.when(F.length("o_first") < F.length("c_first"), F.col("o_first")).otherwise(F.col("c_first")), F.when(F.length("o_first") < F.length("c_first"), F.col("c_first")).otherwise(F.col("o_first"))
    nick = _only(near.where((F.length(less) >= 3) & F.startswith(more, less)), ["cand_key"], "by_short")
    out = candidates.select("cand_key")
    for t in (by_id, seat, name, nick):
        out = out.join(t, "cand_key", "left")
    third, fourth = F.when(F.col("n_by_name") == 1, F.col("by_name")), F.when(F.col("n_by_name").isNull() & (F.col("n_by_short") == 1), F.col("by_short"))
    tier = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_seat").isNotNull(), "seat").when(third.isNotNull(), "name").when(F.col("n_by_name") > 1, "ambiguous").when(fourth.isNotNull(), "short").otherwise("none")
    return out.select("cand_key", F.coalesce("by_id", "by_seat", third, fourth).alias("official_key"), tier.alias("tier"))


def one_per_race(matches: DataFrame, races: DataFrame) -> DataFrame:
    """Two candidates of a race are two people: of those that match one official the first by key keeps the match."""
    # Candidates without an official or a race keep what they have, so they are dealt out by their own keys.
    alone = F.when(F.col("official_key").isNull() | F.col("race_id").isNull(), F.col("cand_key"))
    w = W.partitionBy("official_key", "race_id", alone).orderBy("cand_key")
    ranked = matches.join(races, "cand_key", "left").withColumn("__r", F.row_number().over(w))
    return ranked.withColumn("official_key", F.when((F.col("__r") == 1) | F.col("race_id").isNull(), F.col("official_key"))).drop("__r")


def assign_slugs(people: DataFrame, taken: DataFrame) -> DataFrame:
    """key, slug. ``people``: key, name, state, tag; ``taken``: slug, key (the key it was issued to, null if gone).

    A person keeps an issued slug; slugs are never issued again. Others get the name, then name and state, then the
    tag too; all who collide on a level go to the next together; at last numbers follow, in the order of the keys.
    """
    old = taken.where("key is not null").groupBy("slug").agg(F.min("key").alias("key")).groupBy("key").agg(F.min("slug").alias("slug"))
    used = taken.select("slug").distinct()
    kept = people.join(old, "key").select("key", "slug")
    pending = people.join(old, "key", "left_anti")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    levels = [slugify(F.col("name")), slugify(F.concat_ws(" ", "name", blank("state"))), slugify(F.concat_ws(" ", "name", blank("state"), blank("tag")))]
    for level in levels:
        named = pending.withColumn("slug", level)
        alone = named.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("slug").join(used, "slug", "left_anti")
        fit = named.join(alone, "slug", "left_semi").select("key", "slug")
        kept, used = kept.unionByName(fit), used.unionByName(fit.select("slug"))
        pending = named.join(alone, "slug", "left_anti").drop("slug")
    rest = pending.withColumn("base", levels[2]).withColumn("k", F.row_number().over(W.partitionBy("base").orderBy("key")).cast("long"))
    number = F.when(F.col("slug") == F.col("base"), F.lit(1)).otherwise(F.regexp_extract("slug", "-([0-9]+)$", 1).try_cast("long"))
    bases = used.select("slug", F.explode(F.array_distinct(F.array(F.col("slug"), F.regexp_replace("slug", "-[0-9]+$", "")))).alias("base"))
    numbers = bases.withColumn("n", number).where("n is not null").groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("gone"))
    free = F.aggregate(F.coalesce("gone", F.array().cast("array<bigint>")), F.col("k"), lambda a, x: F.when(x <= a, a + 1).otherwise(a))
    numbered = rest.join(numbers, "base", "left").withColumn("n", free)
    return kept.unionByName(numbered.select("key", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug")))


def staged(names: DataFrame, members: DataFrame) -> DataFrame:
    """Resolve printed surnames (name_id, chamber, surname) in stages: current members of the chamber, departed ones,
    current members of the other chamber. The first stage with a hit decides: one is found, several are ambiguous.
    ``members``: member_key, surname, chamber, current."""
    # Members of one surname, chamber and standing are one row, the least and largest of them: one member is both.
    kept = members.groupBy("surname", F.col("chamber").alias("__c"), "current").agg(F.min("member_key").alias("m"), F.max("member_key").alias("most"))
    same = F.col("chamber") == F.col("__c")
    stage = F.when(same & F.col("current"), 1).when(same, 2).when(F.col("current"), 3)
    hits = names.join(kept, "surname").withColumn("stage", stage).where("stage is not null")
    by = hits.groupBy("name_id", "stage").agg(F.min("m").alias("m"), F.max("most").alias("most"))
    first = by.groupBy("name_id").agg(F.min(F.struct("stage", "m", "most")).alias("f"))
    one = F.col("f.m") == F.col("f.most")
    return names.join(first, "name_id", "left").select("name_id", F.when(one, F.col("f.m")).alias("member_key"), F.col("f.stage").alias("stage"), F.when(F.col("f").isNull(), "unknown").when(one, "found").otherwise("ambiguous").alias("status"))


def match_districts(census: DataFrame, labels: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """census_id, label: labels equal to a district's base name or name once normalised; failing that, for a bare
    number, labels of that number and one letter. ``census``: census_id, basename, name; ``labels``: label. ``scope`` names
    columns of both (a state, a chamber) within which labels count."""
    known = labels.select(*scope, "label").distinct().withColumn("k", norm_district(F.col("label")))
    keys = census.select(*scope, "census_id", F.explode(F.array_distinct(F.array(norm_district(F.col("basename")), F.coalesce(norm_district(F.col("name")), F.lit(""))))).alias("k")).where("k <> ''")
    exact = keys.join(known, [*scope, "k"]).select(*scope, "census_id", "label").distinct()
    rest = census.join(exact.select(*scope, "census_id").distinct(), [*scope, "census_id"], "left_anti").select(*scope, "census_id", norm_district(F.col("basename")).alias("k")).where(F.col("k").rlike("^[0-9]+$"))
    lettered = known.where(F.col("k").rlike("^[0-9]+[a-z]$")).select(*scope, "label", F.regexp_replace("k", "[a-z]$", "").alias("k"))
    return exact.unionByName(rest.join(lettered, [*scope, "k"]).select(*scope, "census_id", "label"))


def match_chamber(census: DataFrame, labels: DataFrame) -> DataFrame:
    """Matches, the labels that apply in the whole chamber, and a row with a null label for each district with none."""
    found = match_districts(census, labels)
    # The spellings of at-large are a handful: one row with all of them, spread over the districts.
    spellings = labels.where(is_at_large(F.col("label"))).agg(F.collect_set("label").alias("__l"))
    wide = census.select("census_id").join(F.broadcast(spellings)).select("census_id", F.explode("__l").alias("label"))
    every = found.unionByName(wide).distinct()
    gaps = census.join(every.select("census_id").distinct(), "census_id", "left_anti").select("census_id", F.lit(None).cast("string").alias("label"))
    return every.unionByName(gaps)


def seat_coverage(census: DataFrame, roster: DataFrame, key: str) -> DataFrame:
    """Districts without a member and members without a district."""
    a = census.select(key).distinct().withColumn("__a", F.lit(1))
    b = roster.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full_outer").where("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), "no district").otherwise("no member").alias("gap"))


def set_differences(expected: DataFrame, got: DataFrame, key: list[str]) -> DataFrame:
    """key and status: keys that are only expected are missing, keys that are only got are extra; a key with a null equals no
    other. Both sides are marked and counted by key in one shuffle, repeats before it, so no side is held whole."""
    side = lambda df, here: df.select(*key, F.lit(here).alias("__e"), F.lit(not here).alias("__g"))
    both = side(expected, True).unionByName(side(got, False)).groupBy(*key).agg(F.max("__e").alias("__e"), F.max("__g").alias("__g"))
    alone = F.lit(False)
    for k in key:
        alone = alone | F.col(k).isNull()
    missing = F.when(F.col("__e") & (~F.col("__g") | alone), "missing")
    extra = F.when(F.col("__g") & (~F.col("__e") | alone), "extra")
    return both.select(*key, F.explode(F.array_compact(F.array(missing, extra))).alias("status"))


def segment_names(text: Column, known: Column, longest: int = 4) -> Column:
    """Cut an unpunctuated run of names into known names, the longest first; null if some word fits none.

    A fold over the words: it skips what the last name took. ``known`` is an array of names in lower case.
    """
    words = F.filter(F.split(F.lower(text), " +"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, i: Column) -> Column:
        take = F.coalesce(*[F.when((i + k <= F.size(words)) & F.array_contains(known, F.array_join(F.slice(words, i + 1, F.lit(k)), " ")), F.lit(k)) for k in range(longest, 0, -1)], F.lit(0))
        name = F.array_join(F.slice(words, i + 1, F.greatest(take, F.lit(1))), " ")
        new = F.struct((take - 1).alias("skip"), F.array_append(acc["out"], name).alias("out"), (acc["ok"] & (take > 0)).alias("ok"))
        return F.when(acc["skip"] > 0, F.struct((acc["skip"] - 1).alias("skip"), acc["out"].alias("out"), acc["ok"].alias("ok"))).otherwise(new)

    places = F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(words) - 1))
    return F.aggregate(places, start, step, lambda a: F.when(a["ok"], a["out"]))


def cut_names(spans: list[tuple[int, int, object]], words: int, count: int) -> list | None:
    """The members of the first way to cut ``words`` words into exactly ``count`` names of different members, trying longer
    names first; None if there is none. ``spans``: place, length in words, member.

    A table of the numbers of names that each rest can be cut into (a bit each) leaves out dead ends; among the rest only
    members that fit in several places can collide, so states that failed are known by place, names left and those.
    """
    at: dict[int, list[tuple[int, object]]] = {}
    for place, length, member in sorted(spans, key=lambda s: (s[0], -s[1])):
        at.setdefault(place, []).append((length, member))
    able = [0] * words + [1]
    for i in range(words - 1, -1, -1):
        for length, _ in at.get(i, ()):
            able[i] |= able[i + length] << 1 if i + length <= words else 0
    seen: dict[object, int] = {}
    for _, _, member in spans:
        seen[member] = seen.get(member, 0) + 1
    path: list[tuple[int, object]] = []
    used: set = set()
    failed: set = set()
    stack = [(0, count, iter(at.get(0, ())))]
    if not able[0] >> count & 1:
        return None
    while stack:
        place, left, options = stack[-1]
        if place == words:
            return [member for _, member in path]
        for length, member in options:
            to = place + length
            if to > words or left < 1 or member in used or not able[to] >> (left - 1) & 1:
                continue
            again = {member} if seen[member] > 1 else set()
            if (to, left - 1, frozenset(used | again)) in failed:
                continue
            path.append((place, member))
            used |= again
            stack.append((to, left - 1, iter(at.get(to, ()))))
            break
        else:
            failed.add((place, left, frozenset(used)))
            stack.pop()
            if path:
                used.discard(path.pop()[1])
    return None


def partition_names(text: str, known: list[str], count: int, longest: int = 4) -> list[str] | None:
    """Cut one block into exactly ``count`` distinct known names, each of at most ``longest`` words; None if impossible."""
    words, names = text.lower().split(), set(known)
    runs = [(i, k, " ".join(words[i : i + k])) for i in range(len(words)) for k in range(1, min(longest, len(words) - i) + 1)]
    return cut_names([r for r in runs if r[2] in names], len(words), count)


def name_key(name: Column) -> Column:
    """Letters of a name in lower case, without accents."""
    return F.regexp_replace(F.lower(fold(name)), "[^a-z]", "")


#: Rosters of up to so many names are sent to all executors (some 100 bytes a name); larger ones are shuffled.
MAX_SENT = 500_000


def cut_blocks(counts, words, starts, place, length, members, longest: int = 4):
    """``cut_names`` for many blocks at once: an Arrow array of lists of members. ``starts`` are the bounds of each block's
    spans in ``place``, ``length`` and ``members``; a count below 0 stands for none.

    The table of the numbers of names that each rest can be cut into, and the walk along it that takes the longest name
    first, are made for all blocks together, place by place. If all members of that walk differ, it is the first way.
    Blocks in which a member would come twice, and those of more than 60 words, are searched one by one.
    """
    import numpy as np
    import pyarrow as pa

    counts, words, place, length = (np.asarray(x, dtype="int64") for x in (counts, words, place, length))
    starts, n = np.asarray(starts, dtype="int64"), len(counts)
    of = np.repeat(np.arange(n), np.diff(starts))
    together = (words <= 60) & (counts <= words) & (counts >= 0)
    alone = (words > 60) & (counts <= words) & (counts >= 0)
    most = int(words[together].max(initial=0))
    fits = together[of] & (place + length <= words[of])
    span = np.full((n, most + longest + 1, longest + 1), -1, dtype="int64")
    span[of[fits], place[fits], length[fits]] = np.flatnonzero(fits)
    able = np.zeros((n, most + longest + 1), dtype="int64")
    able[np.flatnonzero(together), words[together]] = 1
    for i in range(most - 1, -1, -1):
        for k in range(1, longest + 1):
            able[:, i] |= np.where(span[:, i, k] >= 0, able[:, i + k] << 1, 0)
    live = together & (able[:, 0] >> np.clip(counts, 0, 62) & 1 > 0)
    rows, at, left, steps = np.flatnonzero(live), np.zeros(n, dtype="int64"), counts.copy(), []
    while len(rows := rows[left[rows] > 0]):
        taken = np.full(len(rows), -1, dtype="int64")
        for k in range(longest, 0, -1):
            hit = span[rows, at[rows], k]
            ok = (taken < 0) & (hit >= 0) & (able[rows, at[rows] + k] >> (left[rows] - 1) & 1 > 0)
            taken[ok] = hit[ok]
        steps.append((rows, taken))
        at[rows] += length[taken]
        left[rows] -= 1
    row = np.concatenate([r for r, _ in steps] or [np.zeros(0, dtype="int64")])
    order = np.argsort(row, kind="stable")
    row, picked = row[order], np.concatenate([t for _, t in steps] or [row])[order]
    code = members.dictionary_encode().indices.to_numpy(zero_copy_only=False)[picked]
    by = np.lexsort((code, row))
    twice = np.zeros(n, dtype=bool)
    twice[row[by][1:][(row[by][1:] == row[by][:-1]) & (code[by][1:] == code[by][:-1])]] = True
    searched = {}
    for i in np.flatnonzero(twice & live | alone):
        spans = range(starts[i], starts[i + 1])
        ids = members[starts[i] : starts[i + 1]].dictionary_encode().indices.to_pylist()
        first = {m: j for m, j in zip(reversed(ids), reversed(spans))}
        got = cut_names([(int(place[j]), int(length[j]), m) for j, m in zip(spans, ids)], int(words[i]), int(counts[i]))
        searched[int(i)] = None if got is None else [first[m] for m in got]
    found = live & ~twice
    sizes = np.where(found, counts, 0)
    for i, got in searched.items():
        found[i], sizes[i] = got is not None, len(got or ())
    ends = np.concatenate([[0], np.cumsum(sizes)])
    values = np.empty(ends[-1], dtype="int64")
    values[np.repeat(found & ~np.isin(np.arange(n), list(searched)), sizes)] = picked[~(twice | alone)[row]]
    for i, got in searched.items():
        values[ends[i] : ends[i + 1]] = got or []
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members.take(pa.array(values)), mask=pa.array(~found))


def partition_blocks(blocks: DataFrame, roster: DataFrame, longest: int = 4) -> DataFrame:
    """block_id and ``members``: each block of names without separators cut into exactly ``count`` different members; null
    if impossible. Of several cuts the first counts that takes a longer name at the first place where they differ.

    ``blocks``: block_id, chamber, text, count; ``roster``: chamber, name, member_key; a name that several members of a
    chamber share names none. Glued words ("WilsonStivers") are cut at capitals. All runs of up to ``longest`` words meet
    the roster in one join, so a task that cuts a block sees only the spans found in it. Letters are found once a text;
    rows go on from the join with their block's count, so blocks that are dealt by their ids are not shuffled again.

    Cases: null and empty texts can be cut into no names (count 0: an empty list); null counts and chambers give null; very
    long texts take time in proportion to words times names; repeated block ids must not occur; empty tables give no rows.
    """
    import pyarrow as pa

    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z])(?=[A-Z])", "$1 ")
    line = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    asked = F.when(F.col("chamber").isNotNull(), F.col("count").cast("int"))
    lines = blocks.select("block_id", "chamber", asked.alias("count"), line.alias("line"))
    folded = F.when(F.col("line").rlike(r"[^\x00-\x7F]"), fold(F.col("line"))).otherwise(F.col("line"))
    letters = F.split(F.regexp_replace(F.lower(folded), "[^a-z ]", ""), " ", -1)
    cut = lines.select("block_id", "chamber", "count", letters.alias("w"), F.when(F.col("line") != "", F.size(letters)).otherwise(0).alias("words"))
    places = cut.select("*", F.explode_outer(F.when(F.col("words") > 0, F.sequence(F.lit(0), F.col("words") - 1))).alias("place"))
    spans = places.select("*", F.explode_outer(F.when(F.col("words") > 0, F.sequence(F.lit(1), F.least(F.lit(longest), F.col("words") - F.col("place"))))).alias("length"))
    each = spans.select("block_id", "chamber", "count", "words", "place", "length", F.array_join(F.slice("w", F.col("place") + 1, F.col("length")), "").alias("name"))
    known = roster.select("chamber", name_key(F.col("name")).alias("name"), "member_key").where("name <> ''").groupBy("chamber", "name").agg(F.min("member_key").alias("m"), F.max("member_key").alias("other")).where("m = other").drop("other")
    if known.count() <= MAX_SENT:
        known = F.broadcast(known)
    met = each.join(known, ["chamber", "name"], "left").where("m IS NOT NULL OR coalesce(place, 0) = 0 AND coalesce(length, 1) = 1")
    found = met.groupBy("block_id", "count", "words").agg(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("place", "length", "m"))).alias("spans"))

    def run(batches):
        for b in batches:
            spans = b.column("spans")
            place, length, members = spans.flatten().flatten()
            starts = spans.offsets.to_numpy() - spans.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column("block_id"), cut_blocks(b.column("count").fill_null(-1), b.column("words"), starts, place, length, members, longest)], names=["block_id", "members"])

    kind, of = blocks.schema["block_id"].dataType.simpleString(), roster.schema["member_key"].dataType.simpleString()
    return found.mapInArrow(run, f"block_id {kind}, members array<{of}>")


# The given name that a nickname stands for.
NICKNAMES = {
    "tom": "thomas", "mike": "michael", "jim": "james", "bill": "william", "bob": "robert", "dan": "daniel", "joe": "joseph", "chris": "christopher", "tim": "timothy", "ben": "benjamin", "ed": "edward", "dave": "david", "steve": "steven",
    "rick": "richard", "andy": "andrew", "tony": "anthony", "ron": "ronald", "don": "donald", "ken": "kenneth", "pat": "patrick", "greg": "gregory", "jack": "john", "liz": "elizabeth", "kate": "katherine", "sam": "samuel", "nick": "nicholas",
}


def formal_name(given: Column) -> Column:
    """One name for all that stand for each other: the formal one."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv]), given), given)


def printed_parts(printed: Column) -> Column:
    """Struct of surname, given and initial of a printed name: 'Nelson, D.', 'D. Nelson', 'Ann M. Nelson' or 'Nelson'.

    Suffixes, quoted nicknames and parentheses go. A given name of one letter is an initial. Null names have nulls.
    """
    bare = F.regexp_replace(F.regexp_replace(fold(printed), r"\([^)]*\)|[\"“][^\"”]*[\"”]|'[^']*'", " "), r"(?i),?\s+(jr|sr|ii|iii|iv)\.?\s*$", "")
    after, before = F.split_part(bare, F.lit(","), F.lit(1)), F.split_part(bare, F.lit(","), F.lit(2))
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z ]", ""), " +"), lambda w: w != "")
    turned = F.contains(bare, F.lit(","))
    whole = words(bare)
    first = F.when(turned, F.get(words(before), F.lit(0))).when(F.size(whole) > 1, F.get(whole, F.lit(0)))
    surname = F.when(turned, F.array_join(words(after), "")).otherwise(F.element_at(F.when(F.size(whole) > 0, whole), -1))
    return F.struct(surname.alias("surname"), F.when(F.length(first) > 1, first).alias("given"), F.substring(first, 1, 1).alias("initial"))


def resolve_names(names: DataFrame, members: DataFrame) -> DataFrame:
    """name_id, member_key, stage, status: printed names to members, by tiers of the name within stages of the chamber.

    ``names``: name_id, chamber, printed, party (may be null); ``members``: member_key, given, family, party, chamber (null:
    departed). A member fits whose family name, or its last word, is the surname, and whose given name agrees with the
    printed one: equal or a start of it, equal as nicknames, or of the same initial if only that is printed. If a given
    name fits nobody, the one member of the chamber with that surname does. Members of the chamber come before departed
    ones, those before members elsewhere; the first stage with a hit decides: one member is found; several are told apart
    by party, and else are ambiguous.

    Cases: null and empty names are unknown; repeated rows of a member are one; repeated names are resolved alike; empty
    tables give no or only unknown rows; further columns are not used.
    """
    key = lambda c: F.regexp_replace(F.lower(fold(F.col(c))), "[^a-z ]", "")
    words = F.filter(F.split(key("family"), " +"), lambda w: w != "")
    surnames = F.array_distinct(F.array(F.array_join(words, ""), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))))
    known = members.select("member_key", F.col("party").alias("of_party"), F.col("chamber").alias("of"), F.regexp_replace(key("given"), " .*", "").alias("known"), F.explode(surnames).alias("surname")).where("surname <> ''")
    # Members alike in all that a name is held against are one row, the least and largest of them; so are names.
    known = known.groupBy("surname", "known", "of", "of_party").agg(F.min("member_key").alias("m"), F.max("member_key").alias("most"))
    as_said = ["chamber", "party", "surname", "given", "initial"]
    asked = names.select("name_id", "chamber", "party", printed_parts(F.col("printed")).alias("p")).select("name_id", "chamber", "party", "p.*").where("surname is not null")
    met = asked.select(*as_said).distinct().join(known, "surname")
    start = F.startswith("known", F.col("given")) | F.startswith("given", F.col("known"))
    given = (F.length("known") > 0) & (start | (formal_name(F.col("given")) == formal_name(F.col("known"))))
    by_initial = (F.col("initial") == F.substring("known", 1, 1)) | (F.col("initial") == F.substring(formal_name(F.col("known")), 1, 1))
    fits = F.when(F.col("given").isNotNull(), given).when(F.col("initial").isNotNull(), by_initial).otherwise(F.lit(True))
    stage = F.when(F.col("of") == F.col("chamber"), 1).when(F.col("of").isNull(), 2).otherwise(3)
    of_party = F.coalesce(F.col("party") == F.col("of_party"), F.col("of_party").isNull() & F.col("party").isNotNull())
    mine = lambda c: F.when(of_party, F.col(c))
    hits = met.select(*as_said, stage.alias("stage"), F.coalesce(fits, F.lit(False)).alias("fits"), F.col("given").isNotNull().alias("full"), "m", "most", mine("m").alias("own_m"), mine("most").alias("own_most")).where("fits or (full and stage = 1)")
    ends = [F.min("m").alias("m"), F.max("most").alias("most"), F.min("own_m").alias("own_m"), F.max("own_most").alias("own_most")]
    said = hits.groupBy(*as_said, "fits", "stage").agg(*ends)
    alike = [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in as_said if c != "surname"]
    each = asked.alias("a").join(said.alias("s"), [F.col("a.surname") == F.col("s.surname"), *alike]).select("a.name_id", "s.fits", "s.stage", "s.m", "s.most", "s.own_m", "s.own_most")
    tiers = each.groupBy("name_id", "fits", "stage").agg(*ends)
    pick = F.struct((~F.col("fits")).alias("late"), "stage", "m", "most", "own_m", "own_most")
    first = tiers.groupBy("name_id").agg(F.min(pick).alias("f"))
    one, own = F.col("f.m") == F.col("f.most"), F.col("f.own_m") == F.col("f.own_most")
    member = F.when(one, F.col("f.m")).when(~F.col("f.late") & own, F.col("f.own_m"))
    gone = F.col("f").isNull() | (F.col("f.late") & ~one)
    return names.select("name_id").join(first, "name_id", "left").select("name_id", member.alias("member_key"), F.when(~gone, F.col("f.stage")).alias("stage"), F.when(gone, "unknown").when(member.isNotNull(), "found").otherwise("ambiguous").alias("status"))


def resolve_truncated(names: DataFrame, roster: DataFrame, width: int = 15) -> DataFrame:
    """Printed surnames, cut at ``width`` letters and at times with an initial, to members of the same chamber.

    A name with one fitting member is found. Then elimination: a name whose fitting members are all found elsewhere on
    its roll but one is that one. ``names``: roll_id, chamber, printed; ``roster``: chamber, member_key, first, last.
    """
    initial = F.nullif(F.regexp_extract("printed", r"[ ,]+([A-Za-z])\.?$", 1), F.lit(""))
    last = F.lower(F.trim(F.regexp_replace("printed", r"[ ,]+[A-Za-z]\.?$", "")))
    cut = F.lower(F.substring("last", 1, width))
    asked = names.withColumns({"__last": F.substring(last, 1, width), "__i": F.lower(initial)})
    fits = asked.join(roster.withColumn("__last", cut), ["chamber", "__last"]).where(F.col("__i").isNull() | F.startswith(F.lower("first"), F.col("__i")))
    hits = fits.groupBy("roll_id", "chamber", "printed").agg(F.collect_set("member_key").alias("hits"))
    sure = hits.where(F.size("hits") == 1).select("roll_id", F.col("hits")[0].alias("m")).groupBy("roll_id").agg(F.collect_set("m").alias("found"))
    left = F.array_except("hits", F.coalesce("found", F.array().cast(hits.schema["hits"].dataType)))
    member = F.when(F.size("hits") == 1, F.col("hits")[0]).when(F.size(left) == 1, left[0])
    return names.join(hits.join(sure, "roll_id", "left").select("roll_id", "chamber", "printed", member.alias("member_key")), ["roll_id", "chamber", "printed"], "left")


def fix_subjects(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Nominations whose number names another person move to the one other number of that person.

    ``rows``: roll_id, number, nominee; ``registry``: number, nominee. A shared first or last name counts as agreeing.
    """
    part = lambda c, i: F.try_element_at(name_words(F.col(c)), F.lit(i))
    own = rows.join(registry.withColumnRenamed("nominee", "__on_file"), "number", "left")
    agrees = F.col("__on_file").isNull() | (part("nominee", 1) == part("__on_file", 1)) | (part("nominee", -1) == part("__on_file", -1))
    other = registry.select(norm_name(F.col("nominee")).alias("__n"), "number").groupBy("__n").agg(F.count_distinct("number").alias("c"), F.min("number").alias("__to")).where("c = 1")
    moved = own.withColumn("__n", norm_name(F.col("nominee"))).join(other, "__n", "left")
    return moved.select("roll_id", "nominee", F.when(agrees, F.col("number")).otherwise(F.coalesce("__to", "number")).alias("number"))


def party_roster(lists: DataFrame, votes: DataFrame) -> DataFrame:
    """Party of each member that occurs in votes: the first list that has it wins, of lists of one
    ordinal the party first by name. ``lists``: ordinal, file, member_key, party."""
    first = lists.where("party is not null").groupBy("file", "member_key").agg(F.min(F.struct("ordinal", "party")).alias("f")).select("file", "member_key", "f.party")
    return first.join(votes.select("file", "member_key").distinct(), ["file", "member_key"], "left_semi")
