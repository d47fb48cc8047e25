"""Blocks of names cut by search against plain recursion, and printed names through tiers and stages."""

from __future__ import annotations

import itertools
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from hustings.operators import identity


def recurse(spans, words, count, place=0, used=()):
    """The first cut, longer names first."""
    if place == words:
        return list(used) if len(used) == count else None
    for length, member in sorted(((n, m) for p, n, m in spans if p == place), key=lambda x: -x[0]):
        if place + length <= words and member not in used and (got := recurse(spans, words, count, place + length, (*used, member))) is not None:
            return got
    return None


def test_search_agrees_with_recursion():
    rng = random.Random(5)
    hits = 0
    for _ in range(600):
        words = rng.randrange(9)
        spans = sorted({(p, n): (p, n, rng.randrange(6)) for p in range(words) for n in range(1, min(4, words - p) + 1) if rng.random() < 0.5}.values())
        for count in range(words + 2):
            want = recurse(spans, words, count)
            assert identity.cut_names(spans, words, count) == want
            hits += want is not None
    assert hits > 500


def test_long_blocks_take_no_exponential_time():
    """Every word is a name, pairs are names of members that occur everywhere: plain recursion would not end."""
    words = 1500
    spans = [(i, 1, f"w{i}") for i in range(words)] + [(i, 2, "pair" if i % 2 else f"p{i}") for i in range(words - 1)]
    begun = time.time()
    got = identity.cut_names(spans, words, words - 3)
    assert len(got) == words - 3 and len(set(got)) == len(got)
    assert identity.cut_names(spans, words, words + 1) is None and time.time() - begun < 20


def test_blocks_together_agree_with_each_alone():
    rng = random.Random(7)
    blocks = []
    for _ in range(2000):
        words = rng.choice([0, 5, 61, 63]) if rng.random() < 0.05 else rng.randrange(9)
        spans = [(p, n, f"m{rng.randrange(rng.choice([3, 6, 60]))}") for p in range(words) for n in range(1, min(4, words - p) + 1) if rng.random() < 0.5]
        rng.shuffle(spans)
        blocks.append((spans, words, rng.randrange(-1, words + 2) if words < 10 else rng.choice([words, words // 2, 30])))
    starts = [0, *itertools.accumulate(len(s) for s, _, _ in blocks)]
    place, length, members = zip(*[s for spans, _, _ in blocks for s in spans])
    got = identity.cut_blocks([c for _, _, c in blocks], [w for _, w, _ in blocks], starts, place, length, pa.array(members)).to_pylist()
    want = [None if c < 0 else identity.cut_names(s, w, c) for s, w, c in blocks]
    assert got == want and sum(w is not None for w in want) > 200


def test_blocks_are_made_once_and_not_shuffled_again(spark):
    roster = spark.createDataFrame([("c", "King", 3), ("c", "Lee", 4)], "chamber string, name string, member_key long")
    said = spark.createDataFrame([(i, w) for i in range(50) for w in ("King", "Lee")], "block_id long, w string")
    blocks = said.groupBy("block_id").agg(F.array_join(F.sort_array(F.collect_list("w")), "").alias("text")).withColumns({"chamber": F.lit("c"), "count": F.lit(2)})
    got = identity.partition_blocks(blocks, roster)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block_id") == 1 and "SortMergeJoin" not in plan
    assert {tuple(r.members) for r in got.collect()} == {(3, 4)}


def test_large_rosters_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(identity, "MAX_SENT", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_blocks(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocks(spark):
    roster = [("c", "Van der Berg", 1), ("c", "Van", 2), ("c", "King", 3), ("c", "Lee", 4), ("c", "Lee", 5), ("c", "Ünal", 6), ("d", "King", 7)]
    blocks = [(1, "c", "Van der Berg King", 2), (2, "c", "VanKing", 2), (3, "c", "King Lee", 2), (4, "c", "King King", 2), (5, "c", "Unal King Van", 3), (6, "c", "Unal King Van", 2), (7, "d", "King", 1), (8, "c", None, 0), (9, "c", "", 1), (10, None, "King", 1), (11, "c", "King", None)]
    got = identity.partition_blocks(spark.createDataFrame(blocks, "block_id long, chamber string, text string, count int").withColumn("spans", F.lit("x")), spark.createDataFrame(roster, "chamber string, name string, member_key long"))
    assert {r.block_id: r.members for r in got.collect()} == {1: [1, 3], 2: [2, 3], 3: None, 4: None, 5: [6, 3, 2], 6: None, 7: [7], 8: [], 9: None, 10: None, 11: None}


MEMBERS = [
    (1, "Thomas", "Smith", "D", "h"), (2, "Ann", "Smith", "R", "h"), (3, "William", "Jones", "D", "h"), (4, "Bo", "Jones", "D", None), (5, "Cy", "Jones", "R", "s"), (6, "Di", "De La Cruz", "D", "h"),
    (7, "Robert", "Long", "D", "h"), (8, "Ed", "Twin", "D", "h"), (9, "Ed", "Twin", "R", "h"), (10, "Alex", "Solo", None, "h"), (11, None, "Blank", "D", "h"), (1, "Thomas", "Smith", "D", "h"),
]
PRINTED = [
    ("Tom Smith", "h", None, 1, 1, "found"), ("Smith, A.", "h", None, 2, 1, "found"), ("Smith", "h", None, None, 1, "ambiguous"), ("Smith", "h", "R", 2, 1, "found"), ("Jones", "h", None, 3, 1, "found"), ("Bo Jones", "h", None, 4, 2, "found"), ("C. Jones", "h", None, 5, 3, "found"),
    ("Bill Jones, Jr.", "h", None, 3, 1, "found"), ("Cruz", "h", None, 6, 1, "found"), ("de la Cruz, D", "h", None, 6, 1, "found"), ("Long, B.", "h", None, None, None, "unknown"), ("Long, R.", "h", None, 7, 1, "found"), ("Ed Twin", "h", "R", 9, 1, "found"), ("Ed Twin", "h", None, None, 1, "ambiguous"),
    ('Zed "Al" Solo', "h", None, 10, 1, "found"), ("Zed Smith", "h", None, None, None, "unknown"), ("Zed Jones", "s", None, 5, 1, "found"), ("Blank", "h", None, 11, 1, "found"), (None, "h", None, None, None, "unknown"), ("", "h", None, None, None, "unknown"), ("Nobody", "h", None, None, None, "unknown"),
]


def test_tiers_and_stages(spark):
    names = spark.createDataFrame([(i, c, p, party) for i, (p, c, party, *_) in enumerate(PRINTED)], "name_id long, chamber string, printed string, party string").withColumns({c: F.lit("x") for c in ("p", "stage", "n", "known", "surname")})
    members = spark.createDataFrame(MEMBERS, "member_key long, given string, family string, party string, chamber string").withColumn("of", F.lit("x"))
    got = {r.name_id: (r.member_key, r.stage, r.status) for r in identity.resolve_names(names, members).collect()}
    for i, (p, _, _, *want) in enumerate(PRINTED):
        assert got[i] == tuple(want), p
    assert identity.resolve_names(names.limit(0), members).collect() == []
    assert {r.status for r in identity.resolve_names(names, members.limit(0)).collect()} == {"unknown"}
