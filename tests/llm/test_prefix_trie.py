from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hustings.llm import prefix_trie
from hustings.llm.queries import ORACLES, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def conversations(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def rebuild(by):
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = by.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(seqs):
    """All nodes of a trie held as a table of prefixes."""
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    words = lambda p: len(p[-1][1].encode().split()) if p else 0
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words(p)
    sha = lambda p, m: hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], sha(p, m)) for p, m in members.items())


def nodes(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS).repartition(3)


@pytest.fixture
def small(monkeypatch):
    """Small blocks and buckets, so that a few turns take many passes."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "LOCAL", 6)
    monkeypatch.setattr(prefix_trie, "PATH", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)


TURN = st.tuples(st.sampled_from([None, *range(45)]), st.sampled_from([None, 0, 1, 2, 3]), st.sampled_from([None, "user", "assistant"]), st.sampled_from([None, "", "a b", "c", "é\x0bd"]))


@settings(max_examples=3, deadline=None, database=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(TURN, min_size=1, max_size=80))
def test_agrees_with_a_table_of_prefixes(spark, small, rows):
    got = prefix_trie.trie(*prefix_trie.rebuilt(frame(spark, rows)))
    assert nodes(got) == brute(rebuild(conversations(rows)))


@pytest.mark.parametrize("limit", [0, 1000])
def test_hot_heads_copies_and_long_conversations(spark, small, limit):
    """A head that all share, a group of copies, prefixes of each other, and conversations of many blocks."""
    rows = [(c, t, "user", f"t{t}") for c in range(100, 108) for t in range(9)]
    rows += [(c, t, "user", f"t{t}" if t < 4 else f"own {c} {t}") for c in range(200, 206) for t in range(7)]
    rows += [(c, t, "user", f"t{t}") for c in range(300, 307) for t in range(c - 299)]
    rows += [(400, t, "assistant", f"x{t % 5} y") for t in range(40)] + [(401, t, "assistant", f"x{t % 5} y") for t in range(37)]
    turns = frame(spark, rows).withColumns({c: F.lit("x") for c in ("part", "digest", "bucket", "depth", "n", "ids", "words", "block", "row")})
    got = prefix_trie.trie(*prefix_trie.plain(turns), limit)
    assert nodes(got) == brute(conversations(rows))


def test_turnless_conversations_and_repeated_rows(spark, small):
    rows = [(27, 0, "user", "a"), (27, 0, "user", "a"), (28, None, None, None), (29, 5, "user", "a")] + [(41, 0, "user", "z")] * 3
    got = prefix_trie.trie(*prefix_trie.rebuilt(frame(spark, rows)))
    assert nodes(got) == brute(rebuild(conversations(rows)))


def test_empty_table(spark):
    assert prefix_trie.trie(*prefix_trie.rebuilt(frame(spark, [(1, 1, "a", "b")]).limit(0))).collect() == []
    assert prefix_trie.trie(*prefix_trie.rebuilt(frame(spark, [(None, 1, "a", "b")]))).collect() == []


def test_query_agrees_with_sql(spark):
    same(QUERIES["op13_prefix_trie"](spark, SF), ORACLES["op13_prefix_trie"], SF)
