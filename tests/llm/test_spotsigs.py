from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


from hustings.llm import spotsigs as S

from .helpers import documents, words


def brute_spots(text: str, chain: int = S.CHAIN) -> set[tuple]:
    """Spots as tuples of words."""
    tokens = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", text.lower())
    common = set(S.ANCHORS) | set(S.STOP)
    out = set()
    for i, w in enumerate(tokens):
        if w in S.ANCHORS:
            after = [x for x in tokens[i + 1 :] if x not in common][:chain]
            if len(after) == chain:
                out.add((w, *after))
    return out or ({("all", *tokens)} if tokens else {("raw", text)} if text else set())


SAMPLE = st.lists(st.sampled_from(["the", "A", "der", "cat", "dog", "Haus", "and", "é1", "x", "-", "!?", "\n"]), max_size=25).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(SAMPLE, SAMPLE)
def test_likeness_is_that_of_the_spots(a, b):
    x, y = brute_spots(a), brute_spots(b)
    want = float(len(x) == len(y)) if not x or not y else len(x & y) / len(x | y)
    assert S.likeness(S.spots(a), S.spots(b)) == pytest.approx(want)
    assert len(S.spots(a)) == len(x) and np.array_equal(S.spots_of(S.fingerprint(S.spots(a))), S.spots(a))


def report(spark, rows, **kw):
    return [tuple(r) for r in S.edit_report(documents(spark, rows, **kw)).collect()]


def brute_report(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        x, y, z = (S.spots(t) for t in (text, edited, after))
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), S.fingerprint(x), S.fingerprint(y), S.likeness(x, y), S.likeness(x, z)))
    return out


def test_report_over_buckets(spark):
    rows = [(i * 7 % 1009, f"the {words(i % 11, i)} is a {'é😀' * (i % 5)} {words(3, i % 4)}") for i in range(400)]
    assert sorted(report(spark, rows)) == sorted(brute_report(rows)) == sorted(report(spark, rows, extra=True))


def test_null_and_repeated_ids_are_dealt_out(spark):
    """Many rows without an id and of one id follow one another by their texts, in partitions that share neither."""
    start = "a common start of sixty-four characters and more, so that it fills the key "
    rows = [(None, f"{w} the {w} is a thing") for w in map(str, range(120))] + [(7, f"{w} the {w} is a thing") for w in map(str, range(120))] + [(7, start + str(k)) for k in range(30)] + [(7, None), (7, ""), (None, None), (9, "x"), (9, "x")]
    assert sorted(report(spark, rows), key=str) == sorted(brute_report(rows), key=str)


def test_more_buckets_change_nothing(spark, monkeypatch):
    rows = [(i * 7 % 1009, f"the {words(i % 11, i)} is a {words(3, i % 4)}") for i in range(300)] + [(None, "no id"), (5, "again")]
    want = sorted(brute_report(rows), key=str)
    for size in (1, 40, 10**6):
        monkeypatch.setattr(S, "PARTITION_ROWS", size)
        assert sorted(report(spark, rows), key=str) == want


def test_edges(spark):
    assert report(spark, []) == []
    for rows in ([(1, "the cat sat down")], [(1, None), (2, ""), (3, "x")], [(5, "a b"), (5, "a b"), (5, "a c"), (4, "z")], [(None, "odd one"), (1, "the only one here")], [(1, "the " + words(30_000)), (2, "tiny")]):
        assert sorted(report(spark, rows), key=str) == sorted(brute_report(rows), key=str)


def test_join_finds_every_link(spark):
    base = " ".join(f"the {w} is" for w in words(40).split())
    rows = [(1, base), (2, base), (3, base + " the extra bit"), (4, base.replace("w5 ", "v5 ")), (5, "the " + words(9, 500)), (6, None), (7, ""), (8, base[: len(base) // 3]), (9, base + " " + words(30, 700, "the q"))]
    rows += [(100 + i, base.replace(f"w{i} ", "changed ")) for i in range(30)]
    sets = {d: S.spots(t or "") for d, t in rows}
    want = dict.fromkeys(sets, 0)
    for a, b in combinations(sets, 2):
        if len(sets[a]) and len(sets[b]) and S.likeness(sets[a], sets[b]) >= 0.8:
            want[a] += 1
            want[b] += 1
    got = {r.doc_id: r for r in S.join(documents(spark, rows, extra=True)).collect()}
    assert {d: r.n_links for d, r in got.items()} == want and got[3].class_id == got[2].class_id == 1 and got[6].class_id == 6
