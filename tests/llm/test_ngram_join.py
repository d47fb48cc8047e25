from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hustings.llm import ngram_join as J
from hustings.llm import setjoin
from hustings.llm.common import weighed_lookup
from hustings.llm.queries import QUERIES
from hustings.llm.shingles import mixed, shingle_set, word_hashes

from .helpers import documents, words


def grams(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    """class and links of each row by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) / len(a | b) >= 0.8 - 1e-12:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, low[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def near_copies(n: int, length: int = 120):
    base = words(length).split()
    out = []
    for i in range(n):
        w = list(base)
        for k in range(i % 4):
            w[(i * 13 + k * 29) % length] = f"x{i}"
        out.append((i, " ".join(w)))
    return out


ROWS = [
    *near_copies(60),
    *[(100 + i, words(80, 1000)) for i in range(20)],
    (200, words(30, 5000) + "  \n" + words(3, 9000)), (201, words(30, 5000) + " " + words(3, 9000)),
    (300, "one two three"), (301, "one two three"), (302, "one two"), (303, None), (304, ""), (305, " \n "),
    *[(400 + i, words(40, 7000) + " " + words(160, 8000 + 300 * i)) for i in range(10)],
    (500, words(30_000, 0, "long")), (501, words(29_900, 0, "long")),
]


def result(spark, rows, **kw):
    return sorted(map(tuple, J.link(documents(spark, rows, **kw)).collect()))


def test_agrees_with_all_pairs(spark):
    assert result(spark, ROWS) == brute(ROWS)


def test_large_components_are_compared_in_blocks(spark, monkeypatch):
    rows = near_copies(60, 60) + [(1000 + i, words(60, 5000)) for i in range(3)]
    want = brute(rows)
    for sets, items in ((25, 1 << 21), (2048, 1500)):
        monkeypatch.setattr(setjoin, "BLOCK_SETS", sets)
        monkeypatch.setattr(setjoin, "BLOCK_ITEMS", items)
        assert result(spark, rows) == want


def test_edges(spark):
    assert result(spark, []) == []
    assert result(spark, [(7, words(9))] * 3, extra=True) == [(7, 7, 2)] * 3
    rows = [(1, words(50)), (1, words(50, 900)), (2, words(50)), (3, words(50, 900))]  # an id with two texts
    assert [(d, c) for d, c, _ in result(spark, rows)] == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_one_of_each_class_stays(spark):
    docs = documents(spark, ROWS, extra=True)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, c, _ in brute(ROWS) if d == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert sorted(r.doc_id for r in J.keep_one(documents(spark, [(7, words(9))] * 3 + [(8, "b")])).collect()) == [7, 8]


def test_bands_reach_their_recall():
    bands, rows = J.choose_bands()
    assert 1 - (1 - J.THRESHOLD**rows) ** bands >= J.RECALL
    r = np.random.default_rng(5)
    hits = 0
    for _ in range(300):
        both, own = r.integers(0, 1 << 63, 160, dtype=np.uint64), r.integers(0, 1 << 63, 40, dtype=np.uint64)
        a, b = np.concatenate([both, own[:20]]), np.concatenate([both, own[20:]])  # similarity 0.8
        hits += bool((J.band_hashes(np.sort(a), bands, rows) == J.band_hashes(np.sort(b), bands, rows)).any())
    assert hits >= 298
    with pytest.raises(ValueError):
        J.choose_bands(0.1, 0.999999, 20)


@settings(max_examples=100, deadline=None)
@given(st.text(" ab\té\n", max_size=40), st.text(" ab\té\n", max_size=40))
def test_shingles_are_those_of_the_words(a, b):
    x, y = grams(a), grams(b)
    u, v = shingle_set(a), shingle_set(b)
    assert len(u) == len(x) and len(v) == len(y) and len(np.intersect1d(u, v)) == len(x & y)
    assert len(word_hashes(a)) == len(re.findall(r"[^\x20\x09-\x0D]+", a))
    assert len(np.unique(mixed(np.arange(100, dtype=np.uint64)))) == 100


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in setjoin.components(df).collect()} == root


def test_components_of_hot_nodes_and_long_chains(spark):
    edges = [(500, k) for k in range(40)] + [(k, 600 + k) for k in range(40)] + [(k, k + 1) for k in range(1000, 1050)]
    got = {r.node: r.component for r in setjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 81 + 51


def test_an_id_with_several_texts_is_one_document(spark):
    rows = [(1, words(50)), (2, words(50)), (2, words(50, 900)), (3, words(50, 900)), (4, words(9, 70))]
    assert [(d, c) for d, c, _ in result(spark, rows)] == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]
    docs = documents(spark, rows + [(5, words(60, 300)), (5, words(60, 400))]).withColumn("row", F.lit("mine"))
    assert sorted((r.doc_id, r.row) for r in J.keep_one(docs).collect()) == [(1, "mine"), (4, "mine"), (5, "mine")]


def test_lookups_deal_out_hot_keys(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 3), (None, 4), (3, 1)) for i in range(n)], "k long, i long")
    right = spark.createDataFrame([(1, 500, "a"), (2, 3, "b"), (9, 1, "c")], "k long, n long, v string")
    got = weighed_lookup(left, right, ["k"], "n", F.col("i"), "left")
    assert got.columns == ["k", "i", "n", "v"] and got.count() == 508 and got.where("v = 'a'").count() == 500 and got.where("v is null").count() == 5


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op9_ngram_join"](spark, sf).collect())) == brute(rows)
