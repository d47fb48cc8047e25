from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from hustings.llm import classifier as C
from hustings.llm.queries import QUERIES

from .helpers import documents, words

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op7_quality_gam"](spark, SF).collect()}
    known = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    test = [(got[d].score, q, got[d].predicted) for d, q in known if got[d].held_out]
    assert np.mean([p == q for _, q, p in test]) > 0.95
    good, bad = ([s for s, q, _ in test if q == v] for v in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_labels_of_the_held_out_fifth_change_nothing(spark):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = known.withColumn("quality", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = C.train(docs, known), C.train(docs, flipped)
    assert all((x == y).all() for x, y in zip(a["tables"], b["tables"])) and a["base"] == b["base"]


def test_scores_come_from_the_text_alone(spark):
    model = C.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    text = spark.read.parquet(f"{SF}/documents.parquet").first().text
    rows = [(i, text, s) for i, s in enumerate(["a", None, "zz"])]
    assert len({r.score for r in C.score(documents(spark, rows), model).collect()}) == 1
    kept = C.keep_good(documents(spark, [(1, text), (2, None), (3, ""), (1, text)], extra=True), model)
    want = {r.doc_id for r in C.score(documents(spark, [(1, text), (2, None), (3, "")]), model).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns[-1] == "copies"


def test_shallow_tree_finds_the_best_cut():
    g, h = np.array([1.0, 1.2, -2.0, -2.2, 0.1]), np.ones(5)
    gain = lambda cut: g[:cut].sum() ** 2 / (cut + 5) + g[cut:].sum() ** 2 / (5 - cut + 5)
    best = max(range(1, 5), key=gain)
    tree = C.shallow_tree(g, h, depth=1)
    assert len(set(tree[:best])) == len(set(tree[best:])) == 1 and tree[0] != tree[-1]


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(0)
    x = np.zeros((4000, 3))
    x[:, :2] = r.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = C.fit(x, y), C.fit(x, y, pairs=0)
    right = lambda m: ((C.predict(m, x) > 0.5) == y).mean()
    assert right(with_pairs) > 0.9 > 0.65 > right(without)


def test_no_labels_and_conflicting_ones(spark):
    docs = documents(spark, [(i, words(5 + i)) for i in range(6)])
    assert {r.score for r in C.score(docs, C.train(docs, labels(spark, []))).collect()} == {0.5}
    model = C.train(docs, labels(spark, [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (99, 1, 1)]))
    assert all(r.score == pytest.approx(0.5) for r in C.score(docs, model).collect())
    assert C.score(documents(spark, []), model).count() == 0


def plain_features(text: str) -> list[float]:
    """The features from their definitions, a character at a time."""
    symbols, spaces = "#%*$&|<>{}[]=_~^@\\+/", "\t\n\x0b\x0c\r "
    upper, lower, digit = (sum(c.isascii() and f(c) for c in text) for f in (str.isupper, str.islower, str.isdigit))
    symbol, space = sum(c in symbols for c in text), sum(c in spaces for c in text)
    punct = sum(c.isascii() for c in text) - upper - lower - digit - symbol - space
    words, lines, chars = text.split(), [x for x in text.split("\n") if x], max(len(text), 1)
    n, m = max(len(words), 1), max(len(lines), 1)
    return [
        math.log1p(len(text)), (len(text) - space) / n, sum(w.lower().strip(".,;:!?") in C.STOP for w in words) / n,
        upper / max(upper + lower, 1), digit / chars, symbol / chars, punct / chars, text.count("|") / n, text.count("!") / n,
        len(set(words)) / n, max((words.count(w) for w in set(words)), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        math.log1p(len(lines)), math.log1p(len(text) / m), 1 - len(set(lines)) / m if lines else 0.0, sum(x[-1] in ".!?" for x in lines) / m,
        math.log1p(max(map(len, words), default=0)), sum(not w.rstrip(".,;:!?").isalpha() for w in words) / n,
    ]


def plain_score(model: dict, x: list[float]) -> float:
    """Table entries looked up and added one by one."""
    fine = [sum(e <= v for e in edges) for v, edges in zip(x, model["edges"])]
    rough = [sum(e <= v for e in edges) for v, edges in zip(x, model["coarse"])]
    margin = model["base"] + sum(t[b] for t, b in zip(model["tables"], fine)) + sum(t[rough[a], rough[b]] for (a, b), t in model["pairs"])
    return 1 / (1 + math.exp(-margin))


def test_scores_of_the_querys_table_are_those_of_plain_sums(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = C.train(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op7_quality_gam"](spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(texts)
    for k, text in sorted(texts.items(), key=lambda x: len(x[1]))[:150]:
        x = plain_features(text)
        assert C.features(text) == pytest.approx(x, abs=1e-12)
        assert got[k].score == pytest.approx(plain_score(model, x), abs=1e-9) and got[k].predicted == int(got[k].score >= 0.3)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)


def plain_tree(g, h, depth=2, l2=5.0):
    """The best cuts by trying every one, then each side alone."""
    leaf = sum(g) / (sum(h) + l2)
    if depth == 0 or len(g) < 2:
        return [leaf] * len(g)
    gain = lambda c: sum(g[:c]) ** 2 / (sum(h[:c]) + l2) + sum(g[c:]) ** 2 / (sum(h[c:]) + l2) - sum(g) ** 2 / (sum(h) + l2)
    cut = max(range(1, len(g)), key=gain)
    if gain(cut) <= 1e-9:
        return [leaf] * len(g)
    return plain_tree(g[:cut], h[:cut], depth - 1, l2) + plain_tree(g[cut:], h[cut:], depth - 1, l2)


def test_boosting_is_that_of_plain_loops():
    r = np.random.default_rng(8)
    x = r.normal(size=(120, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] ** 2 > 0.4).astype(float)
    model = C.fit(x, y, rounds=4, pairs=0, bins=6)
    edges = [sorted({float(q) for q in np.quantile(x[:, f], np.linspace(0, 1, 7)[1:-1])}) for f in range(3)]
    at = [[sum(e <= v for e in edges[f]) for v in x[:, f]] for f in range(3)]
    base = math.log(y.mean() / (1 - y.mean()))
    tables, margin = [[0.0] * (len(e) + 1) for e in edges], [base] * len(y)
    for _ in range(4):
        for f in range(3):
            p = [1 / (1 + math.exp(-m)) for m in margin]
            g, h = ([sum(v for v, b in zip(values, at[f]) if b == k) for k in range(len(tables[f]))] for values in ([a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]))
            step = [0.1 * v for v in plain_tree(g, h)]
            tables[f] = [a + b for a, b in zip(tables[f], step)]
            margin = [m + step[b] for m, b in zip(margin, at[f])]
    assert model["base"] == pytest.approx(base) and all(list(a) == pytest.approx(b, abs=1e-9) for a, b in zip(model["tables"], tables))
