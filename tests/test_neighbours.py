"""Nearest rows, bounded next rows and title repair against the product of a key's rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hustings.operators import asof, serving


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_next_and_nearest_agree_with_the_product(spark, width):
    rng = random.Random(width or 0)
    left = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(-20, 20)]), rng.choice([None, -5, 30, 5])) for i in range(150)]
    right = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(-20, 20)]), rng.choice("xyz")) for _ in range(40)]
    l = spark.createDataFrame(left, "id long, k string, t long, until long").withColumns({"__x": F.lit(1), "value": F.lit(2), "s": F.lit(3)})
    r = spark.createDataFrame(right, "k string, stamp long, found string")
    bucket = (lambda c: F.floor(c / width)) if width else None
    got = {x.id: x.found for x in asof.first_after(l, r, "k", "t", "stamp", "found", "until", bucket).collect()}
    near = {x.id: (x.prev, x.next) for x in asof.neighbours(l, r, "k", "t", "stamp", "found", bucket).collect()}
    assert len(got) == len(left) == len(near)
    for i, k, t, until in left:
        of = sorted((s, v) for kk, s, v in right if kk == k and None not in (k, s, t))
        after = [x for x in of if x[0] >= t]
        assert got[i] == next((v for s, v in after[:1] if until is None or s < until), None)
        before = [x for x in of if x[0] <= t]
        last = min((x for x in before if x[0] == before[-1][0]), default=None) if before else None
        assert near[i] == (last, after[0] if after else None)
    marks = spark.createDataFrame([(k, i, float(t)) for i, k, t, _ in left if k and t is not None], "page string, mark_id long, x double")
    headers = spark.createDataFrame([(k, v, float(s)) for k, s, v in right if k and s is not None], "page string, column string, hx double")
    got = {x.mark_id: x.column for x in serving.nearest_column(marks, headers, width).collect()}
    for i, k, t, _ in left:
        of = [(abs(t - s), v) for kk, s, v in right if k and kk == k and None not in (s, t)]
        assert got.get(i) == (min(of)[1] if of else None)


def test_nothing_to_find(spark):
    l = spark.createDataFrame([(1, "a", 1)], "id long, k string, t long")
    r = spark.createDataFrame([], "k string, stamp long, found string")
    assert asof.first_after(l, r, "k", "t", "stamp", "found").first().found is None
    assert asof.first_after(l.limit(0), r, "k", "t", "stamp", "found").collect() == []


WORDS = ["tax", "reform", "taxation", "water", "waterways", "clean", "an", "the", "schools", "school", "road", "Éducation"]


def fit(title, caption):
    """The share of the caption's words that the title has, by loops."""
    plain = lambda t: [w for w in (t or "").lower().replace("é", "e").split() if len(w) > 2 and w not in ("the", "and", "for", "act", "resolve")]
    c, t = plain(caption), plain(title)
    return 1.0 if len(c) < 2 else sum(any(x == w or (len(w) > 4 and x.startswith(w)) for x in t) for w in c) / len(c)


def test_titles_from_the_index_agree_with_the_product(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8)))])
    rolls = [(i, rng.choice(["b1", "b2", None]), text() or "", rng.choice([text(), " ".join(rng.choice(WORDS) for _ in range(5))])) for i in range(200)]
    titles = [(rng.choice(["b1", "b2", None]), i // 2, text()) for i in range(120)]
    got = serving.repaired_titles(spark.createDataFrame(rolls, "roll_id long, bill string, title string, caption string").withColumn("t", F.lit(1)), spark.createDataFrame(titles, "bill string, priority long, alternative string"))
    got = {r.roll_id: (r.title, r.doubtful) for r in got.collect()}
    for i, bill, title, caption in rolls:
        if fit(title, caption) >= 0.5:
            want = (title, False)
        else:
            best = min(((p, t) for b, p, t in titles if bill and b == bill and t is not None and fit(t, caption) >= 0.5), default=None)
            want = (best[1] if best else title, best is None)
        assert got[i] == want, (i, bill, title, caption)


def test_versions_link_as_a_loop_links_them(spark):
    rng = random.Random(9)
    versions = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), rng.choice(["x", "y", None])) for _ in range(60)]
    history = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(30)]), rng.choice(["x", "y", None])) for _ in range(60)]
    got = asof.link_versions(spark.createDataFrame(versions, "bill string, version long, action string").withColumn("side", F.lit("x")), spark.createDataFrame(history, "bill string, position long, action string"))
    want = []
    for bill in ("a", "b", None):
        at = -1
        for v, action in sorted(((v, x) for b, v, x in versions if b == bill and v is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
            hit = min((p for b, p, x in history if bill is not None and b == bill and action is not None and x == action and p is not None and p >= at), default=None)
            want.append((bill, v, hit))
            at = at if hit is None else hit
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
