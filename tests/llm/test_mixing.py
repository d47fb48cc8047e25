from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hustings.llm import mixing
from hustings.llm.queries import ORACLES, QUERIES
from tests.oracle import same

from .helpers import documents, words


def brute(rows):
    """Targets by repeated sharing, taken words by a sort of each source."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((d, size(t)))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = {s: sum(n for _, n in by[s]) for s in order}
    target, capped = {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * total[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * total[s]}
        if not over:
            return by, total, target
        capped |= over


def check(spark, rows, **kw):
    got = mixing.mix(documents(spark, rows, **kw)).collect()
    by, total, target = brute(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    source = {d: s for d, _, s in rows}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - target[source[r.doc_id]]) < 1e-6 * max(1, r.target) and r.source_size == total[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= len(by[s]) + 1  # the boundary documents share what is left
    return got


def test_targets_caps_nulls_and_ties(spark):
    rows = [(i, words(i % 7), f"s{i % 4}") for i in range(60)] + [(100 + i, words(3), None) for i in range(5)] + [(200, None, "s0"), (201, "", "s9"), (202, words(2000), "s1")]
    a = check(spark, rows)
    assert sorted(a) == sorted(check(spark, rows, extra=True))
    check(spark, [(1, "a b c", "x")] * 4 + [(2, "d e", "y")])


def test_empty_and_wordless(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]
    assert mixing.apply_mix(documents(spark, [(1, "", "a")], extra=True)).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 12), st.sampled_from(["a", "b", "é", "Z", None])), min_size=1, max_size=25))
def test_any_table(spark, rows):
    check(spark, [(i, words(n), s) for i, (_, n, s) in enumerate(rows)])


def test_budget_that_ends_between_two_documents(spark):
    check(spark, [(0, "", "a"), (1, words(3), None), (2, words(5), "a"), (3, words(6), "a")])


def test_hash_is_that_of_the_id(spark):
    from pyspark.sql import functions as F

    assert spark.range(7, 8).select(mixing.document_hash(F.col("id"))).first()[0] == int(hashlib.md5(b"7").hexdigest()[:12], 16)


def test_applied_rows_follow_the_copies(spark):
    rows = [(i, words(5 + i % 3), f"s{i % 3}") for i in range(90)]
    docs = documents(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    for r in mixing.apply_mix(docs).collect():
        got[r.doc_id] += 1
    assert sum(abs(got[d] - c) for d, c in copies.items()) <= 3 and max(got.values()) <= 3


def test_agrees_with_oracle(spark):
    same(QUERIES["op1_source_mixing"](spark, "/root/testdata/sf0.001"), ORACLES["op1_source_mixing"], "/root/testdata/sf0.001")


def test_documents_that_share_a_hash_are_split(spark):
    rows = [(None, f"{words(10, 10 * i)}", "a") for i in range(20)] + [(i, words(20, 5 * i), "b") for i in range(10)] + [(100 + i, words(10), "c") for i in range(20)]
    targets = {r.source: (r.source_size, r.target) for r in mixing.decided(mixing.sized(documents(spark, rows))).collect()}
    docs = documents(spark, rows).withColumns({"hash": F.lit("mine"), "copy": F.lit(1), "edge": F.lit(2)})
    taken = {r.source: r.n for r in mixing.apply_mix(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert mixing.apply_mix(docs).columns == docs.columns
    assert all(abs(taken.get(s, 0) - t) <= 10 for s, (_, t) in targets.items()), (taken, targets)
