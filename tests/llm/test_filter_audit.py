from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hustings.llm import filter_audit
from hustings.llm.queries import ORACLES, QUERIES
from tests.oracle import same

from .helpers import documents, words

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(rows, labels):
    """Every order is applied to the documents, one filter after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    fails = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > smallest[t]}
        fails.append((d, s or "", f))
    out = {}
    shapley = Counter()
    for part in {s for _, s, _ in fails}:
        own = [(d, f) for d, s, f in fails if s == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                failing = [(d, f) for d, f in own if f[x]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for _, f in failing), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[part, x] += len(gone)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def check(spark, rows, labels, extra=False, limit=1000):
    got = filter_audit.audit(documents(spark, rows, extra), spark.createDataFrame(labels, LABELS), limit).collect()
    assert {(r.part, r.filter_order, r.step): [*(r[c] for c in COLUMNS), r.shapley] for r in got} == brute(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


TEXTS = st.sampled_from([None, "", "A B", "a $ b", words(200), words(120) + " " + words(120), words(120) + " " + words(120) + " |", "word " * 300, words(250).upper(), "\x0b é é " * 120])


@settings(max_examples=6, deadline=None, database=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([None, *range(12)]), TEXTS, st.sampled_from([None, "", "a", "b"])), min_size=1, max_size=30), st.lists(st.tuples(st.sampled_from([None, *range(12)]), st.sampled_from([None, 0, 1]), st.sampled_from([None, 0, 1])), max_size=12), st.booleans())
def test_agrees_with_applying_every_order(spark, rows, labels, extra):
    check(spark, rows, labels, extra, limit=0 if extra else 1000)  # beyond the limit, look-ups shuffle


def test_hot_text_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "WINDOW", 64)  # windows are cut at white space, also on the driver
    assert filter_audit.word_counts(("x" * 500 + " " + words(300)).encode()) == (301, 301)
    rows = [(k, "same text", "hot") for k in range(300)] + [(None, "same text", "a"), (1000, words(40_000) + " same", "a")]
    check(spark, rows, [(k, 1, k % 2) for k in range(0, 1001, 5)], limit=0)


def test_many_parts_in_a_task(spark):
    rows = [(k, words(3, k), f"s{k % 300}") for k in range(600)]
    check(spark, rows, [])


def test_empty_tables(spark):
    assert filter_audit.audit(documents(spark, [(1, "a")]).limit(0), spark.createDataFrame([], LABELS)).collect() == []
    check(spark, [(1, "a", "s")], [])


def test_large_tables_are_not_broadcast(spark):
    k = F.col("id")
    rows = spark.range(4000).select(k.alias("doc_id"), F.lit("a").alias("part"), F.lit(0).alias("failed"), k.cast("int").alias("deal"))
    got = filter_audit.labelled(rows, spark.range(120_000).select(k.alias("doc_id"), (k % 2).cast("int").alias("quality"), F.lit(1).alias("toxic")))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r["count"]) for r in got.groupBy("label").count().collect()} == {(2, 2000), (3, 2000)}
    docs = spark.range(240_000).select(k.alias("doc_id"), (k % 120_000).cast("string").alias("text"), F.lit("a").alias("source"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = filter_audit.flagged(docs)
        assert "SortMergeJoin" in seen._jdf.queryExecution().executedPlan().toString()
        assert {(r.failed, r["count"]) for r in seen.groupBy("failed").count().collect()} == {(1, 120_000), (17, 120_000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_query_agrees_with_sql(spark):
    same(QUERIES["op12_filter_audit"](spark, SF), ORACLES["op12_filter_audit"], SF)
