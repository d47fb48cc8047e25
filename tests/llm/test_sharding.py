from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hustings.llm import sharding
from hustings.llm.common import new_path
from hustings.llm.queries import ORACLES, QUERIES
from tests.oracle import same

from .helpers import documents, words

SF = "/root/testdata/sf0.001"


def brute(rows, n):
    """Shards by a running sum over all records in order."""
    data = sorted(((hashlib.md5((t or "").encode()).digest()[:8], d is not None, d or 0, t or "") for d, t in rows), key=lambda r: r[:3])
    size = lambda t: len(t.encode()) + 8
    total = sum(size(r[3]) for r in data)
    groups = defaultdict(list)
    for r in data:
        groups[r[0]].append(r)
    out, start, slots = [], 0, Counter()
    for group in groups.values():
        whole = sum(size(r[3]) for r in group)
        together = whole <= total // (64 * n) and len(group) <= len(data) // (64 * n)
        at = start
        for r in group:
            middle = 2 * start + whole if together else 2 * at + size(r[3])
            shard = middle * n // (2 * total)
            out.append((r[2] if r[1] else None, size(r[3]), zlib.crc32(r[3].encode()), "bytes", shard, slots[shard], None))
            slots[shard] += 1
            at += size(r[3])
        start = at
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[4], r[5]))


TEXTS = st.sampled_from([None, "", "a", "é é", "same", words(30), words(500)])


@settings(max_examples=5, deadline=None, database=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([None, -5, *range(40)]), TEXTS), min_size=1, max_size=60), st.integers(1, 5))
def test_agrees_with_a_running_sum(spark, rows, n):
    got = sharding.shards(documents(spark, rows, extra=True), n)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert order(got.collect()) == order(brute(rows, n))


def test_hot_texts_tiny_texts_and_long_texts(spark):
    rows = [(k, "hot " * 40) for k in range(1500)] + [(None, "") for _ in range(800)] + [(k, words(5, k)) for k in range(5000, 6500)] + [(9000, words(20_000))]
    got = order(sharding.shards(documents(spark, rows), 6).collect())
    assert got == order(brute(rows, 6))
    # whatever is drawn, no range is overfull: hot keys are subdivided by id and row
    table = sharding.records(documents(spark, rows))
    cuts, held = sharding.splitters(table, 60)
    total, n = sum(r[1] for r in held), sum(r[2] for r in held)
    assert n == len(rows) and all((b / total + c / n) / 2 <= 2 / 60 or c == 1 for _, b, c, _ in held)


def test_small_groups_stay_together_and_sizes_are_near(spark):
    rows = [(k, words(20, k // 3)) for k in range(3000)]
    got = sharding.shards(documents(spark, rows), 4).collect()
    shard = defaultdict(set)
    for r in got:
        shard[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shard.values())
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) - min(size.values()) <= 2 * 3 * max(r["size"] for r in got)


def test_ranges_of_another_key(spark):
    rows = [(k, words(k % 7)) for k in range(-40, 200)]
    docs = documents(spark, rows)
    got = sharding.shards(docs, 3, sharding.long_bytes(F.col("doc_id"))).orderBy("doc_id").collect()
    assert [r.shard for r in got] == sorted(r.shard for r in got) and {r.shard for r in got} == {0, 1, 2}


def test_written_shards_hold_all_columns(spark):
    rows = [(k, words(k % 9)) for k in range(300)]
    docs = documents(spark, rows, extra=True)
    path = new_path(spark, "shards")
    sharding.write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("record.*").collect())) == sorted(map(tuple, docs.collect()))
    for s, slots in back.groupBy("shard").agg(F.sort_array(F.collect_list("slot"))).collect():
        assert slots == list(range(len(slots))) and 0 <= s < 4


def test_empty_table(spark):
    assert sharding.shards(documents(spark, [(1, "a")]).limit(0)).collect() == []


def test_query_agrees_with_sql(spark):
    same(QUERIES["op11_sampled_splitters"](spark, SF), ORACLES["op11_sampled_splitters"], SF)
