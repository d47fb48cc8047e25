from __future__ import annotations

import numpy as np
import pytest

from hustings.llm import chroma as C
from hustings.llm.queries import QUERIES


def tune(seed: int, notes: int = 60, sound: C.Sound = C.Sound(), level: int = 12000) -> np.ndarray:
    r = np.random.default_rng(seed)
    hertz = 440 * 2 ** (r.integers(0, 12, notes) / 12)
    return (np.sin(np.cumsum(np.repeat(hertz, sound.hop)) * 2 * np.pi / sound.rate) * level).astype("<i2")


def media(spark, sounds):
    rows = [(k, None if s is None else bytearray(s.tobytes() if hasattr(s, "tobytes") else s)) for k, s in sounds]
    return spark.createDataFrame(rows, "rec long, pcm binary").repartition(3)


def test_chroma_hears_the_pitch_class():
    t = np.arange(4000) / 4000
    for k in range(12):
        frames = C.chroma((np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) * 9000).astype("<i2"))
        assert (frames.argmax(1) == k).all()


def test_filters_equal_plain_sums():
    image = np.random.default_rng(1).random((40, 12))
    got = C.packed(image)
    assert len(C.FILTERS) == 16 and len(got) == 40 - C.WIDTH + 1
    for t in (0, 7, len(got) - 1):
        code = 0
        for plus, minus in C.FILTERS:
            a, b = (sum(image[t + x : t + x + w, y : y + h].mean() for x, y, w, h in side) / len(side) for side in (plus, minus))
            code = code << 2 | int(C.GRAY[np.searchsorted(C.CUTS, round(np.log((a + 0.01) / (b + 0.01)), 9))])
        assert code == int(got[t])


def test_loudness_and_noise_change_few_bits():
    clean, quiet = tune(1), tune(1, level=3000)
    noisy = (clean + np.random.default_rng(0).normal(0, 600, len(clean))).astype("<i2")
    code = lambda s: C.packed(C.chroma(s))
    assert C.bit_error(code(clean), code(quiet), 0)[0] < 0.02 and C.bit_error(code(clean), code(noisy), 0)[0] < 0.15 < 0.3 < C.bit_error(code(clean), code(tune(2)), 0)[0]


def test_search_aligns_shifted_copies(spark):
    hop = C.Sound().hop
    song = tune(100, 120)
    sounds = [(100, song), (200, tune(200, 120)), (300, tune(100, 120)), (7, song[20 * hop :]), (8, np.concatenate([tune(9, 15), song[: 80 * hop]])), (11, (song + np.random.default_rng(3).normal(0, 500, len(song))).astype("<i2"))]
    sounds += [(12, tune(777, 120)), (13, None), (14, b""), (15, tune(5, 3)), (16, np.zeros(60 * hop, "<i2")), (7, song[20 * hop :])]
    rows = C.search(media(spark, sounds).withColumnRenamed("rec", "rec_id2").selectExpr("rec_id2", "pcm", "1 as codes", "2 as block"), "rec_id2").collect()
    got = {r.rec_id2: r for r in rows}
    assert len(rows) == len(sounds)
    assert (got[7].query_id, got[7].offset) == (100, -20) and (got[8].query_id, got[8].offset) == (100, 15) and (got[11].query_id, got[11].offset) == (100, 0)
    assert got[100].query_id == 300 and got[300].query_id == 100 and got[100].bit_error == 0  # equal, but never itself
    assert all(got[k].query_id is None for k in (200, 12, 13, 14, 15, 16)) and got[13].n_codes == got[14].n_codes == got[15].n_codes == 0


def best_offset(a, b):
    """(votes, offset) of two lists of integers by counting all pairs of positions; None under ``MIN_VOTES``."""
    votes = {}
    for p, x in enumerate(a):
        for q, y in enumerate(b):
            if x == y:
                votes[p - q] = votes.get(p - q, 0) + 1
    good = [(-v, abs(o), o) for o, v in votes.items() if v >= C.MIN_VOTES]
    return (-min(good)[0], min(good)[2]) if good else None


def test_votes_are_those_of_all_pairs(monkeypatch):
    r = np.random.default_rng(4)
    for at_once in (1 << 20, 25, 1):
        monkeypatch.setattr(C, "AT_ONCE", at_once)
        for spread in (12, 3, 2):
            rows, queries = ([r.integers(0, spread, n).astype(np.uint32) for n in (9, 0, 14, 30, 5)] + [np.repeat(r.integers(0, 3, 6), r.integers(1, 9, 6)).astype(np.uint32), np.zeros(20, np.uint32)] for _ in range(2))
            want = {(i, j): best_offset(a, b) for i, a in enumerate(rows) for j, b in enumerate(queries) if best_offset(a, b)}
            assert {(i, j): (v, o) for i, j, o, v in C.best_offsets(rows, queries)} == want
    assert C.best_offsets([], []) == [] == C.best_offsets([np.zeros(0, np.uint32)], [np.zeros(3, np.uint32)])


def test_long_silence_is_one_run():
    rows = [np.zeros(200_000, np.uint32), np.concatenate([np.zeros(90_000), np.arange(90_000)]).astype(np.uint32)]
    assert {(i, j): (v, o) for i, j, o, v in C.best_offsets(rows, rows)} == {(0, 0): (200_000, 0), (0, 1): (90_001, 0), (1, 0): (90_001, 0), (1, 1): (180_000, 0)}


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    sounds = [(k, tune(k % 9, 40)) for k in range(0, 700, 25)]
    once = sorted(map(tuple, C.search(media(spark, sounds), "rec").collect()), key=str)
    for name, size in (("ROW_CODES", 50), ("QUERY_CODES", 40), ("AT_ONCE", 10)):
        monkeypatch.setattr(C, name, size)
    assert sorted(map(tuple, C.search(media(spark, sounds), "rec").collect()), key=str) == once


def test_windows_of_frames_change_nothing():
    whole, cut = C.chroma(tune(3, 200)), C.chroma(tune(3, 200), window=7)  # sums of products may differ in the last bits
    assert np.allclose(whole, cut, atol=1e-12) and np.array_equal(C.packed(whole), C.packed(cut)) and len(C.chroma(np.zeros(100, "<i2"))) == 0


def test_search_is_that_of_all_pairs(spark):
    """Every link, and each recording's best alignment with its ties, recomputed from plain lists."""
    hop = C.Sound().hop
    sounds = [(k, tune(k % 9, 40)) for k in range(0, 700, 25)] + [(1, tune(4, 40)[5 * hop :]), (2, np.zeros(40 * hop, "<i2")), (300, np.zeros(90 * hop, "<i2"))]
    rows = C.search(media(spark, sounds), "rec").collect()
    codes = [C.packed(C.chroma(s)) for _, s in sounds]
    members = {}
    for r in rows:
        members.setdefault(r.class_id, []).append(r.rec)
    want = set()
    for (k, _), a in zip(sounds, codes):
        for (q, _), b in zip(sounds, codes):
            if q % 100 == 0 and q != k and (best := best_offset(a, b)) and C.bit_error(a, b, best[1])[0] <= C.MAX_BIT_ERROR:
                want.add((k, q, best[1], best[0], round(C.bit_error(a, b, best[1])[0], 9)))
    got = {(k, q, x.offset, x.votes, round(x.bit_error, 9)) for r in rows for x in r.links or [] for k in members[r.class_id] for q in members[x.query_class] if q % 100 == 0 and q != k}
    assert got == want and len(rows) == len(sounds)
    for r in rows:
        if r.query_id is not None:
            assert (r.rec, r.query_id, r.offset, r.votes, round(r.bit_error, 9)) in want and round(r.bit_error, 9) == min(x[4] for x in want if x[0] == r.rec)
        else:
            assert all(x[0] != r.rec for x in want)
    assert C.search(media(spark, []), "rec").count() == 0


def test_the_querys_table_has_a_row_for_each_vector(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op6_chroma_prints"](spark, sf).collect()
    vectors = {r.vec_id: r.rec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id", "vec_id as rec_id").collect()}
    assert sorted(r.vec_id for r in rows) == sorted(vectors)
    codes = {r.vec_id: [int(r.fingerprint[k : k + 8], 16) for k in range(0, len(r.fingerprint), 8)] for r in rows}
    for r in rows[:200]:
        found = [(C.bit_error(np.array(codes[r.vec_id], np.uint32), np.array(codes[q], np.uint32), best[1])[0]) for q in codes if q % 100 == 0 and q != r.vec_id and (best := best_offset(codes[r.vec_id], codes[q]))]
        found = [e for e in found if e <= C.MAX_BIT_ERROR]
        assert (r.bit_error is None and not found) or abs(r.bit_error - min(found)) < 1e-9


def test_vectors_become_melodies(spark):
    df = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [float("nan"), None, 9.0])], "vec_id long, embedding array<float>")
    got = {r.rec_id: len(r.pcm) for r in C.melodies(df).collect()}
    assert got == {1: 64 * 256 * 2, 2: 0, 3: 3 * 512}


@pytest.mark.parametrize("offset", [0, 3, -4, 50])
def test_bit_error(offset):
    a, b = np.arange(20, dtype=np.uint32), np.arange(25, dtype=np.uint32)
    pairs = [(a[p + offset], b[p]) for p in range(25) if 0 <= p + offset < 20]
    want = sum(bin(int(x ^ y)).count("1") for x, y in pairs) / 32 / len(pairs) if pairs else 1.0
    assert C.bit_error(a, b, offset) == (pytest.approx(want), len(pairs))


def test_every_verified_link_is_returned(spark):
    """Links and classes, spread over their members, are the verified pairs of all recordings with all queries."""
    hop = C.Sound().hop
    song, other = tune(1, 90), tune(2, 90)
    noisy = (song + np.random.default_rng(5).normal(0, 400, len(song))).astype("<i2")
    sounds = [(100, song), (200, song[10 * hop :]), (300, song), (400, noisy), (500, other), (7, song[20 * hop :]), (8, song), (9, other), (10, np.concatenate([song, other])), (11, tune(3, 90)), (12, None), (8, song)]
    rows = C.search(media(spark, sounds), "rec").collect()
    codes = {k: C.packed(C.chroma(s)) for k, s in sounds if s is not None}
    want = set()
    for k, a in codes.items():
        for q in (x for x in codes if x % 100 == 0 and x != k):
            best = best_offset(a.tolist(), codes[q].tolist())
            if best and C.bit_error(a, codes[q], best[1])[0] <= C.MAX_BIT_ERROR:
                want.add((k, q, best[1]))
    members = {}
    for r in rows:
        members.setdefault(r.class_id, set()).add(r.rec)
    got = {(k, q, x.offset) for r in rows for x in r.links or [] for k in members[r.class_id] for q in members[x.query_class] if q % 100 == 0 and q != k}
    assert got == want and len(rows) == len(sounds)
    assert {q for k, q, _ in got if k == 7} == {100, 200, 300, 400} and {q for k, q, _ in got if k == 100} == {200, 300, 400}
    assert {q for k, q, _ in got if k == 10} > {500} and all(x.n_queries == sum(q % 100 == 0 for q in members[x.query_class]) for r in rows for x in r.links or [])
    assert {(r.rec, r.query_id) for r in rows} <= {(k, q) for k, q, _ in want} | {(500, None), (11, None), (12, None)}
