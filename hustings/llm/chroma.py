"""Chroma audio fingerprints of a media column, and alignment of recordings by offset histograms and bit errors.

PCM samples become frames of twelve pitch-class energies. Sixteen rectangle filters slide over the frames; each
compares two areas of the chroma image, read from its integral image in four look-ups an area, and gives two bits in
Gray code. Together they are one packed 32-bit integer for each position. To align two recordings, positions with
equal integers vote for their offset; the offset with the most votes is verified by the share of differing bits over
the whole overlap.

A search compares a stated set of queries with all recordings that share an integer with one, in blocks: tasks hold a
bounded number of integers of either side. Recordings with equal integers are one class, and every verified link between a class and a class of
queries is kept; each recording also tells its best alignment. No recording, query, link or integer is left out.

Cases: null or empty samples, and recordings shorter than a frame and the filters, have no integers and no
alignment; silence has the integers of silence; a recording is not aligned with a query of its own id; repeated rows
give repeated results; ties go to the smaller bit error, more votes, then the smaller query id and offset; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, salted_lookup, slices

#: Frames that the widest filter covers.
WIDTH = 16
#: Equal integers at one offset from which a pair is verified, and the largest share of differing bits of a match.
MIN_VOTES, MAX_BIT_ERROR = 3, 0.35
#: Frames that are transformed at once.
FRAMES = 4096
#: Integers of recordings and of queries in one task on average; pairs of runs that are expanded at once.
ROW_CODES, QUERY_CODES, AT_ONCE = 1 << 17, 1 << 17, 1 << 20


@dataclass(frozen=True)
class Sound:
    """Sample rate, samples of a frame, and samples from one frame to the next."""

    rate: int = 4000
    frame: int = 512
    hop: int = 256


def _filters() -> list[tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]]:
    """Sixteen pairs of areas (frame, class, width, height): low against high classes, early against late frames,
    opposite quarters, and a middle band against its neighbours, each at several places and sizes."""
    out = []
    for y, h, w in ((0, 6, 16), (3, 6, 8), (6, 6, 16), (2, 4, 4)):
        out.append(([(0, y, w, h // 2)], [(0, y + h // 2, w, h - h // 2)]))
    for y, h, w in ((0, 3, 16), (3, 3, 12), (6, 3, 16), (9, 3, 8)):
        out.append(([(0, y, w // 2, h)], [(w // 2, y, w // 2, h)]))
    for y, h, w in ((0, 6, 16), (6, 6, 16), (3, 6, 12), (0, 12, 8)):
        a, b = w // 2, h // 2
        out.append(([(0, y, a, b), (a, y + b, a, b)], [(a, y, a, b), (0, y + b, a, b)]))
    for y, h, w in ((0, 6, 12), (3, 9, 6), (6, 6, 9), (0, 9, 15)):
        out.append(([(0, y + h // 3, w, h // 3)], [(0, y, w, h // 3), (0, y + 2 * (h // 3), w, h // 3)]))
    return out


FILTERS = _filters()
#: Cuts of a filter's log ratio into four levels, and their Gray code.
CUTS = np.array([-0.3, 0.0, 0.3])
GRAY = np.array([0, 1, 3, 2], np.uint64)


@cache
def _folding(sound: Sound) -> tuple[np.ndarray, np.ndarray]:
    """The window over a frame, and which pitch class each of its frequencies from 55 Hz on belongs to."""
    hertz = np.fft.rfftfreq(sound.frame, 1 / sound.rate)
    heard = np.flatnonzero(hertz >= 55)
    fold = np.zeros((len(hertz), 12))
    fold[heard, np.rint(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    return np.hanning(sound.frame).astype(np.float32), fold


def chroma(samples: np.ndarray, sound: Sound = Sound(), window: int = FRAMES) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of unit length (or zero in silence). ``window`` frames at once are
    transformed, so beside the result memory is that of a window."""
    if len(samples) < sound.frame:
        return np.zeros((0, 12))
    shape, fold = _folding(sound)
    frames = np.lib.stride_tricks.sliding_window_view(samples, sound.frame)[:: sound.hop]
    parts = [np.abs(np.fft.rfft(frames[k : k + window].astype(np.float32) * shape, axis=1)) ** 2 @ fold for k in range(0, len(frames), window)]
    out = np.concatenate(parts)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-3)


def packed(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each position of the filters over a chroma image."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        return (total[t + w : t + w + n, y + h] - total[t : t + n, y + h] - total[t + w : t + w + n, y] + total[t : t + n, y]) / (w * h)

    out = np.zeros(n, np.uint64)
    for plus, minus in FILTERS:
        a, b = (np.maximum(sum(area(*x) for x in side) / len(side), 0) for side in (plus, minus))
        level = np.searchsorted(CUTS, np.round(np.log((a + 0.01) / (b + 0.01)), 9))
        out = out << np.uint64(2) | GRAY[level]
    return out.astype(np.uint32)


def fingerprints(media: DataFrame, id_col: str, pcm_col: str = "pcm", sound: Sound = Sound()) -> DataFrame:
    """rec_id and codes (packed integers) of each recording: little-endian 16-bit mono samples in ``pcm_col``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = [packed(chroma(np.frombuffer(x[: len(x) // 2 * 2], "<i2"), sound)).view(np.int32) if x else np.zeros(0, np.int32) for x in batch.column("pcm").to_pylist()]
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), lists], names=["rec_id", "codes"])

    return media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(pcm_col).alias("pcm")).mapInArrow(run, "rec_id long, codes array<int>")


def melodies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 0.0625, sound: Sound = Sound()) -> DataFrame:
    """Recordings for tables that hold vectors only: each component is one note of ``hop`` samples, ``scale`` of
    value a semitone around the middle of the octave above 440 Hz; what lies beyond is the lowest or highest note."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sounds = []
            for v in batch.column("v").to_pylist():
                steps = np.nan_to_num(np.array([0.0 if x is None else x for x in v or []], float)) / scale
                hertz = 440 * 2 ** (np.clip(np.floor(steps + 6), 0, 11) / 12)
                phase = np.cumsum(np.repeat(hertz, sound.hop)) * (2 * np.pi / sound.rate)
                sounds.append((np.sin(phase) * 12000).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(sounds, pa.binary())], names=["rec_id", "pcm"])

    return vectors.select(F.col(id_col).cast("long").alias("rec_id"), F.col(vector_col).alias("v")).mapInArrow(run, "rec_id long, pcm binary")


_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits, and positions compared, when b's position p is laid on a's position p + offset."""
    at, to = max(0, offset), min(len(a), len(b) + offset)
    if to <= at:
        return 1.0, 0
    x = a[at:to] ^ b[at - offset : to - offset]
    return float((_BITS[x & 0xFFFF] + _BITS[x >> 16]).mean()) / 32, to - at


def _runs(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integer, list, place and length of each run of one integer in the lists."""
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint32)
    of = np.repeat(np.arange(len(lists)), sizes)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    start = np.flatnonzero(new)
    return flat[start], of[start], start - (sizes.cumsum() - sizes)[of[start]], np.diff(np.append(start, len(flat)))


def best_offsets(rows: list[np.ndarray], queries: list[np.ndarray], min_votes: int = MIN_VOTES) -> list[tuple[int, int, int, int]]:
    """(row, query, offset, votes) for the pairs that have at least ``min_votes`` equal integers at one offset; of
    several best offsets the one nearest to 0, then the smaller.

    Runs meet, not positions: two runs give each offset as many votes as they overlap there, a line up, a level and a
    line down. The places where these lines bend are summed by offset, and running sums over the bends of a pair, at
    most four for each run of either side, give the votes wherever their number can be largest. ``AT_ONCE`` runs meet at
    once, so a long silence costs no more than a note.
    """
    qc, qi, qp, ql = _runs(queries)
    order = np.argsort(qc, kind="stable")
    qc, qi, qp, ql = qc[order], qi[order], qp[order], ql[order]
    rc, ri, rp, rl = _runs(rows)
    low, high = np.searchsorted(qc, rc, "left"), np.searchsorted(qc, rc, "right")
    met = np.flatnonzero(high > low)
    low, n, ri, rp, rl = low[met], (high - low)[met], ri[met], rp[met], rl[met]
    span = 2 * (max(map(len, rows), default=0) + max(map(len, queries), default=0)) + 8
    half, out = span // 2, []

    def summed(keys: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, at = np.unique(keys, return_inverse=True)
        return seen, np.bincount(at, by, len(seen)).astype(np.int64)

    def settle(keys: np.ndarray, by: np.ndarray) -> None:
        pairs = np.unique(keys // span)
        keys, by = summed(np.concatenate([keys, pairs * span + half + 1]), np.concatenate([by, np.zeros(len(pairs), np.int64)]))
        pair, bend = keys // span, keys % span - half
        # The bends of a pair and their moments sum to 0, so one running sum serves all pairs.
        votes = bend * (by.cumsum() - by) - ((by * bend).cumsum() - by * bend)
        rank = np.lexsort((bend - 1, np.abs(bend - 1), -votes, pair))
        first = rank[np.flatnonzero(np.diff(pair[rank], prepend=-1))]
        first = first[votes[first] >= min_votes]
        out.extend(zip((pair[first] // len(queries)).tolist(), (pair[first] % len(queries)).tolist(), (bend[first] - 1).tolist(), votes[first].tolist()))

    held, at = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
    load = np.concatenate([[0], n.cumsum()])
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(load, load[at] + AT_ONCE, "right")) - 1)
        k = n[at:to]
        who = np.repeat(np.arange(at, to), k)
        hit = np.repeat(low[at:to], k) + np.arange(k.sum()) - np.repeat(k.cumsum() - k, k)
        pair = (ri[who] * len(queries) + qi[hit]) * span + half
        first = rp[who] - qp[hit] - ql[hit] + 1
        bends = np.concatenate([pair + first, pair + first + rl[who], pair + first + ql[hit], pair + first + rl[who] + ql[hit]])
        one = np.ones(len(who), np.int64)
        new = summed(bends, np.concatenate([one, -one, -one, one]))
        keys, by = summed(np.concatenate([held[0], new[0]]), np.concatenate([held[1], new[1]]))
        # Rows before the next run's row are done.
        cut = np.searchsorted(keys, int(ri[to]) * len(queries) * span) if to < len(n) else len(keys)
        if cut:
            settle(keys[:cut], by[:cut])
        held, at = (keys[cut:], by[cut:]), to
    return out


_LINKED = pa.schema([("key", pa.string()), ("query_key", pa.string()), ("bit_error", pa.float64()), ("votes", pa.int64()), ("offset", pa.int64()), ("overlap", pa.int64())])


def links(classes: DataFrame, queries: DataFrame, min_votes: int = MIN_VOTES, max_bit_error: float = MAX_BIT_ERROR) -> DataFrame:
    """Every verified link of a class with a class of queries (key and codes, one row a key; durable tables both): key,
    query_key, offset (frames by which the query starts later), votes, overlap, bit_error. A class links to itself too.

    Only classes that share an integer with a query are compared (an equi-join on the integers), the stated queries
    against all of them in blocks of a bounded number of integers of either side.
    """
    total = lambda df: int(df.agg(F.coalesce(F.sum(F.size("codes").cast("long")), F.lit(0))).first()[0])
    asked = queries.select(F.explode("codes").alias("code")).distinct()
    hits = classes.select("key", F.explode(F.array_distinct("codes")).alias("code")).join(asked, "code", "left_semi").select("key").distinct()
    near = durable(classes.join(hits, "key", "left_semi").select("key", "codes"), "near")
    blocks, chunks = max(1, -(-total(queries) // QUERY_CODES)), max(1, -(-total(near) // ROW_CODES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = near.select("key", "codes", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(chunks)).cast("int").alias("chunk"), every(blocks).alias("block"))
    right = queries.select("key", "codes", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), every(chunks).alias("chunk"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        def arrays(t: pa.Table) -> list[np.ndarray]:
            c = t.column("codes").combine_chunks()
            at, flat = c.offsets.to_numpy(), c.values.to_numpy().view(np.uint32)
            return [flat[at[i] : at[i + 1]] for i in range(len(c))]

        if not a.num_rows or not b.num_rows:
            return _LINKED.empty_table()
        rows, others = arrays(a), arrays(b)
        keys, query_keys = a.column("key").to_pylist(), b.column("key").to_pylist()
        found = []
        for i, j, offset, votes in best_offsets(rows, others, min_votes):
            error, overlap = bit_error(rows[i], others[j], offset)
            if error <= max_bit_error:
                found.append((keys[i], query_keys[j], error, votes, offset, overlap))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 6, _LINKED.types)], schema=_LINKED)

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, "key string, query_key string, bit_error double, votes long, offset long, overlap long")


def _best(id_col: str | None) -> Column:
    """The best of ``links``: of a class of queries the smallest id answers, and to that recording itself the largest."""
    query = lambda x: x["query_id"] if id_col is None else F.when(x["query_id"] == F.col(id_col), x["other"]).otherwise(x["query_id"])
    each = F.transform("links", lambda x: F.struct(x["bit_error"].alias("bit_error"), (-x["votes"]).alias("v"), query(x).alias("query_id"), x["offset"].alias("offset"), x["overlap"].alias("overlap")))
    return F.array_min(each if id_col is None else F.filter(each, lambda x: x["query_id"] != F.col(id_col)))


def search(media: DataFrame, id_col: str, every: int = 100, sound: Sound = Sound()) -> DataFrame:
    """Fingerprints of all recordings (rec_id, pcm) and their alignments with the queries, the recordings whose id
    ``every`` divides: one row a recording.

    class_id is the smallest id of the recordings with the same fingerprint. The row of that id has in ``links`` every
    verified link of its class: class_id, number (n_queries) and smallest id of the queries of the other class, and how
    they align. The queries that a recording meets are the members, among the queries and besides itself, of the
    classes linked to its class. Its best alignment stands in the columns query_id to bit_error, null if there is none.
    """
    hexed = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    printed = fingerprints(media, id_col, sound=sound).withColumn("fingerprint", hexed)
    prints = durable(printed.withColumn("key", F.when(F.size("codes") > 0, F.sha2("fingerprint", 256))), "prints")
    heard = prints.where(F.col("key").isNotNull())
    asked = durable(heard.where(F.pmod("rec_id", F.lit(every)) == 0).select("key", "rec_id").distinct(), "queries")
    classes = durable(heard.groupBy("key").agg(F.first("codes").alias("codes"), F.min("rec_id").alias("class_id")), "classes")
    groups = durable(asked.groupBy("key").agg(F.min("rec_id").alias("query_id"), F.max("rec_id").alias("other"), F.count(F.lit(1)).alias("n_queries")).join(classes, "key"), "groups")
    found = durable(links(classes, groups), "links")
    ends = broadcast_if_small(groups.select(F.col("key").alias("query_key"), F.col("class_id").alias("query_class"), "query_id", "other", "n_queries"))
    one = F.struct("query_class", "query_id", "n_queries", "other", "offset", "votes", "overlap", "bit_error")
    linked = durable(found.join(ends, "query_key").groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("links")), "linked")
    narrow = durable(classes.select("key", "class_id").join(linked.select("key", _best(None).alias("best")), "key", "left"), "best")
    own = salted_lookup(asked, linked.join(groups.select("key"), "key", "left_semi"), "key", "rec_id", how="inner").select("key", "rec_id", _best("rec_id").alias("own"), F.lit(True).alias("asks"))
    shown = F.transform("links", lambda x: x.dropFields("other"))
    tops = linked.join(classes.select("key", "class_id"), "key").select("key", F.col("class_id").alias("rec_id"), shown.alias("links"))
    rows = salted_lookup(prints.withColumn("n_codes", F.size("codes").cast("long")).drop("codes"), narrow, "key", "rec_id")
    rows = rows.join(own, ["key", "rec_id"], "left").join(tops, ["key", "rec_id"], "left").withColumn("m", F.when(F.col("asks"), F.col("own")).otherwise(F.col("best")))
    return rows.select(
        F.col("rec_id").alias(id_col), "n_codes", "fingerprint", "m.query_id", "m.offset", (-F.col("m.v")).alias("votes"), "m.overlap", "m.bit_error", "class_id", "links"
    )
