"""Sharding by sampled splitters: shards of near equal bytes, each a contiguous range of keys.

Records are ordered by (key, doc_id, row); the key is a hash of the text unless another is given, so equal texts lie side
by side. A sample drawn with probability proportional to size (half to the bytes, half to the count, so that many tiny
records can't hide in one range) gives quantiles, and the quantiles split the order into many more ranges than shards.
Each range is then measured over all records; one that came out overfull is sampled again and subdivided, within one key
if a single key fills it. So a key that a third of all records share is dealt over many ranges, and a task only ever
sorts one range. Where shards begin is exact and doesn't depend on the sample: a record goes to the shard in which the
middle of its bytes falls, counted over all records in order. Equal texts stay in one shard as long as they fill no more
than a sixty-fourth of a shard; larger groups are split where the bytes demand it.

Bounds: the driver holds the ranges' splitters and counts (about ``RANGES`` a shard, 24 bytes each) and samples of
``SAMPLES`` keys a range, whatever the input's size; only narrow rows (id, size, checksum, position) are shuffled.

Cases: a null text has no bytes, size 8 and checksum 0, like an empty one; very long texts are whole records, so a shard
can be off by half of one at either end; null ids come first among equal keys; rows that repeat id and text are told
apart by their place in the table; a table without rows has no shards; further columns, whatever their names, are kept
by ``write_shards`` and ignored by ``shards``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import durable, forget, fresh, pick

#: Ranges a shard, and samples a range.
RANGES, SAMPLES = 32, 32
#: A group of equal keys up to this part of a shard is never split.
WHOLE_GROUP = 64
#: Rounds of subdivision. A range that is overfull after them makes a longer task, never a different result.
ROUNDS = 12
_KEY, _WIDE = 8, 24


def long_bytes(c: Column) -> Column:
    """Eight bytes that order like the long ``c``; null is the smallest long."""
    flipped = F.coalesce(c, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def text_key(text: Column) -> Column:
    """Eight bytes of the MD5 of a text: the key under which equal texts are adjacent."""
    return F.unhex(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16))


def records(docs: DataFrame, key: Column | None = None, whole: bool = False) -> DataFrame:
    """A durable row for each document: doc_id, size, text_crc32, key and position (key, id and row, 24 bytes that order
    like them); ``whole`` adds all columns as the struct ``record``. ``key`` is eight bytes, those of the text if None."""
    text = F.coalesce("text", F.lit(""))
    key = text_key(F.col("text")) if key is None else key
    row, at = (fresh(c, docs) for c in ("row", "key"))
    keyed = docs.withColumns({row: F.monotonically_increasing_id(), at: key})
    position = F.concat(F.col(at), long_bytes(F.col("doc_id").cast("long")), long_bytes(F.col(row)))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")] if whole else []
    return durable(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col(at).alias("key"), position.alias("position"), *own), "records")


def _ranges_of(batch: pa.RecordBatch, cuts: list[bytes]) -> np.ndarray:
    """The range of each row: how many of the sorted cuts are at or below its position."""
    column = batch.column("position").cast(pa.binary(_WIDE))
    at = np.frombuffer(column.buffers()[1], dtype=f"S{_WIDE}", count=len(column), offset=column.offset * _WIDE)
    return np.searchsorted(np.array(cuts, dtype=f"S{_WIDE}"), at, side="right")


def ranged(rows: DataFrame, cuts: list[bytes]) -> DataFrame:
    """``rows`` with the column ``range``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("range", pa.array(_ranges_of(b, cuts), pa.int32()))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("range", IntegerType())]))


def _measured(rows: DataFrame, cuts: list[bytes]) -> list[tuple[int, int, int, bool]]:
    """(range, bytes, rows, whether all share one key) of each range with rows, over all records."""
    per = ranged(rows.select("position", "size", "key"), cuts).groupBy("range").agg(F.sum("size"), F.count(F.lit(1)), F.min("key") == F.max("key"))
    return sorted(tuple(r) for r in per.collect())


def _sampled(rows: DataFrame, cuts: list[bytes], over: set[int], per_byte: float, per_row: float) -> dict[int, list[tuple[bytes, float]]]:
    """A sample (position, weight) of each range in ``over``; a record is drawn with probability size * per_byte + per_row
    and stands for as much as that probability leaves out."""
    wanted = np.zeros(len(cuts) + 1, bool)
    wanted[list(over)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = _ranges_of(b, cuts)
            weight = np.asarray(b.column("size")) * per_byte + per_row
            drawn = np.flatnonzero(wanted[of] & (np.asarray(b.column("draw")) < weight))
            yield pa.RecordBatch.from_arrays([pa.array(of[drawn], pa.int32()), b.column("position").take(pa.array(drawn)), pa.array(np.maximum(weight[drawn], 1.0))], names=["range", "position", "weight"])

    draw = (F.shiftrightunsigned(F.xxhash64("position"), 11) / F.lit(float(1 << 53))).alias("draw")
    found: dict[int, list[tuple[bytes, float]]] = defaultdict(list)
    for r in rows.select("position", "size", draw).mapInArrow(run, "range int, position binary, weight double").toLocalIterator():
        found[r["range"]].append((bytes(r["position"]), r["weight"]))
    return found


def _quantiles(sample: list[tuple[bytes, float]], parts: int, one_key: bool) -> set[bytes]:
    """Cuts of one overfull range. Between keys, a key as heavy as half a part is cut off at both ends."""
    sample.sort()
    upto = list(accumulate(w for _, w in sample))
    cuts, k = set(), 1
    for (position, _), sum_ in zip(sample, upto):
        while k < parts and sum_ >= upto[-1] * k / parts:
            cuts.add(position if one_key else position[:_KEY].ljust(_WIDE, b"\0"))
            k += 1
    if not one_key:
        mass: dict[bytes, float] = defaultdict(float)
        for position, w in sample:
            mass[position[:_KEY]] += w
        for key, w in mass.items():
            if 2 * w * parts >= upto[-1]:
                cuts |= {key.ljust(_WIDE, b"\0"), key.ljust(_WIDE, b"\xff")}
    return cuts


def splitters(rows: DataFrame, ranges: int) -> tuple[list[bytes], list[tuple[int, int, int, bool]]]:
    """Sorted cuts of about ``ranges`` ranges, none overfull: each has at most twice its share of bytes and rows together;
    and what the ranges hold."""
    cuts: list[bytes] = []
    held = _measured(rows, cuts)
    total, n = sum(r[1] for r in held), sum(r[2] for r in held)
    for _ in range(ROUNDS if n else 0):
        share = {r[0]: (r[1] / total + r[2] / n) / 2 for r in held}
        over = {r[0]: r[3] for r in held if r[2] > 1 and share[r[0]] > 2 / ranges}
        found = _sampled(rows, cuts, set(over), SAMPLES * ranges / (2 * total), SAMPLES * ranges / (2 * n)) if over else {}
        more = set().union(*(_quantiles(s, ceil(share[r] * ranges), over[r]) for r, s in found.items())) - set(cuts)
        if not more:
            break
        cuts = sorted({*cuts, *more})
        held = _measured(rows, cuts)
    return cuts, held


def place(rows: DataFrame, n_shards: int, ranges_per_shard: int = RANGES) -> DataFrame:
    """``rows`` of ``records`` with ``shard`` and ``slot`` (the record's number in its shard, from 0)."""
    spark = rows.sparkSession
    cuts, held = splitters(rows, n_shards * ranges_per_shard)
    if not held:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    total, n = sum(r[1] for r in held), sum(r[2] for r in held)
    starts = zip(held, accumulate((r[1] for r in held), initial=0), accumulate((r[2] for r in held), initial=0))
    known = spark.createDataFrame([(r[0], b, c) for r, b, c in starts], "range int, bytes_before long, rows_before long")
    ordered = Window.partitionBy("range").orderBy("key", "position")
    group = Window.partitionBy("range", "key")
    each = ranged(rows, cuts).join(F.broadcast(known), "range")  # as many rows as ranges
    each = each.withColumns({"upto": F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(ordered)})
    each = each.withColumns({"start": F.col("upto") - F.col("size"), "number": F.col("rows_before") + F.col("nth") - 1})
    each = each.withColumns({"group_size": F.sum("size").over(group), "group_rows": F.count(F.lit(1)).over(group), "group_start": F.min("start").over(group)})
    most = WHOLE_GROUP * n_shards
    together = (F.col("group_size") <= total // most) & (F.col("group_rows") <= n // most)
    middle = 2 * F.col("bytes_before") + F.when(together, 2 * F.col("group_start") + F.col("group_size")).otherwise(2 * F.col("start") + F.col("size"))
    shard = F.expr(f"least({n_shards - 1}, (cast(middle as decimal(27, 0)) * {n_shards}) div cast({2 * total} as decimal(27, 0)))").cast("int")
    kept = [c for c in rows.columns if c not in ("key", "position")]
    placed = durable(each.withColumn("middle", middle).select(*kept, "number", shard.alias("shard")), "placed")
    counts = dict(map(tuple, placed.groupBy("shard").count().collect()))
    first = accumulate((counts.get(s, 0) for s in range(n_shards)), initial=0)
    begins = spark.createDataFrame(list(zip(range(n_shards), first)), "shard int, begin long")
    return placed.join(F.broadcast(begins), "shard").withColumn("slot", F.col("number") - F.col("begin")).drop("number", "begin")  # as many rows as shards


def shards(docs: DataFrame, n_shards: int = 24, key: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: shards are not stable under growth) of each document."""
    rows = records(pick(docs, ("doc_id", "text")), key)
    return place(rows, n_shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int, key: Column | None = None) -> None:
    """Write all columns of ``docs`` as Parquet, a folder a shard; each file is in the order of ``slot``, which is kept
    beside the document as (record, slot)."""
    rows = records(docs, key, whole=True)
    placed = place(rows, n_shards)
    placed.select("shard", "slot", "record").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    forget(rows, placed)


#: The same law in DuckDB. CRC-32 of each text is folded byte by byte over a table of 256 entries.
ORACLE = r"""
WITH tab AS (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
    FROM range(256) AS r(i))),
hexes AS (SELECT map(list(printf('%02X', i)), list(CAST(i AS BIGINT))) AS byte FROM range(256) AS r(i)),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size, substr(md5(coalesce(text, '')), 1, 16) AS key FROM documents),
b AS (SELECT n, [byte[h] FOR h IN regexp_extract_all(hex(encode(text)), '..')] AS bytes FROM d, hexes),
crc AS (SELECT n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM b, tab),
o AS (
  SELECT *, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) - size AS start,
         row_number() OVER (ORDER BY key, doc_id NULLS FIRST, n) AS number,
         sum(size) OVER (PARTITION BY key) AS gsize, count(*) OVER (PARTITION BY key) AS grows, sum(size) OVER () AS total, count(*) OVER () AS rows
  FROM d),
g AS (SELECT *, min(start) OVER (PARTITION BY key) AS gstart FROM o),
s AS (
  SELECT *, least(23, (CASE WHEN gsize <= total // (64 * 24) AND grows <= rows // (64 * 24) THEN 2 * gstart + gsize ELSE 2 * start + size END) * 24 // (2 * total)) AS shard
  FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY number) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN crc USING (n)
"""
