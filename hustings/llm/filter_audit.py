"""Filter interaction audit: what five filters remove in each of the 120 orders they can be applied in.

A document is removed by the first filter of an order that it fails, so all that an order does to it follows from the
set of filters it fails: 32 sets. A table of 32 sets by 120 orders holds the step of the first failure. Arrow tasks
compute each document's set, index the table with it and add up removals by part, order, step and label with
``np.bincount``; Spark sums the partial arrays. No order is ever applied to the corpus.

Filters (words are maximal runs of anything but ASCII white space, case-sensitive; null texts are empty):
A: under 200 words; B: under half of the words distinct; C: over 2% capital ASCII letters; D: holds one of ``#$%&*|``;
E: identical to the text of a smaller doc_id, anywhere in the table, removed or not.

Cases: a null source and an empty one are the same part, the empty string; an empty text fails A only (and E, if
repeated); very long texts are read whole, in pieces cut at white space; rows that repeat both id and text have no
smaller id of their own and fare alike; a null id is smaller than none and has none smaller, so it never fails E; of
several labels of one id any good one makes it good and any toxic one toxic; null labels are none; a table without rows
gives no parts and no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pick, salted_lookup, slices, weighed_lookup

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = len(LETTERS)
#: Step (from 0) of the first failure of each set of failed filters (bits, A lowest) in each order; STEPS for none.
FIRST_FAILURE = np.array([[next((k for k, f in enumerate(o) if mask >> LETTERS.index(f) & 1), STEPS) for o in ORDERS] for mask in range(1 << STEPS)])

MIN_WORDS = 200
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
SPACE = b" \t\n\v\f\r"
#: Bytes of a text that are cut into words at once.
WINDOW = 1 << 20
#: Parts whose arrays a task holds before it emits them (a part takes about 25 KB).
HELD_PARTS = 256
#: Rows of a table of digests or labelled ids that is broadcast: both grow with the input, and the driver holds such a table several times, at 187 bytes a digest.
LOOKUP_ROWS = 100_000


def word_counts(data: bytes) -> tuple[int, int]:
    """Words and distinct words of a UTF-8 text, windows of which are cut at white space."""
    if len(data) <= WINDOW:
        words = data.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(data):
        to = min(at + WINDOW, len(data))
        while to < len(data) and data[to] not in SPACE:
            to += 1
        words = data[at:to].split()
        n += len(words)
        seen.update(words)
        at = to
    return n, len(seen)


def failures(data: bytes, chars: int) -> int:
    """The set of filters A to D that a text fails."""
    n, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    marked = len(data.translate(None, MARKS)) < len(data)
    return (n < MIN_WORDS) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 2 * chars) << 2 | marked << 3


_FLAGS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("failed", pa.int32()), ("digest", pa.binary()), ("deal", pa.int32())])


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for batch in slices(batches, 200):
        text = pc.fill_null(batch.column("text"), "")
        raw = [x.as_buffer() for x in text]
        failed = [failures(bytes(b), n) for b, n in zip(raw, pc.utf8_length(text).to_pylist())]
        digest = [hashlib.sha256(b).digest() for b in raw]
        deal = np.arange(at, at + batch.num_rows) & 0xFFFF
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(failed, pa.int32()), pa.array(digest, pa.binary()), pa.array(deal, pa.int32())], schema=_FLAGS)


def flagged(docs: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """A narrow row for each document: doc_id, part, ``failed`` (the set of all five filters) and ``deal``, a number
    that deals rows out. Texts are read once and not shuffled; only SHA-256 digests are. Up to ``limit`` repeated texts
    are broadcast, more are looked up with hot ones dealt out."""
    named = pick(docs, ("doc_id", "source", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = durable(named.mapInArrow(_flag, "doc_id long, part string, failed int, digest binary, deal int"), "flags")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("smallest"))
    repeated = durable(groups.where("rows > 1 and smallest is not null"), "repeated")
    if repeated.count() <= limit:
        seen = rows.join(F.broadcast(repeated.drop("rows")), "digest", "left")
    else:
        seen = weighed_lookup(rows, repeated, ["digest"], "rows", F.col("deal"), "left")
    late = F.coalesce(F.col("doc_id") > F.col("smallest"), F.lit(False)).cast("int")
    return seen.select("doc_id", "part", F.col("failed").bitwiseOR(F.shiftleft(late, 4)).alias("failed"), "deal")


def labelled(rows: DataFrame, labels: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """``rows`` with ``label``: 1 for quality 1, 2 for toxic 1, 3 for both, else 0. Up to ``limit`` labelled ids are broadcast."""
    any_is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = pick(labels, ("doc_id", "quality", "toxic")).where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((any_is_one("quality") + 2 * any_is_one("toxic")).alias("label"))
    marks = durable(marks.where("label > 0"), "marks")
    joined = rows.join(F.broadcast(marks), "doc_id", "left") if marks.count() <= limit else salted_lookup(rows, marks, "doc_id", "deal")
    return joined.withColumn("label", F.coalesce("label", F.lit(0)))


_CELLS = 3 * STEPS + 2 * STEPS + 1
_PARTIAL = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("cells", pa.list_(pa.int64()))])
_BITS = np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1
_ONLY = _BITS * (_BITS.sum(axis=1) == 1)[:, None]


def _partial(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of part and order: removals by step of all, good and toxic documents, failures and sole failures by filter, documents."""
    for part, (removed, masks) in held.items():
        by_label = [removed.sum(axis=0), removed[1] + removed[3], removed[2] + removed[3]]
        own = np.concatenate([masks @ _BITS, masks @ _ONLY, [masks.sum()]])
        cells = np.concatenate([*(x[:, :STEPS] for x in by_label), np.tile(own, (len(ORDERS), 1))], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(ORDERS)), pa.array(ORDERS), pa.array(cells.tolist(), pa.list_(pa.int64()))], schema=_PARTIAL)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    orders, width = len(ORDERS), STEPS + 1
    for batch in slices(batches, 1000):
        parts = batch.column("part").dictionary_encode()
        code, failed, label = (np.asarray(x) for x in (parts.indices, batch.column("failed"), batch.column("label")))
        n = len(parts.dictionary)
        cell = ((code * 4 + label) * orders)[:, None] + np.arange(orders)
        counts = np.bincount((cell * width + FIRST_FAILURE[failed]).ravel(), minlength=n * 4 * orders * width).reshape(n, 4, orders, width)
        masks = np.bincount(code * (1 << STEPS) + failed, minlength=n << STEPS).reshape(n, 1 << STEPS)
        for k, part in enumerate(parts.dictionary.to_pylist()):
            if part in held:
                held[part][0][...] += counts[k]
                held[part][1][...] += masks[k]
            else:
                held[part] = (counts[k].copy(), masks[k].copy())
        if len(held) > HELD_PARTS:
            yield from _partial(held)
            held = {}
    yield from _partial(held)


def tally(rows: DataFrame) -> DataFrame:
    """Counts of each part and order, from rows of (part, failed, label): a partial array of each task, part and order, then their sums."""
    partial = rows.select("part", "failed", "label").mapInArrow(_tally, "part string, filter_order string, cells array<long>")
    return partial.groupBy("part", "filter_order").agg(F.array(*[F.sum(F.col("cells")[k]) for k in range(_CELLS)]).alias("cells"))


def audit(docs: DataFrame, labels: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley
    (the removals of the step's filter in all orders of the part)."""
    sums = tally(labelled(flagged(docs, limit), labels, limit))
    cell = lambda block, k: F.get("cells", F.lit(block * STEPS) + k)
    each = sums.withColumn("at", F.explode(F.array(*map(F.lit, range(STEPS))))).withColumn("letter", F.substring("filter_order", F.col("at") + 1, F.lit(1)))
    of = F.instr(F.lit(LETTERS), F.col("letter")) - 1
    gone = F.aggregate(F.slice("cells", F.lit(1), F.col("at") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    removed = cell(0, F.col("at"))
    steps = each.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "letter",
        (F.get("cells", F.lit(_CELLS - 1)) - gone).alias("kept"), removed.alias("removed"), (cell(3, of) - removed).alias("redundant"),
        cell(4, of).alias("unique_fails"), cell(1, F.col("at")).alias("good_lost"), cell(2, F.col("at")).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


#: The same audit in DuckDB: every order and step over the counts of each set of failed filters.
ORACLE = r"""
WITH g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (SELECT text, min(doc_id) AS smallest FROM t GROUP BY text),
w AS (SELECT t.*, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS words, m.smallest FROM t JOIN m ON t.text = m.text),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         map(['A', 'B', 'C', 'D', 'E'], [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
             100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > smallest, false)]) AS fails
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x)
      JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT c.*, s.filter_order, s.step, s.letter, fails[letter] AS failing,
         len(list_filter(string_split(substr(filter_order, 1, CAST(step - 1 AS INTEGER)), ''), lambda y: y <> '' AND fails[y])) > 0 AS gone,
         len(list_filter(map_values(fails), lambda y: y)) AS n_fails
  FROM c CROSS JOIN s),
x AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
         sum(CASE WHEN gone OR failing THEN 0 ELSE n END) AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failing AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failing AND NOT gone THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT gone THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM x
"""
