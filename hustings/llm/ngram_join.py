"""N-gram Jaccard join through MinHash bands.

A text is the set of its runs of five words. Signatures of MinHash values are cut into bands whose number and rows
are chosen for a target recall at the threshold; band hashes are shuffled, and sets that share one are verified on
their full n-gram sets. Texts with equal sets are one set with copies, so exact copies cost one row each.

Recall: a pair at the threshold itself shares a band with probability ``RECALL`` or more, a nearer pair more surely;
every candidate is verified, so no reported link is wrong. There is no cap on buckets, candidates or partners.

Cases: a text of fewer than five words is one n-gram of all its words; null and empty texts have none, no links and
a class of their own; a row with a null id adds no link and has the class of an equal text; a repeated id is one
document whose links are those of any of its texts; repeated rows count as copies; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, fresh, slices
from .setjoin import class_table, distinct_sets, link_sets, lookup
from .shingles import mixed, set_digest, shingle_set

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999


@cache
def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false candidates) that reach ``recall`` at ``threshold`` with at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-p)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall; allow more hashes")
    return best


@cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_501)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def band_hashes(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of the MinHash signature of a set."""
    a, b = _multipliers(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        x = items[at : at + 2048]
        np.minimum(least, (a[:, None] * x[None, :] + b[:, None]).min(1), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + least.reshape(bands, rows)[:, r])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, pa.int64()))


def signatures(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, d1, d2 (digest of the n-gram set), n (its size), keys (band hashes; null if the set is empty)."""
    bands, rows = choose_bands(threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t or "", words) for t in batch.column("text").to_pylist()]
            marks = [set_digest(s) for s in sets]
            keys = [signed(band_hashes(s, bands, rows)) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists(keys)], names=["doc_id", "d1", "d2", "n", "keys"]
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n long, keys array<long>")


def ngram_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """d1, d2, node (the document's id) and items, the hashes of its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t or "", words) for t in batch.column("text").to_pylist()]
            marks = [set_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)), batch.column("doc_id"), lists([signed(s) for s in sets])], names=["d1", "d2", "node", "items"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "d1 long, d2 long, node long, items array<long>")


def link(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the smallest id that links lead to; else its own) and
    n_links (documents, copies among them, whose sets are at least ``threshold`` alike)."""
    sig = durable(signatures(docs, words, threshold, recall), "signatures")
    sets = distinct_sets(sig)
    links, edges = link_sets(sets, lambda nodes: ngram_sets(lookup(docs, nodes), words), threshold)
    return class_table(sig, sets, links, edges)


def keep_one(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` without the documents of a class but the one with its smallest id; all columns stay.

    Rows with a null id stay. Of rows that repeat an id, one stays (they are one document).
    """
    classes = durable(link(docs, words, threshold, recall), "classes")
    gone = durable(classes.where("doc_id <> class_id").select("doc_id").distinct(), "gone")
    twice = classes.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    rest = docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if twice.isEmpty():
        return rest
    # Numbers are written down before they are compared: another run of the same rows may number them otherwise.
    row = fresh("row", docs)
    named = durable(rest.withColumn(row, F.monotonically_increasing_id()), "numbered")
    first = named.where("doc_id is not null").groupBy("doc_id").agg(F.min(row).alias(row)).select(row)
    none = named.where("doc_id is null")
    return named.join(first, row, "left_semi").unionByName(none).select(*[F.col(f"`{c}`") for c in docs.columns])
