"""SpotSigs document fingerprints.

A spot is an anchor (a very common word) with the chain of the next content words after it. A text's fingerprint is
the set of its spots, 32 bits each, written as base64 of the sorted numbers; likeness is the Jaccard coefficient of
two sets. For a join, sets are partitioned by length so that only neighbouring partitions can hold pairs above the
threshold, indexed by their rarest spots only, and the candidates are compared in full.

Cases: null texts are empty; an empty text has an empty fingerprint (like another empty one, unlike all else); a
text without any spot gets one spot of all its words, or of its characters if it has no words; texts are read whole;
documents of equal id follow one another in the order of their texts; null ids come last; a single document's next
one is itself; repeated rows give repeated results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, slices, weighed_lookup
from .ngram_join import lists
from .setjoin import class_table, distinct_sets, link_sets
from .shingles import chained, set_digest, word_hashes

# Anchors and further function words of English, German, French and Spanish.
ANCHORS = """the a is was that with for this der die ist und das ein le la les est une dans el los las es una por""".split()
STOP = """of and to in it as be by on not he his are at have from or an they which nicht mit von zu den eine im auf für
als auch sich dem des et un que pour qui sur par pas au aux en du y con para del se lo como su al de""".split()
CHAIN = 2
#: Rows of a partition of the document order, about, and such partitions for each shuffle partition at least.
PARTITION_ROWS, PARTITIONS_A_SHUFFLE = 1 << 18, 3


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([word_hashes(w, marks=True) for w in words]))


_ANCHORS, _COMMON = _hashes(ANCHORS), _hashes(ANCHORS + STOP)


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def spots(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct spots of a text as 32-bit numbers."""
    if not text:
        return np.zeros(0, np.uint32)
    words = word_hashes(text.lower(), marks=True)
    content = np.flatnonzero(~_member(words, _COMMON)) if len(words) else words
    anchors = np.flatnonzero(_member(words, _ANCHORS)) if len(words) else words
    first = np.searchsorted(content, anchors)
    first, anchors = first[first + chain <= len(content)], anchors[first + chain <= len(content)]
    if len(first):
        found = chained([words[anchors], *(words[content[first + k]] for k in range(chain))])
    elif len(words):
        found = chained([words[:, None]])[:, 0] if len(words) == 1 else np.array([chained([w[None] for w in words])[0]])
    else:
        found = np.frombuffer(hashlib.sha256(text.encode("utf-8", "replace")).digest()[:8], np.uint64)
    return np.unique((found >> np.uint64(32)).astype(np.uint32))


def packed(found: np.ndarray) -> bytes:
    return found.astype("<u4").tobytes()


def fingerprint(found: np.ndarray) -> str:
    return base64.b64encode(packed(found)).decode()


def spots_of(written: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(written), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited_text(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as many first characters of the next one, or all it has."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
_NAMES = [x.split()[0] for x in _REPORT.split(", ")]


def _report(doc_id: int | None, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    changed = own if edited == text else spots(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(own), packed(changed), likeness(own, changed), likeness(own, after)


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like the text is to that and to the next document.

    Documents are range-partitioned by descending id (then by the start of the text, so that null and repeated ids are dealt
    out too) and sorted within. A task meets each next document but that of its last one; it writes its first and last text
    beside its results, and these ends, two a partition, are joined from partition to partition. The number of partitions
    grows with the rows; nothing but Spark's own sample of the keys reaches the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(-(-docs.count() // PARTITION_ROWS), PARTITIONS_A_SHUFFLE * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, F.desc_nulls_last("doc_id"), F.substring("text", 1, 16)).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple], at: int, head: str | None = None, tail: str | None = None) -> pa.RecordBatch:
            further = [pa.array([v] * len(out), t) for v, t in ((at, pa.int32()), (head, pa.string()), (tail, pa.string()))]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out), _TYPES)), *further], names=[*_NAMES, "at", "head", "tail"])

        none = (None,) * (len(_NAMES) - 1)
        last: tuple | None = None
        at = 0
        for batch in slices(batches):
            out = []
            for doc_id, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at"))):
                found = spots(text)
                if last is None:
                    yield made([(doc_id, *none)], at, head=text)
                else:
                    out.append(_report(*last, text, found))
                last = (doc_id, text, found)
            if out:
                yield made(out, at)
        if last is not None:
            yield made([(last[0], *none)], at, tail=last[1])

    parts = durable(dealt.withColumn("at", F.spark_partition_id()).mapInArrow(run, _REPORT + ", at int, head string, tail string"), "edits")
    heads, tails = parts.where("head is not null").select("at", "head"), parts.where("tail is not null").select("doc_id", "at", "tail")
    # One row a partition that has documents: the next one of each, the first after the last.
    every = W.orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = heads.select("at").select("at", F.coalesce(F.lead("at").over(W.orderBy("at")), F.first("at").over(every)).alias("to"))
    ends = tails.join(following, "at").join(heads.withColumnRenamed("at", "to"), "to").select("doc_id", "tail", "head")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            out = [_report(i, t, spots(t), h, spots(h)) for i, t, h in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "head")))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    every_row = parts.where("head is null and tail is null").select(*_NAMES).unionByName(ends.mapInArrow(close, _REPORT))
    return every_row.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})


def join(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """doc_id, class_id, n_links: documents whose spot sets are at least ``threshold`` alike, every such link found.

    Partition of a set: the logarithm of its length to the base 1 / threshold; alike sets are at most one apart.
    Index: of a set of n spots, the n - ceil(threshold n) + 1 rarest; alike sets share one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [spots(t or "", chain) for t in batch.column("text").to_pylist()]
            marks = [set_digest(f.astype(np.uint64)) for f in found]
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)), pa.array([len(f) for f in found], pa.int64()), lists([f.astype(np.int64) for f in found])], names=["doc_id", "d1", "d2", "n", "items"])

    rows = durable(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n long, items array<long>"), "spots")
    held = distinct_sets(rows)
    each = held.select("node", "n", F.explode("items").alias("item"))
    counted = weighed_lookup(each, durable(each.groupBy("item").agg(F.count(F.lit(1)).alias("f")), "items"), ["item"], "f", F.col("node"))
    ranked = counted.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "item"))).alias("r"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + F.lit(1e-9))
    prefix = F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int"))
    keys = F.array_distinct(F.flatten(F.transform(prefix, lambda s: F.array(F.xxhash64(s["item"], part), F.xxhash64(s["item"], part + 1)))))
    keyed = durable(ranked.select("node", keys.alias("keys")).join(held.select("d1", "d2", "node", "n", "copies"), "node"), "keyed")
    links, edges = link_sets(keyed, lambda nodes: held.join(broadcast_if_small(nodes), "node", "left_semi").select("d1", "d2", "node", "items"), threshold)
    return class_table(rows, held, links, edges)
