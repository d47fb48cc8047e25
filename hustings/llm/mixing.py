"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Sizes are summed by source and hash bucket. A source's budget is a number of whole passes over it plus a
remainder; the remainder is the set of documents whose hash lies below a threshold. The threshold is found by
nested histograms: the bucket in which the budget runs out is refined into finer buckets, no other one is, and
at last by the single hash values of what is left. Documents are never sorted; each is kept or left by comparing
its own hash with its source's threshold. A larger budget keeps a superset (nested thresholds).

Cases: a null text has size 0; a document of no words stays or goes by its hash like any other; a null source is a
source of its own, ranked last; sources of size 0 get target 0; an empty table gives no rows; rows that repeat a
document id share a hash and so cross a threshold together, each taking the same part of what is left; further columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, durable, fresh

#: Bits of a document's hash, and of one histogram level.
HASH_BITS = 48
LEVEL_BITS = 12
CAP = 3


def document_hash(doc_id: Column, seed: str = "") -> Column:
    """48 bits of the MD5 of the id as text: the same in any engine and any run. A null id hashes as empty text."""
    digits = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digits, 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by code point of the source, null last. ``sources`` has a row for each source."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    return sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("long"))


def capped_targets(sources: DataFrame, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by ``weight``, no more than ``cap`` times the source's own size.

    What a capped source can't take is shared again by weight among the others until none is above its cap. With
    sources in the order of size / weight that fixed point is the first prefix of capped sources whose successor
    is not above the level that the prefix leaves. The windows are over one row a source.
    """
    ratio = F.col("source_size").cast("double") / F.col("weight")
    order = W.orderBy(ratio, F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    ranked = sources.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(whole) * F.lit(share)).alias("all"),
        F.sum("weight").over(whole).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    left = F.col("all") - cap * F.col("size_before")
    left_weight = F.col("all_weight") - F.col("weight_before")
    # Capped if the level its predecessors leave would put it above its cap; true for a prefix of the order.
    level = ranked.withColumn("capped", left * F.col("weight") > F.lit(cap) * F.col("source_size") * left_weight)
    totals = [F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(whole), F.lit(0)).alias(f"capped_{c}") for c in ("source_size", "weight")]
    return level.select("*", *totals).select(
        "source", "source_size", "weight",
        F.when(F.col("capped"), F.col("source_size").cast("double") * cap)
        .otherwise((F.col("all") - cap * F.col("capped_source_size")).cast("double") * F.col("weight") / (F.col("all_weight") - F.col("capped_weight")))
        .alias("target"),
    )


def _cross(rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Of the histogram ``rows`` (a row for each source and ``step``), the one in which the budget runs out."""
    order = W.partitionBy("source").orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    at = rows.withColumn("below", F.coalesce(F.sum("words").over(order), F.lit(0)))
    return at.where((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("words") > F.col("budget"))).select(
        "source", step, *keys, (F.col("budget") - F.col("below")).alias("budget"), "words"
    )


def _match(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets null sources meet, under ``a``'s names."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(b, on, how).drop(*[f"__{k}" for k in keys])


def sized(docs: DataFrame, seed: str = "") -> DataFrame:
    """Id, source, size and hash of each document, written once so that no later pass reads texts."""
    text_hash = F.shiftrightunsigned(F.xxhash64("text"), 64 - HASH_BITS)
    narrow = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), seed).alias("hash"), text_hash.alias("text_hash"))
    return durable(narrow, "sized")


def _boundary(rows: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """Nested histograms over ``key`` (48 bits): for each source of ``budgets`` (source, budget) the value at which the
    budget runs out, the words that rows of that value still owe (``owed``) and those they have (``words``)."""
    first, second = F.shiftright(key, HASH_BITS - LEVEL_BITS), F.shiftright(key, HASH_BITS - 2 * LEVEL_BITS)
    h1 = rows.groupBy("source", first.alias("b1")).agg(F.sum("size").alias("words"))
    c1 = _cross(_match(h1, budgets, ["source"]), [], "b1").drop("words")
    r1 = _match(rows.withColumn("b1", first), c1, ["source", "b1"])
    h2 = r1.groupBy("source", "b1", "budget", second.alias("b2")).agg(F.sum("size").alias("words"))
    c2 = _cross(h2, ["b1"], "b2").drop("words", "b1")
    r2 = _match(rows.withColumn("b2", second), c2, ["source", "b2"])
    h3 = r2.groupBy("source", "budget", key).agg(F.sum("size").alias("words"))
    return _cross(h3, [], key).select("source", key, F.col("budget").alias("owed"), "words")


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: ``passes`` over all of it, the boundary ``hash`` (null: none is needed), the words that the
    documents of that hash still owe (``owed``) and the words they have (``words``)."""
    plan = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("passes"),
        F.when(F.col("source_size") > 0, F.round("target").cast("long") % F.col("source_size")).otherwise(F.lit(0)).cast("long").alias("budget"),
    )
    c3 = _boundary(rows, plan.where("budget > 0").select("source", "budget"), "hash")
    return _match(plan.drop("budget"), c3, ["source"], "left")


def decided(rows: DataFrame, weights=cycle_weights, cap: int = CAP) -> DataFrame:
    """The thresholds of each source, written once: a row a source, so it is small beside any corpus."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return durable(thresholds(rows, capped_targets(weights(sources), cap)).withColumnRenamed("hash", "edge"), "thresholds")


def mix(docs: DataFrame, weights=cycle_weights, cap: int = CAP, seed: str = "") -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies.

    ``weights`` adds a column ``weight`` to a table with a row a source. ``taken`` counts the words that the mix
    takes from the document, repeats counted; the document at the boundary gives only the words its source still
    owes. ``copies`` is how often the document is taken, in whole or in part.
    """
    rows = sized(docs, seed)
    joined = _match(rows, broadcast_if_small(decided(rows, weights, cap)), ["source"])
    inside, edge = F.col("hash") < F.col("edge"), F.col("hash") == F.col("edge")
    part = F.when(edge, F.floor(F.col("size") * F.col("owed").cast("double") / F.col("words"))).otherwise(F.lit(0)).cast("long")
    extra = F.when(inside, F.col("size")).otherwise(part)
    once = F.when(inside | (part > 0), F.lit(1)).otherwise(F.lit(0))
    return joined.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("passes") + extra).cast("long").alias("taken"),
        F.least(F.col("passes") + once, F.lit(cap)).cast("int").alias("copies"),
    )


def apply_mix(docs: DataFrame, weights=cycle_weights, cap: int = CAP, seed: str = "") -> DataFrame:
    """The mixed rows themselves, with all columns of ``docs``: each document as often as the mix takes it.

    Documents stay whole here: the one at the boundary is taken if its source still owes at least half of it. Documents
    that share the boundary's hash, as null and repeated ids do, are told apart by the hashes of their texts in the same
    way; rows equal in id and text go together.
    """
    rows = sized(docs, seed)
    at = decided(rows, weights, cap).select("source", "passes", "edge", "owed", "words")
    tied = _match(rows.withColumnRenamed("hash", "edge").select("source", "edge", "text_hash", "size"), at.where("edge is not null").select("source", "edge", "owed"), ["source", "edge"])
    several = durable(tied.groupBy("source").agg(F.first("owed").alias("budget"), F.count(F.lit(1)).alias("n")).where("n > 1 and budget > 0").drop("n"), "tied")
    if several.isEmpty():
        at = at.withColumns({"text_edge": F.lit(None).cast("long"), "take_edge": 2 * F.col("owed") >= F.col("words")})
    else:
        inner = _boundary(tied.drop("edge", "owed"), several, "text_hash").select("source", F.col("text_hash").alias("text_edge"), (2 * F.col("owed") >= F.col("words")).alias("take_text"))
        at = _match(at, inner, ["source"], "left").withColumn("take_edge", F.coalesce("take_text", 2 * F.col("owed") >= F.col("words")))
    at = broadcast_if_small(durable(at.select("source", "passes", "edge", "text_edge", "take_edge"), "edges"))
    name = {c: fresh(c, docs) for c in (*at.columns, "hash", "text_hash", "copy")}
    new = {c: F.col(name[c]) for c in name}
    key = fresh("mixed_source", docs)
    hashed = docs.withColumns({name["hash"]: document_hash(F.col("doc_id"), seed), name["text_hash"]: F.shiftrightunsigned(F.xxhash64("text"), 64 - HASH_BITS)})
    joined = hashed.join(at.select(F.col("source").alias(key), *[F.col(c).alias(name[c]) for c in at.columns if c != "source"]), F.col("source").eqNullSafe(F.col(key)))
    at_edge = F.when(new["text_edge"].isNull() | (new["text_hash"] == new["text_edge"]), new["take_edge"]).otherwise(new["text_hash"] < new["text_edge"])
    once = F.when((new["hash"] < new["edge"]) | ((new["hash"] == new["edge"]) & at_edge), F.lit(1)).otherwise(F.lit(0))
    copies = F.least(new["passes"] + once, F.lit(cap)).cast("int")
    return joined.where(copies > 0).withColumn(name["copy"], F.explode(F.sequence(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same mix in DuckDB: a running sum over each source in the order of the hash.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS tw,
         coalesce(sum(source_size) OVER o, 0) AS sb, coalesce(sum(weight) OVER o, 0) AS wb
  FROM s WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (t - 3 * sb) * weight > 3 * source_size * (tw - wb) AS capped FROM r),
g AS (
  SELECT *, coalesce(sum(CASE WHEN capped THEN source_size END) OVER (), 0) AS cs,
         coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS cw FROM c),
p AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(source_size AS DOUBLE) * 3
              ELSE CAST(t - 3 * cs AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(tw - cw AS DOUBLE) END AS target FROM g),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) % source_size ELSE 0 END AS budget FROM p),
x AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.passes, b.budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
y AS (SELECT *, CASE WHEN upto <= budget THEN size
                     WHEN upto - same < budget THEN CAST(floor(size * CAST(budget - (upto - same) AS DOUBLE) / same) AS BIGINT) ELSE 0 END AS extra FROM x)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * passes + extra AS BIGINT) AS taken,
       CAST(least(passes + CASE WHEN upto <= budget AND budget > 0 THEN 1 WHEN extra > 0 THEN 1 ELSE 0 END, 3) AS INTEGER) AS copies
FROM y
"""
