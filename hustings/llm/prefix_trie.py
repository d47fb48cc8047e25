"""Conversation prefix trie by most-significant-digit radix partitioning over dictionary-encoded turns.

A turn (role, text) is a digit: a dictionary gives each distinct one a number. The root bucket holds all conversations.
A pass takes each bucket that is too large for one task: it steps over the digits that all its conversations share (the
smallest and the largest rest of a bucket share as much as all of them do), then partitions by the next digit. Buckets
of one conversation end there: their rest is a path. Buckets that are small enough are finished by multikey quicksort in
Arrow tasks, whose recursion emits the nodes. Large ones go into the next pass. Then the few nodes of the passes are
summed bottom-up. A node is named by its smallest conversation and its depth.

Skew: passes count with partial aggregation; look-ups deal hot buckets and hot turns out by their counts; turns are
numbered by a range partitioning of all rows, so a conversation of any length is spread over tasks; sequences travel in
blocks of ``BLOCK`` digits, one of which is live at a time. The digest of the conversations that end at one node is
sequential by contract: their numbers are joined to texts in parallel, and one task hashes those texts as a stream.

Cases: null roles and texts are empty; rows without conv_id belong to no conversation; null turns come first, ties go
by role and text in code points, repeated rows stay separate turns; empty texts and roles are turns like any other; very
long texts are read once, for their digest and words; a conversation whose parent is absent or that has no turns of its
own left may be turnless and ends at the root; a table without conversations has no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, pick, slices, weighed_lookup

#: Digits of a sequence in one row.
BLOCK = 64
#: Conversations and turns of a bucket up to which one task finishes it.
LOCAL = 1024
#: Characters of conversation numbers that are joined before they are hashed, and nodes of a path made at once.
CHUNK, PATH = 1 << 20, 4096

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number among the rows of its conversation in this partition, with its turn's digest and words."""
    part, last, nth = TaskContext.get().partitionId(), None, 0
    for b in slices(batches, 500):
        convs = b.column("conv_id")
        numbers, digests, words = [], [], []
        for conv, role, text in zip(convs.to_pylist(), b.column("role"), b.column("text")):
            nth = nth + 1 if conv == last else 1
            last = conv
            r, t = bytes(role.as_buffer()), bytes(text.as_buffer())
            numbers.append(nth)
            digests.append(hashlib.sha256(b"%d:%b%b" % (len(r), r, t)).digest())
            words.append(len(t.split()))
        yield pa.RecordBatch.from_arrays([convs, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()), pa.array(digests, pa.binary()), pa.array(words, pa.int64())], names=["conv_id", "part", "nth", "digest", "words"])


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), digest and words of each turn. Texts are shuffled once, by ranges of (conversation,
    turn), so equal conversations lie in adjacent partitions; only the at most two conversations that reach over a
    partition's ends need an offset."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    named = pick(turns, ("conv_id", "turn", "role", "text")).where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    ranges = named.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    rows = durable(ranges.mapInArrow(_numbers, "conv_id long, part int, nth long, digest binary, words long"), "turns")
    edges = rows.groupBy("part").agg(F.array(F.min("conv_id"), F.max("conv_id")).alias("ends")).select(F.explode("ends").alias("conv_id")).distinct()
    pieces = rows.join(F.broadcast(edges), "conv_id").groupBy("conv_id", "part").count()  # at most two a partition
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = durable(pieces.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("offset")).where("offset > 0"), "offsets")
    return rows.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", (F.col("nth") + F.coalesce("offset", F.lit(0))).alias("position"), "digest", "words")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: their steps (conv_id, depth, digest, words) and lengths (conv_id, length)."""
    steps = durable(numbered(turns).withColumnRenamed("position", "depth"), "steps")
    return steps, steps.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Steps and lengths of conversations that share heads: conversation c is the first h turns of c - c % family (all of
    them if there are fewer), then its own turns after its first h, where h is the CRC-32 of its decimal modulo ``most``."""
    rows = numbered(turns)
    own = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    parent = (F.col("conv_id") - F.col("conv_id") % family).alias("parent")
    heads = own.select(F.col("conv_id").alias("parent"), F.col("own").alias("parent_own")).where(F.col("parent") % family == 0)
    convs = own.select("conv_id", "own", h, parent).join(heads, "parent", "left").withColumn("taken", F.least("h", F.coalesce("parent_own", F.lit(0))))
    convs = durable(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    first = rows.where((F.col("conv_id") % family == 0) & (F.col("position") < most)).withColumnRenamed("conv_id", "parent")
    inherited = convs.where("taken > 0").select("conv_id", "parent", "taken").join(first, "parent").where("position <= taken").select("conv_id", F.col("position").alias("depth"), "digest", "words")
    kept = weighed_lookup(rows, convs.select("conv_id", "own", "h", "taken"), ["conv_id"], "own", F.col("position")).where("position > h")
    steps = kept.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words").unionByName(inherited)
    return durable(steps, "steps"), convs.select("conv_id", "length")


def blocks_of(steps: DataFrame) -> DataFrame:
    """Dictionary-encoded sequences: conv_id, block, ids and words of up to ``BLOCK`` steps."""
    dictionary = durable(steps.groupBy("digest").agg(F.count(F.lit(1)).alias("uses")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = weighed_lookup(steps, dictionary, ["digest"], "uses", F.struct("conv_id", "depth"))
    own = F.array_sort(F.collect_list(F.struct("depth", "id", "words")))
    grouped = coded.groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block")).agg(own.alias("own"))
    return durable(grouped.select("conv_id", "block", F.col("own.id").alias("ids"), F.col("own.words").alias("words")), "blocks")


def _look(left: DataFrame, right: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Inner join with a durable table of ``n`` rows a key: broadcast up to ``limit`` rows, else hot keys dealt out."""
    if right.count() <= limit:
        return left.join(F.broadcast(right.drop("n")), keys)
    return weighed_lookup(left, right, keys, "n", F.col("conv_id")).drop("n")


def _rest(c: str, depth: Column) -> Column:
    """What is left of a live block's array after ``depth`` steps of the sequence."""
    return F.slice(c, F.pmod(depth, F.lit(BLOCK)).cast("int") + 1, F.lit(BLOCK))


def _next_blocks(live: DataFrame, blocks: DataFrame) -> DataFrame:
    """``live`` with the next block for those sequences whose block is used up but that go on."""
    used_up = (F.col("depth") > 0) & (F.col("depth") % BLOCK == 0) & (F.col("length") > F.col("depth"))
    fetched = live.where(used_up).drop("ids", "words").withColumn("block", (F.col("depth") / BLOCK).cast("long")).join(blocks, ["conv_id", "block"]).drop("block")
    return live.where(~used_up).unionByName(fetched)


def _pass(live: DataFrame, tops: DataFrame, blocks: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One radix pass over the live buckets: their shared paths, the rows that end there, children and rows that go on."""
    rest, words = _rest("ids", F.col("depth")), _rest("words", F.col("depth"))
    ends = live.select("bucket", rest.alias("rest"), words.alias("rest_words")).groupBy("bucket").agg(F.min(F.struct("rest", "rest_words")).alias("low"), F.max("rest").alias("high"))
    differ = F.array_position(F.zip_with("low.rest", "high", lambda x, y: x.eqNullSafe(y)), False)
    shared = F.when(differ == 0, F.size("low.rest")).otherwise(differ - 1).cast("int")
    paths = durable(tops.join(ends.select("bucket", shared.alias("shared"), F.col("low.rest_words").alias("path")), "bucket").withColumn("path", F.slice("path", F.lit(1), F.col("shared"))), "paths")
    moved = _look(live, paths.select("bucket", "shared", "n"), ["bucket"], limit).withColumn("depth", F.col("depth") + F.col("shared")).drop("shared")
    if not paths.where((F.col("shared") > 0) & ((F.col("depth") + F.col("shared")) % BLOCK == 0)).isEmpty():
        moved = _next_blocks(moved, blocks)
    at = F.pmod(F.col("depth"), F.lit(BLOCK)).cast("int")
    moved = durable(moved.withColumn("digit", F.when(F.col("depth") < F.col("length"), F.get("ids", at))), "moved")
    going = moved.where("digit is not null").withColumn("word", F.get("words", at))
    children = going.groupBy("bucket", "digit").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("child"), (F.max("depth") + 1).alias("depth"),
        F.sum(F.col("length") - F.col("depth") - 1).alias("rest"), F.max("word").alias("top_words"),
    )
    return paths, moved.where("digit is null").select("bucket", "depth", "conv_id"), durable(children, "children"), going


def multikey_quicksort(rows: list[tuple[int, list[int], list[int]]], depth: int, parent: int | None, top_words: int) -> list[list]:
    """Nodes of one bucket of (conv_id, ids, words) below the node at ``depth`` that they share, itself first:
    [conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends]."""
    nodes = [[min(r[0] for r in rows), depth, parent, len(rows), 0, 0, (len(rows) - 1) * top_words, _NO_ENDS]]
    above = [-1]

    def add(conv: int, at: int, over: int, n: int, words: int) -> int:
        nodes.append([conv, depth + at + 1, nodes[over][0], n, 0, 0, (n - 1) * words, _NO_ENDS])
        above.append(over)
        nodes[over][4] += 1
        return len(nodes) - 1

    stack = [(0, len(rows), 0, 0)]
    while stack:
        lo, hi, at, node = stack.pop()
        if hi - lo == 1:  # a path
            conv, ids, _ = rows[lo]
            for k in range(at, len(ids)):
                node = add(conv, k, node, 1, 0)
            nodes[node][7] = hashlib.sha256(b"%d" % conv).hexdigest()
            continue
        digit = lambda k: ids[at] if at < len(ids := rows[k][1]) else -1  # noqa: B023, E731
        pivot = digit((lo + hi) // 2)
        below, k, beyond = lo, lo, hi
        while k < beyond:
            d = digit(k)
            if d < pivot:
                rows[below], rows[k] = rows[k], rows[below]
                below, k = below + 1, k + 1
            elif d > pivot:
                beyond -= 1
                rows[beyond], rows[k] = rows[k], rows[beyond]
            else:
                k += 1
        convs = [rows[k][0] for k in range(below, beyond)]
        if pivot < 0:
            nodes[node][7] = hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest()
        else:
            stack.append((below, beyond, at + 1, add(min(convs), at, node, len(convs), rows[below][2][at])))
        stack += [(a, b, at, node) for a, b in ((lo, below), (beyond, hi)) if a < b]
    for node, over in zip(reversed(nodes), reversed(above)):
        node[5] = node[5] or 1
        if over >= 0:
            nodes[over][5] += node[5]
            nodes[over][6] += node[6]
    return nodes


_LOCAL = pa.schema([*((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("top", pa.bool_())])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each bucket in a stream sorted by (bucket, conv_id, block). A task holds one bucket at a time."""

    def rows() -> Iterator[tuple]:
        for b in slices(batches, 500):
            yield from zip(*(b.column(c).to_pylist() for c in ("bucket", "conv_id", "depth", "parent", "top_words", "ids", "words")))

    for _, bucket in groupby(rows(), key=lambda r: r[0]):
        seqs: list[tuple[int, list[int], list[int]]] = []
        for _, conv, depth, parent, top_words, ids, words in bucket:  # noqa: B007
            if seqs and seqs[-1][0] == conv:
                seqs[-1][1].extend(ids)
                seqs[-1][2].extend(words)
            else:
                seqs.append((conv, ids, words))
        nodes = multikey_quicksort(seqs, depth, parent, top_words)
        columns = [pa.array(c, t) for c, t in zip([*zip(*nodes), [True] + [False] * (len(nodes) - 1)], _LOCAL.types)]
        yield pa.RecordBatch.from_arrays(columns, schema=_LOCAL)


def _finished(local: DataFrame, blocks: DataFrame) -> DataFrame:
    """All nodes of the buckets that one task can hold."""
    last = F.floor((F.col("depth") - 1) / BLOCK)
    skip = (F.col("depth") - last * BLOCK).cast("int")
    now = local.select("bucket", "conv_id", "depth", "parent", "top_words", last.alias("block"), F.slice("ids", skip + 1, F.lit(BLOCK)).alias("ids"), F.slice("words", skip + 1, F.lit(BLOCK)).alias("words"))
    long = local.where(F.col("length") > (last + 1) * BLOCK).select("bucket", "conv_id", "depth", "parent", "top_words", last.alias("last"))
    more = long.join(blocks, "conv_id").where("block > last").drop("last")  # a bucket's rest has at most LOCAL turns
    keys = ["bucket", "conv_id", "block"]
    return now.unionByName(more).repartition("bucket").sortWithinPartitions(*keys).mapInArrow(_finish, NODE + ", top boolean")


def _paths(children: DataFrame) -> DataFrame:
    """The nodes of buckets of one conversation: a path from the bucket's depth to the conversation's end, in pieces."""
    own = children.where("n = 1").select("bucket", "child", "depth", "rest")
    upto = F.col("depth") + F.col("rest")
    piece = lambda start: F.explode(F.sequence(start, F.least(upto, start + PATH - 1)))
    short = own.where(F.col("rest") < PATH).withColumn("at", piece(F.col("depth")))
    starts = own.where(F.col("rest") >= PATH).withColumn("start", F.explode(F.sequence(F.col("depth"), upto, F.lit(PATH).cast("long"))))
    long = starts.repartition("child", "start").withColumn("at", piece(F.col("start"))).drop("start")
    last = F.col("at") == upto
    return short.unionByName(long).select(
        F.col("child").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("bucket")).otherwise(F.col("child")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("child").cast("string"), 256)).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, depth, conv_id) as texts of comma-joined numbers, ``CHUNK`` characters each."""

    def rows() -> Iterator[tuple]:
        for b in slices(batches, 10_000):
            yield from zip(*(b.column(c).to_pylist() for c in ("bucket", "depth", "conv_id")))

    def emit(node: tuple[int, int], convs: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, int(convs[0]), ",".join(convs))], names=["bucket", "depth", "first", "said"])

    for node, found in groupby(rows(), key=lambda r: r[:2]):
        convs, chars = [], 0
        for r in found:
            convs.append(str(r[2]))
            chars += len(convs[-1])
            if chars >= CHUNK:
                yield emit(node, convs)
                convs, chars = [], 0
        if convs:
            yield emit(node, convs)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in slices(batches, 4):
            yield from zip(*(b.column(c).to_pylist() for c in ("bucket", "depth", "said")))

    for node, found in groupby(rows(), key=lambda r: r[:2]):
        digest, first = hashlib.sha256(), True
        for r in found:
            digest.update((r[2] if first else "," + r[2]).encode())
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=["bucket", "depth", "ends"])


def end_digests(ended: DataFrame) -> DataFrame:
    """A row a node with the digest of the conversations (bucket, depth, conv_id) that end there."""
    keys = ["bucket", "depth", "conv_id"]
    texts = ended.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_joined, "bucket long, depth long, first long, said string")
    return texts.repartition("bucket", "depth").sortWithinPartitions("bucket", "depth", "first").mapInArrow(_hashed, "bucket long, depth long, ends string")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def trie(steps: DataFrame, lengths: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each node of the trie of ``steps`` (durable; conv_id, depth from 1, digest, words); ``lengths`` has a row a
    conversation. Look-up tables of up to ``limit`` rows are broadcast, larger ones joined with hot keys dealt out."""
    spark = steps.sparkSession
    n, root = lengths.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not n:
        return spark.createDataFrame([], NODE)
    blocks = blocks_of(steps)
    none = F.array().cast("array<long>")
    live = lengths.join(blocks.where("block = 0"), "conv_id", "left").select(F.lit(root).alias("bucket"), F.lit(0).cast("long").alias("depth"), "conv_id", "length", F.coalesce("ids", none).alias("ids"), F.coalesce("words", none).alias("words"))
    live = durable(live, "live")
    tops = live.groupBy("bucket").agg(F.min("depth").alias("depth"), F.lit(None).cast("long").alias("parent"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("top_words"))
    passes, ended, childs, locals_ = [], [], [], []
    while True:
        paths, ends, children, going = _pass(live, tops, blocks, limit)
        passes.append(paths)
        ended.append(ends)
        childs.append(children)
        small = F.col("rest") + F.col("n") <= LOCAL
        shared = children.where("n > 1").select("bucket", "digit", "n", "child", "top_words", small.alias("small"))
        onward = _look(going.drop("word"), shared, ["bucket", "digit"], limit)
        onward = durable(onward.select(F.col("child").alias("bucket"), (F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"), "conv_id", "length", "ids", "words", "top_words", "small"), "onward")
        locals_.append(onward.where("small").drop("small"))
        tops = children.where((F.col("n") > 1) & ~small).select(F.col("child").alias("bucket"), "depth", F.col("bucket").alias("parent"), "n", "top_words")
        if tops.isEmpty():
            break
        live = onward.where("not small").drop("small", "parent", "top_words")
        if not tops.where(F.col("depth") % BLOCK == 0).isEmpty():
            live = durable(_next_blocks(live, blocks), "live")
    finished = durable(_finished(_union(locals_), blocks), "finished")
    given = finished.where("top").select(F.col("parent_conv_id").alias("parent"), "depth", "n_leaves", "saved_tokens")
    alone = _union(childs).where("n = 1").select(F.col("bucket").alias("parent"), "depth", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    sums = lambda t: t.groupBy("parent", "depth").agg(F.sum("kids").alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    known = durable(sums(given.unionByName(alone).withColumn("kids", F.lit(1))), "known")
    digests = durable(end_digests(_union(ended)), "digests")
    upper, below = [], None
    for paths in reversed(passes):
        total = known if below is None else sums(known.unionByName(below))
        bottom = F.col("depth") + F.col("shared")
        whole = paths.withColumns({"bottom": bottom, "path": F.concat(F.array("top_words"), "path")}).join(total.select(F.col("parent").alias("bucket"), (F.col("depth") - 1).alias("bottom"), "kids", "n_leaves", "saved_tokens"), ["bucket", "bottom"], "left")
        add = lambda a, x: a + x
        of = lambda k: F.coalesce("saved_tokens", F.lit(0)) + (F.col("n") - 1) * F.aggregate(F.slice("path", k + 1, F.lit(BLOCK + 1)), F.lit(0).cast("long"), add)
        whole = durable(whole.select("bucket", "depth", "bottom", "parent", "n", "shared", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.transform(F.sequence(F.lit(0), F.col("shared")), of).alias("saved")), "whole")
        below = whole.select("parent", "depth", "n_leaves", F.col("saved")[0].alias("saved_tokens"), F.lit(1).alias("kids"))
        upper.append(whole)
    each = _union(upper).select("*", F.posexplode("saved").alias("k", "saved_tokens")).join(digests.withColumnRenamed("depth", "bottom"), ["bucket", "bottom"], "left")
    last = F.col("k") == F.col("shared")
    nodes = each.select(
        F.col("bucket").alias("conv_id"), (F.col("depth") + F.col("k")).alias("depth"), F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(F.lit(1)).alias("n_children"), "n_leaves", "saved_tokens", F.when(last, F.coalesce("ends", F.lit(_NO_ENDS))).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    return _union([nodes, *map(_paths, childs), finished.drop("top")])


#: The same trie in DuckDB: a node is the digests of a conversation's first turns, its subtree a join of paths.
ORACLE = r"""
WITH tab AS (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
    FROM range(256) AS r(i))),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
c AS (SELECT conv_id, own, conv_id - conv_id % 20 AS parent,
             xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '') IF x <> '']), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 4 AS h
      FROM o, tab),
d AS (SELECT c.conv_id, c.own, c.parent, c.h, least(c.h, coalesce(p.own, 0)) AS taken FROM c LEFT JOIN o p ON c.parent = p.conv_id),
s AS (SELECT d.conv_id, t.pos AS depth, role, text FROM d JOIN t ON t.conv_id = d.parent AND t.pos <= d.taken
      UNION ALL SELECT d.conv_id, pos - h + taken, role, text FROM d JOIN t ON t.conv_id = d.conv_id WHERE pos > h),
k AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
             string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM d),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM k GROUP BY key, depth),
m AS (SELECT k.conv_id AS member, k.depth, n.conv_id FROM k JOIN n ON k.key = n.key AND k.depth = n.depth),
e AS (SELECT conv_id, depth, sha256(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member)) AS ends
      FROM m WHERE depth = (SELECT max(depth) FROM k WHERE k.conv_id = m.member) GROUP BY conv_id, depth),
p AS (SELECT n.conv_id, n.depth, n.n_convs, n.saved, m.conv_id AS parent_conv_id FROM n LEFT JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1),
x AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
q AS (SELECT p.*, coalesce(x.n_children, 0) AS n_children FROM p LEFT JOIN x USING (conv_id, depth)),
u AS (SELECT m.conv_id, m.depth, sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(q.saved) AS saved_tokens
      FROM q JOIN m ON m.member = q.conv_id AND m.depth <= q.depth GROUP BY m.conv_id, m.depth)
SELECT q.conv_id, CAST(q.depth AS BIGINT) AS depth, q.parent_conv_id, CAST(q.n_convs AS BIGINT) AS n_convs, CAST(q.n_children AS BIGINT) AS n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM q JOIN u USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth)
"""
