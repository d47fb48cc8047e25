"""Similarity join of sets through shared keys, exact within the candidates, without a row for each pair.

Each set comes with keys; two sets are compared if they share a key. The sets of a key form a bucket, and the hub of
a bucket is its smallest set; buckets of one hub are one group. A pair is compared in each group that both are in, and
counts only in that of the smallest hub among the keys it shares, so once. A group of bounded size is one task: it
holds its sets once and compares them all by products of incidence matrices. A larger one is dealt over blocks, and a
task compares two blocks. A task returns how many links each set has, and for sets that links connect an edge to the
smallest of them: at most an edge a set, never the pairs.

Cases: sets without keys or without a partner are in no task; rows that repeat a node stand for one set if their
digests agree, else for several sets of one document, between which no link counts; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, forget, weighed_lookup

#: Sets and items that one side of a task holds on average (items take 8 bytes).
BLOCK_SETS, BLOCK_ITEMS = 1024, 1 << 19
#: Columns of an incidence matrix that are multiplied at once.
_COLUMNS = 4096

_FOUND = pa.schema([("kind", pa.string()), ("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (a, b), by hooking and pointer jumping.

    A round points each node at the smallest of its smaller neighbours, or at what that one points at, and hooks its
    other smaller neighbours on that smallest one. It ends when every node points at one that points nowhere. A hot
    neighbour is one side of plain equi-joins, which adaptive execution splits. Rounds are written to the shared
    folder, so lost executors cost one round.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while True:
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        above = least.select(F.col("u").alias("m"), F.col("m").alias("top"))
        points = least.join(above, "m", "left").select("u", F.coalesce("top", "m").alias("v"), F.col("top").isNotNull().alias("moved"))
        forks = least.where("most > m").select("u", "m")
        hooks = e.join(forks, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        new = durable(points.unionByName(hooks), "edges")
        forget(e)
        e = new
        if e.where("moved").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _incidence(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of each item that at least two rows have; columns are numbered by rank."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[col]
    return of[keep], (shared.cumsum() - 1)[col[keep]], int(shared.sum())


def common(rows: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of numbers."""
    n = len(rows)
    out = np.zeros((n, n), np.float32)
    of, col, width = _incidence(rows)
    order = np.argsort(col, kind="stable")
    of, col = of[order], col[order]
    cuts = np.searchsorted(col, np.arange(0, width + _COLUMNS, _COLUMNS))
    for k in range(len(cuts) - 1):
        i, c = of[cuts[k] : cuts[k + 1]], col[cuts[k] : cuts[k + 1]] - k * _COLUMNS
        some, local = np.unique(i, return_inverse=True)
        m = np.zeros((len(some), min(_COLUMNS, width - k * _COLUMNS)), np.float32)
        m[local, c] = 1
        out[np.ix_(some, some)] += m @ m.T
    return out


def _smallest(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node) for the nodes that the links (a, b), positions in ``nodes``, connect to a smaller one."""
    root = list(range(len(nodes)))
    rank = nodes.tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            p, q = (p, q) if rank[p] <= rank[q] else (q, p)
            root[q] = p
    return [(rank[x], rank[r]) for x in range(len(rank)) if rank[x] != rank[r := find(x)]]


def compare(nodes: np.ndarray, items: list[np.ndarray], keys: list[np.ndarray], hubs: list[np.ndarray], copies: np.ndarray, sides: np.ndarray, hub: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each set, and edges that connect what they connect: of the pairs from side 0 to side 1 or within side 2
    that share a key whose hub is ``hub`` (``hubs`` has that of each key), and none whose hub is smaller."""
    sizes = np.array([len(x) for x in items], np.float32)
    shared = common(items)
    near = shared >= np.float32(threshold) * (sizes[:, None] + sizes[None, :] - shared) - np.float32(1e-3)
    # Settle the rounding of single precision with whole numbers.
    x, y = np.nonzero(near)
    real = shared[x, y].astype(np.float64) / (sizes[x].astype(np.float64) + sizes[y] - shared[x, y]) >= threshold - 1e-12
    near[x[~real], y[~real]] = False
    np.fill_diagonal(near, False)
    near &= common([k[h == hub] for k, h in zip(keys, hubs)]) > 0
    near &= common([k[h < hub] for k, h in zip(keys, hubs)]) == 0
    near &= ((sides[:, None] == 2) & (sides[None, :] == 2)) | (sides[:, None] + sides[None, :] == 1)
    near &= nodes[:, None] != nodes[None, :]
    a, b = np.nonzero(np.triu(near))
    return (near @ copies.astype(np.float64)).astype(np.int64), _smallest(a, b, nodes)


def _task(threshold: float) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        def arrays(name: str) -> list[np.ndarray]:
            c = table.column(name).combine_chunks()
            at, flat = c.offsets.to_numpy(), c.values.to_numpy()
            return [flat[at[i] : at[i + 1]] for i in range(len(c))]

        hub = table.column("hub")[0].as_py()
        nodes, items, keys, hubs, copies, sides = table.column("node").to_numpy(), arrays("items"), arrays("keys"), arrays("hubs"), table.column("copies").to_numpy(), table.column("side").to_numpy()
        if len(np.unique(nodes)) < len(nodes):  # rows that repeat an id: each of its sets once
            at = list({(int(nodes[i]), items[i].tobytes()): i for i in range(len(nodes))}.values())
            nodes, copies, sides = nodes[at], copies[at], sides[at]
            items, keys, hubs = ([x[i] for i in at] for x in (items, keys, hubs))
        links, edges = compare(nodes, items, keys, hubs, copies, sides, hub, threshold)
        at = np.flatnonzero(links)
        rows = {"kind": ["link"] * len(at) + ["edge"] * len(edges), "node": [*nodes[at].tolist(), *(x for x, _ in edges)], "other": [None] * len(at) + [r for _, r in edges], "n": [*links[at].tolist(), *[None] * len(edges)]}
        return pa.Table.from_pydict(rows, schema=_FOUND)

    return run


def _tasks(members: DataFrame) -> DataFrame:
    """Deal the members (hub, node, n items) of each hub's group over blocks of bounded mean size and pair the blocks:
    hub, low, high, side, node. A group of bounded size is one block, and most are."""
    size = durable(members.groupBy("hub").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("items")), "sizes")
    n_blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    sized = weighed_lookup(members.select("hub", "node"), size.select("hub", "sets", n_blocks.alias("blocks")), ["hub"], "sets", F.col("node"))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select("hub", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), F.when(F.col("block") == F.col("with"), 2).when(F.col("block") < F.col("with"), 0).otherwise(1).alias("side"), "node")


def link_sets(keyed: DataFrame, items_of: Callable[[DataFrame], DataFrame], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links between sets that share a key and whose Jaccard similarity is at least ``threshold``.

    ``keyed`` is durable, with a row for each distinct set: d1, d2, node, n (items), copies, keys (distinct numbers).
    ``items_of`` takes a table of nodes and returns d1, d2, node and items for them. Returns (node, links) for the sets
    that have links, where a linked set counts as often as it has copies, and (a, b) edges that connect linked sets.
    """
    members = keyed.select("node", "n", F.explode("keys").alias("key"))
    buckets = durable(members.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("hub")).where("sets > 1"), "buckets")
    shared = weighed_lookup(members, buckets, ["key"], "sets", F.col("node")).select("node", "n", "key", "hub")
    linked = shared.groupBy("node").agg(F.max("n").alias("n"), F.collect_set(F.struct("hub", "key")).alias("shared"))
    held = durable(linked.select("node", "n", F.col("shared.hub").alias("hubs"), F.col("shared.key").alias("keys")), "shared")
    tasks = _tasks(held.select("node", "n", F.explode(F.array_distinct("hubs")).alias("hub")))
    full = items_of(held.select("node")).join(keyed.select("d1", "d2", "node", "copies"), ["d1", "d2", "node"]).join(held.select("node", "hubs", "keys"), "node")
    full = durable(full.select("node", "items", "copies", "hubs", "keys"), "items")
    found = durable(tasks.join(full, "node").groupBy("hub", "low", "high").applyInArrow(_task(threshold), "kind string, node long, other long, n long"), "found")
    forget(buckets, held, full)
    links = found.where("kind = 'link'").groupBy("node").agg(F.sum("n").alias("links"))
    return links, found.where("kind = 'edge'").select(F.col("node").alias("a"), F.col("other").alias("b"))


def lookup(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is a node: a broadcast where the ids are counted few, else a shuffle join."""
    return docs.join(broadcast_if_small(nodes.withColumnRenamed("node", id_col)), id_col, "left_semi")


def distinct_sets(sig: DataFrame) -> DataFrame:
    """The distinct filled sets of ``sig`` (doc_id, d1, d2, n and further columns that d1 and d2 decide), durable: node
    is the smallest id of a set's documents, copies their number. Copies meet in a partial aggregation first."""
    rest = [F.first(c).alias(c) for c in sig.columns if c not in ("doc_id", "d1", "d2")]
    filled = sig.where("n > 0 and doc_id is not null")
    return durable(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), *rest), "sets")


def class_table(sig: DataFrame, sets: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links for each row of ``sig`` (doc_id, d1, d2, n), given its distinct ``sets`` (d1, d2,
    node, copies) and what ``link_sets`` found between them. Empty sets have no links and a class of their own."""
    rows = sig.select("doc_id", "d1", "d2", "n")
    filled = rows.where("n > 0 and doc_id is not null")
    which = F.struct("d1", "d2")
    several = durable(filled.groupBy("doc_id").agg(F.min(which).alias("a"), F.max(which).alias("b")).where("a <> b").select("doc_id"), "several")
    if not several.isEmpty():  # an id with several texts is one document, so its sets are in one class
        texts = filled.join(several, "doc_id", "left_semi").join(sets.select("d1", "d2", "node"), ["d1", "d2"])
        edges = edges.unionByName(texts.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    found = sets.select("d1", "d2", "node", "copies").join(links, "node", "left").join(components(edges), "node", "left")
    of_set = durable(found.select("d1", "d2", F.coalesce("component", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "classes")
    alone = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    filled = weighed_lookup(rows.where("n > 0"), of_set, ["d1", "d2"], "copies", F.coalesce("doc_id", F.lit(0)), "left")
    return filled.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).unionByName(alone)
