"""Connected components and threshold linking, without lists of all pairs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, grouped, partitions

BLOCK = 1024
BIG = 256


ROWS_PER_TASK = 250_000


def _tasks(rows: int) -> int:
    """Tasks for steps over this many small rows.  Shuffle files number tasks times
    partitions; with few rows in many partitions they would outweigh the rows."""
    return max(4, -(-rows // ROWS_PER_TASK))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable over ``edges`` (a, b).

    Alternating large-star and small-star steps, each one partially aggregated minimum
    per node and one join back on the node, so a node with very many neighbours is a
    skewed join that adaptive execution splits, never a group held by a task.  Every edge
    leads from a node to a smaller one; when no edge begins where another ends, the edges
    are stars around the roots.  Edges with a null end or from a node to itself are
    ignored; no edges give no rows.
    """
    real = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    e = cut(edges.where(real).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = _tasks(e.count())
    e = e.coalesce(n)
    for _ in range(max_rounds):
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(n).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").coalesce(n)
        merged = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = cut(merged.where("u != v").distinct().coalesce(n))
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def packed_sets(flat: np.ndarray, sizes: np.ndarray, width: int = 8) -> pa.Array:
    """Sorted sets of 64-bit columns, laid end to end, as binary values of the ``width`` high
    bytes of each column."""
    raw = np.ascontiguousarray(flat.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, 8 - width :])
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * width
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def unpacked_set(blob, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(blob, dtype="<u8")
    raw = np.frombuffer(blob, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, 8 - width :] = raw
    return out.reshape(-1).view("<u8")


def overlap_links(threshold_num: int, threshold_den: int, width: int = 8) -> Callable:
    """Arrow map over (a, b, cols_a, cols_b): keeps pairs whose sets of columns (``width``
    bytes each) have ``den * |both| >= num * |either|`` given sizes n_a and n_b."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            n_a, n_b = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            keep = np.zeros(batch.num_rows, dtype=bool)
            held, left = None, None
            for i, (x, y) in enumerate(zip(batch.column("cols_a"), batch.column("cols_b"), strict=True)):
                key = a[i].as_py()
                if key != held:
                    held, left = key, unpacked_set(x.as_buffer(), width)
                right = unpacked_set(y.as_buffer(), width)
                at = np.searchsorted(left, right)
                at[at == len(left)] = 0
                both = int((left[at] == right).sum()) if len(left) else 0
                keep[i] = threshold_den * both >= threshold_num * (n_a[i] + n_b[i] - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def linked_components(
    rows: DataFrame, keys: DataFrame, verify: Callable[[DataFrame, int], DataFrame], num: int, den: int, width: int = 8, pivot_rounds: int = 2
) -> DataFrame:
    """Components (node, root) of the pairs that share a key and pass ``verify``.

    ``rows`` has (node, n, cols): one row per distinct set, cols its columns (``packed_sets``).  ``keys`` has (key, node, n):
    any two nodes that may link share a key.  ``verify`` takes distinct pairs (a, b)
    and a number of tasks and returns those that link.

    Pairs are never listed whole.  A pivot round compares one node of every key (its
    smallest) with the others of that key, then takes the pivot out: all its pairs there
    are settled.  Nodes already in one component are not compared again.  What is left
    after the pivot rounds (keys whose nodes still lie in several components) is
    multiplied block by block.  Each step drops pairs whose sizes alone exclude a link.
    """

    def sizes_fit(x, y):
        return F.least(x, y) * F.lit(den) >= F.greatest(x, y) * F.lit(num)

    n = _tasks(keys.count())
    labels = None
    links = None
    left = keys.coalesce(n)
    for _ in range(pivot_rounds):
        pivots = left.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.min(F.struct("node", "n")).alias("p"))
        pivots = pivots.where(F.col("a") != F.col("z")).select("key", "a", F.col("p.n").alias("n_a"))
        pairs = left.join(pivots, "key").where((F.col("node") != F.col("a")) & sizes_fit(F.col("n"), F.col("n_a")))
        if labels is not None:
            at = labels.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
            pairs = pairs.join(at, "a", "left").where(F.coalesce("root_a", "a") != F.coalesce("root", "node"))
        found = verify(pairs.select("a", F.col("node").alias("b")).coalesce(n).distinct().coalesce(n), n).coalesce(n)
        links = cut(found if links is None else links.unionByName(found).coalesce(n))
        labels = cut(connected_components(links).coalesce(n))
        rest = left.join(pivots.select("key", "a"), "key").where(F.col("node") != F.col("a")).select("key", "node", "n")
        rest = cut(rest.coalesce(n).join(labels, "node", "left").coalesce(n))
        many = rest.groupBy("key").agg(F.min(F.coalesce("root", "node")).alias("lo"), F.max(F.coalesce("root", "node")).alias("hi"))
        left = cut(rest.join(many.where("lo != hi").select("key"), "key", "left_semi").coalesce(n))
        if left.isEmpty():
            return labels
    groups = left.select("key", "node", "n", F.coalesce("root", "node").alias("group"))
    more = cut(_block_links(groups, rows, num, den, width, n).coalesce(n))
    if more.isEmpty():
        return labels
    return connected_components(links.unionByName(more))


def _block_links(groups: DataFrame, rows: DataFrame, num: int, den: int, width: int, n: int) -> DataFrame:
    """Links (a, b), as a spanning forest per block, between nodes of different groups that
    share a key; ``groups`` has (key, node, n, group), ``rows`` (node, cols).

    Keys that share a group form a cell, and a cell is parted by size: sets whose sizes
    lie two parts from each other can't link.  Groups of more than BIG nodes in a cell
    have blocks of their own, which don't meet one another; small ones share blocks.  A
    pair of blocks is a task of bounded size: a sparse product of both.
    """
    low = groups.groupBy("key").agg(F.min("group").alias("low"))
    cells = connected_components(groups.select("key", "group").distinct().join(low, "key").select(F.col("group").alias("a"), F.col("low").alias("b")).coalesce(n))
    lane = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num)) + F.lit(1e-9)).cast("int")
    nodes = groups.select("node", "n", "group").distinct().coalesce(n).join(cells.select(F.col("node").alias("group"), F.col("root").alias("cell")), "group").withColumn("lane", lane)
    nodes = cut(nodes.coalesce(n))
    big = nodes.groupBy("cell", "lane", "group").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") > BIG)
    nodes = nodes.join(big, ["cell", "lane", "group"], "left").withColumn("sub", F.when(F.col("own").isNotNull(), F.col("group")))
    held = nodes.groupBy("cell", "lane", "sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    same = (F.col("m.cell") == F.col("h.cell")) & (F.col("m.lane") == F.col("h.lane")) & F.col("m.sub").eqNullSafe(F.col("h.sub"))
    members = nodes.alias("m").join(held.alias("h"), same).select("m.node", "m.n", "m.cell", "m.lane", "m.sub", F.pmod(F.xxhash64("m.node"), F.col("h.blocks")).alias("block"))
    members = cut(members.withColumn("id", F.xxhash64("cell", "lane", F.coalesce("sub", F.lit(0)), "block")).coalesce(n))
    blocks = cut(members.select("cell", "lane", "sub", "id").distinct().coalesce(n))
    x, y = blocks.alias("x"), blocks.alias("y")
    step = F.col("y.lane") - F.col("x.lane")
    meets = (F.col("x.cell") == F.col("y.cell")) & ((step == 1) | ((step == 0) & (F.col("x.id") <= F.col("y.id")))) & ~F.coalesce(F.col("x.sub") == F.col("y.sub"), F.lit(False))
    tasks = x.join(y, meets).select(F.col("x.id").alias("left"), F.col("y.id").alias("right"), F.xxhash64("x.id", "y.id").alias("task"))
    sides = tasks.select("task", F.col("left").alias("id"), F.lit(0).alias("side")).unionByName(tasks.where("left <> right").select("task", F.col("right").alias("id"), F.lit(1).alias("side")))
    dealt = members.select("id", "node", "n").join(rows.select("node", "cols"), "node").coalesce(n).join(sides, "id").coalesce(n).select("task", "side", "node", "n", "cols")
    dealt = dealt.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(_block_products(num, den, width), "a long, b long")


def _block_products(num: int, den: int, width: int) -> Callable:
    def product(records):
        sides, nodes, sizes, cols = zip(*((r["side"], r["node"], r["n"], unpacked_set(r["cols"], width)) for r in records), strict=True)
        side, node, n = np.array(sides), np.array(nodes, dtype=np.int64), np.array(sizes, dtype=np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)  # a block that meets itself
        right = left if alone else right
        # The right block column by column: which of its rows hold a column.
        flat = np.concatenate([cols[i] for i in right])
        owner = np.repeat(np.arange(len(right)), [len(cols[i]) for i in right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        parent = np.arange(len(node))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in left.tolist():
            lo, hi = np.searchsorted(flat, cols[i], side="left"), np.searchsorted(flat, cols[i], side="right")
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            both = np.bincount(owner[at], minlength=len(right))
            linked = np.flatnonzero((both > 0) & (den * both >= num * (n[i] + n[right] - both)))
            for j in right[linked].tolist():
                u, v = root(i), root(j)
                if u != v:
                    parent[max(u, v)] = min(u, v)
        ends = np.array([root(i) for i in range(len(node))])
        apart = np.flatnonzero(ends != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(node[ends[apart]])], names=["a", "b"])

    def run(batches):
        yield from grouped(batches, "task", product)

    return run
