"""Connected components by label propagation with pointer jumping, after thinning the edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import lean
from .storage import checkpointed

EDGES_A_TASK = 500_000
#: A key is hot if it has more than one in so many of all rows.
HOT_SHARE = 1000


def join_forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the edges (a, b) that connect two trees of the forest, which grows with them."""
    kept_a, kept_b = [], []
    while len(a):
        ra, rb = parent[a], parent[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        if not len(a):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        _, pick = np.unique(high, return_index=True)  # each root hangs below one smaller root
        kept_a.append(a[pick])
        kept_b.append(b[pick])
        parent[high[pick]] = low[pick]
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up
    none = np.zeros(0, np.int64)
    return (np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else (none, none)


def looked_up(rows: DataFrame, table: DataFrame, key: str, *values: str) -> DataFrame:
    """rows with the values of table at their key, which is unique there; nulls where it has none.

    Keys of more than one row in HOT_SHARE are looked up by broadcast - there can't be more than HOT_SHARE of them -
    and all others by a join, in which no key has a large share.  rows are read three times: give a written table."""
    n = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT_SHARE > n).select(key)
    few = table.join(F.broadcast(hot), key, "left_semi").select(key, *values, F.lit(True).alias("_hot"))
    met = rows.join(F.broadcast(few), key, "left")
    rest = met.where("_hot IS NULL").drop(*values, "_hot").join(table.select(key, *values), key, "left")
    return met.where("_hot").drop("_hot").unionByName(rest)


def _trees(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a task's edges (a, b) in order, and for each the place of the smallest node of its component in them."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), ())))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = np.arange(len(nodes))
    join_forest(top, at[: len(a)], at[len(a) :])
    return nodes, top


def thinned(edges: DataFrame, tasks: int) -> DataFrame:
    """(a, b): fewer of the edges (a, b), with the same components and few at each node.

    Each task finds the components of its edges, and ties each one's nodes into a binary tree, the smallest on top: a
    dense group of g nodes comes down to g - 1 edges for each EDGES_A_TASK edges, and a node has three at most
    in each task, however many it had."""

    @lean
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, top = _trees(batches)
        order = np.argsort(top, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], np.diff(top[order]) > 0))) if len(nodes) else np.zeros(0, np.int64)
        first = np.repeat(head, np.diff(np.append(head, len(nodes))))
        place = np.arange(len(nodes)) - first
        low = np.flatnonzero(place > 0)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[order[first[low] + (place[low] - 1) // 2]]), pa.array(nodes[order[low]])], ["a", "b"])

    return edges.coalesce(tasks).mapInArrow(forest, "a long, b long")


def _labelled_at_once(edges: DataFrame, node: str) -> DataFrame:
    """(node, component) of at most EDGES_A_TASK edges, which one task reads."""

    @lean
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, top = _trees(batches)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], [node, "component"])

    return checkpointed(edges.coalesce(1).mapInArrow(label, f"{node} long, component long"))


def connected_components(spark: SparkSession, edges: DataFrame, node: str) -> DataFrame:
    """(node, component): component is the smallest node reachable over edges (a, b).  Give a written table: edges are read twice.

    Edges that fit a task, at first or once thinned, are done in it; each round over joins costs the driver thousands of tasks.
    Otherwise, in every round, a node takes the smallest label among its own and its neighbours', its old label's
    owner takes it too, and labels jump to their label's label, so that the number of rounds grows
    with the logarithm of a component's width.  Each round is checkpointed; only the number of
    changed labels reaches the driver.  Nodes without edges don't occur in the result."""
    edges = edges.select("a", "b").where("a <> b")
    n = edges.count()
    while n > EDGES_A_TASK:
        edges = checkpointed(thinned(edges, math.ceil(n / EDGES_A_TASK)))
        n, before = edges.count(), n
        if 2 * n > before:  # the trees of so many tasks don't get much smaller
            break
    if n <= EDGES_A_TASK:
        return _labelled_at_once(edges, node)
    both = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")))
    while True:
        near = both.join(labels, "u").groupBy("v").agg(F.min("l").alias("m")).withColumnRenamed("v", "u")
        seen = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        hooked = seen.where("m < l").groupBy(F.col("l").alias("u")).agg(F.min("m").alias("h"))
        moved = checkpointed(seen.join(hooked, "u", "left").select("u", "l", F.least("m", F.coalesce("h", "m")).alias("m")))
        up = moved.select(F.col("u").alias("m"), F.col("m").alias("top"))
        step = checkpointed(looked_up(moved, up, "m", "top").select("u", "l", F.least("m", "top").alias("n")))
        changed = step.where("n < l").limit(1).count()
        labels = step.select("u", F.col("n").alias("l"))
        if not changed:
            return labels.select(F.col("u").alias(node), F.col("l").alias("component"))
