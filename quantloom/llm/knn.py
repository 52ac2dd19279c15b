"""Exact top-k inner products with a KD-tree for each shard of vectors.

A tree halves its shard at the median of the widest side of each node's tight bounding box, down to
leaves of about ``LEAF`` vectors.  A query's inner product with anything in a box is at most the sum,
over the dimensions, of the larger product with the box's two sides.  A search is best-first: each query opens its
nodes in the order of their bounds, from a queue of its own, and stops when the best bound left does not reach its kth
best score so far.  Queries of a block that open the same node at the same turn do so together.  The kth score
travels: a first search of one shard gives every query a score to beat in all shards, and within a task it goes
on from shard to shard.

Queries are a table of blocks, trees a table of shards.  Every group of at most ``GROUP_SHARDS`` shards meets all blocks in
one place, where its trees are held and the blocks stream past, so a task holds a few trees and one block however many
there are.  Of all this only the first shard's tree, one of at most ``SHARD_ROWS`` vectors, is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed

SHARD_ROWS, LEAF = 4096, 128
#: Shards whose trees a task holds at most at once, and queries of a block.
GROUP_SHARDS, BLOCK_QUERIES = 32, 1000
LEAST = np.iinfo(np.int64).min + 1  # can be negated
FREE = np.iinfo(np.int64).max


def quantized(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with a null or non-finite one are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def build_tree(ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Ids and points in leaf order, the boxes (low, high) of each level, and the leaves' borders."""
    depth = max(0, math.ceil(math.log2(max(1, len(ids) / LEAF))))
    order, cuts, boxes = np.argsort(ids, kind="stable"), np.array([0, len(ids)]), []
    for level in range(depth + 1):
        low = np.stack([points[order[a:b]].min(axis=0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        high = np.stack([points[order[a:b]].max(axis=0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        boxes.append((low, high))
        if level == depth:
            break
        new = [0]
        for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            side = int(np.argmax(high[n] - low[n])) if points.shape[1] else 0
            middle = (b - a) // 2
            if points.shape[1]:
                order[a:b] = order[a:b][np.argpartition(points[order[a:b], side], middle)]
            new += [a + middle, b]
        cuts = np.array(new)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        order[a:b] = np.sort(order[a:b])
    by_id = np.concatenate([order[a:b][np.argsort(ids[order[a:b]], kind="stable")] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return ids[by_id], points[by_id], boxes, cuts


class Search:
    """The k best of each query, over trees added one after another."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, to_beat: np.ndarray):
        self.ids, self.k, self.to_beat = query_ids, k, to_beat
        self.q, self.up, self.down = queries, np.maximum(queries, 0), np.minimum(queries, 0)
        self.score = np.full((len(query_ids), k), LEAST)
        self.near = np.full((len(query_ids), k), FREE)

    def kth(self) -> np.ndarray:
        return np.maximum(self.to_beat, self.score[:, -1])

    def _bound(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.up[rows] @ high.T + self.down[rows] @ low.T

    def add(self, ids: np.ndarray, points: np.ndarray, boxes: list, cuts: np.ndarray) -> None:
        """Searches one tree; its nodes are numbered from 1, those below n are 2 n and 2 n + 1."""
        everyone, leaves = np.arange(len(self.ids)), 1 << (len(boxes) - 1)
        none = np.finfo(np.float64).min if self.q.dtype == np.float64 else LEAST
        queue = np.full((len(self.ids), 2 * leaves), none, self.q.dtype)  # bounds of each query's open nodes
        low, high = (np.concatenate([b[side] for b in boxes]) for side in (0, 1))
        queue[:, 1] = self._bound(everyone, low[:1], high[:1])[:, 0]
        live = everyone
        while len(live):
            node = queue[live].argmax(axis=1)
            bound = queue[live, node]
            going = (bound > none) & (bound >= self.kth()[live])
            live, node = live[going], node[going]
            queue[live, node] = none
            order = np.argsort(node, kind="stable")
            edge = np.flatnonzero(np.diff(node[order], prepend=-1)).tolist() + [len(node)]
            for x, y in pairwise(edge):
                rows, n = live[order[x:y]], int(node[order[x]])
                if n >= leaves:
                    first, last = cuts[n - leaves], cuts[n - leaves + 1]
                    self._offer(rows, ids[first:last], points[first:last])
                else:
                    queue[rows, 2 * n : 2 * n + 2] = self._bound(rows, low[2 * n - 1 : 2 * n + 1], high[2 * n - 1 : 2 * n + 1])

    def _offer(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        score = (self.q[rows] @ points.T).astype(np.int64)
        score[ids[None, :] == self.ids[rows, None]] = LEAST
        pick = np.argsort(-score, axis=1, kind="stable")[:, : self.k]  # ids ascend, so ties go to the smaller
        new, near = np.take_along_axis(score, pick, 1), ids[pick]
        near = np.where(new == LEAST, FREE, near)
        score, near = np.hstack([self.score[rows], new]), np.hstack([self.near[rows], near])
        order = np.lexsort((near, -score))[:, : self.k]
        self.score[rows], self.near[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(near, order, 1)

    def table(self) -> pa.RecordBatch:
        found = self.score != LEAST
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, found.sum(axis=1))), pa.array(self.near[found]), pa.array(self.score[found])], ["query_id", "vec_id", "score"])


def _trees(vectors: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its tree as arrays."""

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        points = np.array(table.column("v").to_pylist(), np.int64).reshape(len(ids), -1)
        ids, points, boxes, cuts = build_tree(ids, points)
        row = {"shard": table.column("shard")[0].as_py(), "dim": points.shape[1], "ids": ids.tobytes(), "points": points.tobytes(), "boxes": np.concatenate([np.concatenate(b) for b in boxes]).tobytes(), "cuts": cuts.astype(np.int64).tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int64()), ("dim", pa.int64()), *[(c, pa.binary()) for c in ("ids", "points", "boxes", "cuts")]]))

    dealt = vectors.select("vec_id", "v", F.size("v").cast("long").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    return dealt.repartition(shards, "shard", "dim").groupBy("shard", "dim").applyInArrow(build, "shard long, dim long, ids binary, points binary, boxes binary, cuts binary")


def _load(row: dict, kind: type) -> tuple:
    dim = row["dim"]
    read = lambda c: np.frombuffer(row[c], np.int64)
    boxes, flat, levels, at = [], read("boxes"), len(read("cuts")) - 1, 0
    flat = flat.reshape(-1, dim) if dim else np.zeros((4 * levels, 0), np.int64)
    nodes = 1
    while nodes <= levels:
        boxes.append((flat[at : at + nodes].astype(kind), flat[at + nodes : at + 2 * nodes].astype(kind)))
        at, nodes = at + 2 * nodes, 2 * nodes
    return read("ids"), read("points").reshape(len(read("ids")), dim).astype(kind), boxes, read("cuts")


def _blocks(asked: DataFrame, n: int) -> DataFrame:
    """One row for each block of queries of one length: their ids and vectors as arrays."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vectors = np.array(table.column("v").to_pylist(), np.int64)
        row = {"block": table.column("block")[0].as_py(), "dim": table.column("dim")[0].as_py(), "qids": table.column("vec_id").to_numpy().tobytes(), "vectors": vectors.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("block", pa.int64()), ("dim", pa.int64()), ("qids", pa.binary()), ("vectors", pa.binary())]))

    blocks = max(1, math.ceil(n / BLOCK_QUERIES))
    dealt = asked.select("vec_id", "v", F.size("v").cast("long").alias("dim"), F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block", "dim").applyInArrow(build, "block long, dim long, qids binary, vectors binary")


def _search_of(row: dict, k: int, kind: type) -> Search:
    ids = np.frombuffer(row["qids"], np.int64)
    beat = np.full(len(ids), LEAST) if row.get("beat") is None else np.frombuffer(row["beat"], np.int64)
    return Search(ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dim"]).astype(kind), k, beat)


def _piloted(blocks: DataFrame, trees: DataFrame, k: int, kind: type) -> DataFrame:
    """blocks with the score that each query has to beat: its kth best in the first shard's trees, one for each length of vectors."""
    first = {row["dim"]: row for row in trees.where("shard = 0").toArrow().to_pylist()}  # at most SHARD_ROWS vectors or so
    shared = blocks.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beat = []
            for row in batch.to_pylist():
                search = _search_of(row, k, kind)
                if row["dim"] in shared.value:
                    search.add(*_load(shared.value[row["dim"]], kind))
                beat.append(search.score[:, -1].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beat, pa.binary())], [*batch.schema.names, "beat"])

    return blocks.mapInArrow(run, "block long, dim long, qids binary, vectors binary, beat binary")


def _searched(trees: DataFrame, blocks: DataFrame, shards: int, k: int, kind: type) -> DataFrame:
    """(query_id, vec_id, score): the best of each query in each group of shards."""
    cores = trees.sparkSession.sparkContext.defaultParallelism
    groups = max(math.ceil(shards / GROUP_SHARDS), min(shards, cores))
    none = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    tree_columns, block_columns = ["shard", "ids", "points", "boxes", "cuts"], ["block", "qids", "vectors", "beat"]
    left = trees.select(F.pmod("shard", F.lit(groups)).alias("at"), F.lit(0).alias("side"), "dim", *tree_columns, *none(blocks, block_columns))
    right = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("at"), F.lit(1).alias("side"), "dim", *none(trees, tree_columns), *block_columns)
    met = left.unionByName(right).repartition(groups, "at").sortWithinPartitions("at", "side", "shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for k_ in range(batch.num_rows):
                row = batch.slice(k_, 1).to_pylist()[0]
                if row["at"] != at:
                    at, held = row["at"], []
                if row["side"] == 0:
                    held.append((row["dim"], _load(row, kind)))
                else:
                    search = _search_of(row, k, kind)
                    for dim, tree in held:
                        if dim == row["dim"]:
                            search.add(*tree)
                    yield search.table()

    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products with the rows of other ids.

    Ties go to the smaller id.  Null vectors, vectors with null or non-finite components and null ids
    take no part; vectors of different lengths don't meet; repeated queries count once (the smallest
    vector of an id), repeated rows each.  No queries or no rows give no result; other columns are
    ignored.  Products are exact while they fit a long."""
    vectors = checkpointed(quantized(rows, id_col, vector_col, scale))
    n, largest = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x))))).first()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    trees = checkpointed(_trees(vectors, shards))
    asked = checkpointed(quantized(queries, id_col, vector_col, scale).groupBy(F.col("vec_id")).agg(F.min("v").alias("v")))
    n_queries, dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    kind = np.float64 if dim * max(largest or 0, 1) ** 2 < 2**53 else np.int64
    blocks = checkpointed(_piloted(_blocks(asked, n_queries), trees, k, kind))
    found = _searched(trees, blocks, shards, k, kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a task and query at most
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
