"""Prediction for large populations: packed trees in shards, bars in blocks, met in a grid.

A shard packs some trees into arrays: nodes level by level, each with the place of its parent, and for every branch its
actions in breadth-first order.  A block packs some bars.  A place of the grid holds one shard and has blocks stream past:
decisions become rows of bits over a block's bars, a level at a time; a node is reached where its parent is and its own
decision holds; and a branch's action is the first one reached.  Nothing depends on the size of a population or of a
table of bars: no shard or block passes the driver or is broadcast.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .trees import ACTION, DECISION, ROOT

#: Nodes of a shard and bars of a block, about; and cells of features, or of actions by bars, that are computed at once.
SHARD_NODES, BLOCK_BARS, CELLS = 32_768, 1024, 4_000_000
ANSWER = [("tree_id", T.LongType()), ("branch", T.IntegerType()), ("action", T.IntegerType()), ("ratio", T.DoubleType()), ("leverage", T.DoubleType())]


@dataclass
class Packed:
    """levels: for each level below the roots, the places of its nodes' parents within the level above.  kinds, features,
    others, numbers, at_most: their decisions, side by side; tree_ids, branches: the roots; action_level, action_at: where the
    actions stand; first: the first action of each branch, in breadth-first order; acts: what they do."""

    tree_ids: np.ndarray
    branches: np.ndarray
    levels: list[np.ndarray]
    decisions: list[tuple[np.ndarray, ...]]
    actions: list[np.ndarray]
    order: np.ndarray
    first: np.ndarray
    acts: np.ndarray

    @classmethod
    def of(cls, nodes: dict[str, np.ndarray], max_depth: int) -> Packed:
        """nodes: columns of the node table.  Nodes that no root reaches within max_depth levels are left out."""
        kind, index, up, tree = (nodes[c] for c in ("node_type", "node_idx", "parent_idx", "tree_id"))
        root = np.flatnonzero(kind == ROOT)
        root = root[np.lexsort((index[root], tree[root]))]
        trees, number = np.unique(tree, return_inverse=True)
        width = int(max(index.max(initial=0), up.max(initial=0))) + 1
        key = lambda rows, i: number[rows] * np.int64(width) + i[rows]
        below = np.flatnonzero(np.isin(kind, (DECISION, ACTION)) & (up >= 0))
        below = below[np.lexsort((index[below], key(below, up)))]
        parents = key(below, up)
        levels, decisions, actions, owners = [], [], [], []
        level, branch = root, np.arange(len(root))
        for _ in range(1, max_depth):
            open_ = np.flatnonzero(kind[level] != ACTION)
            want = key(level[open_], index)
            a, b = np.searchsorted(parents, want, "left"), np.searchsorted(parents, want, "right")
            if not (b > a).any():
                break
            at = np.repeat(open_, b - a)
            rows = below[np.concatenate([np.arange(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])]
            level, branch = rows, branch[at]
            levels.append(at)
            ask = np.where(kind[rows] == DECISION, nodes["p3"][rows], 9.0)
            whole = lambda c, rows=rows: np.where(np.abs(np.nan_to_num(nodes[c][rows], nan=-1.0)) < 2**31, np.nan_to_num(nodes[c][rows], nan=-1.0), -1).astype(np.int64)
            decisions.append((ask, whole("p1"), whole("p4"), nodes["p4"][rows], nodes["p2"][rows] != 0))
            act = np.flatnonzero(kind[rows] == ACTION)
            actions.append(act)
            owners.append((branch[act], rows[act]))
        owner, row = (np.concatenate([o[k] for o in owners]) if owners else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(owner, kind="stable")  # levels come first, and within one the order of parents and indices
        acts = np.stack([nodes[c][row[order]] for c in ("p1", "p2", "p3")], axis=1) if len(row) else np.zeros((0, 3))
        return cls(tree[root], nodes["p1"][root].astype(np.int64), levels, decisions, actions, order, np.searchsorted(owner[order], np.arange(len(root) + 1)), acts)

    def _holds(self, level: int, x: np.ndarray) -> np.ndarray:
        """Bits of the bars, by node of a level, for which its decision holds; x: features by bars, NaN where unknown."""
        ask, one, other, value, at_most = self.decisions[level]
        n = x.shape[1]
        out = np.zeros((len(ask), (n + 7) // 8), np.uint8)
        known = (one >= 0) & (one < len(x)) & np.isin(ask, (0.0, 1.0, 2.0)) & ((ask != 1.0) | ((other >= 0) & (other < len(x))))
        step = max(1, CELLS // max(1, n))
        for want, most in ((0.0, False), (0.0, True), (1.0, False), (1.0, True), (2.0, None)):
            rows = np.flatnonzero(known & (ask == want) & (most is None or at_most == most))
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                left = x[one[some]]
                right = x[other[some]] if want == 1.0 else value[some][:, None]
                held = left == right if most is None else left <= right if most else left >= right
                out[some] = np.packbits(held, axis=1, bitorder="little")
        return out

    def answer(self, x: np.ndarray) -> np.ndarray:
        """The place in acts of each root's action for each bar, or -1."""
        n = x.shape[1]
        reached, found = np.full((len(self.tree_ids), (n + 7) // 8), 255, np.uint8), []
        for level, at in enumerate(self.levels):
            above = reached[at]
            found.append(above[self.actions[level]])
            reached = above & self._holds(level, x)
        bits = np.concatenate(found)[self.order] if found else np.zeros((0, (n + 7) // 8), np.uint8)
        out = np.full((len(self.tree_ids), n), -1, np.int32)
        sizes = np.diff(self.first)
        have = np.flatnonzero(sizes)
        step = max(1, CELLS // max(1, n))
        a = 0
        while a < len(have):
            b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[have[a:]]), step, "right")) + a)
            low, high = self.first[have[a]], self.first[have[b - 1] + 1]
            hit = np.unpackbits(bits[low:high], axis=1, count=n, bitorder="little")
            place = np.where(hit, np.arange(low, high, dtype=np.int32)[:, None], np.int32(2**31 - 1))
            best = np.minimum.reduceat(place, self.first[have[a:b]] - low, axis=0)
            out[have[a:b]] = np.where(best < 2**31 - 1, best, -1)
            a = b
        return out


def _shards(nodes: DataFrame, n: int, max_depth: int) -> DataFrame:
    """(shard, packed) for each shard that has trees."""
    columns = ["tree_id", "node_idx", "node_type", "parent_idx", "p1", "p2", "p3", "p4"]

    def pack(table: pa.Table) -> pa.Table:
        get = lambda c: np.array(table.column(c).to_pandas(), np.float64 if c[0] == "p" and len(c) == 2 else np.int64)
        made = Packed.of({c: get(c) for c in columns}, max_depth)
        return pa.table({"shard": table.column("shard")[:1], "packed": pa.array([pickle.dumps(made)], pa.binary())})

    dealt = nodes.select(*columns, F.pmod(F.xxhash64("tree_id"), F.lit(n)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(pack, "shard long, packed binary")


def _blocks(bars: DataFrame) -> DataFrame:
    """(block) rows: some bars each, their columns as they are in an Arrow stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_BARS):
                sink = pa.BufferOutputStream()
                part = batch.slice(a, BLOCK_BARS)
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    return bars.mapInArrow(pack, "block binary")


def _matrix(features: pa.Array) -> np.ndarray:
    """Features by bars; NaN for nulls and behind the end of a shorter array."""
    sizes = np.diff(features.offsets.to_numpy()) if len(features) else np.zeros(0, np.int64)
    flat = features.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False) if not flat.null_count else np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.fill_null(0.0).to_numpy(zero_copy_only=False))
    sizes = np.where(features.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    out = np.full((int(sizes.max(initial=0)), len(sizes)), np.nan)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = values
    return out


def predict_packed(nodes: DataFrame, bars: DataFrame, max_depth: int = 10) -> DataFrame:
    """The rows of trees.predict: (bar, ..., tree_id, branch, action, ratio, leverage) for each bar, tree and branch.

    A shard meets every block, which the result has rows of anyway.  Few shards are held in several places each, between
    which the blocks are dealt, so that all cores work.  Nulls and NaN in features, features that a bar lacks and
    decisions of unknown kinds don't hold; trees without a root give no rows; other columns of bars come back."""
    keys = [f for f in bars.schema.fields if f.name != "features"]
    shards = max(1, math.ceil(nodes.count() / SHARD_NODES))
    lanes = max(1, math.ceil(nodes.sparkSession.sparkContext.defaultParallelism / shards))
    none = F.lit(None).cast("binary")
    held = _shards(nodes, shards, max_depth).select("shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("side"), "packed", none.alias("block"))
    passing = _blocks(bars.select(*[F.col(f"`{f.name}`") for f in keys], "features"))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    passing = passing.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), lane.alias("lane"), F.lit(1).alias("side"), none.alias("packed"), "block")
    met = held.unionByName(passing).repartition(shards * lanes, "shard", "lane").sortWithinPartitions("shard", "lane", "side").drop("side")
    names = [f.name for f in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, trees = None, None
        for batch in batches:
            for at, packed, block in zip(zip(batch.column("shard").to_pylist(), batch.column("lane").to_pylist(), strict=True), batch.column("packed"), batch.column("block"), strict=True):
                if packed.is_valid:
                    place, trees = at, pickle.loads(packed.as_py())
                elif at == place and trees is not None:
                    for part in pa.ipc.open_stream(block.as_buffer()):
                        yield from _answers(part, trees)

    def _answers(part: pa.RecordBatch, trees: Packed) -> Iterator[pa.RecordBatch]:
        found = trees.answer(_matrix(part.column("features")))
        n, step = part.num_rows, max(1, 65_536 // max(1, part.num_rows))
        for a in range(0, len(found), step):
            some = found[a : a + step].ravel()
            acts = np.where(some[:, None] >= 0, trees.acts[np.maximum(some, 0)], np.nan) if len(trees.acts) else np.full((len(some), 3), np.nan)
            repeat = pa.array(np.tile(np.arange(n), len(some) // n))
            root = np.repeat(np.arange(a, a + len(some) // n), n)
            columns = [part.column(c).take(repeat) for c in names]
            columns += [pa.array(trees.tree_ids[root], pa.int64()), pa.array(trees.branches[root], pa.int32()), pa.array(np.nan_to_num(acts[:, 0]).astype(np.int32))]
            columns += [pa.array(acts[:, k], pa.float64(), from_pandas=True) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *[c for c, _ in ANSWER]])

    return met.select("shard", "lane", "packed", "block").mapInArrow(run, T.StructType([*keys, *(T.StructField(c, t) for c, t in ANSWER)]))
