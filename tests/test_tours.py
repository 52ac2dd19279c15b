"""Euler tours against walks over plain Python trees."""

import random

import pytest
from conftest import small_trees
from pyspark.sql import functions as F

from quantloom import queries
from quantloom.operators import tours, trees, variation


def rows_of(parents):
    """(tree_id, node_idx, node_type, parent_idx, depth, p1..p4) from {tree: {node: parent}}."""
    return [(t, i, 1 if p < 0 else 2, p, 0, float(i), 0.0, 0.0, 0.0) for t, tree in parents.items() for i, p in tree.items()]


def walk(tree):
    """{node: (enter, leave, level, root)} of what roots reach, depth first, by index."""
    out, clock = {}, 0
    kids = {}
    for i in sorted(tree):
        kids.setdefault(tree[i] if tree[i] >= 0 else -1, []).append(i)
    for root in kids.get(-1, []):
        stack = [(root, 0, False)]
        while stack:
            i, level, leaving = stack.pop()
            if leaving:
                out[i] = (out[i][0], clock, level, root)
            else:
                out[i] = (clock, None, level, root)
                stack.append((i, level, True))
                stack += [(k, level + 1, False) for k in reversed(kids.get(i, []))]
            clock += 1
    return out


def test_tours_by_force(spark, monkeypatch):
    """Random forests with gaps, orphans and a cycle, a chain of 1,000 nodes, and a star."""
    x = random.Random(6)
    parents = {}
    for t in range(6):
        ids = x.sample(range(200), 40)
        parents[t] = {i: -1 if k < 3 else ids[x.randrange(k)] for k, i in enumerate(ids)} | {500: 499, 501: 500, 600: 601, 601: 600}
    parents[10] = {i: i - 1 for i in range(1000)}
    parents[11] = {i: -1 if i == 0 else 0 for i in range(300)}
    parents[12] = {5: 4}
    rounds = []
    real = tours.written
    monkeypatch.setattr(tours, "written", lambda df: (rounds.append(1), real(df))[1])
    got = tours.toured(spark.createDataFrame(rows_of(parents), trees.NODE)).collect()
    want = {(t, i): v for t, tree in parents.items() for i, v in walk(tree).items()}
    assert {(r.tree_id, r.node_idx): (r.enter, r.leave, r.level, r.branch) for r in got} == want
    assert len(rounds) <= 1 + 11  # a depth of 1,000 takes 11 rounds


def test_nearest_by_force(spark):
    x = random.Random(7)
    tree = {i: -1 if i < 3 else x.randrange(max(0, i - 4), i) for i in range(120)}
    stops = {i for i in tree if x.random() < 0.15}

    def top(i):
        while i >= 0 and i not in stops:
            i = tree[i]
        return i if i >= 0 else None

    nodes = spark.createDataFrame([(1, i, p, i in stops) for i, p in tree.items()], "tree_id long, node_idx int, parent_idx int, halt boolean")
    assert {r.node_idx: r.top for r in tours.nearest(nodes, "halt").collect()} == {i: top(i) for i in tree}


def test_subtrees_and_compaction(spark):
    nodes = small_trees(spark, 4)
    found = trees.subtree(nodes, spark.createDataFrame([(1, 3), (1, 0), (2, 14), (3, 99)], "tree_id long, top int")).collect()
    got = {(r.tree_id, r.top, r.node_idx): (r.below, r.branch) for r in found}
    assert got == {(1, 3, 3): (0, 0), (1, 3, 5): (1, 0), (1, 0, 0): (0, 0), (1, 0, 3): (1, 0), (1, 0, 4): (1, 0), (1, 0, 5): (2, 0), (1, 0, 6): (2, 0), (2, 14, 14): (0, 2)}
    cut = trees.compact(nodes.where("NOT (tree_id = 2 AND node_idx = 3)")).collect()
    assert sorted(r.node_idx for r in cut if r.tree_id == 2) == list(range(13)) and trees.compact(nodes.limit(0)).count() == 0


def test_what_makes_the_nodes_runs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    nodes = trees.cut_lineage(small_trees(spark, 4)).mapInArrow(count, trees.NODE)
    assert variation.delete_subtree(nodes, 1, rate=1.0).count() < 60 == made.value


@pytest.mark.parametrize("seed", [1, 2])
def test_deleted_subtrees_leave_valid_trees(spark, seed):
    nodes = trees.random_population(spark, 8, queries.CATALOG, max_depth=6, seed=seed)
    left = variation.delete_subtree(nodes, seed, rate=1.0)
    assert left.count() < nodes.count() and left.exceptAll(nodes.select(left.columns)).count() == 0
    assert trees.validate(left).where(F.col("faults") != 0).count() == 0
