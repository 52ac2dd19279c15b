"""Packed populations against prediction by joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import queries
from quantloom.operators import packed, trees

KEYS = ["symbol", "bar", "tree_id", "branch", "action", "ratio", "leverage"]


def answers(df):
    return sorted((tuple(r[k] for k in KEYS) for r in df.collect()), key=str)


def some_bars(spark, n, seed=1):
    x = random.Random(seed)
    data = [(x.choice(["A", "B", None]), i, None if x.random() < 0.05 else [x.choice([None, 0.0, 1.0, x.uniform(0, 300)]) for _ in range(x.choice([4, 4, 4, 2, 0]))]) for i in range(n)]
    return spark.createDataFrame(data, "symbol string, bar long, features array<double>").repartition(3)


@pytest.mark.parametrize("nodes_a_shard, bars_a_block, cells", [(32_768, 1024, 4_000_000), (60, 7, 50)])
def test_packed_trees_answer_as_joins_do(spark, monkeypatch, nodes_a_shard, bars_a_block, cells):
    """Many and few shards; nulls, short feature arrays, unknown features and kinds, a tree without actions."""
    monkeypatch.setattr(packed, "SHARD_NODES", nodes_a_shard)
    nodes = trees.weighted_population(spark, 14, [*queries.CATALOG, (3, "bool", None, None), (9, "num", 0.0, 1.0)], max_depth=6, max_children=5, max_nodes=60, seed=11)
    nodes = nodes.withColumn("p3", F.when((F.col("node_type") == 2) & (F.col("node_idx") % 13 == 5), 7.0).otherwise(F.col("p3"))).where("NOT (tree_id = 3 AND node_type = 3)")
    bars_ = some_bars(spark, 60)
    for depth in (1, 3, 6):
        assert answers(packed.predict_packed(nodes, bars_, depth)) == answers(trees.predict(nodes, bars_, depth))
    assert len(answers(packed.predict_packed(nodes, bars_, 6))) == 60 * 14 * 3
    assert packed.predict_packed(nodes, bars_.limit(0)).count() == 0 and packed.predict_packed(nodes.limit(0), bars_).count() == 0
    made = packed.Packed.of({c: np.array([r[c] for r in nodes.collect()], float if c[0] == "p" and len(c) == 2 else np.int64) for c in ("tree_id", "node_idx", "node_type", "parent_idx", "p1", "p2", "p3", "p4")}, 6)
    x = np.random.default_rng(2).uniform(0, 300, (5, 83))
    whole = made.answer(x)
    monkeypatch.setattr(packed, "CELLS", cells)
    assert (made.answer(x) == whole).all() and (whole >= -1).all() and whole.max() > 0
    assert (np.concatenate([made.answer(x[:, a : a + bars_a_block]) for a in range(0, 83, bars_a_block)], axis=1) == whole).all()


def test_the_population_is_neither_collected_nor_broadcast(spark):
    nodes = trees.random_population(spark, 10, queries.CATALOG, max_depth=4, seed=3)
    plan = packed.predict_packed(nodes, some_bars(spark, 5), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
