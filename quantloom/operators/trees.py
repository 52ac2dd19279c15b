"""Populations of decision trees as tables of nodes.

A node is (tree_id, node_idx, node_type, parent_idx, depth, p1..p4).  Types: 1 root of a branch, 2 decision, 3
action; unused slots are absent rows.  A decision compares feature p1 by p2 (0: at least, 1: at
most) with the number p4 (p3 = 0), with feature p4 (p3 = 1), or asks whether it equals p4 (p3 = 2).
An action is p1 in 1..6 with ratio p2 and leverage p3.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage, written
from .tours import inside, toured

ROOT, DECISION, ACTION = 1, 2, 3
LONG, HOLD, SHORT = 0, 1, 2
NEW_LONG, NEW_SHORT, CLOSE_ALL, CLOSE_PARTIAL, ADD_POSITION, FLIP_POSITION = range(1, 7)
COLUMNS = ["tree_id", "node_idx", "node_type", "parent_idx", "depth", "p1", "p2", "p3", "p4"]
NODE = "tree_id long, node_idx int, node_type int, parent_idx int, depth int, p1 double, p2 double, p3 double, p4 double"


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone, not on partitions.

    52 bits of an MD5 digest, so that any SQL engine draws the same numbers; nulls in a key don't count."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def lcg(state: Column) -> Column:
    """The next state of the linear congruential generator modulo 2**32."""
    return (state * 1664525 + 1013904223).bitwiseAND(F.lit(0xFFFFFFFF))


def random_action(branch: Column, *key: Column | str, seed: int) -> dict[str, Column]:
    """An action that its branch allows: entries under HOLD, the others under LONG and SHORT."""
    u = uniform(seed, F.lit("kind"), *key)
    kind = F.when(branch == HOLD, F.floor(1 + 2 * u)).otherwise(F.floor(3 + 4 * u)).cast("double")
    sized = kind.isin(1.0, 2.0, 4.0, 5.0, 6.0)
    levered = kind.isin(1.0, 2.0, 5.0, 6.0)
    return {
        "p1": kind,
        "p2": F.when(sized, uniform(seed, F.lit("ratio"), *key)).otherwise(0.0),
        "p3": F.when(levered, F.floor(1 + 100 * uniform(seed, F.lit("leverage"), *key)).cast("double")).otherwise(0.0),
        "p4": F.lit(0.0),
    }


def random_decision(catalog: list[tuple[int, str, float | None, float | None]], *key: Column | str, seed: int) -> dict[str, Column]:
    """A decision over a feature catalogue (idx, family, low, high); families are drawn by their size."""
    table = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(f).alias("f"), F.lit(float(lo or 0)).alias("lo"), F.lit(float(hi or 0)).alias("hi")) for i, f, lo, hi in catalog])
    compared = [float(i) for i, f, _, _ in catalog if f == "comparison"]
    one = F.element_at(table, (F.floor(uniform(seed, F.lit("feature"), *key) * len(catalog)) + 1).cast("int"))
    family, u = one["f"], uniform(seed, F.lit("value"), *key)
    others = F.filter(F.array(*[F.lit(i) for i in compared]) if compared else F.array().cast("array<double>"), lambda x: x != one["i"])
    other = F.try_element_at(others, (F.floor(u * F.greatest(F.size(others), F.lit(1))) + 1).cast("int"))
    return {
        "p1": one["i"],
        "p2": F.when(family == "bool", 0.0).otherwise(F.floor(2 * uniform(seed, F.lit("op"), *key)).cast("double")),
        "p3": F.when(family == "comparison", 1.0).when(family == "bool", 2.0).otherwise(0.0),
        "p4": F.when(family == "comparison", F.coalesce(other, one["i"])).when(family == "bool", F.floor(2 * u).cast("double")).otherwise(one["lo"] + u * (one["hi"] - one["lo"])),
    }


def random_population(spark: SparkSession, n_trees: int, catalog: list[tuple], max_depth: int = 6, max_children: int = 3, max_nodes: int = 256, seed: int = 0) -> DataFrame:
    """Random valid trees, grown level by level for all trees at once.

    A frontier node gets either one action or up to max_children decisions; every decision on the last level but
    one gets an action.  Growth stops early where the next level could exceed max_nodes."""
    trees = spark.range(n_trees).select(F.col("id").alias("tree_id"))
    level = trees.select("tree_id", F.explode(F.array(*[F.lit(b) for b in range(3)])).alias("node_idx")).select(
        "tree_id", "node_idx", F.lit(ROOT).alias("node_type"), F.lit(-1).alias("parent_idx"), F.lit(0).alias("depth"),
        F.col("node_idx").cast("double").alias("p1"), *[F.lit(0.0).alias(p) for p in ("p2", "p3", "p4")], F.col("node_idx").alias("branch"), F.lit(3).cast("long").alias("used"),
    )
    levels = [level]
    for depth in range(1, max_depth):
        order = Window.partitionBy("tree_id").orderBy("parent_idx", "nth")
        open_ = level.where(F.col("node_type") != ACTION).withColumn("width", F.count("*").over(Window.partitionBy("tree_id")))
        key = ("tree_id", "node_idx", F.lit(depth))
        last = (F.lit(depth) == max_depth - 1) | (F.col("used") + F.col("width") * (2 * max_children) > max_nodes)
        stop = last | ((F.col("depth") > 0) & (uniform(seed, F.lit("stop"), *key) < 0.5))
        n = F.when(stop, 1).otherwise(F.floor(1 + max_children * uniform(seed, F.lit("children"), *key))).cast("int")
        born = open_.withColumn("leaf", stop).withColumn("nth", F.explode(F.sequence(F.lit(1), n))).select("tree_id", F.col("node_idx").alias("parent_idx"), "nth", "leaf", "branch", "used")
        placed = born.withColumn("node_idx", (F.col("used") + F.row_number().over(order) - 1).cast("int")).withColumn("used", F.col("used") + F.count("*").over(Window.partitionBy("tree_id")))
        act = random_action(F.col("branch"), "tree_id", "node_idx", seed=seed)
        ask = random_decision(catalog, "tree_id", "node_idx", seed=seed)
        level = placed.select(
            "tree_id", "node_idx", F.when(F.col("leaf"), ACTION).otherwise(DECISION).alias("node_type"), "parent_idx", F.lit(depth).alias("depth"),
            *[F.when(F.col("leaf"), act[p]).otherwise(ask[p]).alias(p) for p in ("p1", "p2", "p3", "p4")], "branch", "used",
        )
        levels.append(level)
    return cut_lineage(reduce(DataFrame.unionByName, levels).select(COLUMNS).repartition("tree_id"))  # what follows reads it many times


def _shapes(rngs: list[np.random.Generator], budgets: np.ndarray, max_depth: int, max_children: int) -> dict[str, np.ndarray]:
    """tree (its place in rngs), node_idx, node_type, parent_idx, depth and branch of some trees' nodes, as weighted_population grows them.

    Every step adds a node to each tree that still grows, so the nodes of all are one matrix.  A tree draws the numbers that
    rng.choice(n, p=weights) and rng.random() would draw for it alone."""
    n_trees, most = len(rngs), int(budgets.max(initial=3))
    drawn = np.stack([rng.random(2 * most) for rng in rngs]) if rngs else np.zeros((0, 2 * most))
    kind, up, depth, branch, kids = (np.zeros((n_trees, most), np.int32) for _ in range(5))
    kind[:, :3], up[:, :3], branch[:, :3] = ROOT, -1, range(3)
    weight = np.zeros((n_trees, most))  # free places over depth + 1; none below an action
    weight[:, :3] = max_children * (2 < max_depth)
    open_, used, size = np.full(n_trees, 3), np.zeros(n_trees, np.int64), np.full(n_trees, 3)  # open: nodes still without children
    grows = np.arange(n_trees)
    for n in range(3, most):
        now = weight[grows, :n]
        left = budgets[grows] - (n + 1 + open_[grows])
        now[left == 0] *= kids[grows[left == 0], :n] == 0
        now[left < 0] = 0
        total = now.sum(axis=1)
        grows, now, total = grows[total > 0], now[total > 0], total[total > 0, None]
        if not len(grows):
            break
        chance = (now / total).cumsum(axis=1)
        chance /= chance[:, -1:]
        parent = (chance <= drawn[grows, used[grows], None]).sum(axis=1)
        first = kids[grows, parent] == 0
        act = first & (drawn[grows, used[grows] + 1] < 0.5)
        used[grows] += 1 + first
        open_[grows] += ~act - first.astype(np.int64)
        kids[grows, parent] += 1
        above = depth[grows, parent]
        weight[grows, parent] = np.where(act, 0, (max_children - kids[grows, parent]) * (above + 2 < max_depth) / (above + 1.0))
        weight[grows, n] = np.where(act, 0, max_children * (above + 3 < max_depth) / (above + 2.0))
        kind[grows, n], up[grows, n], depth[grows, n], branch[grows, n] = np.where(act, ACTION, DECISION), parent, above + 1, branch[grows, parent]
        size[grows] = n + 1
    tree, node = np.nonzero(np.arange(most) < size[:, None])
    bare = (kids[tree, node] == 0) & (kind[tree, node] != ACTION)
    under, at = tree[bare], node[bare]
    count = np.bincount(under, minlength=n_trees)
    place = size[under] + np.arange(len(under)) - (np.cumsum(count) - count)[under]
    ends = {"tree": under, "node_idx": place, "node_type": np.full(len(under), ACTION), "parent_idx": at, "depth": depth[under, at] + 1, "branch": branch[under, at]}
    grown = {"tree": tree, "node_idx": node, "node_type": kind[tree, node], "parent_idx": up[tree, node], "depth": depth[tree, node], "branch": branch[tree, node]}
    return {name: np.concatenate([x, ends[name]]) for name, x in grown.items()}


#: Trees that a task grows at once.
TREES_AT_ONCE = 256


def weighted_population(spark: SparkSession, n_trees: int, catalog: list[tuple], max_depth: int = 6, max_children: int = 30, max_nodes: int = 256, seed: int = 0) -> DataFrame:
    """Random valid trees of half to all of max_nodes nodes, grown one node at a time.

    The next node's parent is drawn by its free places over its depth + 1; a first child is an action half of the time.
    One node stays reserved for every node without children, so that each ends in an action within the limit; a tree
    may stay smaller where actions close all its nodes.  Trees spread over tasks, each grown from (seed, tree) alone."""
    if max_nodes < 6 or max_depth < 2:
        raise ValueError("a tree needs room for three roots with an action each")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for trees in batches:
            for k in range(0, len(trees), TREES_AT_ONCE):
                ids = trees["id"].to_numpy()[k : k + TREES_AT_ONCE]
                rngs = [np.random.default_rng([seed, int(t)]) for t in ids]
                budgets = np.array([rng.integers(max(6, max_nodes // 2), max_nodes + 1) for rng in rngs])
                nodes = pd.DataFrame(_shapes(rngs, budgets, max_depth, max_children))
                yield nodes.assign(tree_id=ids[nodes["tree"]])[["node_type", "parent_idx", "depth", "branch", "tree_id", "node_idx"]]

    shape = spark.range(n_trees).mapInPandas(grow, "node_type int, parent_idx int, depth int, branch int, tree_id long, node_idx int")
    act, ask = random_action(F.col("branch"), "tree_id", "node_idx", seed=seed), random_decision(catalog, "tree_id", "node_idx", seed=seed)
    root, leaf = F.col("node_type") == ROOT, F.col("node_type") == ACTION
    drawn = lambda p: F.when(root, F.col("branch") if p == "p1" else 0).when(leaf, act[p]).otherwise(ask[p]).cast("double").alias(p)
    return cut_lineage(shape.select(*COLUMNS[:5], *map(drawn, COLUMNS[5:])))


def with_paths(nodes: DataFrame, max_depth: int = 10) -> DataFrame:
    """nodes with their branch and the path of node indices from the root, level by level; computed once, as its users read it many times."""
    level = nodes.where("parent_idx = -1").select(*COLUMNS, F.col("p1").cast("int").alias("branch"), F.array("node_idx").alias("path"))
    levels = [level]
    for depth in range(1, max_depth):
        up = level.select(F.col("tree_id").alias("_t"), F.col("node_idx").alias("_i"), "branch", F.col("path").alias("_path"))
        below = nodes.where(F.col("depth") == depth)
        level = below.join(up, (F.col("tree_id") == F.col("_t")) & (F.col("parent_idx") == F.col("_i"))).select(*COLUMNS, "branch", F.concat("_path", F.array("node_idx")).alias("path"))
        levels.append(level)
    return cut_lineage(reduce(DataFrame.unionByName, levels).repartition("tree_id"))  # what groups by tree needs no further shuffle


def adjacency(nodes: DataFrame) -> DataFrame:
    """(tree_id, parent_idx, n_children, children): children in order of their index."""
    return nodes.where("parent_idx >= 0").groupBy("tree_id", "parent_idx").agg(F.count("*").alias("n_children"), F.sort_array(F.collect_list("node_idx")).alias("children"))


def child_overflow(nodes: DataFrame, limit: int) -> DataFrame:
    """(tree_id, most_children, overflow)."""
    counts = nodes.where("parent_idx >= 0").groupBy("tree_id", "parent_idx").count()
    return counts.groupBy("tree_id").agg(F.max("count").alias("most_children"), (F.max("count") > limit).alias("overflow"))


def validate(nodes: DataFrame, max_depth: int | None = None, max_children: int | None = None) -> DataFrame:
    """(tree_id, faults) for every tree: 0, or a sum of

    1 roots (three, one of each branch, depth 0); 2 a parent that is missing or not one level above; 4 a leaf
    that is no action, or an action with children; 8 actions and decisions under one parent; 16 an action that is
    not an only child; 32 an unknown type; 64 too deep; 128 too many children."""
    kids = nodes.where("parent_idx >= 0").groupBy(F.col("tree_id").alias("_t"), F.col("parent_idx").alias("_p")).agg(
        F.count("*").alias("n"), F.count_if(F.col("node_type") == ACTION).alias("acts"), F.count_if(F.col("node_type") == DECISION).alias("asks")
    )
    above = nodes.select(F.col("tree_id").alias("_ut"), F.col("node_idx").alias("_ui"), F.col("depth").alias("_ud"))
    met = nodes.join(kids, (F.col("tree_id") == F.col("_t")) & (F.col("node_idx") == F.col("_p")), "left").join(above, (F.col("tree_id") == F.col("_ut")) & (F.col("parent_idx") == F.col("_ui")), "left")
    n = F.coalesce("n", F.lit(0))
    root, action = F.col("node_type") == ROOT, F.col("node_type") == ACTION
    rules = [
        (1, root & ((F.col("parent_idx") != -1) | (F.col("depth") != 0) | ~F.col("p1").isin(0.0, 1.0, 2.0))),
        (2, ~root & (F.col("_ud").isNull() | (F.col("depth") != F.col("_ud") + 1))),
        (4, (action & (n > 0)) | (~action & (n == 0))),
        (8, F.coalesce((F.col("acts") > 0) & (F.col("asks") > 0), F.lit(False))),
        (16, F.coalesce((F.col("acts") > 0) & (n > 1), F.lit(False))),
        (32, ~F.col("node_type").isin(1, 2, 3)),
    ]
    if max_depth is not None:
        rules.append((64, F.col("depth") >= max_depth))
    if max_children is not None:
        rules.append((128, n > max_children))
    mask = reduce(Column.bitwiseOR, [F.when(rule, F.lit(bit)).otherwise(F.lit(0)) for bit, rule in rules])
    found = met.groupBy("tree_id").agg(F.bit_or(mask).alias("m"), F.count_if(root).alias("roots"), F.count_distinct(F.when(root, F.col("p1"))).alias("kinds"))
    return found.select("tree_id", F.col("m").bitwiseOR(F.when((F.col("roots") == 3) & (F.col("kinds") == 3), 0).otherwise(1)).alias("faults"))


def require_valid(nodes: DataFrame, **limits) -> None:
    bad = validate(nodes, **limits).where("faults <> 0").orderBy("tree_id").limit(10).collect()
    if bad:
        raise ValueError("invalid trees: " + ", ".join(f"{r.tree_id} (faults {r.faults})" for r in bad))


def compact(nodes: DataFrame) -> DataFrame:
    """nodes with indices 0.. without gaps in each tree; nodes whose parent is missing are dropped, with all below them."""
    reached = toured(written(nodes))
    new = reached.select("tree_id", F.col("node_idx").alias("old"), (F.row_number().over(Window.partitionBy("tree_id").orderBy("node_idx")) - 1).alias("new"))
    own = reached.select(COLUMNS).alias("n").join(new.alias("a"), F.expr("n.tree_id = a.tree_id AND n.node_idx = a.old"))
    met = own.join(new.alias("b"), F.expr("n.tree_id = b.tree_id AND n.parent_idx = b.old"), "left")
    return met.select("n.tree_id", F.col("a.new").alias("node_idx"), "n.node_type", F.coalesce("b.new", F.lit(-1)).alias("parent_idx"), "n.depth", "n.p1", "n.p2", "n.p3", "n.p4")


def subtree(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes below and at each top (tree_id, top), with top and how far below it they are."""
    tour = toured(written(nodes))
    met = tops.select("tree_id", "top").join(tour.select("tree_id", F.col("node_idx").alias("top"), F.col("enter").alias("top_enter"), F.col("leave").alias("top_leave"), F.col("level").alias("top_level")), ["tree_id", "top"])
    found = tour.join(met, "tree_id").where(inside())
    return found.select(*COLUMNS, "branch", "top", (F.col("level") - F.col("top_level")).cast("int").alias("below"))


def decision_holds(features: Column, p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Whether a decision is true of a feature array; unknown features and nulls make it false."""
    at = lambda p: F.get(features, p.cast("int"))
    compare = lambda a, b: F.when(p2 == 0, a >= b).otherwise(a <= b)
    return F.coalesce(F.when(p3 == 0, compare(at(p1), p4)).when(p3 == 1, compare(at(p1), at(p4))).when(p3 == 2, at(p1) == p4), F.lit(False))


def predict(nodes: DataFrame, bars: DataFrame, max_depth: int = 10) -> DataFrame:
    """(bar, tree_id, branch, action, ratio, leverage) for each bar (bar, features), tree and branch.

    Other columns of bars, such as a symbol, are part of what identifies a bar and come back with it.  All branches are answered at once, so that a simulator only has to pick one.  From the root on, true decisions are
    expanded level by level; the first action in breadth-first order is the one of least (depth, path).
    Branches that reach none give action 0."""
    roots = nodes.where(F.col("node_type") == ROOT).select("tree_id", F.col("p1").cast("int").alias("branch"), "node_idx")
    keys = [c for c in bars.columns if c != "features"]
    level = bars.join(roots, how="cross").select(*keys, "features", "tree_id", "branch", F.array("node_idx").alias("path"), F.col("node_idx").alias("at"))
    everyone, found = level.select(*keys, "tree_id", "branch"), []
    child = nodes.select(F.col("tree_id").alias("_t"), "node_idx", "node_type", F.col("parent_idx").alias("_p"), "p1", "p2", "p3", "p4")
    for _ in range(1, max_depth):
        met = level.join(child, (F.col("tree_id") == F.col("_t")) & (F.col("at") == F.col("_p"))).withColumn("path", F.concat("path", F.array("node_idx")))
        found.append(met.where(F.col("node_type") == ACTION).select(*keys, "tree_id", "branch", "path", "p1", "p2", "p3"))
        level = met.where((F.col("node_type") == DECISION) & decision_holds(F.col("features"), *map(F.col, ("p1", "p2", "p3", "p4")))).select(*keys, "features", "tree_id", "branch", "path", F.col("node_idx").alias("at"))
    none = everyone.select("*", F.lit(None).cast("array<int>").alias("path"), *[F.lit(None).cast("double").alias(p) for p in ("p1", "p2", "p3")])
    acts = reduce(DataFrame.unionByName, found, none)
    first = F.min_by(F.struct("p1", "p2", "p3"), F.when(F.col("path").isNotNull(), F.struct(F.size("path"), F.col("path"))))
    best = acts.groupBy(*keys, "tree_id", "branch").agg(first.alias("a"))
    return best.select(*keys, "tree_id", "branch", F.coalesce(F.col("a.p1").cast("int"), F.lit(0)).alias("action"), F.col("a.p2").alias("ratio"), F.col("a.p3").alias("leverage"))
