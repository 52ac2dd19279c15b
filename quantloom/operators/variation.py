"""Crossover and mutation of trees, as joins and projections over node tables.

All randomness hangs on (seed, operator, tree, node), never on partitions, so a lost task draws the same again.
Every operator takes and gives valid trees: what would break a rule leaves the tree as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage, written
from .segments import prefixed
from .tours import inside, nearest, toured
from .trees import ACTION, CLOSE_ALL, COLUMNS, DECISION, HOLD, LONG, ROOT, random_action, random_decision, uniform, with_paths

_P = ("p1", "p2", "p3", "p4")


def _parents(pairs: DataFrame, paths: DataFrame, which: str) -> DataFrame:
    """The nodes of one parent of each pair (child, first, second), by child."""
    return pairs.join(paths, F.col(which) == F.col("tree_id")).select(F.col("child"), *COLUMNS[1:], "branch", "path")


def _numbered(parts: DataFrame) -> DataFrame:
    """Nodes (child, part, node_idx, parent_part, parent_idx, ...) of several sources as trees numbered from 0, roots first."""
    new = parts.select("child", "part", "node_idx", (F.row_number().over(Window.partitionBy("child").orderBy(F.col("node_type") != ROOT, F.when(F.col("node_type") == ROOT, F.col("branch")), "part", "node_idx")) - 1).alias("new"))
    up = new.select(F.col("child").alias("_c"), F.col("part").alias("_part"), F.col("node_idx").alias("_i"), F.col("new").alias("_up"))
    met = parts.join(new, ["child", "part", "node_idx"]).join(up, F.expr("child = _c AND parent_part = _part AND parent_idx = _i"), "left")
    return met.select(F.col("child").alias("tree_id"), F.col("new").alias("node_idx"), "node_type", F.coalesce("_up", F.lit(-1)).alias("parent_idx"), "depth", *_P)


def root_branch_crossover(pairs: DataFrame, nodes: DataFrame, seed: int, max_depth: int = 10, first_donor: Column | None = None) -> DataFrame:
    """Children that take each of their branches, whole, from one of their two parents.

    first_donor: when the first gives (over child and branch); by default, half of the time."""
    paths = with_paths(nodes, max_depth)
    both = _parents(pairs, paths, "first").withColumn("part", F.lit(1)).unionByName(_parents(pairs, paths, "second").withColumn("part", F.lit(2)))
    chosen = uniform(seed, F.lit("branch"), "child", "branch") < 0.5 if first_donor is None else first_donor
    donor = F.when(chosen, 1).otherwise(2)
    return _numbered(both.where(F.col("part") == donor).withColumn("part", F.col("branch")).withColumn("parent_part", F.col("branch")))


def _place(free: bool) -> Column:
    """What two nodes must share to be exchanged: the branch, or, freely, only what actions it allows."""
    return F.when(F.col("branch") == HOLD, HOLD).otherwise(LONG) if free else F.col("branch")


def node_crossover(pairs: DataFrame, nodes: DataFrame, seed: int, max_depth: int = 10, free: bool = False) -> DataFrame:
    """Children like their first parent, with the parameters of some nodes taken from nodes of the same type and branch of the second.

    free: of any branch that allows the same actions.  At most half of the nodes of a kind are paired, at least one."""
    paths = with_paths(nodes, max_depth)
    kind = ["child", "node_type", "place"]

    def ranked(df: DataFrame, salt: str) -> DataFrame:
        df = df.withColumn("place", _place(free))
        order = Window.partitionBy(*kind).orderBy(uniform(seed, F.lit(salt), "child", "node_idx"))
        return df.where(F.col("node_type") != ROOT).withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*kind)))

    own, other = ranked(_parents(pairs, paths, "first"), "own"), ranked(_parents(pairs, paths, "second"), "other")
    met = own.alias("a").join(other.select(*kind, "rank", "n", *_P).alias("b"), [*kind, "rank"]).where(F.col("rank") <= F.greatest(F.lit(1), F.least("a.n", "b.n") / 2))
    swapped = met.select(F.col("child").alias("_c"), F.col("node_idx").alias("_i"), *[F.col(f"b.{p}").alias(f"_{p}") for p in _P])
    child = _parents(pairs, paths, "first").join(swapped, F.expr("child = _c AND node_idx = _i"), "left")
    return child.select(F.col("child").alias("tree_id"), "node_idx", "node_type", "parent_idx", "depth", *[F.when(F.col("_c").isNotNull(), F.col(f"_{p}")).otherwise(F.col(p)).alias(p) for p in _P])


def subtree_crossover(pairs: DataFrame, nodes: DataFrame, seed: int, max_depth: int = 10, max_nodes: int = 256, free: bool = False) -> DataFrame:
    """Children like their first parent, with one subtree replaced by one of the second parent's.

    Both subtrees have roots of the same type and branch, so siblings stay alike (free: of any branch that allows the same
    actions).  Candidates are paired at random; one of those that keep depth and size limits is taken; without one the
    child is a copy of the first parent."""
    paths = with_paths(nodes, max_depth)
    span = paths.select("tree_id", F.explode("path").alias("top"), F.col("depth").alias("d")).groupBy("tree_id", "top").agg(F.max("d").alias("deepest"), F.count("*").alias("size"))
    sized = paths.join(span.withColumnRenamed("top", "node_idx"), ["tree_id", "node_idx"])
    total = nodes.groupBy("tree_id").agg(F.count("*").alias("total"))

    def candidates(which: str, salt: str) -> DataFrame:
        rows = pairs.join(sized, F.col(which) == F.col("tree_id")).where(F.col("node_type") != ROOT)
        rows = rows.withColumn("place", _place(free))
        order = Window.partitionBy("child", "node_type", "place").orderBy(uniform(seed, F.lit(salt), "child", "node_idx"))
        return rows.withColumn("rank", F.row_number().over(order)).select("child", "first", "node_type", "place", "rank", "node_idx", "parent_idx", "depth", "deepest", "size")

    a, b = candidates("first", "a").alias("a"), candidates("second", "b").alias("b")
    fits = (F.col("a.depth") + F.col("b.deepest") - F.col("b.depth") < max_depth) & (F.col("total") - F.col("a.size") + F.col("b.size") <= max_nodes)
    met = a.join(b, ["child", "node_type", "place", "rank"]).join(total, F.col("a.first") == F.col("tree_id")).where(fits)
    chosen = F.min_by(F.struct(F.col("a.node_idx").alias("at"), F.col("a.parent_idx").alias("under"), F.col("b.node_idx").alias("from"), (F.col("a.depth") - F.col("b.depth")).alias("shift")), uniform(seed, F.lit("pick"), "child", "node_type", "place", "rank"))
    cut = met.groupBy("child").agg(chosen.alias("x")).select(F.col("child").alias("_c"), "x.*")
    own = _parents(pairs, paths, "first").join(cut, F.col("child") == F.col("_c"), "left").where("at IS NULL OR NOT array_contains(path, at)")
    own = own.select("child", *COLUMNS[1:], "branch", F.lit(1).alias("part"), F.lit(1).alias("parent_part"))
    new = _parents(pairs, paths, "second").join(cut, F.col("child") == F.col("_c")).where("array_contains(path, `from`)")
    top = F.col("node_idx") == F.col("from")
    moved = new.withColumn("parent_part", F.when(top, 1).otherwise(2)).withColumn("parent_idx", F.when(top, F.col("under")).otherwise(F.col("parent_idx"))).withColumn("depth", F.col("depth") + F.col("shift"))
    return _numbered(own.unionByName(moved.select("child", *COLUMNS[1:], "branch", F.lit(2).alias("part"), "parent_part")))


def crossover_chain(pairs: DataFrame, nodes: DataFrame, seed: int, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), rate: float = 0.8, max_depth: int = 10, max_nodes: int = 256) -> DataFrame:
    """Pairs dealt over subtree, node and root-branch crossover; without crossover a child copies a parent.

    Of k crossed pairs, in random order, the first int(w * k) go to the first crossover, the next to the second, and the rest
    to the last, each by its weight w.  The children come in random order."""
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("the weights of the crossovers must sum to 1")
    crossed = uniform(seed, F.lit("rate"), "child") < rate
    dealt = cut_lineage(prefixed(pairs.where(crossed).withColumn("_u", uniform(seed, F.lit("chain"), "child")), ["_u", "child"]))
    k = dealt.count()
    one = math.floor(weights[0] * k)
    two = one + math.floor(weights[1] * k)
    ends = (0, one, two, k)
    share = lambda to: dealt.where((F.col("_rank") >= ends[to]) & (F.col("_rank") < ends[to + 1])).select(pairs.columns)
    copies = pairs.where(~crossed).withColumn("from", F.when(uniform(seed, F.lit("copy"), "child") < 0.5, F.col("first")).otherwise(F.col("second")))
    copied = copies.join(nodes, F.col("from") == F.col("tree_id")).select(F.col("child").alias("tree_id"), *COLUMNS[1:])
    made = [
        subtree_crossover(share(0), nodes, seed, max_depth, max_nodes),
        node_crossover(share(1), nodes, seed, max_depth),
        root_branch_crossover(share(2), nodes, seed, max_depth),
    ]
    return permuted(reduce(DataFrame.unionByName, made, copied), seed)


def permuted(nodes: DataFrame, seed: int) -> DataFrame:
    """The trees in random order, numbered from 0, so that what made a child no longer shows in its number."""
    ids = nodes.select("tree_id").distinct().withColumn("_u", uniform(seed, F.lit("order"), "tree_id"))
    new = prefixed(ids, ["_u", "tree_id"]).select(F.col("tree_id").alias("_old"), F.col("_rank").alias("_new"))
    return nodes.join(new, F.col("tree_id") == F.col("_old")).withColumn("tree_id", F.col("_new")).select(nodes.columns)


def _gate(seed: int, name: str, rate: float, *key: str) -> Column:
    return uniform(seed, F.lit(name), *key) < rate


def _clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, float) else low, F.least(F.lit(high) if isinstance(high, float) else high, x))


def mutate_parameters(nodes: DataFrame, catalog: list[tuple], seed: int, rate: float = 0.1, noise: float = 0.1, leverage_step: float = 5.0) -> DataFrame:
    """Some nodes' values move: thresholds and ratios by noise, leverages by steps, operators and booleans anew."""
    bounds = {float(i): (float(lo), float(hi)) for i, f, lo, hi in catalog if f == "num"}
    side = lambda k: F.create_map(*[F.lit(x) for i, b in bounds.items() for x in (i, b[k])]) if bounds else F.create_map().cast("map<double,double>")
    lo, hi = (F.coalesce(F.try_element_at(side(k), F.col("p1")), F.col("p4")) for k in (0, 1))
    u = lambda name: uniform(seed, F.lit(name), "tree_id", "node_idx")
    around = 2 * u("amount") - 1
    hit = _gate(seed, "parameter", rate, "tree_id", "node_idx")
    ask, act = hit & (F.col("node_type") == DECISION), hit & (F.col("node_type") == ACTION)
    sized, levered = F.col("p1").isin(1.0, 2.0, 4.0, 5.0, 6.0), F.col("p1").isin(1.0, 2.0, 5.0, 6.0)
    return nodes.select(
        *COLUMNS[:6],
        F.when(ask & (F.col("p3") != 2), F.floor(2 * u("op")).cast("double")).when(act & sized, _clamp(F.col("p2") + noise * around, 0.0, 1.0)).otherwise(F.col("p2")).alias("p2"),
        F.when(act & levered, _clamp(F.col("p3") + F.round(leverage_step * around), 1.0, 100.0)).otherwise(F.col("p3")).alias("p3"),
        F.when(ask & (F.col("p3") == 0), _clamp(F.col("p4") + (hi - lo) * noise * around, lo, hi)).when(ask & (F.col("p3") == 2), F.floor(2 * u("bool")).cast("double")).otherwise(F.col("p4")).alias("p4"),
    )


def reinitialize_nodes(nodes: DataFrame, catalog: list[tuple], seed: int, rate: float = 0.05, max_depth: int = 10) -> DataFrame:
    """Some decisions and actions are drawn anew, actions as their branch allows."""
    hit = _gate(seed, "renew", rate, "tree_id", "node_idx") & (F.col("node_type") != ROOT)
    act, ask = random_action(F.col("branch"), "tree_id", "node_idx", seed=seed), random_decision(catalog, "tree_id", "node_idx", seed=seed)
    return with_paths(nodes, max_depth).select(*COLUMNS[:5], *[F.when(hit & (F.col("node_type") == ACTION), act[p]).when(hit, ask[p]).otherwise(F.col(p)).alias(p) for p in _P])


def _picked(rows: DataFrame, seed: int, name: str, rate: float | Column, weight: Column) -> DataFrame:
    """One row for each tree that the rate, or a condition, hits, drawn by weight: the least exponential key of its candidates."""
    key = -F.log(1 - uniform(seed, F.lit(name), "tree_id", "node_idx")) / weight
    chosen = rows.where(rate if isinstance(rate, Column) else _gate(seed, name, rate, "tree_id")).groupBy("tree_id").agg(F.min_by(F.struct("node_idx", "parent_idx", "depth", "branch"), key).alias("x"))
    return chosen.select(F.col("tree_id").alias("_t"), F.col("x.node_idx").alias("at"), F.col("x.parent_idx").alias("under"), F.col("x.depth").alias("level"), F.col("x.branch").alias("side"))


def _spans(paths: DataFrame) -> DataFrame:
    below = paths.select("tree_id", F.explode("path").alias("node_idx"), F.col("depth").alias("d")).groupBy("tree_id", "node_idx").agg(F.max("d").alias("deepest"), F.count("*").alias("size"))
    kids = paths.where("parent_idx >= 0").groupBy("tree_id", F.col("parent_idx").alias("node_idx")).agg(F.count("*").alias("kids"), F.count_if(F.col("node_type") == ACTION).alias("acts"))
    own = paths.join(below, ["tree_id", "node_idx"]).join(kids, ["tree_id", "node_idx"], "left")
    up = kids.select(F.col("tree_id"), F.col("node_idx").alias("parent_idx"), F.col("kids").alias("siblings"))
    total = paths.groupBy("tree_id").agg(F.count("*").alias("total"), F.max("node_idx").alias("last"))
    return own.join(up, ["tree_id", "parent_idx"], "left").join(total, "tree_id")


def repeated(nodes: DataFrame, once: Callable[[DataFrame, int, float | Column], DataFrame], seed: int, name: str, rate: float, most: int) -> DataFrame:
    """once(nodes, seed, which trees) from 1 to most times, as each tree draws, on the trees that the rate hits."""
    if most == 1:
        return once(nodes, seed, rate)
    times = 1 + F.floor(most * uniform(seed, F.lit(f"{name} times"), "tree_id"))
    for k in range(most):
        nodes = written(once(nodes, seed + 7_368_787 * k, _gate(seed, name, rate, "tree_id") & (times > k)))
    return nodes


def add_node(nodes: DataFrame, catalog: list[tuple], seed: int, rate: float | Column = 0.2, max_depth: int = 10, max_nodes: int = 256) -> DataFrame:
    """A new decision on one edge of some trees, rather high up; what hangs below moves one level down."""
    paths = with_paths(nodes, max_depth)
    room = _spans(paths).where((F.col("parent_idx") >= 0) & (F.col("deepest") + 1 < max_depth) & (F.col("total") < max_nodes))
    cut = _picked(room, seed, "add_node", rate, 1 / F.col("depth").cast("double"))
    last = nodes.groupBy("tree_id").agg(F.max("node_idx").alias("last"))
    ask = random_decision(catalog, "_t", "at", seed=seed)
    met = paths.join(cut, F.col("tree_id") == F.col("_t"), "left").join(last, "tree_id")
    inside = F.coalesce(F.expr("array_contains(path, at)"), F.lit(False))
    old = met.select("tree_id", "node_idx", "node_type", F.when(F.col("node_idx") == F.col("at"), F.col("last") + 1).otherwise(F.col("parent_idx")).alias("parent_idx"), (F.col("depth") + inside.cast("int")).alias("depth"), *_P)
    new = cut.join(last, F.col("_t") == F.col("tree_id")).select("tree_id", (F.col("last") + 1).alias("node_idx"), F.lit(DECISION).alias("node_type"), F.col("under").alias("parent_idx"), F.col("level").alias("depth"), *[ask[p].alias(p) for p in _P])
    return old.unionByName(new)


def delete_node(nodes: DataFrame, seed: int, rate: float | Column = 0.2, max_depth: int = 10, max_children: int = 30) -> DataFrame:
    """One decision of some trees goes, and its children move up to its parent.

    A decision above an action goes only if it has no siblings, as an action is an only child."""
    paths = with_paths(nodes, max_depth)
    alone = (F.col("acts") == 0) | (F.col("siblings") == 1)
    room = _spans(paths).where((F.col("node_type") == DECISION) & alone & (F.col("siblings") - 1 + F.col("kids") <= max_children))
    cut = _picked(room, seed, "delete_node", rate, F.col("kids") + 1e-6)
    met = paths.join(cut, F.col("tree_id") == F.col("_t"), "left").where("at IS NULL OR node_idx <> at")
    below = F.coalesce(F.expr("array_contains(path, at)"), F.lit(False))
    return met.select("tree_id", "node_idx", "node_type", F.when(F.col("parent_idx") == F.col("at"), F.col("under")).otherwise(F.col("parent_idx")).alias("parent_idx"), (F.col("depth") - below.cast("int")).alias("depth"), *_P)


def add_subtree(nodes: DataFrame, catalog: list[tuple], seed: int, rate: float = 0.2, most: int = 3, max_depth: int = 10, max_children: int = 30, max_nodes: int = 256, least: int = 1) -> DataFrame:
    """A subtree of least to most decisions under one node of some trees that has decisions below.

    A new decision hangs below that node or a new one before it, as drawn, where depth allows it and else below that
    node; new decisions without others below end in an action.  Only nodes and trees with room for the largest are chosen."""
    paths = with_paths(nodes, max_depth)
    room = _spans(paths).where((F.col("kids") > 0) & (F.col("acts") == 0) & (F.col("kids") + most <= max_children) & (F.col("depth") + 2 < max_depth) & (F.col("total") + 2 * most <= max_nodes))
    cut = _picked(room, seed, "add_subtree", rate, (max_children - F.col("kids")) / (F.col("depth") + 1.0))
    last = nodes.groupBy("tree_id").agg(F.max("node_idx").alias("last"))

    def grow(made: Column, k: Column) -> Column:
        drawn = F.floor(uniform(seed, F.lit("under"), "_t", k) * k).cast("int")
        above = F.try_element_at(made, F.greatest(drawn, F.lit(1)))["level"]
        nested = (drawn > 0) & (above + 2 < max_depth)
        one = F.struct(F.when(nested, drawn).otherwise(0).alias("up"), (F.when(nested, above).otherwise(F.col("level")) + 1).alias("level"))
        return F.concat(made, F.array(one))

    numbers = F.sequence(F.lit(1), F.floor(least + (most - least + 1) * uniform(seed, F.lit("length"), "_t")).cast("int"))
    grown = cut.join(last, F.col("_t") == F.col("tree_id")).withColumn("made", F.aggregate(numbers, F.array().cast("array<struct<up:int,level:int>>"), grow))
    places = F.sequence(F.lit(1), F.size("made"))
    ends = F.filter(places, lambda k: ~F.exists(F.col("made"), lambda one: one["up"] == k))
    ask, act = random_decision(catalog, "_t", "k", seed=seed), random_action(F.col("side"), "_t", "k", seed=seed)
    asks = grown.withColumn("k", F.explode(places)).withColumn("one", F.element_at("made", F.col("k"))).select(
        "tree_id", (F.col("last") + F.col("k")).alias("node_idx"), F.lit(DECISION).alias("node_type"), F.when(F.col("one.up") == 0, F.col("at")).otherwise(F.col("last") + F.col("one.up")).alias("parent_idx"),
        F.col("one.level").alias("depth"), *[ask[p].alias(p) for p in _P],
    )
    acts = grown.select("*", F.posexplode(ends).alias("nth", "k")).select(
        "tree_id", (F.col("last") + F.size("made") + F.col("nth") + 1).alias("node_idx"), F.lit(ACTION).alias("node_type"), (F.col("last") + F.col("k")).alias("parent_idx"),
        (F.element_at("made", F.col("k"))["level"] + 1).alias("depth"), *[act[p].alias(p) for p in _P],
    )
    return nodes.select(COLUMNS).unionByName(asks).unionByName(acts)


def delete_subtree(nodes: DataFrame, seed: int, rate: float = 0.2, alpha: float = 1.0) -> DataFrame:
    """One subtree of some trees goes, rather a large one, with the decisions above it that would be left without children.

    So what is cut hangs at the nearest node above it, or is it itself, that has siblings; a subtree without such a node, the
    only thing below its root, stays."""
    tour = written(toured(written(nodes)))  # a tour reads its nodes six times
    siblings = tour.groupBy("tree_id", "parent_idx").agg(F.count("*").alias("siblings"))
    below = written(tour.where(F.col("node_type") != ROOT).join(siblings, ["tree_id", "parent_idx"]))
    lifted = nearest(below, "siblings > 1").where("top IS NOT NULL")
    size = F.floor((F.col("leave") - F.col("enter") + 1) / 2).cast("double")
    chosen = _picked(below.join(lifted, ["tree_id", "node_idx"]), seed, "delete_subtree", rate, F.pow(size, F.lit(alpha)))
    ends = tour.select("tree_id", F.col("node_idx").alias("top"), F.col("enter").alias("top_enter"), F.col("leave").alias("top_leave"))
    cut = chosen.join(lifted, F.expr("_t = tree_id AND at = node_idx")).select("tree_id", "top").join(ends, ["tree_id", "top"]).drop("top")
    return tour.join(cut, "tree_id", "left").where(f"top_enter IS NULL OR NOT ({inside()})").select(COLUMNS)


def repair_roots(nodes: DataFrame) -> DataFrame:
    """Roots without children get one action that closes everything."""
    used = nodes.select(F.col("tree_id").alias("_t"), F.col("parent_idx").alias("_p")).distinct()
    bare = nodes.where(F.col("node_type") == ROOT).join(used, F.expr("tree_id = _t AND node_idx = _p"), "left_anti")
    last = nodes.groupBy("tree_id").agg(F.max("node_idx").alias("last"))
    place = F.col("last") + F.row_number().over(Window.partitionBy("tree_id").orderBy("node_idx"))
    new = bare.join(last, "tree_id").select("tree_id", place.cast("int").alias("node_idx"), F.lit(ACTION).alias("node_type"), F.col("node_idx").alias("parent_idx"), F.lit(1).alias("depth"), F.lit(float(CLOSE_ALL)).alias("p1"), *[F.lit(0.0).alias(p) for p in _P[1:]])
    return nodes.select(COLUMNS).unionByName(new)
