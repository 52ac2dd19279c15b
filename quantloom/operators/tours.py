"""Euler tours of trees: every node's interval, so that a subtree is a range and not a list of ancestors.

A tour enters and leaves every node.  As a linked list - enter leads to the first child's enter or to leaving, leave to the
next sibling's enter or to leaving the parent - it is ranked by pointer doubling: in each round every element jumps to its
successor's successor, so a list of m elements takes about log2(m) rounds, however deep the tree is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

INTERVAL = ["enter", "leave", "level", "branch"]


def toured(nodes: DataFrame) -> DataFrame:
    """The nodes that some root reaches, with enter, leave, level (0 for roots) and branch (p1 of their root).

    A node's subtree are the nodes of its tree whose enter lies from its enter to its leave; enters rise in depth-first
    order, roots and siblings by index.  Nodes whose parent is missing, and all below them, and nodes on cycles are left
    out.  Joins are by tree and place, so one large tree spreads over tasks as many small ones do."""
    order = Window.partitionBy("tree_id", "parent_idx").orderBy("node_idx")
    kids = nodes.where("parent_idx >= 0").groupBy("tree_id", F.col("parent_idx").alias("node_idx")).agg(F.min("node_idx").alias("child"))
    there = nodes.select("tree_id", F.col("node_idx").alias("parent_idx"), F.lit(True).alias("there"))
    own = nodes.select("tree_id", "node_idx", "parent_idx", F.lead("node_idx").over(order).alias("sibling"))
    own = own.join(kids, ["tree_id", "node_idx"], "left").join(there, ["tree_id", "parent_idx"], "left")
    enter, leave = 2 * F.col("node_idx").cast("long"), 2 * F.col("node_idx").cast("long") + 1
    enters = own.select("tree_id", enter.alias("at"), F.coalesce(2 * F.col("child").cast("long"), leave).alias("to"), F.lit(1).alias("up"), (F.col("parent_idx") < 0).cast("int").alias("roots"))
    behind = F.coalesce(2 * F.col("sibling").cast("long"), F.when(F.col("there"), 2 * F.col("parent_idx").cast("long") + 1))
    leaves = own.select("tree_id", leave.alias("at"), behind.alias("to"), F.lit(-1).alias("up"), F.lit(0).alias("roots"))
    # steps, up, roots: what lies from an element (with it) up to the one that it points to (without); end: the last element so far
    tour = enters.unionByName(leaves).withColumn("steps", F.lit(1).cast("long")).withColumn("end", F.col("at"))
    tour = written(tour)
    most = tour.groupBy("tree_id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    for _ in range(math.ceil(math.log2(max(2, most)))):
        if not tour.where("to IS NOT NULL").limit(1).count():
            break
        ahead = tour.select("tree_id", F.col("at").alias("to"), *[F.col(c).alias(f"_{c}") for c in ("to", "up", "roots", "steps", "end")])
        met = tour.join(ahead, ["tree_id", "to"], "left")
        more = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("up", "roots", "steps")}
        tour = written(met.select("tree_id", "at", F.col("_to").alias("to"), *[x.alias(c) for c, x in more.items()], F.coalesce("_end", "end").alias("end")))
    done = tour.where("to IS NULL")
    roots = nodes.where("parent_idx < 0").select("tree_id", "node_idx", F.col("p1").cast("int").alias("branch"))
    last = roots.groupBy("tree_id").agg((2 * F.max("node_idx").cast("long") + 1).alias("end"), F.count("*").alias("n_roots"))
    reached = done.join(last, ["tree_id", "end"])  # lists of nodes without a root end elsewhere
    length = reached.groupBy("tree_id").agg(F.max("steps").alias("length"))
    half = lambda side: reached.where(F.col("at") % 2 == side).withColumn("node_idx", F.floor(F.col("at") / 2).cast("int"))
    into = half(0).join(length, "tree_id").select("tree_id", "node_idx", (F.col("length") - F.col("steps")).alias("enter"), (-F.col("up")).alias("level"))
    out = half(1).join(length, "tree_id").select("tree_id", "node_idx", (F.col("length") - F.col("steps")).alias("leave"), (F.col("n_roots") - F.col("roots")).alias("nth"))
    numbered = roots.withColumn("nth", F.row_number().over(Window.partitionBy("tree_id").orderBy("node_idx")).cast("long")).drop("node_idx")
    return nodes.join(into, ["tree_id", "node_idx"]).join(out, ["tree_id", "node_idx"]).join(numbered, ["tree_id", "nth"]).select(*[F.col(c) for c in nodes.columns], *INTERVAL)


def inside(top: str = "top") -> str:
    """SQL: whether a row's node lies in the subtree of the node whose columns are {top}_enter and {top}_leave; null without one."""
    return f"enter BETWEEN {top}_enter AND {top}_leave"


def nearest(nodes: DataFrame, stop: str) -> DataFrame:
    """(tree_id, node_idx, top): the nearest node above, or the node itself, of which stop is true; null if there is none among nodes.

    Nodes jump to where the node that they point to points, until all point to a stop or to nothing."""
    now = written(nodes.select("tree_id", "node_idx", F.when(F.expr(stop), F.col("node_idx")).otherwise(F.col("parent_idx")).alias("top"), F.expr(stop).alias("done")))
    while now.where("NOT done").limit(1).count():
        ahead = now.select("tree_id", F.col("node_idx").alias("top"), F.col("top").alias("_top"), F.col("done").alias("_done"))
        met = now.join(ahead, ["tree_id", "top"], "left")
        now = written(met.select("tree_id", "node_idx", F.col("_top").alias("top"), F.coalesce("_done", F.lit(True)).alias("done")))
    return now.drop("done")
