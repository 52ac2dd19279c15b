"""Choosing trees by fitness: elites, roulette, tournament, the pool of the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from .bars import as_of
from .segments import prefixed
from .trees import uniform


def elites(fitness: DataFrame, n: int) -> DataFrame:
    """The n fittest trees; of equally fit ones the smaller ids."""
    return fitness.orderBy(F.desc("fitness"), "tree_id").limit(n)


def draws(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(draw, u): n random numbers, the same for the same seed."""
    return spark.range(n).select(F.col("id").alias("draw"), uniform(seed, "id").alias("u"))


def roulette(fitness: DataFrame, drawn: DataFrame, segments: int | None = None) -> DataFrame:
    """(draw, tree_id): with replacement, in proportion to fitness shifted above 0; uniform if all are 0.

    Each tree has its range of the summed weights, by two-level prefix sums over tree ids; a draw's number meets the last
    range that starts at or before it.  Draws and trees are dealt by ranges of these numbers, so a heavy tree takes no more
    room than a light one.  Trees of no weight, or of unknown fitness, have no range."""
    known = fitness.where("fitness IS NOT NULL")
    least = known.agg(F.least(F.min("fitness"), F.lit(0.0)).alias("_least"))
    shifted = known.join(F.broadcast(least), how="cross").select("tree_id", (F.col("fitness") - F.col("_least")).alias("w"), F.lit(1.0).alias("one"))
    upto = cut_lineage(prefixed(shifted, ["tree_id"], {"weight": "w", "number": "one"}, segments))
    total = upto.agg(F.coalesce(F.max("weight.upto"), F.lit(0.0)).alias("all"), F.count("*").alias("n"))
    whole, n = total.first()
    by = "weight" if whole > 0 else "number"
    ranges = upto.where(F.col(f"{by}.upto") > F.col(f"{by}.before")).select(F.lit(0).alias("wheel"), F.col(f"{by}.before").alias("lo"), "tree_id")
    placed = drawn.select(F.lit(0).alias("wheel"), "draw", (F.col("u") * float(whole if whole > 0 else n)).alias("x"))
    return as_of(placed, ranges, "x", "lo", "wheel", segments).where("tree_id IS NOT NULL").select("draw", "tree_id")


def tournament(fitness: DataFrame, entries: DataFrame, segments: int | None = None) -> DataFrame:
    """(draw, tree_id): the fittest of the trees that a draw's entries (draw, entry, u) pick; the earlier entry of equals."""
    ranked = prefixed(fitness, ["tree_id"], segments=segments).select("tree_id", "fitness", F.col("_rank").alias("rank"))
    n = fitness.count()
    met = entries.withColumn("rank", F.floor(F.col("u") * n).cast("long")).join(ranked, "rank")
    return met.groupBy("draw").agg(F.max_by("tree_id", F.struct("fitness", -F.col("entry"))).alias("tree_id"))


def best_pool(pool: DataFrame, new: DataFrame, n: int, min_compound: float = 6.0, max_drawdown: float = 0.6) -> DataFrame:
    """pool and those new trees (tree_id, fitness, compound_value, max_drawdown) that qualify, the n fittest."""
    fit = new.where((F.col("compound_value") > min_compound) & (F.col("max_drawdown") < max_drawdown))
    return pool.unionByName(fit.select(pool.columns)).orderBy(F.desc("fitness"), "tree_id").limit(n)


def next_generation(nodes: DataFrame, elite_ids: DataFrame, offspring: DataFrame) -> DataFrame:
    """Nodes of the elites, renumbered from 0 in order of fitness, and of the offspring after them."""
    first = prefixed(elite_ids.select("tree_id", (-F.col("fitness")).alias("_worse")), ["_worse", "tree_id"])
    first = first.select(F.col("tree_id").alias("_old"), F.col("_rank").alias("_new"))
    after = prefixed(offspring.select("tree_id").distinct(), ["tree_id"]).select(F.col("tree_id").alias("_old"), (F.col("_rank") + first.count()).alias("_new"))
    new = lambda df, ids: df.join(ids, F.col("tree_id") == F.col("_old")).withColumn("tree_id", F.col("_new")).select(nodes.columns)
    return new(nodes, first).unionByName(new(offspring, after))
