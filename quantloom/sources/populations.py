"""Populations as tables, together with the features that their nodes number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trees import COLUMNS, NODE


def save_population(nodes: DataFrame, catalog: DataFrame, path: str) -> None:
    """Writes the nodes and the catalogue (feature, family, low, high, idx) that p1 and p4 refer to."""
    catalog.select("feature", "family", "low", "high", "idx").write.mode("overwrite").parquet(f"{path}/catalog")
    nodes.select(COLUMNS).write.mode("overwrite").parquet(f"{path}/nodes")


def load_population(spark: SparkSession, path: str, catalog: DataFrame | None = None, trees: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and catalogue; trees: only those.

    Given a catalogue, nodes are renumbered to it by feature name; a feature that it lacks and a node needs is an error."""
    nodes, own = spark.read.schema(NODE).parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/catalog")
    if trees is not None:
        nodes = nodes.where(F.col("tree_id").isin(trees))
    if catalog is None:
        return nodes, own
    new = catalog.select("feature", F.col("idx").alias("new"))
    moved = F.broadcast(own.join(new, "feature", "left").select(F.col("idx").cast("double").alias("old"), F.col("new").cast("double"), "feature"))  # a catalogue has some hundreds of rows
    asks, pairs = F.col("node_type") == 2, (F.col("node_type") == 2) & (F.col("p3") == 1)
    a, b = moved.select(F.col("old").alias("a"), F.col("new").alias("a_new")), moved.select(F.col("old").alias("b"), F.col("new").alias("b_new"))
    met = nodes.join(a, asks & (F.col("p1") == F.col("a")), "left").join(b, pairs & (F.col("p4") == F.col("b")), "left")
    lost = met.where((asks & F.col("a_new").isNull()) | (pairs & F.col("b_new").isNull())).limit(1).count()
    if lost:
        raise ValueError("the catalogue lacks features that the population asks for")
    return met.withColumn("p1", F.when(asks, F.col("a_new")).otherwise(F.col("p1"))).withColumn("p4", F.when(pairs, F.col("b_new")).otherwise(F.col("p4"))).select(COLUMNS), catalog
