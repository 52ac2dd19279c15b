"""The two jobs: preprocessing raw market data to features, and searching trees over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import trees
from ..operators.segments import numbered
from ..sources.populations import load_population, save_population
from . import config as C
from . import evolution, pipeline


def _written(spark: SparkSession, path: str) -> bool:
    return evolution._exists(spark, f"{path}/_SUCCESS")


def preprocess(spark: SparkSession, bars: DataFrame, config: dict, features: pipeline.Config, path: str, funding: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(features by symbol and ts, with the prices of their bars; their catalogue), written under path unless they are there.

    config: feature_classification may hold rules of its own.  features: see feature_table."""
    if not (_written(spark, f"{path}/features") and _written(spark, f"{path}/catalog")):
        rules = C.classification_rules(config["feature_classification"]) if config.get("feature_classification") else registry.RULES
        names = spark.createDataFrame([(n,) for n in pipeline.feature_names(features)], "feature string")
        classes = registry.classify(names, rules)
        classes.join(registry.feature_order(classes).select("feature", "idx"), "feature").write.mode("overwrite").parquet(f"{path}/catalog")
        base = pipeline.base_interval(list(features))
        priced = pipeline.resample(bars, base)
        if funding is not None:
            priced = pipeline.with_funding(priced, funding)
        prices = priced.select("symbol", "ts", *[F.col(c).alias(f"bar_{c}") for c in ("open", "high", "low", "funding_rate") if c in priced.columns])
        table = pipeline.feature_table(bars, features).join(prices, ["symbol", "ts"])
        table.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").parquet(f"{path}/features")
    return spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/catalog")


def numbered_bars(table: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((symbol, bar, features), (symbol, bar, ts, open, high, low[, funding_rate])) of preprocessed features."""
    order = [r.feature for r in catalog.orderBy("idx").collect()]  # some hundreds of names
    rows = numbered(table)
    prices = [F.col(c).alias(c.removeprefix("bar_")) for c in table.columns if c.startswith("bar_")]
    arrays = rows.select("symbol", "bar", F.array(*[pipeline.col(n).cast("double") for n in order]).alias("features"))
    return arrays, rows.select("symbol", "bar", "ts", *prices)


def train(spark: SparkSession, config: dict, table: DataFrame, catalog: DataFrame, path: str, generations: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes of the best trees of all generations, their metrics on the bars kept out of training).

    Generations go on where an earlier call under path stopped; the best are written to path/best with their catalogue."""
    listed = [(r.idx, r.family, r.low, r.high) for r in catalog.orderBy("idx").collect()]
    search = C.search(config, listed)
    arrays, bars = numbered_bars(table, catalog)
    ratio = (config.get("data") or {}).get("train_ratio", 0.8)
    (seen, unseen), (bars_seen, bars_unseen) = evolution.split(arrays, ratio), evolution.split(bars, ratio)
    first = trees.weighted_population(spark, search.population, listed, search.max_depth, search.max_children, search.max_nodes, search.seed)
    loop = (config.get("ga_core") or {}).get("evolution_loop") or {}
    evolution.evolve(spark, first, seen, bars_seen, search, generations if generations is not None else loop.get("generations", 1), f"{path}/search")
    save_population(evolution.best_trees(spark, f"{path}/search"), catalog, f"{path}/best")
    best, _ = load_population(spark, f"{path}/best")
    return best, evolution.evaluate(best, unseen, bars_unseen, search)
