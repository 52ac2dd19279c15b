"""The engine's queries: one for each operator, over the tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import registry
from .functions.features import apply, col
from .operators import packed, selection, simulator, trees, variation
from .operators.bars import align, as_of, resample, ticks_to_bars
from .plans import evolution, pipeline
from .sources import market
from .sources.populations import load_population, save_population
from .sources.storage import shared_folder
from .streaming.bars import streamed_bars

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(spark: SparkSession, sf_dir: str, interval: str = "30m") -> DataFrame:
    return ticks_to_bars(market.event_ticks(_read(spark, sf_dir, "events")), interval)


def _shown(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """symbol, ts as text, and rounded columns."""
    kinds = dict(df.dtypes)
    return df.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *[(F.round(col(n), digits) if kinds[n] == "double" else col(n)).alias(n) for n in names])


def _features(*calls: tuple[str, dict]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = [registry.build(name, **params) for name, params in calls]
        return _shown(apply(_bars(spark, sf_dir), made), [n for f in made for n in f.outputs])

    return run


_PRICES = ["open", "high", "low", "close", "volume"]
_W14, _W20 = {"window": 14}, {"window": 20}
_MACD = {"short_window": 12, "long_window": 26, "signal_window": 9}
FEATURES: dict[str, Query] = {
    name: _features(*calls)
    for name, calls in {
        "price_change": [("price_change_features", {})], "sma": [("ma", _W20)], "ema": [("ema", _W20)], "vwma": [("vwma", _W20)], "macd": [("macd", _MACD)], "adx": [("adx", _W14)],
        "ichimoku": [("ichimoku", {})], "dema": [("dema", _W20)], "tema": [("tema", _W20)], "sar": [("sar", {"acceleration": 0.02, "maximum": 0.2})], "trima": [("trima", _W20)], "rsi": [("rsi", _W14)],
        "stoch": [("stochastic_oscillator", {"k_window": 14, "d_window": 3})], "williams_r": [("williams_r", _W14)], "cci": [("cci", _W20)], "stochrsi": [("stochrsi", {})],
        "ppo": [("ppo", {"fast_window": 12, "slow_window": 26})], "roc": [("roc", {"window": 10})], "ultosc": [("ultosc", {"window1": 7, "window2": 14, "window3": 28})], "mom": [("mom", {"window": 10})],
        "bollinger": [("bollinger_bands", _W20)], "atr": [("atr", _W14)], "natr": [("natr", _W14)], "obv": [("obv", {})], "cmf": [("cmf", _W20)], "ad": [("ad", {})],
        "adosc": [("adosc", {"fast_window": 3, "slow_window": 10})], "hilbert": [("ht_dcperiod", {}), ("ht_trendmode", {}), ("ht_sine", {})], "support_resistance": [("support_resistance", _W20)],
        "candles": [("all_candlestick_patterns", {})], "rsi_adx_ratio": [("rsi_adx_ratio", {"rsi_window": 14, "adx_window": 14})], "macd_atr_ratio": [("macd_atr_ratio", _MACD | {"atr_window": 14})],
        "short_long_ratio": [("short_long_ratio", {"indicator_name": "RSI", "short_window": 7, "long_window": 28})], "indicator_roc": [("indicator_roc", {"indicator_name": "RSI", "indicator_window": 14, "roc_period": 5})],
        "volume_spike": [("volume_spike", {"window": 20, "factor": 2.0})], "consecutive": [("consecutive_candles", {"period": 3, "direction": d}) for d in ("bullish", "bearish")],
        "confirmation": [("confirmation_signal", {"rsi_window": 14, "adx_window": 14, "macd_short": 12, "macd_long": 26, "rsi_threshold": 50, "adx_threshold": 20, "direction": "bullish"})],
    }.items()
}


def ohlc_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_bars(spark, sf_dir), ["open", "high", "low", "close", "volume"])


def daily_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars made of hourly ones: bars resample like ticks."""
    hours = ticks_to_bars(market.order_line_ticks(_read(spark, sf_dir, "lineitem")), "1h")
    return _shown(resample(hours, "1d"), ["open", "high", "low", "close", "volume"], 8)


def _funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's rate, every eight hours, from the mean of its events."""
    eight = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.window("ts", "8 hours").alias("w")).agg(((F.avg("value") - 50) / 1e5).alias("funding_rate"))
    return eight.select("symbol", F.col("w.start").alias("funding_ts"), "funding_rate")


def asof_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = as_of(_bars(spark, sf_dir), _funding(spark, sf_dir), "ts", "funding_ts")
    return met.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "close", F.round("funding_rate", 12).alias("funding_rate"))


def _aligned(spark: SparkSession, sf_dir: str, base: DataFrame, longer: list[str], compat: bool = False) -> DataFrame:
    for tf in longer:
        base = align(base, _bars(spark, sf_dir, tf).select("symbol", "ts", "close"), "30m", tf, f"_{tf}", compat)
    return base


def asof_multi_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("close_30m"))
    return _shown(_aligned(spark, sf_dir, base, ["1h", "4h"]), ["close_30m", "close_1h", "close_4h"])


def asof_multi_tf_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("close_30m"))
    return _shown(_aligned(spark, sf_dir, base, ["1h"], compat=True), ["close_30m", "close_1h"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to half-hour bars with three indicators, aligned with the last complete hour."""
    made = [registry.build("ma", window=20), registry.build("vwma", window=20), registry.build("roc", window=10)]
    base = apply(_bars(spark, sf_dir), made).select("symbol", "ts", "close", "SMA_20", "VWMA_20", "ROC_10")
    return _shown(_aligned(spark, sf_dir, base, ["1h"]), ["close", "SMA_20", "VWMA_20", "ROC_10", "close_1h"])


_NAMES = [
    "RSI_14_5m", "%K_14_3_5m", "MACD_Signal_12_26_9_1h", "MACD_12_26_1h", "SMA_20_30m", "EMA_20_30m", "BB_Width_20_2_1h", "BB_Width_Ratio_10_50_1h", "HT_TRENDMODE_5m", "Volume_Spike_20_2.0_5m",
    "3BlackCrows_1h", "AD_5m", "ADX_14_5m", "ADOSC_3_10_5m", "SAR_0.02_0.2_5m", "unknown_1", "SMA_20_30m",
]


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured name with every number that the events have."""
    rows = _read(spark, sf_dir, "events").select((F.col("event_id") % len(_NAMES) + 1).cast("int").alias("i"), F.get_json_object("props", "$.k").alias("k"))
    return registry.classify(rows.select(F.concat_ws("_", F.element_at(F.array(*map(F.lit, _NAMES)), F.col("i")), "k").alias("feature")))


def feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.feature_order(classify(spark, sf_dir))


def comparison_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.comparison_pairs(classify(spark, sf_dir))


def _grown(base: DataFrame) -> DataFrame:
    """A tree for each row (t, n) of base: three roots with two decisions each, every decision above one action; n moves thresholds and leverages."""
    base = base.withColumn("b", F.explode(F.array(*map(F.lit, range(3)))))
    two = base.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    pair = F.col("b") * 4 + F.col("k")
    row = lambda df, idx, kind, up, depth, *p: df.select(F.col("t").alias("tree_id"), idx.cast("int").alias("node_idx"), F.lit(kind).alias("node_type"), up.cast("int").alias("parent_idx"), F.lit(depth).alias("depth"), *[x.cast("double").alias(f"p{i}") for i, x in enumerate(p, 1)])
    t, n, b, k, zero = F.col("t"), F.col("n"), F.col("b"), F.col("k"), F.lit(0.0)
    pairwise = (t + b) % 5 == 4
    asks = row(two, 3 + pair, 2, b, 1, (t + b + k) % 3, (t + k) % 2, F.when(pairwise, 1).otherwise(0), F.when(pairwise, (t + k) % 4).otherwise(20 + (t * 7 + b * 11 + k * 13 + n) % 60))
    acts = row(two, 5 + pair, 3, 3 + pair, 2, F.when(b == 1, 1 + (t + k) % 2).otherwise(3 + (t + k) % 4), F.lit(0.5), 1 + (t + n) % 100, zero)
    return row(base, b, 1, F.lit(-1), 0, b, zero, zero, zero).unionByName(asks).unionByName(acts)


def _trees(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    """A tree for each user, or group of users, of the events."""
    return _grown(_read(spark, sf_dir, "events").groupBy(F.expr(by).cast("long").alias("t")).agg(F.count("*").alias("n")))


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten trees: prediction has a row for each bar, tree and branch."""
    return _trees(spark, sf_dir, "user_id % 10")


def _couples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, first, second): every user's tree with another user's."""
    users = _read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("child"))
    last = users.agg(F.max("child").alias("last"))
    return users.distinct().join(F.broadcast(last), how="cross").select("child", F.col("child").alias("first"), ((F.col("child") * 3 + 1) % (F.col("last") + 1)).alias("second"))


def _catalog(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """The catalogue with bounds of the two numbers as the events have them."""
    low, high = _read(spark, sf_dir, "events").agg(F.min("value"), F.max("value")).first()
    return [(i, f, low, high) if f == "num" else (i, f, None, None) for i, f, *_ in CATALOG]


def _users(spark: SparkSession, sf_dir: str) -> int:
    return _read(spark, sf_dir, "events").agg(F.count_distinct("user_id")).first()[0]


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's bars, numbered, with a feature array."""
    order = Window.partitionBy("symbol").orderBy("ts")
    rows = _bars(spark, sf_dir).withColumn("bar", (F.row_number().over(order) - 1).cast("long"))
    return rows.withColumn("features", F.array("close", "high", F.coalesce(F.avg("close").over(order.rowsBetween(-4, 0)), F.lit(0.0)), "volume"))


def tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.predict(_cohorts(spark, sf_dir), _numbered(spark, sf_dir).select("symbol", "bar", "features"), 3)


def tree_predict_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.predict_packed(_cohorts(spark, sf_dir), _numbered(spark, sf_dir).select("symbol", "bar", "features"), 3)


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.adjacency(_trees(spark, sf_dir)).select("tree_id", "parent_idx", "n_children", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


def child_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.child_overflow(_trees(spark, sf_dir), 1)


def tree_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = _trees(spark, sf_dir).where("NOT (tree_id % 5 = 1 AND node_idx = 5) AND NOT (tree_id % 5 = 2 AND node_idx = 0) AND NOT (tree_id % 5 = 3 AND node_idx IN (3, 4))")
    return trees.validate(broken)


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.compact(_trees(spark, sf_dir).where("NOT (tree_id % 2 = 0 AND node_idx IN (4, 6))"))


def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _trees(spark, sf_dir)
    tops = nodes.where("node_idx = 0").select("tree_id", (3 + F.col("tree_id") % 2).cast("int").alias("top"))
    return trees.subtree(nodes, tops).select("tree_id", "node_idx", (F.col("node_idx") - F.col("top")).alias("step"), "below")


def root_branch_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variation.root_branch_crossover(_couples(spark, sf_dir), _trees(spark, sf_dir), 0, 3, first_donor=(F.col("child") + F.col("branch")) % 2 == 0)


def critical_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _trees(spark, sf_dir).where("NOT (tree_id % 5 = 3 AND node_idx IN (3, 4, 5, 6))")
    return variation.repair_roots(cut).select("tree_id", "node_idx", "node_type", "parent_idx", "p1")


def lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("seed"))
    return seeds.select("seed", trees.lcg(trees.lcg(F.col("seed"))).alias("state"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("tree_id")).agg((F.round(F.avg("value"), 3) - 40).alias("fitness"))


def _u(i: Column) -> Column:
    return trees.lcg(i * 7919 + 17) / float(2**32)


def elites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.elites(_scores(spark, sf_dir), 8)


def roulette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.roulette(_scores(spark, sf_dir), spark.range(100).select(F.col("id").alias("draw"), _u(F.col("id")).alias("u")))


def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.range(400).select(F.floor(F.col("id") / 4).alias("draw"), (F.col("id") % 4).alias("entry"), _u(F.col("id")).alias("u"))
    return selection.tournament(_scores(spark, sf_dir), entries)


def best_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    new = scores.where("tree_id >= 5").select("*", (F.col("tree_id") % 10).cast("double").alias("compound_value"), (F.col("tree_id") % 4 / 4.0).alias("max_drawdown"))
    return selection.best_pool(scores.where("tree_id < 5"), new, 8)


def next_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _trees(spark, sf_dir)
    scores = _read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("tree_id")).agg(F.count("*").cast("double").alias("fitness"))
    new = selection.next_generation(nodes, selection.elites(scores, 3), nodes.where("tree_id % 4 = 1"))
    return new.select("tree_id", "node_idx", "node_type", "parent_idx")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events")
    profit = F.when(F.col("event_id") % 4 == 0, 0.0).otherwise((F.col("value") - 50) / 5000)
    return simulator.metrics(rows.select((F.col("user_id") % 20).alias("tree_id"), F.col("event_id").alias("bar"), profit.alias("profit")))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["mean_return", "profit_factor", "win_rate", "max_drawdown", "compound_value"]
    return _measured(spark, sf_dir).select("tree_id", "n", *[F.round(c, 8 if c == "mean_return" else 6).alias(c) for c in names])


def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulator.fitness(_measured(spark, sf_dir)).select("tree_id", F.round("fitness", 6).alias("fitness"))


def metrics_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics, sums for further ones included; trees of fewer than 500 trades have none."""
    rows = _read(spark, sf_dir, "events")
    profit = F.when(F.col("event_id") % 4 == 0, 0.0).otherwise((F.col("value") - 50) / 5000)
    found = simulator.metrics(rows.select(F.length(F.bin("user_id")).cast("long").alias("tree_id"), F.col("event_id").alias("bar"), profit.alias("profit")), 500)
    return found.select("tree_id", "n", *[F.round(c, 6).alias(c) for c in found.columns[2:] if c != "n_losses"], "n_losses")


def _mated(tournament: int) -> Query:
    search = evolution.Search(CATALOG, population=48, n_elites=8, parents=16, pool_size=8, tournament=tournament)
    return lambda spark, sf_dir: evolution.parent_pairs(_scores(spark, sf_dir), search, 3)


def kline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as raw kline CSV files, a folder for each symbol, and read back."""
    path = f"{shared_folder(spark)}/klines-{uuid.uuid4().hex}"
    raw = _bars(spark, sf_dir).select("symbol", F.unix_millis(F.col("ts").cast("timestamp")).alias("Open time"), *[F.col(c).alias(c.title()) for c in _PRICES])
    market.write_table(raw, path, "csv", if_missing=True, partition_by=["symbol"])
    return _shown(market.read_klines(spark, path, F.col("symbol")), _PRICES, 8)


def kline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written by symbol and day, and a range of time of two symbols read back: other days and symbols stay closed."""
    path = f"{shared_folder(spark)}/klines-{uuid.uuid4().hex}"
    market.write_klines(_bars(spark, sf_dir), path)
    columns = "ts timestamp_ntz, " + ", ".join(f"{c} double" for c in _PRICES)
    return _shown(market.read_klines_between(spark, path, columns, "2024-01-05 12:00:00", "2024-01-20 06:30:00", ["click", "error"]), _PRICES, 8)


def funding_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding rates of every symbol written by day, and those of a range of time read back."""
    path = f"{shared_folder(spark)}/funding-{uuid.uuid4().hex}"
    market.write_klines(_funding(spark, sf_dir), path, "csv", "funding_ts")
    back = market.read_klines_between(spark, path, "funding_ts timestamp_ntz, funding_rate double", "2024-01-03", None, kind="csv", time="funding_ts")
    return back.select("symbol", F.date_format("funding_ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("funding_rate", 12).alias("funding_rate"))


def funding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding rates written as a raw CSV file and read back."""
    path = f"{shared_folder(spark)}/funding-{uuid.uuid4().hex}"
    at = F.window("ts", "8 hours")["start"].cast("timestamp")
    rates = _read(spark, sf_dir, "events").groupBy(F.unix_millis(at).alias("fundingTime")).agg(((F.avg("value") - 50) / 1e5).alias("fundingRate"))
    market.write_table(rates, path, "csv")
    back = market.read_funding_csv(spark, path, "ALL")
    return back.select("symbol", F.date_format("funding_ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("funding_rate", 12).alias("funding_rate"))


def population_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A population saved with its catalogue and loaded against one in another order."""
    path = f"{shared_folder(spark)}/population-{uuid.uuid4().hex}"
    own = spark.createDataFrame([(f"F{i}", f, lo, hi, i) for i, f, lo, hi in CATALOG], "feature string, family string, low double, high double, idx int")
    save_population(_trees(spark, sf_dir), own, path)
    return load_population(spark, path, own.withColumn("idx", 3 - F.col("idx")))[0]


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = zip(("train", "test"), evolution.split(_numbered(spark, sf_dir), 0.7), strict=True)
    one, two = (p.withColumn("part", F.lit(n)) for n, p in parts)
    return one.unionByName(two).groupBy("symbol", "part").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


def simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _numbered(spark, sf_dir)
    return simulator.simulate(tree_predict_batched(spark, sf_dir), bars, series=("symbol",))


CATALOG = [(0, "num", 0.0, 200.0), (1, "num", 0.0, 300.0), (2, "comparison", None, None), (3, "comparison", None, None)]


def random_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.random_population(spark, _users(spark, sf_dir), _catalog(spark, sf_dir), max_depth=5, seed=7)


def weighted_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.weighted_population(spark, _users(spark, sf_dir), _catalog(spark, sf_dir), max_depth=6, seed=7)


def _varied(make: Callable[[DataFrame], DataFrame], deeper: bool = False) -> Query:
    """make over the trees; deeper: over trees of which each got a decision more, so that their branches differ."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = _trees(spark, sf_dir)
        return make(variation.add_node(nodes, CATALOG, 9, rate=1.0, max_depth=5) if deeper else nodes).select(trees.COLUMNS)

    return run


def permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variation.permuted(_trees(spark, sf_dir), 5).select(trees.COLUMNS)


def _crossed(make: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(_couples(spark, sf_dir), _trees(spark, sf_dir), 5, 5)

    return run


def evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation of a small search over all series; the new population."""
    bars = _numbered(spark, sf_dir)
    search = evolution.Search(CATALOG, population=8, n_elites=2, parents=4, max_depth=5)
    return evolution.evolve(spark, _cohorts(spark, sf_dir), bars.select("symbol", "bar", "features"), bars, search, 1, f"{shared_folder(spark)}/evolve-{uuid.uuid4().hex}")


def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preprocessing pipeline over two timeframes, with complete rows only."""
    calls = {"ma": [{"window": 20}], "roc": [{"window": 10}], "bollinger_bands": [{"window": 20}]}
    ticks = market.event_ticks(_read(spark, sf_dir, "events"))
    return _shown(pipeline.feature_table(ticks_to_bars(ticks, "30m"), {"30m": calls, "1h": calls}), pipeline.feature_names({"30m": calls, "1h": calls}))


def streaming_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_bars(spark, f"{sf_dir}/events.parquet", "30m")


QUERIES: dict[str, Query] = {
    "flagship": flagship,
    **FEATURES,
    **{f.__name__: f for f in (
        ohlc_resample, daily_resample, asof_funding, asof_multi_tf, asof_multi_tf_compat, classify, feature_order, comparison_pairs, tree_predict, tree_predict_batched, adjacency, child_overflow,
        tree_validate, compact, subtree, root_branch_copy, critical_repair, lcg, elites, roulette, tournament, best_pool, next_generation, metrics, metrics_minimum, fitness, kline_files, kline_range, funding_files, funding_range, population_files, train_test_split, simulate, random_population, weighted_population,
        evolve, feature_pipeline, streaming_bars, permuted,
    )},
    "mating_roulette": _mated(0),
    "mating_tournament": _mated(5),
    "mutate_parameters": _varied(lambda n: variation.mutate_parameters(n, CATALOG, 1, rate=0.5)),
    "reinitialize_nodes": _varied(lambda n: variation.reinitialize_nodes(n, CATALOG, 1, rate=0.5, max_depth=5)),
    "add_node": _varied(lambda n: variation.add_node(n, CATALOG, 1, rate=1.0, max_depth=5)),
    "delete_node": _varied(lambda n: variation.delete_node(n, 1, rate=1.0, max_depth=5), deeper=True),
    "add_subtree": _varied(lambda n: variation.add_subtree(n, CATALOG, 1, rate=1.0, max_depth=6), deeper=True),
    "delete_subtree": _varied(lambda n: variation.delete_subtree(n, 1, rate=1.0), deeper=True),
    "subtree_crossover": _crossed(variation.subtree_crossover),
    "node_crossover": _crossed(variation.node_crossover),
    "subtree_crossover_free": _crossed(lambda *x: variation.subtree_crossover(*x, free=True)),
    "node_crossover_free": _crossed(lambda *x: variation.node_crossover(*x, free=True)),
    "root_branch_crossover": _crossed(variation.root_branch_crossover),
}
