"""Every query with an oracle against DuckDB, and what SQL can't say against plain Python."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from conftest import DATA, small_trees
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom import oracles, queries
from quantloom.functions import features, folds, registry, scans
from quantloom.operators import bars, packed, simulator, trees, variation
from quantloom.plans import evolution, pipeline
from quantloom.sources import market


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(oracles.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_node_stays_valid(spark):
    nodes = trees.random_population(spark, 12, queries.CATALOG, max_depth=5, seed=2)
    pairs = spark.range(6).select(F.col("id").alias("child"), F.col("id").alias("first"), (11 - F.col("id")).alias("second"))
    made = {
        "population": nodes,
        "subtree crossover": variation.subtree_crossover(pairs, nodes, 3, 5),
        "free subtree crossover": variation.subtree_crossover(pairs, nodes, 3, 5, free=True),
        "free node crossover": variation.node_crossover(pairs, nodes, 3, 5, free=True),
        "node crossover": variation.node_crossover(pairs, nodes, 3, 5),
        "root crossover": variation.root_branch_crossover(pairs, nodes, 3, 5),
        "parameters": variation.mutate_parameters(nodes, queries.CATALOG, 3, rate=0.7),
        "renewed": variation.reinitialize_nodes(nodes, queries.CATALOG, 3, rate=0.7, max_depth=5),
        "added": variation.add_node(nodes, queries.CATALOG, 3, rate=1.0, max_depth=6),
        "deleted": variation.delete_node(nodes, 3, rate=1.0, max_depth=5),
        "grown": variation.add_subtree(nodes, queries.CATALOG, 3, rate=1.0, max_depth=6),
        "pruned": variation.delete_subtree(nodes, 3, rate=1.0),
    }
    for name, df in made.items():
        found = trees.validate(df, max_depth=6).collect()
        assert found and not [r for r in found if r.faults], name


def test_weighted_population_keeps_its_limits(spark):
    nodes = trees.weighted_population(spark, 12, queries.CATALOG, max_depth=5, max_children=3, max_nodes=40, seed=3)
    trees.require_valid(nodes, max_depth=5, max_children=3)
    sizes = [r["count"] for r in nodes.groupBy("tree_id").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 40 and min(sizes) >= 6 and len(set(sizes)) > 3
    again = trees.weighted_population(spark, 12, queries.CATALOG, max_depth=5, max_children=3, max_nodes=40, seed=3)
    assert nodes.exceptAll(again).count() == 0
    small = trees.weighted_population(spark, 2, queries.CATALOG, max_nodes=6)
    trees.require_valid(small)
    assert small.count() == 12


def grown_alone(rng, budget, max_depth, max_children):
    """(type, parent, depth, branch) of one tree's nodes, drawn node by node with rng.choice."""
    nodes, kids = [(1, -1, 0, b) for b in range(3)], [0, 0, 0]
    while True:
        bare = sum(k == 0 and kind != 3 for k, (kind, *_) in zip(kids, nodes))
        free = [(max_children - k) * (kind != 3 and d + 2 < max_depth and len(nodes) + 1 + bare + (k > 0) <= budget) if k == 0 or (3, i) not in {(x[0], x[1]) for x in nodes} else 0 for i, (k, (kind, _, d, _)) in enumerate(zip(kids, nodes))]
        weight = np.array([w / (d + 1.0) for w, (_, _, d, _) in zip(free, nodes)])
        if not weight.any():
            break
        parent = int(rng.choice(len(nodes), p=weight / weight.sum()))
        kind = 3 if kids[parent] == 0 and rng.random() < 0.5 else 2
        nodes.append((kind, parent, nodes[parent][2] + 1, nodes[parent][3]))
        kids[parent] += 1
        kids.append(0)
    return nodes + [(3, i, d + 1, b) for i, (kind, _, d, b) in enumerate(nodes) if kids[i] == 0 and kind != 3]


@pytest.mark.parametrize(("max_depth", "max_children", "most"), [(6, 30, 256), (5, 3, 40), (2, 3, 9), (3, 1, 6)])
def test_trees_grown_together_are_those_grown_alone(max_depth, max_children, most):
    draw = lambda: [np.random.default_rng([5, t]) for t in range(30)]
    budgets = np.array([max(6, most - t) for t in range(30)])
    got = trees._shapes(draw(), budgets, max_depth, max_children)
    order = np.lexsort((got["node_idx"], got["tree"]))
    rows = list(zip(*(got[c][order].tolist() for c in ("tree", "node_idx", "node_type", "parent_idx", "depth", "branch")), strict=True))
    want = [grown_alone(rng, b, max_depth, max_children) for rng, b in zip(draw(), budgets.tolist(), strict=True)]
    assert rows == [(t, i, *node) for t, nodes in enumerate(want) for i, node in enumerate(nodes)]
    assert not len(trees._shapes([], np.zeros(0, np.int64), 6, 30)["tree"])


def test_invalid_trees_are_named(spark):
    bad = small_trees(spark, 3).where("NOT (tree_id = 1 AND node_idx = 5)")
    with pytest.raises(ValueError, match="1 \\(faults 4\\)"):
        trees.require_valid(bad)


def test_both_predictors_agree(spark):
    nodes = trees.random_population(spark, 10, queries.CATALOG, max_depth=5, seed=5)
    x = random.Random(1)
    data = [(i, [x.uniform(0, 200) if x.random() < 0.9 else None for _ in range(4)]) for i in range(40)]
    feats = spark.createDataFrame(data, "bar long, features array<double>")
    a, b = (rows(d.columns, d.collect()) for d in (trees.predict(nodes, feats, 5), packed.predict_packed(nodes, feats, 5)))
    assert a == b and len(a) == 10 * 40 * 3


def test_simulator_by_hand():
    hold, new_long, close = (0, 0, 0), (trees.NEW_LONG, 0.5, 10.0), (trees.CLOSE_ALL, 0, 0)
    market_ = simulator.Market(fee=0.001, slippage=0.0)
    bars_ = [(0, 100.0, 101.0, 99.0, 0.0), (3600, 100.0, 111.0, 99.0, 0.0), (7200, 110.0, 111.0, 109.0, 0.0), (10800, 110.0, 111.0, 109.0, 0.0)]
    acts = [[hold, new_long, hold], [close, hold, hold], [hold, hold, hold], [hold, hold, hold]]
    out = simulator.simulate_series(bars_, acts, market_)
    assert out[0][:3] == (simulator.LONG, 0.5, 10) and out[0][3] == pytest.approx(-0.5 * 10 * 0.001)
    assert out[1][0] == simulator.FLAT and out[1][3] == pytest.approx(0.5 * 0.1 * 10 - 0.5 * 10 * 0.001)
    fall = [(0, 100.0, 101.0, 99.0, 0.0), (1, 100.0, 100.0, 50.0, 0.0), (2, 60.0, 60.0, 60.0, 0.0)]
    assert simulator.simulate_series(fall, acts, market_)[1][3] == pytest.approx(-0.5)  # liquidated; the close does nothing


def test_funding_counts():
    assert simulator.fundings_between(0, 28800, False) == 1 and simulator.fundings_between(0, 86400 * 3, False) == 9
    assert simulator.fundings_between(0, 86400 * 3, True) == 3


def test_wilder_and_ema_by_hand():
    import numpy as np

    x = np.array([1.0, 2, 3, 4, 5])
    assert scans.alone(lambda s: [folds.ema(s, s["close"], 3)], close=x)[0].tolist()[2:] == [2.0, 3.0, 4.0]
    assert scans.alone(lambda s: [folds.wilder(s, s["close"], 2)], close=x)[0].tolist()[1:] == [1.5, 2.25, 3.125, 4.0625]


def test_klines_coerce(spark):
    raw = spark.createDataFrame([("1704067200000", "1", "2", "0.5", "x", "10")], ["Open time", "Open", "High", "Low", "Close", "Volume"])
    r = market.klines(raw, "AAA").first()
    assert str(r.ts) == "2024-01-01 00:00:00" and r.close is None and r.symbol == "AAA"
    with pytest.raises(ValueError):
        market.seconds("7x")


def test_csv_round_trip(spark, tmp_path):
    walk = market.random_walk(spark, "AAA", 50)
    renamed = walk.select((F.unix_millis(F.col("ts").cast("timestamp"))).alias("Open time"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    market.write_table(renamed, str(tmp_path / "k"), "csv")
    back = market.read_klines_csv(spark, str(tmp_path / "k"), "AAA")
    assert back.count() == 50 and back.where("high < low OR close IS NULL").count() == 0
    assert market.read_klines_csv(spark, str(tmp_path / "k"), "AAA", rows=5).count() == 5


def test_unknown_features_warn():
    with pytest.warns(UserWarning):
        assert registry.build("calculate_nothing") is None


def test_pipeline_compat_leaves_composites_out(spark):
    config = {"5m": {"calculate_ma": [{"window": 3}], "calculate_rsi_adx_ratio": [{"rsi_window": 3, "adx_window": 3}]}}
    assert pipeline.feature_names(config, compat=True) == ["SMA_3_5m"]
    table = pipeline.feature_table(market.random_walk(spark, "AAA", 120), config)
    assert table.columns == ["symbol", "ts", "RSI_ADX_Ratio_3_3_5m", "SMA_3_5m"] and table.count() > 0
    assert pipeline.feature_array(table, ["SMA_3_5m", "none"]).first().features[1] is None


def test_all_configured_functions_make_columns(spark):
    made = [registry.build(n, **p) for n, p in [("ht_dcperiod", {}), ("ht_sine", {}), ("ht_trendmode", {}), ("all_candlestick_patterns", {}), ("indicator_roc", {"indicator_name": "MACD_Hist", "indicator_window": "12_26_9", "roc_period": 3})]]
    table = features.apply(bars.resample(market.random_walk(spark, "AAA", 200), "1m"), made)
    assert table.where("HT_DCPERIOD IS NOT NULL AND abs(HT_SINE) > 1").count() == 0 and "MACD_Hist_ROC_12_26_9_3" in table.columns


def test_resume(spark, tmp_path):
    bars_ = queries._numbered(spark, DATA).where("bar < 60")
    search = evolution.Search(queries.CATALOG, population=4, n_elites=1, parents=2, max_depth=5)
    args = (spark, small_trees(spark, 4), bars_.select("symbol", "bar", "features"), bars_, search)
    evolution.evolve(*args, 1, str(tmp_path))
    assert os.path.isdir(tmp_path / "generation=0") and evolution._latest(spark, str(tmp_path)) == 0
    assert evolution.evolve(*args, 1, str(tmp_path)).select("tree_id").distinct().count() == 4


def test_predictors_stop_at_the_depth_asked_for(spark):
    nodes = trees.random_population(spark, 6, queries.CATALOG, max_depth=6, seed=9)
    feats = spark.createDataFrame([(i, [float(i * 7 % 200)] * 4) for i in range(30)], "bar long, features array<double>")
    for depth in (2, 3, 6):
        a, b = (rows(d.columns, d.collect()) for d in (trees.predict(nodes, feats, depth), packed.predict_packed(nodes, feats, depth)))
        assert a == b


def test_crossovers_get_exact_shares(spark, monkeypatch):
    got = {}
    for k, name in enumerate(("subtree_crossover", "node_crossover", "root_branch_crossover")):
        real = getattr(variation, name)
        monkeypatch.setattr(variation, name, lambda pairs, *a, real=real, k=k: (got.__setitem__(k, pairs.count()), real(pairs, *a))[1])
    pairs = spark.range(17).select(F.col("id").alias("child"), (F.col("id") % 10).alias("first"), ((F.col("id") * 3 + 1) % 10).alias("second"))
    made = variation.crossover_chain(pairs, small_trees(spark), 4, (0.6, 0.2, 0.2), rate=1.0, max_depth=5)
    assert got == {0: 10, 1: 3, 2: 4} and made.select("tree_id").distinct().count() == 17


def test_streams_in_many_batches_give_the_same_bars(spark, tmp_path):
    """Files one by one, in order of time: every batch changes bars of an earlier one."""
    from quantloom.streaming import bars as streaming

    events = spark.read.parquet(f"{DATA}/events.parquet")
    edges = events.select(F.percentile_approx("ts", [0.0, 0.31, 0.62, 1.0])).first()[0]
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = events.where((F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(b)) if k < 2 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ticks = market.event_ticks(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    streaming.write_bars(streaming.bar_stream(ticks, "4h", "30 days"), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    want, got = bars.ticks_to_bars(market.event_ticks(events), "4h"), streaming.read_bars(spark, str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) >= 3 and rows(want.columns, want.collect()) == rows(got.columns, got.collect())


CONFIG = """
environment: {seed: 3}
data: {train_ratio: 0.7}
ga_core:
  population: {size: 4, max_nodes: 64, max_depth: 3, max_children: 5}
  evolution_loop: {generations: 1, parent_pool_size: 3, elite_size: 1, best_chromosome_pool_size: 2, warming_steps: 0}
operators:
  selection: {type: TournamentSelection, tournament_k_size: 2}
  crossover: {weights: [0.6, 0.2, 0.2]}
  mutation:
    probabilities: {add_node: 0.5, delete_node: 0.5, add_subtree: 0.5, delete_subtree: 0.5, reinitialize_node: 0.1, node_param: 0.5}
    node_param_mutation: {noise_ratio: 0.2, leverage_change: 7}
    add_node_mutation: {max_add_nodes: 2}
    delete_node_mutation: {max_delete_nodes: 3}
    add_subtree_mutation: {node_count_range: [2, 4]}
evaluation:
  simulation_env: {taker_fee_rate: 0.001, max_additional_entries: 2}
  fitness_function: {minimum_trades: 1, weights: [0.2, 0.2, 0.2, 0.2, 0.2]}
feature_classification:
  feature_num: {RSI: [0, 100], ROC: [-50, 50]}
  feature_comparison: [SMA]
"""
FUNCTIONS = """
5m:
  calculate_ma: [{window: 3}, {window: 5}]
  calculate_rsi: [{window: 3}]
15m:
  calculate_roc: [{window: 2}]
1d: {}
"""


def test_jobs_from_configuration_files(spark, tmp_path):
    from quantloom.plans import config as C
    from quantloom.plans import jobs
    from quantloom.sources import populations

    (tmp_path / "config.yaml").write_text(CONFIG)
    (tmp_path / "functions.yaml").write_text(FUNCTIONS)
    config = C.read_config(str(tmp_path / "config.yaml"))
    with pytest.warns(UserWarning, match="4h"):
        functions = C.feature_config(C.read_config(str(tmp_path / "functions.yaml")), ["5m", "15m", "4h"])
    with pytest.raises(ValueError), pytest.warns(UserWarning, match="2h"):
        C.feature_config(functions, ["2h"])
    walk = market.random_walk(spark, "AAA", 400).unionByName(market.random_walk(spark, "BBB", 300, seed=5))
    funding = spark.createDataFrame([("AAA", 0.0001)], "symbol string, funding_rate double").select("symbol", F.lit("2024-01-01").cast("timestamp_ntz").alias("funding_ts"), "funding_rate")
    table, catalog = jobs.preprocess(spark, walk, config, functions, str(tmp_path / "data"), funding)
    assert [r.feature for r in catalog.orderBy("idx").collect()] == ["ROC_2_15m", "RSI_3_5m", "SMA_3_5m", "SMA_5_5m"]
    assert {r.symbol for r in table.select("symbol").distinct().collect()} == {"AAA", "BBB"} and "bar_funding_rate" in table.columns
    before = os.path.getmtime(tmp_path / "data" / "features" / "_SUCCESS")
    jobs.preprocess(spark, walk.limit(0), config, functions, str(tmp_path / "data"))
    assert os.path.getmtime(tmp_path / "data" / "features" / "_SUCCESS") == before  # what is there stays
    search = C.search(config, [])
    assert (search.population, search.n_elites, search.tournament, search.weights, search.market.fee, search.market.max_added) == (4, 1, 2, (0.6, 0.2, 0.2), 0.001, 2)
    assert (search.noise, search.leverage_step, search.most_added, search.most_deleted, search.subtree_nodes) == (0.2, 7, 2, 3, (2, 4)) and set(search.fitness_weights.values()) == {0.2}
    with pytest.warns(UserWarning, match="swap_mutation"):
        C.search({"operators": {"mutation": {"swap_mutation": {}}}}, [])
    search_best = evolution.Search(queries.CATALOG, min_compound=-1e9, most_drawdown=1e9)
    scored = spark.createDataFrame([(i, float(i), 1.0, 0.1) for i in range(4)], "tree_id long, fitness double, compound_value double, max_drawdown double")
    for g in (0, 1):
        evolution._pooled(spark, str(tmp_path / "pool"), g, small_trees(spark, 4), scored, search_best)
    pooled = spark.read.parquet(str(tmp_path / "pool" / "generation=1" / "pool"))
    assert pooled.select("tree_id").distinct().count() == 8 and pooled.count() == 8 * 15
    best, judged = jobs.train(spark, config, table, catalog, str(tmp_path / "run"))
    assert best.columns == trees.COLUMNS and judged.count() == best.select("tree_id").distinct().count() <= 2
    assert trees.validate(spark.read.parquet(str(tmp_path / "run" / "search" / "generation=0" / "nodes")), 3, 5).where("faults <> 0").count() == 0
    populations.save_population(small_trees(spark, 3), catalog, str(tmp_path / "saved"))
    turned = catalog.withColumn("idx", (3 - F.col("idx")).cast("int"))
    moved, _ = populations.load_population(spark, str(tmp_path / "saved"), turned, trees=[0, 2])
    old = {(r.tree_id, r.node_idx): r for r in small_trees(spark, 3).collect()}
    for r in moved.collect():
        was = old[r.tree_id, r.node_idx]
        assert r.p1 == (3 - was.p1 if r.node_type == 2 else was.p1) and r.p4 == (3 - was.p4 if r.node_type == 2 and r.p3 == 1 else was.p4)
    with pytest.raises(ValueError, match="lacks"):
        populations.load_population(spark, str(tmp_path / "saved"), turned.where("idx < 2"))


def test_several_nodes_at_once(spark):
    """Each tree that is hit gets or loses 1 to most decisions, and stays valid."""
    nodes = trees.random_population(spark, 30, queries.CATALOG, max_depth=5, seed=2)
    size = lambda df: {r.tree_id: r["count"] for r in df.groupBy("tree_id").count().collect()}
    more = variation.repeated(nodes, lambda m, s, hit: variation.add_node(m, queries.CATALOG, s, hit, 9), 3, "add_node", 0.6, 3)
    grown = [b - a for a, b in zip(*(list(dict(sorted(size(d).items())).values()) for d in (nodes, more)), strict=True)]
    assert {0, 1, 2, 3} == set(grown) and trees.validate(more, max_depth=9).where("faults <> 0").count() == 0
    fewer = variation.repeated(more, lambda m, s, hit: variation.delete_node(m, s, hit, 9), 4, "delete_node", 1.0, 3)
    shrunk = [a - b for a, b in zip(*(list(dict(sorted(size(d).items())).values()) for d in (more, fewer)), strict=True)]
    assert max(shrunk) > 1 and min(shrunk) >= 0 and trees.validate(fewer, max_depth=9).where("faults <> 0").count() == 0
    grown = variation.add_subtree(nodes, queries.CATALOG, 5, 1.0, 4, 9, least=4)
    added = [b - a for a, b in zip(*(list(dict(sorted(size(d).items())).values()) for d in (nodes, grown)), strict=True)]
    assert all(n == 0 or 5 <= n <= 8 for n in added) and any(added)


def test_search_checks_its_sizes():
    with pytest.raises(ValueError, match="named"):
        evolution.Search([], rates={"none": 1.0})
    with pytest.raises(ValueError):
        evolution.Search([], population=4, n_elites=4)
