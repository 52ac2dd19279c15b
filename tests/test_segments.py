"""Series cut into segments: the same values as over whole series, whatever the cuts."""

import inspect
import random

import numpy as np
import pandas as pd
import pytest
import whole_series as plain
from conftest import small_trees
from pyspark.sql import functions as F

from quantloom import queries
from quantloom.functions import features, folds, registry, scans
from quantloom.operators import bars, segments, selection, simulator, variation
from quantloom.sources import market


def every_feature():
    calls = [c for q in queries.FEATURES.values() for c in inspect.getclosurevars(q).nonlocals["calls"]]
    return [registry.build(name, **params) for name, params in calls]


def walks(spark):
    """A long series, some that end within a segment, and one shorter than any window; some prices are missing."""
    out = market.random_walk(spark, "AAA", 500)
    for k, (name, n) in enumerate((("BBB", 40), ("CCC", 3), ("DDD", 120), ("EEE", 1)), 5):
        out = out.unionByName(market.random_walk(spark, name, n, seed=k))
    late = (F.col("symbol") == "DDD") & (F.minute("ts") < 7) & (F.hour("ts") == 0)  # no close at the start of a series
    return out.withColumn("close", F.when(~late, F.col("close"))).withColumn("volume", F.when(~late, F.col("volume")))


def as_frame(df, names):
    return df.select("symbol", "ts", *[f"`{n}`" for n in names]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def differing(a, b, names):
    out = []
    for n in names:
        x, y = a[n], b[n]
        exact = not pd.api.types.is_float_dtype(x)
        ok = ((x == y) | (x.isna() & y.isna())).all() if exact else np.allclose(x.astype(float), y.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)
        out += [] if ok else [n]
    return out


def test_every_feature_over_segments_shorter_than_windows(spark):
    made = every_feature()
    names = list(dict.fromkeys(n for f in made for n in f.outputs))
    rows = walks(spark)
    whole, cut = (as_frame(features.apply(rows, made, segments=n), names) for n in (1, 23))
    assert len(whole) == 664 and not differing(whole, cut, names)


def test_scans_agree_with_whole_series(spark):
    """The recursions against plain loops over the whole series, over 64 segments."""
    rows = market.random_walk(spark, "AAA", 6400)
    calls = [("ema", {"window": 20}), ("tema", {"window": 9}), ("macd", {"short_window": 12, "long_window": 26, "signal_window": 9}), ("adx", {"window": 14}), ("rsi", {"window": 14}), ("sar", {"acceleration": 0.02, "maximum": 0.2}), ("adosc", {"fast_window": 3, "slow_window": 10}), ("stochrsi", {}), ("ht_dcperiod", {}), ("ht_sine", {})]
    made = [registry.build(n, **p) for n, p in calls]
    names = [n for f in made for n in f.outputs]
    table = features.apply(rows, made, segments=64)
    got = as_frame(table, ["open", "high", "low", "close", "volume", *names])
    h, low, c, v = (got[x].to_numpy() for x in ("high", "low", "close", "volume"))
    one = plain.ema(c, 9)
    two = plain.ema(one, 9)
    cycle = plain.hilbert(c)
    want = [plain.ema(c, 20), 3 * one - 3 * two + plain.ema(two, 9), *plain.macd(c, 12, 26, 9), *plain.adx(h, low, c, 14), plain.rsi(c, 14), plain.sar(h, low, 0.02, 0.2), plain.adosc(plain.accumulation(h, low, c, v), 3, 10), *plain.stoch_rsi(c, 14, 5, 3), cycle["HT_DCPERIOD"], cycle["HT_SINE"], cycle["HT_LEADSINE"]]
    assert len(names) == len(want)
    for name, w in zip(names, want, strict=True):
        assert np.allclose(got[name].to_numpy(float), w, rtol=1e-9, atol=1e-9, equal_nan=True), name


def test_few_guesses_are_wrong(spark):
    """State machines start from a warm-up of 1,024 rows: hardly a segment has to be done again."""
    cut = segments.segmented(market.random_walk(spark, "AAA", 20_000), ["symbol"], ["ts"], 15)
    for program in (lambda s: [folds.sar(s, s["high"], s["low"], 0.02, 0.2)], lambda s: list(folds.hilbert(s, s["close"]).values())):
        known, wrong = scans.states(cut, scans.cuts(cut), program)
        assert len(known) == 14 and wrong <= 1


def test_wrong_guesses_are_done_again():
    """A machine that remembers its first row for ever: no guess is right, and every segment is right all the same."""
    step = lambda state, columns, at: (np.full(len(columns[0]), columns[0][0] if state is None and len(columns[0]) else -1.0 if state is None else state), state if state is not None else float(columns[0][0]) if len(columns[0]) else None)
    scan = scans.Scan(False, {0: np.array([5.0])}, at=1)
    assert scan.chunk({"close": np.array([1.0, 2.0])}, lambda s: [s.machine(step, lambda: None, s["close"])]) == [scans.PENDING]
    assert scan.report()["guesses"] == {1: (5.0, 5.0)}


def test_first_row_machine_over_segments(spark):
    def step(state, columns, at):
        x = columns[0]
        first = state if state is not None else float(x[0]) if len(x) else None
        return np.full(len(x), np.nan if first is None else first), first

    cut = segments.segmented(market.random_walk(spark, "AAA", 4000), ["symbol"], ["ts"], 6)
    program = lambda s: [s.machine(step, lambda: None, s["close"])]
    known, wrong = scans.states(cut, scans.cuts(cut), program)
    assert wrong >= 3 and len({s[1] for s in known.values()}) == 1
    made = scans.scanned(cut, ["first"], program, 0)
    assert made.select("first").distinct().count() == 1


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 50])
def test_carries_by_force(cut):
    """Every operation over pieces, with states carried through summaries, against the operation over all rows."""
    rng = np.random.default_rng(cut)
    x = rng.normal(size=150)
    late = np.where(np.arange(150) < 20, np.nan, x)
    broken = np.where(np.arange(150) == 90, np.nan, x)
    ops = [scans.Recursion(0.9, 0.1, 12), scans.Recursion(0.9, 1.0, 12, mean=False), scans.Recursion(0.8, 0.2, 1), scans.Recursion(0.8, 1.0, 0, mean=False), scans.Recursion(0.7, 0.3, 5, at=30), scans.Recursion(0.7, 0.3, 1, at=0), scans.Total(), scans.Total(strict=True), scans.Last(7)]
    for op in ops:
        for values in (x, late, broken):
            _, want = op.advance(op.start(), values, 0)
            state = op.start()
            for a in range(0, 150, cut):
                piece, summary = values[a : a + cut], None
                for b in range(0, len(piece), 2):  # a segment comes in chunks
                    summary = op.absorb(summary, piece[b : b + 2], a + b)
                state = op.advance(state, piece, a)[1] if a == 0 else op.carry(state, summary, a)
            assert all(np.allclose(p, q, rtol=1e-9, equal_nan=True) for p, q in zip(np.atleast_1d(state) if isinstance(want, np.ndarray) else state, np.atleast_1d(want) if isinstance(want, np.ndarray) else want, strict=True)), (op, cut)


def test_no_task_holds_a_whole_series(spark):
    """One series in 40 segments: windows run by segment, and rows are dealt evenly."""
    rows = market.random_walk(spark, "AAA", 4000)
    table = features.apply(rows, [registry.build("ma", window=20), registry.build("ema", window=20)], segments=40)
    windows = [x for x in table._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("_segment" in x for x in windows)
    sizes = [r["count"] for r in segments.segmented(rows, ["symbol"], ["ts"], 40).groupBy(segments.SEGMENT).count().collect()]
    assert len(sizes) >= 36 and max(sizes) < 400


def as_of_by_force(left, right):
    out = []
    for by, t, x in left:
        fit = [r for r in right if r[0] == by and by is not None and t is not None and r[1] is not None and r[1] <= t]
        best = max(fit, key=lambda r: (r[1], r[2] is not None, r[2] if r[2] is not None else 0), default=(None, None, None))
        out.append((by, t, x, best[1], best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("cut", [1, 13, 300])
def test_as_of_over_segments(spark, cut):
    """A series over many segments, long gaps without a right row, ties, nulls, and more segments than rows."""
    x = random.Random(cut)
    left = [(x.choice(["A", "A", "A", "B", None]), x.choice([None, *range(400)]), k) for k in range(250)]
    right = [(x.choice(["A", "C", None]), x.choice([None, 3, 3, 250, 251, 390]), x.choice([None, 1, 2])) for _ in range(25)] + [("A", 250, 9), ("B", 0, None)]
    a = spark.createDataFrame(left, "symbol string, t int, x int")
    b = spark.createDataFrame(right, "symbol string, u int, v int")
    got = bars.as_of(a, b, "t", "u", segments=cut)
    assert got.columns == ["symbol", "t", "x", "u", "v"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == as_of_by_force(left, right)
    assert bars.as_of(a.limit(0), b, "t", "u").count() == 0 and bars.as_of(a, b.limit(0), "t", "u").where("u IS NOT NULL").count() == 0


@pytest.mark.parametrize("cut", [1, 9, 200])
def test_prefix_sums_and_ranks(spark, cut):
    x = random.Random(cut)
    rows = [(k, x.choice([0.0, 0.1, 2.5, None])) for k in x.sample(range(1000), 120)]
    got = segments.prefixed(spark.createDataFrame(rows, "id int, w double"), ["id"], {"sum": "w"}, cut).orderBy("id").collect()
    upto = 0.0
    for k, (r, (i, w)) in enumerate(zip(got, sorted(rows), strict=True)):
        assert (r.id, r["_rank"]) == (i, k) and r["sum"].before == pytest.approx(upto)
        assert k == 0 or r["sum"].before == got[k - 1]["sum"].upto  # no gap, to the last bit
        upto += w or 0.0
        assert r["sum"].upto == pytest.approx(upto)
    assert segments.prefixed(spark.createDataFrame([], "id int, w double"), ["id"], {"sum": "w"}).count() == 0


@pytest.mark.parametrize("cut", [1, 13])
def test_numbers_within_series(spark, cut):
    x = random.Random(cut)
    rows = [(x.choice(["A", "A", "B", None]), t) for t in x.sample(range(500), 150)]
    got = sorted(((r.symbol, r.ts, r.bar) for r in segments.numbered(spark.createDataFrame(rows, "symbol string, ts int"), segments=cut).collect()), key=str)
    assert got == sorted(((s, t, sorted(u for v, u in rows if v == s).index(t)) for s, t in rows), key=str)


@pytest.mark.parametrize("cut", [1, 11])
def test_roulette_by_force(spark, cut):
    """One tree of nearly all the weight, trees of none, unknown fitness; and trees that are all alike."""
    x = random.Random(5)
    for scores in ([(i, -3.0 if i % 4 == 0 else 1e6 if i == 7 else x.random()) for i in range(90)] + [(200, None)], [(i, 4.0) for i in range(9)], [(3, -1.0)]):
        known = [(i, f - min(0.0, *(g for _, g in scores if g is not None))) for i, f in sorted(scores) if f is not None]
        known = known if sum(w for _, w in known) > 0 else [(i, 1.0) for i, _ in known]
        total = sum(w for _, w in known)
        drawn = [(d, x.random()) for d in range(300)] + [(300, 0.0), (301, 1 - 2**-52)]
        want = {}
        for d, u in drawn:
            at = u * total
            for i, w in known:
                if at < w:
                    want[d] = i
                    break
                at -= w
        got = {r.draw: r.tree_id for r in selection.roulette(spark.createDataFrame(scores, "tree_id long, fitness double"), spark.createDataFrame(drawn, "draw long, u double"), cut).collect()}
        assert len(got) == 302 and sum(got[d] != want.get(d) for d in got) <= 2  # sums in another order may move a border by a bit


def test_permuted_trees(spark):
    nodes = small_trees(spark, 9)
    got = variation.permuted(nodes, 4)
    shape = lambda df: sorted((r.node_idx, r.p3, r.p4, r.parent_idx) for r in df.collect())
    assert shape(got) == shape(nodes) and {r.tree_id for r in got.collect()} == set(range(9))
    order = [r.p3 for r in got.where("node_idx = 5").orderBy("tree_id").collect()]
    assert order != sorted(order) and sorted(order) == sorted(r.p3 for r in nodes.where("node_idx = 5").collect())
    assert variation.permuted(nodes, 4).exceptAll(got).count() == 0


def metrics_by_force(profits):
    total = peak = drop = 0.0
    compound = 1.0
    for p in profits:
        total += p
        peak = max(peak, total)
        drop = max(drop, peak - total)
        compound *= 1 + p
    return drop, compound, total


@pytest.mark.parametrize("cut", [1, 17, 400])
def test_metrics_over_segments(spark, cut):
    """Drawdowns that begin and end in different segments, and a tree that holds most rows."""
    x = random.Random(cut)
    rows = [(0 if x.random() < 0.7 else x.randrange(1, 6), k, x.choice([None, 0.0, x.uniform(-0.1, 0.09)])) for k in range(300)]
    found = {r.tree_id: r for r in simulator.metrics(spark.createDataFrame(rows, "tree_id long, bar long, profit double"), segments=cut).collect()}
    for t in {t for t, _, _ in rows}:
        p = [v for i, _, v in rows if i == t and v is not None]
        drop, compound, total = metrics_by_force(p)
        n = sum(v != 0 for v in p)
        assert (found[t].n, found[t].n_losses) == (n, sum(v < 0 for v in p))
        assert [found[t].max_drawdown, found[t].compound_value, found[t].mean_return, found[t].sum_squares] == pytest.approx([drop, compound, total / n, sum(v * v for v in p)])
    plan = simulator.metrics(spark.createDataFrame(rows, "tree_id long, bar long, profit double"))._jdf.queryExecution().executedPlan().toString()
    assert all("_segment" in line for line in plan.splitlines() if "Window [" in line)


def test_intervals_are_all_known():
    assert bars.ordered_intervals(["1d", "5m", "1w", "1M", "5m"]) == ["5m", "1d", "1w", "1M"]
    with pytest.raises(ValueError, match="7x"):
        bars.ordered_intervals(["5m", "7x"])
