"""Trading simulation of predicted actions, and what is measured of it."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import trees as T
from .segments import SEGMENT, segmented

FLAT, SHORT, LONG = 0, -1, 1
BRANCH = {LONG: T.LONG, FLAT: T.HOLD, SHORT: T.SHORT}
#: What metrics without trades are, so that they sort last.
WORST = -1e9


@dataclass(frozen=True)
class Market:
    """Rates of fees, maintenance margin and slippage; limits of added positions.  capped_funding charges
    each of the three daily fundings at most once between two bars, however far apart they are."""

    fee: float = 0.0004
    maintenance: float = 0.005
    slippage: float = 0.0005
    min_added: float = 0.05
    max_added: int = 5
    capped_funding: bool = False


def fundings_between(before: int, now: int, capped: bool) -> int:
    """8-hour boundaries in (before, now], both in epoch seconds; capped: as Market says."""
    if not capped:
        return now // 28800 - before // 28800
    day = before // 86400 * 86400
    return sum(any(before < day + 28800 * h + 86400 * k <= now for k in (0, 1)) for h in range(3))


def simulate_series(bars: list[tuple], actions: list[list[tuple]], market: Market) -> list[tuple]:
    """(position, ratio, leverage, profit, compound, held) after each bar but the last.

    bars: (epoch seconds, open, high, low, funding rate); actions: for each bar and branch (action, ratio, leverage)."""
    side, price, lever, ratio, added, held, compound = FLAT, -1.0, -1, 0.0, 0, 0, 1.0
    out = []
    for i in range(len(bars) - 1):
        when, _, high, low, rate = bars[i]
        action, want, wanted_lever = actions[i][BRANCH[side]]
        profit = 0.0
        if i and side and rate:
            profit -= side * rate * lever * ratio * fundings_between(bars[i - 1][0], when, market.capped_funding)
        if side:
            worst = low if side == LONG else high
            if ratio * (1 + side * (worst - price) / price * lever) <= ratio * lever * market.maintenance:
                profit -= ratio
                side, price, lever, ratio, added = FLAT, -1.0, -1, 0.0, 0
        next_open = bars[i + 1][1]
        buy, sell = next_open * (1 + market.slippage), next_open * (1 - market.slippage)
        leaving = sell if side == LONG else buy
        gain = side * (leaving - price) / price * lever if side else 0.0
        size = want or 0.0
        if not next_open > 0:  # nothing can be traded at such a price
            action = 0
        if side == FLAT and action in (T.NEW_LONG, T.NEW_SHORT):
            side = LONG if action == T.NEW_LONG else SHORT
            price, lever, ratio, added = buy if side == LONG else sell, int(wanted_lever or 1), size, 0
            profit -= ratio * lever * market.fee
        elif side and action == T.CLOSE_ALL:
            profit += ratio * gain - ratio * lever * market.fee
            side, price, lever, ratio, added = FLAT, -1.0, -1, 0.0, 0
        elif side and action == T.CLOSE_PARTIAL:
            part = ratio * size
            profit += part * gain - part * lever * market.fee
            ratio -= part
            if ratio <= 1e-12:
                side, price, lever, ratio, added = FLAT, -1.0, -1, 0.0, 0
        elif side and action == T.ADD_POSITION:
            more = min(size, 1 - ratio)
            if more > market.min_added and added < market.max_added:
                entry = buy if side == LONG else sell
                price = (price * ratio + entry * more) / (ratio + more)
                ratio, added = ratio + more, added + 1
                profit -= more * lever * market.fee
        elif side and action == T.FLIP_POSITION:
            profit += ratio * gain - ratio * lever * market.fee
            side = -side
            price, lever, ratio, added = buy if side == LONG else sell, int(wanted_lever or 1), size, 0
            profit -= ratio * lever * market.fee
        held = held + 1 if side else 0
        compound *= 1 + profit
        out.append((side, ratio, lever if side else 0, profit, compound, held))
    return out


def simulate(predictions: DataFrame, bars: DataFrame, market: Market = Market(), series: tuple[str, ...] = ()) -> DataFrame:
    """(series..., tree_id, bar, position, ratio, leverage, profit, compound, held) for each tree and bar but a series' last.

    predictions: see predict; bars: (series..., bar, ts, open, high, low[, funding_rate]).  Each tree's bars of a series are
    folded in order by one task; trees and series are independent, so work spreads over both."""
    branches = [*series, "tree_id", "bar"] + [f"{k}{b}" for b in range(3) for k in ("a", "r", "l")]
    pick = [F.max(F.when(F.col("branch") == b, F.col(c))).alias(f"{k}{b}") for b in range(3) for k, c in (("a", "action"), ("r", "ratio"), ("l", "leverage"))]
    rate = F.coalesce("funding_rate", F.lit(0.0)) if "funding_rate" in bars.columns else F.lit(0.0)
    prices = bars.select(*series, "bar", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "open", "high", "low", rate.alias("rate"))
    rows = predictions.groupBy(*series, "tree_id", "bar").agg(*pick).select(branches).join(prices, [*series, "bar"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar")
        clean = rows.fillna({f"{k}{b}": 0 for k in "arl" for b in range(3)})
        bars = list(zip((clean.us // 1_000_000).tolist(), clean.open.tolist(), clean.high.tolist(), clean.low.tolist(), clean.rate.tolist(), strict=True))
        acts = list(zip(*(list(zip(clean[f"a{b}"].tolist(), clean[f"r{b}"].tolist(), clean[f"l{b}"].tolist(), strict=True)) for b in range(3)), strict=True))
        found = simulate_series(bars, acts, market)
        made = pd.DataFrame(found, columns=["position", "ratio", "leverage", "profit", "compound", "held"])
        return made.assign(**{c: rows[c].iloc[0] for c in (*series, "tree_id")}, bar=rows.bar.to_numpy()[: len(found)])

    keys = "".join(f"{c} {dict(bars.dtypes)[c]}, " for c in series)
    return rows.groupBy(*series, "tree_id").applyInPandas(run, f"{keys}tree_id long, bar long, position int, ratio double, leverage int, profit double, compound double, held int")


def metrics(profits: DataFrame, minimum: int = 1, segments: int | None = None) -> DataFrame:
    """(tree_id, n, mean_return, profit_factor, win_rate, max_drawdown, compound_value) of (tree_id, bar, profit).

    bar may be anything that orders a tree's profits, such as a bar and a symbol.  Only bars with a profit or loss
    count.  Drawdown is that of the summed profit from its highest value so far, 0 at the start.  Trees with fewer than
    minimum such bars have null metrics.

    A tree's bars are cut into segments.  A segment's part of a tree comes down to its sum, its highest and lowest sum so
    far and its largest drop, which combine in order; all other sums and products need none."""
    p = F.col("profit")
    cut = segmented(profits.where("profit IS NOT NULL").select("tree_id", "bar", "profit"), ["tree_id"], ["bar"], segments)
    so_far = Window.partitionBy("tree_id", SEGMENT).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("cum", F.sum(p).over(so_far))
    rows = rows.withColumn("drop", F.greatest(F.lit(0.0), F.max("cum").over(so_far)) - F.col("cum"))
    sums = {
        "n": F.count_if(p != 0), "wins": F.count_if(p > 0), "total": F.sum(p), "gains": F.sum(F.greatest(p, F.lit(0.0))), "losses": F.sum(F.greatest(-p, F.lit(0.0))), "sum_squares": F.sum(p * p),
        "sum_losses": F.sum(F.least(p, F.lit(0.0))), "n_losses": F.count_if(p < 0), "sum_square_losses": F.sum(F.when(p < 0, p * p).otherwise(0.0)), "compound_value": F.product(1 + p),
    }
    parts = rows.groupBy("tree_id", SEGMENT).agg(*[x.alias(c) for c, x in sums.items()], F.greatest(F.lit(0.0), F.max("cum")).alias("top"), F.min("cum").alias("bottom"), F.max("drop").alias("drop"))
    merged = [F.product(c).alias(c) if c == "compound_value" else F.sum(c).alias(c) for c in sums]
    whole = parts.groupBy("tree_id").agg(*merged, F.sort_array(F.collect_list(F.struct(SEGMENT, "total", "top", "bottom", "drop"))).alias("parts"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("top"), F.lit(0.0).alias("drop"))
    combine = lambda a, b: F.struct(
        (a["total"] + b["total"]).alias("total"), F.greatest(a["top"], a["total"] + b["top"]).alias("top"), F.greatest(a["drop"], b["drop"], a["top"] - a["total"] - b["bottom"]).alias("drop")
    )
    n = F.nullif(F.col("n"), F.lit(0))
    found = whole.select(
        "tree_id", "n", (F.col("total") / n).alias("mean_return"), F.when(F.col("losses") > 0, F.least(F.col("gains") / (F.col("losses") + 1e-9), F.lit(100.0))).otherwise(100.0).alias("profit_factor"),
        (F.col("wins") / n).alias("win_rate"), F.aggregate("parts", start, combine)["drop"].alias("max_drawdown"), "compound_value", "sum_squares", "sum_losses", "n_losses", "sum_square_losses",
    )
    keep = F.col("n") >= minimum
    return found.select("tree_id", "n", *[F.when(keep, F.col(c)).alias(c) for c in found.columns[2:]])


#: Weights of the metrics in the fitness, in this order.
WEIGHTS = {"mean_return": 0.1, "profit_factor": 0.2, "win_rate": 0.15, "max_drawdown": 0.15, "compound_value": 0.4}


def fitness(measured: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(tree_id, fitness): weighted sum of the metrics scaled to 0..1 over the population.

    A metric that is the same for all counts one half; drawdown counts inverted; trees without metrics get -1.
    The extremes come from one small aggregate, so no row waits for a global window."""
    ends = measured.agg(*[f(m).alias(f"{n}_{m}") for m in weights for n, f in (("lo", F.min), ("hi", F.max))])
    parts = []
    for m, w in weights.items():
        lo, hi = F.col(f"lo_{m}"), F.col(f"hi_{m}")
        share = F.when(hi == lo, 0.5).otherwise((F.col(m) - lo) / F.nullif(hi - lo, F.lit(0.0)))
        parts.append(w * (1 - share if m == "max_drawdown" else share))
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return measured.join(F.broadcast(ends), how="cross").select("tree_id", F.coalesce(F.when(F.col("mean_return").isNotNull(), total), F.lit(-1.0)).alias("fitness"))
