"""The catalogue of indicators, each a function of its parameters that gives a Feature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import folds
from .features import Feature, Fold, col, feature, frame, full, highest, lag, lag_of, lowest, mean, total, whole

EPS = 1e-9


def _number(x: float) -> str:
    return f"{x:g}" if isinstance(x, float) and x != int(x) else str(x)


# Prices and trends


@feature
def price_change_features() -> Feature:
    o, c, h, low = col("open"), col("close"), col("high"), col("low")
    return Feature({
        "close_change_pct": F.coalesce((c / lag("close") - 1) * 100, F.lit(0.0)), "body_size": F.abs(o - c), "upper_wick_size": h - F.greatest(o, c),
        "lower_wick_size": F.least(o, c) - low, "total_range": h - low, "body_to_range_ratio": F.abs(o - c) / (h - low + EPS),
    })


@feature
def ma(window: int) -> Feature:
    return Feature({f"SMA_{window}": full(window, mean("close", window))})


def _fold(names: list[str], run, levels: list | None = None, outputs: dict | None = None) -> Feature:
    return Feature(outputs or {n: col(n) for n in names}, levels or [], [Fold(names, run)])


@feature
def ema(window: int) -> Feature:
    return _fold([f"EMA_{window}"], lambda s: [folds.ema(s, s["close"], window)])


@feature
def vwma(window: int) -> Feature:
    weighted = F.sum(col("close") * col("volume")).over(frame(window))
    return Feature({f"VWMA_{window}": full(window, weighted / (total("volume", window) + EPS))})


@feature
def macd(short_window: int, long_window: int, signal_window: int) -> Feature:
    pair, three = f"{short_window}_{long_window}", f"{short_window}_{long_window}_{signal_window}"
    return _fold([f"MACD_{pair}", f"MACD_Signal_{three}", f"MACD_Hist_{three}"], lambda s: folds.macd(s, s["close"], short_window, long_window, signal_window))


@feature
def adx(window: int) -> Feature:
    return _fold([f"ADX_{window}", f"DI_plus_{window}", f"DI_minus_{window}"], lambda s: folds.adx(s, s["high"], s["low"], s["close"], window))


@feature
def ichimoku(short_window: int = 9, mid_window: int = 26, long_window: int = 52) -> Feature:
    def middle(n: int) -> Column:
        return full(n, (highest("high", n) + lowest("low", n)) / 2)

    t, k, b = f"Ichimoku_Tenkan_{short_window}", f"Ichimoku_Kijun_{mid_window}", f"_ichimoku_b_{long_window}"
    return Feature(
        {t: col(t), k: col(k), f"Ichimoku_SenkouA_{short_window}_{mid_window}": lag_of((col(t) + col(k)) / 2, mid_window), f"Ichimoku_SenkouB_{long_window}": lag(b, mid_window), f"Ichimoku_Chikou_Ratio_{mid_window}": col("close") / (lag("close", mid_window) + EPS)},
        [{t: middle(short_window), k: middle(mid_window), b: middle(long_window)}],
    )


def _again(s, window: int, times: int) -> list:
    out, x = [], s["close"]
    for _ in range(times):
        x = folds.ema(s, x, window)
        out.append(x)
    return out


@feature
def dema(window: int) -> Feature:
    def run(s):
        one, two = _again(s, window, 2)
        return [2 * one - two]

    return _fold([f"DEMA_{window}"], run)


@feature
def tema(window: int) -> Feature:
    def run(s):
        one, two, three = _again(s, window, 3)
        return [3 * one - 3 * two + three]

    return _fold([f"TEMA_{window}"], run)


@feature
def sar(acceleration: float, maximum: float) -> Feature:
    return _fold([f"SAR_{_number(acceleration)}_{_number(maximum)}"], lambda s: [folds.sar(s, s["high"], s["low"], acceleration, maximum)])


@feature
def trima(window: int) -> Feature:
    first, second = ((window + 1) // 2,) * 2 if window % 2 else (window // 2, window // 2 + 1)
    inner = f"_trima_{window}"
    return Feature({f"TRIMA_{window}": whole(inner, second, mean(inner, second))}, [{inner: full(first, mean("close", first))}])


# Momentum


@feature
def rsi(window: int) -> Feature:
    return _fold([f"RSI_{window}"], lambda s: [folds.rsi(s, s["close"], window)])


def _stoch(n: int) -> Column:
    top, bottom = highest("high", n), lowest("low", n)
    return full(n, F.when(top == bottom, 0.0).otherwise(100 * (col("close") - bottom) / F.nullif(top - bottom, F.lit(0.0))))


@feature
def stochastic_oscillator(k_window: int, d_window: int) -> Feature:
    fast, slow, name = f"_fastk_{k_window}", f"_slowk_{k_window}_{d_window}", f"{k_window}_{d_window}"
    second = whole(slow, d_window, mean(slow, d_window))
    return Feature(
        {f"%K_{name}": F.when(second.isNotNull(), col(slow)), f"%D_{name}": second},
        [{fast: _stoch(k_window)}, {slow: whole(fast, d_window, mean(fast, d_window))}],
    )


@feature
def williams_r(window: int) -> Feature:
    top, bottom = highest("high", window), lowest("low", window)
    return Feature({f"Williams_R_{window}": full(window, F.when(top == bottom, 0.0).otherwise(-100 * (top - col("close")) / F.nullif(top - bottom, F.lit(0.0))))})


@feature
def cci(window: int) -> Feature:
    typical = f"_typical_{window}"
    values = F.collect_list(col(typical)).over(frame(window))
    name_m, name_v = f"_cci_mean_{window}", f"_cci_values_{window}"
    spread = F.aggregate(col(name_v), F.lit(0.0), lambda a, x: a + F.abs(x - col(name_m))) / window
    above = col(typical) - col(name_m)
    return Feature(
        {f"CCI_{window}": full(window, F.when((above == 0) | (spread == 0), 0.0).otherwise(above / F.nullif(0.015 * spread, F.lit(0.0))))},
        [{typical: (col("high") + col("low") + col("close")) / 3}, {name_m: mean(typical, window), name_v: values}],
    )


@feature
def stochrsi(window: int = 14, k_window: int = 5, d_window: int = 3) -> Feature:
    name = f"{window}_{k_window}_{d_window}"
    return _fold([f"STOCHRSI_K_{name}", f"STOCHRSI_D_{name}"], lambda s: folds.stoch_rsi(s, s["close"], window, k_window, d_window))


@feature
def ppo(fast_window: int, slow_window: int) -> Feature:
    fast, slow = mean("close", fast_window), mean("close", slow_window)
    return Feature({f"PPO_{fast_window}_{slow_window}": full(max(fast_window, slow_window), F.when(slow == 0, 0.0).otherwise(100 * (fast - slow) / F.nullif(slow, F.lit(0.0))))})


@feature
def roc(window: int) -> Feature:
    before = lag("close", window)
    return Feature({f"ROC_{window}": F.when(before == 0, 0.0).otherwise(100 * (col("close") / F.nullif(before, F.lit(0.0)) - 1))})


@feature
def ultosc(window1: int, window2: int, window3: int) -> Feature:
    before, bp, tr = lag("close"), "_ult_bp", "_ult_tr"
    low = F.least(col("low"), before)
    share = lambda n: F.when(total(tr, n) == 0, 0.0).otherwise(total(bp, n) / F.nullif(total(tr, n), F.lit(0.0)))
    a, b, c = sorted((window1, window2, window3))
    value = 100 * (4 * share(a) + 2 * share(b) + share(c)) / 7
    real = {bp: F.when(before.isNotNull(), col("close") - low), tr: F.when(before.isNotNull(), F.greatest(col("high"), before) - low)}
    return Feature({f"ULTOSC_{window1}_{window2}_{window3}": full(c + 1, value)}, [real])


@feature
def mom(window: int) -> Feature:
    return Feature({f"MOM_{window}": col("close") - lag("close", window)})


# Volatility, volume, cycles, support and resistance


@feature
def bollinger_bands(window: int, num_std: float = 2) -> Feature:
    name, middle = f"{window}_{_number(num_std)}", mean("close", window)
    width = F.stddev_pop("close").over(frame(window)) * float(num_std)
    return Feature({f"BB_Upper_{name}": full(window, middle + width), f"BB_Mid_{name}": full(window, middle), f"BB_Lower_{name}": full(window, middle - width), f"BB_Width_{name}": full(window, ((middle + width) - (middle - width)) / (middle + EPS))})


@feature
def atr(window: int) -> Feature:
    return _fold([f"ATR_{window}"], lambda s: [folds.atr(s, s["high"], s["low"], s["close"], window)])


@feature
def natr(window: int) -> Feature:
    base = atr(window)
    return Feature({f"NATR_{window}": F.when(col("close") != 0, 100 * col(f"ATR_{window}") / F.nullif(col("close"), F.lit(0.0)))}, [], base.folds)


def _flow(s) -> np.ndarray:
    return folds.flow(s["high"], s["low"], s["close"], s["volume"])


@feature
def obv() -> Feature:
    return _fold(["OBV"], lambda s: [folds.obv(s, s["close"], s["volume"])])


@feature
def cmf(window: int) -> Feature:
    flow = ((col("close") - col("low")) - (col("high") - col("close"))) / (col("high") - col("low") + EPS) * col("volume")
    return Feature({f"CMF_{window}": full(window, F.sum(flow).over(frame(window)) / (total("volume", window) + EPS))})


@feature
def ad() -> Feature:
    return _fold(["AD"], lambda s: [s.total(_flow(s))])


@feature
def adosc(fast_window: int, slow_window: int) -> Feature:
    return _fold([f"ADOSC_{fast_window}_{slow_window}"], lambda s: [folds.adosc(s, s.total(_flow(s), strict=True), fast_window, slow_window)])


def _hilbert(*names: str) -> Feature:
    every = ["HT_DCPERIOD", "HT_SINE", "HT_LEADSINE", "HT_TRENDMODE"]
    hidden = [f"_{n}" for n in every]
    shown = {n: col(f"_{n}").cast("int") if n == "HT_TRENDMODE" else col(f"_{n}") for n in names}
    return Feature(shown, [], [Fold(hidden, lambda s: list(folds.hilbert(s, s["close"]).values()))])


@feature
def ht_dcperiod() -> Feature:
    return _hilbert("HT_DCPERIOD")


@feature
def ht_trendmode() -> Feature:
    return _hilbert("HT_TRENDMODE")


@feature
def ht_sine() -> Feature:
    return _hilbert("HT_SINE", "HT_LEADSINE")


@feature
def support_resistance(window: int) -> Feature:
    h, low, c = lag("high"), lag("low"), lag("close")
    p = (h + low + c) / 3
    return Feature({
        f"Support_MA_{window}": full(window, lowest("low", window)), f"Resistance_MA_{window}": full(window, highest("high", window)), f"Pivot_Point_{window}": p,
        f"Support1_Pivot_{window}": 2 * p - h, f"Support2_Pivot_{window}": p - (h - low), f"Resistance1_Pivot_{window}": 2 * p - low, f"Resistance2_Pivot_{window}": p + (h - low),
    })


# Composites: they bring the indicators that they are made of


def _on(bases: list[Feature], outputs: dict[str, Column], level: dict[str, Column] | None = None) -> Feature:
    """outputs over the outputs of bases, which stay hidden helpers of the plan."""
    depth = max((len(b.levels) for b in bases), default=0)
    levels = [{n: c for b in bases if len(b.levels) > k for n, c in b.levels[k].items()} for k in range(depth)]
    made = {n: c for f in bases for n, c in f.outputs.items() if n not in {x for fold in f.folds for x in fold.names} and not any(n in lv for lv in levels)}
    return Feature(outputs, [*levels, *([made] if made else []), *([level] if level else [])], [f for b in bases for f in b.folds])


@feature
def rsi_adx_ratio(rsi_window: int, adx_window: int) -> Feature:
    return _on([rsi(rsi_window), adx(adx_window)], {f"RSI_ADX_Ratio_{rsi_window}_{adx_window}": col(f"RSI_{rsi_window}") / (col(f"ADX_{adx_window}") + EPS)})


@feature
def macd_atr_ratio(short_window: int, long_window: int, signal_window: int, atr_window: int) -> Feature:
    return _on([macd(short_window, long_window, signal_window), atr(atr_window)], {f"MACD_ATR_Ratio_{short_window}_{long_window}_{atr_window}": col(f"MACD_{short_window}_{long_window}") / (col(f"ATR_{atr_window}") + EPS)})


def _named(indicator: str, window: int) -> tuple[Feature, str] | None:
    """The indicator that a column prefix stands for; None if its parameters can't be told from one window."""
    makers = {"RSI": rsi, "ADX": adx, "ATR": atr, "NATR": natr, "CCI": cci, "SMA": ma, "EMA": ema, "VWMA": vwma, "ROC": roc, "MOM": mom, "CMF": cmf, "Williams_R": williams_r, "DEMA": dema, "TEMA": tema, "TRIMA": trima}
    if indicator == "BB_Width":
        return bollinger_bands(window, 2), f"BB_Width_{window}_2"
    if indicator in makers:
        return makers[indicator](window), f"{indicator}_{window}"
    return None


@feature
def short_long_ratio(indicator_name: str, short_window: int, long_window: int) -> Feature:
    found = [_named(indicator_name, w) for w in (short_window, long_window)]
    if None in found:
        return Feature({})
    (a, short), (b, long) = found
    return _on([a, b], {f"{indicator_name}_Ratio_{short_window}_{long_window}": col(short) / (col(long) + EPS)})


@feature
def indicator_roc(indicator_name: str, indicator_window: int | str, roc_period: int) -> Feature:
    name = f"{indicator_name}_{indicator_window}"
    parts = str(indicator_window).split("_")
    if indicator_name == "MACD_Hist" and len(parts) == 3:
        base = macd(*map(int, parts))
    elif len(parts) == 1 and (found := _named(indicator_name, int(parts[0]))):
        base, name = found
    else:
        return Feature({})
    before = lag(name, roc_period)
    return _on([base], {f"{indicator_name}_ROC_{indicator_window}_{roc_period}": (col(name) - before) / (F.abs(before) + EPS) * 100})


@feature
def volume_spike(window: int, factor: float) -> Feature:
    return Feature({f"Volume_Spike_{window}_{factor}": F.coalesce(full(window, col("volume") > mean("volume", window) * factor), F.lit(False))})


@feature
def consecutive_candles(period: int, direction: str) -> Feature:
    if direction not in ("bullish", "bearish"):
        return Feature({})
    hit = col("close") > col("open") if direction == "bullish" else col("close") < col("open")
    return Feature({f"Consecutive_{direction.title()}_{period}": F.coalesce(F.sum(hit.cast("int")).over(frame(period)) == period, F.lit(False))})


@feature
def confirmation_signal(rsi_window: int, adx_window: int, macd_short: int, macd_long: int, rsi_threshold: float, adx_threshold: float, direction: str) -> Feature:
    if direction not in ("bullish", "bearish"):
        return Feature({})
    r, m = col(f"RSI_{rsi_window}"), col(f"MACD_{macd_short}_{macd_long}")
    side = (r > rsi_threshold) & (m > 0) if direction == "bullish" else (r < rsi_threshold) & (m < 0)
    hit = F.coalesce((col(f"ADX_{adx_window}") > adx_threshold) & side, F.lit(False))
    return _on([rsi(rsi_window), adx(adx_window), macd(macd_short, macd_long, 9)], {f"{direction.title()}_Confirmation_{rsi_window}_{adx_window}": hit})
