"""DuckDB SQL for the engine's queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from . import variation_oracles
from .functions.candles import PATTERNS
from .functions.registry import RULES

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"""


def bars_cte(name: str, interval: str) -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM (
    SELECT symbol, time_bucket(INTERVAL '{interval}', ts) AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
           last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume
    FROM ticks WHERE price IS NOT NULL GROUP BY symbol, time_bucket(INTERVAL '{interval}', ts)))"""


BARS = f"{TICKS},\n{bars_cte('bars', '30 minutes')}"
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
S = "OVER (PARTITION BY symbol ORDER BY ts)"


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n: int, x: str) -> str:
    return f"CASE WHEN rn >= {n} THEN {x} END"


def whole(n: int, c: str, x: str) -> str:
    return f"CASE WHEN count({c}) {over(n)} = {n} THEN {x} END"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) {S}"


def feature(outputs: dict[str, str], *levels: dict[str, str], source: str = "bars", ctes: tuple[str, ...] = (), recursive: bool = False) -> str:
    """SQL that adds each level's columns in turn and then gives the outputs, rounded where they are no booleans."""
    parts, at = [BARS, *ctes], source
    for k, level in enumerate(levels):
        parts.append(f"level{k} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in level.items())} FROM {at})")
        at = f"level{k}"
    shown = ", ".join(f'{x[1:]} AS "{n}"' if x.startswith("=") else f'round({x}, 6) AS "{n}"' for n, x in outputs.items())
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + f"\nSELECT symbol, {STAMP}, {shown} FROM {at}"


def fold(name: str, source: str, x: str, n: int, keep: float, take: float, seed: str = "avg", at: str | None = None) -> str:
    """CTEs for name(symbol, rn, v): v seeded over n values of x (up to row at), then keep * v + take * x."""
    start = at or f"min(rn) FILTER ({x} IS NOT NULL) + {n - 1}"
    return f"""{name}_at AS (SELECT symbol, {start} AS r FROM {source} GROUP BY symbol),
{name}(symbol, rn, v) AS (
  SELECT b.symbol, a.r, {seed}({x}) FROM {source} b JOIN {name}_at a ON b.symbol = a.symbol AND b.rn BETWEEN a.r - {n - 1} AND a.r
  GROUP BY b.symbol, a.r HAVING count({x}) = {n} AND max(b.rn) = a.r
  UNION ALL SELECT b.symbol, b.rn, {keep!r} * e.v + {take!r} * {x} FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"""


def ema(name: str, source: str, x: str, n: int, at: str | None = None) -> str:
    return fold(name, source, x, n, 1 - 2 / (n + 1), 2 / (n + 1), at=at)


def wilder(name: str, source: str, x: str, n: int) -> str:
    return fold(name, source, x, n, (n - 1) / n, 1 / n)


def wilder_sum(name: str, source: str, x: str, n: int) -> str:
    return fold(name, source, x, n - 1, 1 - 1 / n, 1.0, seed="sum")


def joined(name: str, source: str, columns: dict[str, str]) -> str:
    """source with the v of folds as columns."""
    joins = " ".join(f"LEFT JOIN {f} ON {f}.symbol = s.symbol AND {f}.rn = s.rn" for f in columns.values())
    return f"{name} AS (SELECT s.*, {', '.join(f'{f}.v AS {c}' for c, f in columns.items())} FROM {source} s {joins})"


_CHANGE = "moves AS (SELECT *, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down, CASE WHEN rn > 1 THEN greatest(high, lag(close) OVER w) - least(low, lag(close) OVER w) END AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
_CHANGE = _CHANGE.replace("greatest(close - lag(close) OVER w, 0)", "CASE WHEN rn > 1 THEN greatest(close - lag(close) OVER w, 0) END").replace("greatest(lag(close) OVER w - close, 0)", "CASE WHEN rn > 1 THEN greatest(lag(close) OVER w - close, 0) END")


def rsi(n: int, name: str = "rsi") -> tuple[tuple[str, ...], str]:
    """CTEs up to {name}s with the column {name}."""
    r = f"CASE WHEN g IS NULL THEN NULL WHEN g + d = 0 THEN 0 ELSE 100 * g / (g + d) END AS {name}"
    return (wilder(f"{name}_g", "moves", "up", n), wilder(f"{name}_d", "moves", "down", n), joined(f"{name}_j", "moves", {"g": f"{name}_g", "d": f"{name}_d"}), f"{name}s AS (SELECT * EXCLUDE (g, d), {r} FROM {name}_j)")


_DM = "dms AS (SELECT *, CASE WHEN rn > 1 THEN CASE WHEN hu > ld AND hu > 0 THEN hu ELSE 0 END END AS plus, CASE WHEN rn > 1 THEN CASE WHEN ld > hu AND ld > 0 THEN ld ELSE 0 END END AS minus FROM (SELECT *, high - lag(high) OVER w AS hu, lag(low) OVER w - low AS ld FROM moves WINDOW w AS (PARTITION BY symbol ORDER BY ts)))"


def adx(n: int) -> tuple[str, ...]:
    """CTEs up to adxs with adx, di_plus and di_minus."""
    di = lambda x: f"CASE WHEN rn > {n} THEN CASE WHEN t = 0 THEN 0 ELSE 100 * {x} / t END END"
    return (
        _DM, wilder_sum("st", "dms", "tr", n), wilder_sum("sp", "dms", "plus", n), wilder_sum("sm", "dms", "minus", n), joined("dij", "dms", {"t": "st", "p": "sp", "m": "sm"}),
        f"dis AS (SELECT * EXCLUDE (t, p, m), {di('p')} AS di_plus, {di('m')} AS di_minus FROM dij)",
        "dxs AS (SELECT *, CASE WHEN di_plus IS NOT NULL THEN CASE WHEN di_plus + di_minus = 0 THEN 0 ELSE 100 * abs(di_plus - di_minus) / (di_plus + di_minus) END END AS dx FROM dis)",
        wilder("adxf", "dxs", "dx", n), joined("adxs", "dxs", {"adx": "adxf"}),
    )


def macd(short: int, long: int, signal: int) -> tuple[str, ...]:
    """CTEs up to macds with line, sig and hist."""
    at = f"CASE WHEN count(*) >= {long} THEN {long} END"
    return (
        ema("mf", "bars", "close", short, at), ema("ms", "bars", "close", long, at), joined("mj", "bars", {"f": "mf", "s_": "ms"}), "ml AS (SELECT *, f - s_ AS raw FROM mj)",
        ema("mg", "ml", "raw", signal), joined("mk", "ml", {"sig": "mg"}), "macds AS (SELECT *, CASE WHEN sig IS NOT NULL THEN raw END AS line, raw - sig AS hist FROM mk)",
    )


def fed(outputs: dict[str, str], source: str, *ctes: str) -> str:
    return feature(outputs, source=source, ctes=ctes, recursive=True)


def _atr(n: int, source: str = "moves") -> tuple[str, ...]:
    return (wilder("atrf", source, "tr", n), joined("atrs", source, {"atr": "atrf"}))


_SAFE_LOW, _TP = "least(low, lag(close) OVER w)", "(high + low + close) / 3"
_STEP = "CASE WHEN high - low > 0 THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END"
_AD = f"ads AS (SELECT *, sum({_STEP}) {S} AS ad FROM bars)"


def _flat(top: str, bottom: str, x: str) -> str:
    return f"CASE WHEN {top} = {bottom} THEN 0 ELSE {x} END"


def _hh(n: int) -> str:
    return f"max(high) {over(n)}"


def _ll(n: int) -> str:
    return f"min(low) {over(n)}"


_MID = lambda n: full(n, f"({_hh(n)} + {_ll(n)}) / 2")
_U = lambda n: f"CASE WHEN sum(tr) {over(n)} = 0 THEN 0 ELSE sum(bp) {over(n)} / sum(tr) {over(n)} END"
_SD = f"stddev_pop(close) {over(20)}"
_BB = f"avg(close) {over(20)}"
_P = f"(({lag('high')}) + ({lag('low')}) + ({lag('close')})) / 3"

FEATURES: dict[str, str] = {
    "price_change": feature({
        "close_change_pct": f"coalesce((close / ({lag('close')}) - 1) * 100, 0)", "body_size": "abs(open - close)", "upper_wick_size": "high - greatest(open, close)",
        "lower_wick_size": "least(open, close) - low", "total_range": "high - low", "body_to_range_ratio": "abs(open - close) / (high - low + 1e-9)",
    }),
    "sma": feature({"SMA_20": full(20, f"avg(close) {over(20)}")}),
    "ema": fed({"EMA_20": "e"}, "j", ema("e1", "bars", "close", 20), joined("j", "bars", {"e": "e1"})),
    "vwma": feature({"VWMA_20": full(20, f"(sum(close * volume) {over(20)}) / ((sum(volume) {over(20)}) + 1e-9)")}),
    "macd": fed({"MACD_12_26": "line", "MACD_Signal_12_26_9": "CASE WHEN line IS NOT NULL THEN sig END", "MACD_Hist_12_26_9": "hist"}, "macds", *macd(12, 26, 9)),
    "adx": fed({"ADX_14": "adx", "DI_plus_14": "di_plus", "DI_minus_14": "di_minus"}, "adxs", _CHANGE, *adx(14)),
    "ichimoku": feature(
        {"Ichimoku_Tenkan_9": "t", "Ichimoku_Kijun_26": "k", "Ichimoku_SenkouA_9_26": lag("(t + k) / 2", 26), "Ichimoku_SenkouB_52": lag("b", 26), "Ichimoku_Chikou_Ratio_26": f"close / (({lag('close', 26)}) + 1e-9)"},
        {"t": _MID(9), "k": _MID(26), "b": _MID(52)},
    ),
    "dema": fed({"DEMA_20": "2 * a - b"}, "j2", ema("e1", "bars", "close", 20), joined("j1", "bars", {"a": "e1"}), ema("e2", "j1", "a", 20), joined("j2", "j1", {"b": "e2"})),
    "tema": fed({"TEMA_20": "3 * a - 3 * b + c"}, "j3", ema("e1", "bars", "close", 20), joined("j1", "bars", {"a": "e1"}), ema("e2", "j1", "a", 20), joined("j2", "j1", {"b": "e2"}), ema("e3", "j2", "b", 20), joined("j3", "j2", {"c": "e3"})),
    "trima": feature({"TRIMA_20": whole(11, "t", f"avg(t) {over(11)}")}, {"t": full(10, f"avg(close) {over(10)}")}),
    "rsi": fed({"RSI_14": "rsi"}, "rsis", _CHANGE, *rsi(14)),
    "stoch": feature(
        {"%K_14_3": f"CASE WHEN count(slow) {over(3)} = 3 THEN slow END", "%D_14_3": whole(3, "slow", f"avg(slow) {over(3)}")},
        {"fast": full(14, _flat(_hh(14), _ll(14), f"100 * (close - ({_ll(14)})) / (({_hh(14)}) - ({_ll(14)}))"))}, {"slow": whole(3, "fast", f"avg(fast) {over(3)}")},
    ),
    "williams_r": feature({"Williams_R_14": full(14, _flat(_hh(14), _ll(14), f"0 - 100 * (({_hh(14)}) - close) / (({_hh(14)}) - ({_ll(14)}))"))}),
    "cci": feature(
        {"CCI_20": full(20, "CASE WHEN tp - m = 0 OR dev = 0 THEN 0 ELSE (tp - m) / (0.015 * dev) END")},
        {"tp": _TP}, {"m": f"avg(tp) {over(20)}", "l": f"list(tp) {over(20)}"}, {"dev": "list_sum([abs(x - m) FOR x IN l]) / 20"},
    ),
    "stochrsi": fed(
        {"STOCHRSI_K_14_5_3": "CASE WHEN d IS NOT NULL THEN fast END", "STOCHRSI_D_14_5_3": "d"}, "sd", _CHANGE, *rsi(14),
        f"sk AS (SELECT *, {whole(5, 'rsi', _flat(f'max(rsi) {over(5)}', f'min(rsi) {over(5)}', f'100 * (rsi - (min(rsi) {over(5)})) / ((max(rsi) {over(5)}) - (min(rsi) {over(5)}))'))} AS fast FROM rsis)",
        f"sd AS (SELECT *, {whole(3, 'fast', f'avg(fast) {over(3)}')} AS d FROM sk)",
    ),
    "ppo": feature({"PPO_12_26": full(26, f"100 * ((avg(close) {over(12)}) - (avg(close) {over(26)})) / (avg(close) {over(26)})")}),
    "roc": feature({"ROC_10": f"100 * (close / ({lag('close', 10)}) - 1)"}),
    "ultosc": feature(
        {"ULTOSC_7_14_28": full(29, f"100 * (4 * ({_U(7)}) + 2 * ({_U(14)}) + ({_U(28)})) / 7")},
        {"bp": f"CASE WHEN rn > 1 THEN close - least(low, {lag('close')}) END", "tr": f"CASE WHEN rn > 1 THEN greatest(high, {lag('close')}) - least(low, {lag('close')}) END"},
    ),
    "mom": feature({"MOM_10": f"close - ({lag('close', 10)})"}),
    "bollinger": feature({"BB_Upper_20_2": full(20, f"({_BB}) + 2 * ({_SD})"), "BB_Mid_20_2": full(20, _BB), "BB_Lower_20_2": full(20, f"({_BB}) - 2 * ({_SD})"), "BB_Width_20_2": full(20, f"4 * ({_SD}) / (({_BB}) + 1e-9)")}),
    "atr": fed({"ATR_14": "atr"}, "atrs", _CHANGE, *_atr(14)),
    "natr": fed({"NATR_14": "CASE WHEN close <> 0 THEN 100 * atr / close END"}, "atrs", _CHANGE, *_atr(14)),
    "obv": feature({"OBV": f"sum(step) {S}"}, {"step": f"coalesce(sign(close - ({lag('close')})), 1) * volume"}),
    "cmf": feature({"CMF_20": full(20, f"(sum(((close - low) - (high - close)) / (high - low + 1e-9) * volume) {over(20)}) / ((sum(volume) {over(20)}) + 1e-9)")}),
    "ad": feature({"AD": "ad"}, source="ads", ctes=(_AD,)),
    "adosc": fed({"ADOSC_3_10": "CASE WHEN rn >= 10 THEN a - b END"}, "j", _AD, fold("f3", "ads", "ad", 1, 0.5, 0.5), fold("f10", "ads", "ad", 1, 1 - 2 / 11, 2 / 11), joined("j", "ads", {"a": "f3", "b": "f10"})),
    "support_resistance": feature({
        "Support_MA_20": full(20, _ll(20)), "Resistance_MA_20": full(20, _hh(20)), "Pivot_Point_20": _P, "Support1_Pivot_20": f"2 * {_P} - ({lag('high')})",
        "Support2_Pivot_20": f"{_P} - (({lag('high')}) - ({lag('low')}))", "Resistance1_Pivot_20": f"2 * {_P} - ({lag('low')})", "Resistance2_Pivot_20": f"{_P} + (({lag('high')}) - ({lag('low')}))",
    }),
    "rsi_adx_ratio": fed({"RSI_ADX_Ratio_14_14": "rsi / (adx + 1e-9)"}, "both_", _CHANGE, *rsi(14), *adx(14), "both_ AS (SELECT r.symbol, r.ts, r.rsi, a.adx FROM rsis r JOIN adxs a USING (symbol, ts))"),
    "macd_atr_ratio": fed({"MACD_ATR_Ratio_12_26_14": "line / (atr + 1e-9)"}, "both_", _CHANGE, *macd(12, 26, 9), *_atr(14), "both_ AS (SELECT m.symbol, m.ts, m.line, a.atr FROM macds m JOIN atrs a USING (symbol, ts))"),
    "short_long_ratio": fed({"RSI_Ratio_7_28": "r7 / (r28 + 1e-9)"}, "both_", _CHANGE, *rsi(7, "r7"), *rsi(28, "r28"), "both_ AS (SELECT a.symbol, a.ts, a.r7, b.r28 FROM r7s a JOIN r28s b USING (symbol, ts))"),
    "indicator_roc": fed({"RSI_ROC_14_5": f"(rsi - ({lag('rsi', 5)})) / (abs({lag('rsi', 5)}) + 1e-9) * 100"}, "rsis", _CHANGE, *rsi(14)),
    "volume_spike": feature({"Volume_Spike_20_2.0": "=" + f"coalesce({full(20, f'volume > (avg(volume) {over(20)}) * 2.0')}, false)"}),
    "consecutive": feature({"Consecutive_Bullish_3": "=" + f"coalesce(sum(CAST(close > open AS INT)) {over(3)} = 3, false)", "Consecutive_Bearish_3": "=" + f"coalesce(sum(CAST(close < open AS INT)) {over(3)} = 3, false)"}),
    "confirmation": fed(
        {"Bullish_Confirmation_14_14": "=coalesce(adx > 20 AND rsi > 50 AND line > 0, false)"}, "all_", _CHANGE, *rsi(14), *adx(14), *macd(12, 26, 9),
        "all_ AS (SELECT r.symbol, r.ts, r.rsi, a.adx, m.line FROM rsis r JOIN adxs a USING (symbol, ts) JOIN macds m USING (symbol, ts))",
    ),
}

_SHAPES = {"o": "open", "h": "high", "l": "low", "c": "close", "b": "abs(close - open)", "u": "high - greatest(open, close)", "w": "least(open, close) - low", "t": "greatest(open, close)", "m": "least(open, close)", "k": "CASE WHEN close >= open THEN 1 ELSE -1 END"}
_BEFORE = lambda n: f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
FEATURES["candles"] = feature(
    {n: f"=coalesce({rule}, false)" for n, rule in PATTERNS.items()},
    {f"z{k}": x for k, x in _SHAPES.items()},
    {"za": f"CASE WHEN rn > 10 THEN avg(zb) {_BEFORE(10)} END", "zr": f"CASE WHEN rn > 10 THEN avg(high - low) {_BEFORE(10)} END", "zn": f"CASE WHEN rn > 5 THEN avg(high - low) {_BEFORE(5)} END"},
    {f"{k}{n}": f"lag(z{k}, {n}) {S}" for k in [*_SHAPES, "a", "r", "n"] for n in range(5)},
)

_SAR = """prior AS (SELECT *, CASE WHEN rn = 2 THEN high ELSE lag(high) OVER w END AS ph, CASE WHEN rn = 2 THEN low ELSE lag(low) OVER w END AS pl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
begun AS (SELECT a.symbol, NOT (a.low - b.low > 0 AND a.low - b.low > b.high - a.high) AS up, a.high AS h0, a.low AS l0, b.high AS h1, b.low AS l1 FROM bars a JOIN bars b ON a.symbol = b.symbol AND a.rn = 1 AND b.rn = 2),
stops(symbol, rn, up, stop, best, speed, v) AS (
  SELECT symbol, 1::BIGINT, up, CASE WHEN up THEN l0 ELSE h0 END, CASE WHEN up THEN h1 ELSE l1 END, 0.02::DOUBLE, NULL::DOUBLE FROM begun
  UNION ALL SELECT symbol, rn, up2, CASE WHEN up2 THEN least(v + speed2 * (best2 - v), pl, low) ELSE greatest(v + speed2 * (best2 - v), ph, high) END, best2, speed2, v FROM (
    SELECT *, CASE WHEN hit THEN CASE WHEN up2 THEN high ELSE low END WHEN up THEN greatest(best, high) ELSE least(best, low) END AS best2,
      CASE WHEN hit THEN 0.02 WHEN (up AND high > best) OR (NOT up AND low < best) THEN least(speed + 0.02, 0.2) ELSE speed END AS speed2 FROM (
        SELECT *, up <> hit AS up2, CASE WHEN NOT hit THEN stop WHEN up THEN greatest(best, ph, high) ELSE least(best, pl, low) END AS v FROM (
          SELECT s.symbol, b.rn, s.up, s.stop, s.best, s.speed, b.high, b.low, b.ph, b.pl, CASE WHEN s.up THEN b.low <= s.stop ELSE b.high >= s.stop END AS hit
          FROM stops s JOIN prior b ON b.symbol = s.symbol AND b.rn = s.rn + 1))))"""
FEATURES["sar"] = fed({"SAR_0.02_0.2": "sar"}, "j", _SAR, joined("j", "bars", {"sar": "stops"}))

OTHER: dict[str, str] = {
    "ohlc_resample": f"WITH {BARS} SELECT symbol, {STAMP}, open, high, low, close, volume FROM bars",
    "daily_resample": """WITH t AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq, l_extendedprice / l_quantity AS price, l_quantity AS volume FROM lineitem)
SELECT symbol, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(arg_min(price, seq), 8) AS open, round(max(price), 8) AS high, round(min(price), 8) AS low, round(arg_max(price, seq), 8) AS close, sum(volume) AS volume
FROM t GROUP BY symbol, time_bucket(INTERVAL '1 day', ts)""",
    "asof_funding": f"""WITH {BARS},
funding AS (SELECT event_type AS symbol, time_bucket(INTERVAL '8 hours', ts) AS funding_ts, (avg(value) - 50) / 1e5 AS rate FROM events GROUP BY 1, 2)
SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, b.close, round(f.rate, 12) AS funding_rate FROM bars b ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.ts >= f.funding_ts""",
    "asof_multi_tf": f"""WITH {TICKS}, {bars_cte("bars", "30 minutes")}, {bars_cte("hours", "1 hour")}, {bars_cte("fours", "4 hours")}
SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, b.close AS close_30m, h.close AS close_1h, f.close AS close_4h
FROM bars b ASOF LEFT JOIN hours h ON b.symbol = h.symbol AND b.ts + INTERVAL '30 minutes' >= h.ts + INTERVAL '1 hour'
ASOF LEFT JOIN fours f ON b.symbol = f.symbol AND b.ts + INTERVAL '30 minutes' >= f.ts + INTERVAL '4 hours'""",
    "asof_multi_tf_compat": f"""WITH {TICKS}, {bars_cte("bars", "30 minutes")}, {bars_cte("hours", "1 hour")}
SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, b.close AS close_30m, h.close AS close_1h FROM bars b ASOF LEFT JOIN hours h ON b.symbol = h.symbol AND b.ts >= h.ts""",
    "flagship": f"""WITH {TICKS}, {bars_cte("bars", "30 minutes")}, {bars_cte("hours", "1 hour")},
f AS (SELECT *, {full(20, f"avg(close) {over(20)}")} AS sma, {full(20, f"(sum(close * volume) {over(20)}) / ((sum(volume) {over(20)}) + 1e-9)")} AS vwma, 100 * (close / ({lag("close", 10)}) - 1) AS roc FROM bars)
SELECT f.symbol, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS ts, f.close, round(f.sma, 6) AS "SMA_20", round(f.vwma, 6) AS "VWMA_20", round(f.roc, 6) AS "ROC_10", h.close AS close_1h
FROM f ASOF LEFT JOIN hours h ON f.symbol = h.symbol AND f.ts + INTERVAL '30 minutes' >= h.ts + INTERVAL '1 hour'""",
}

_NAMES = "['RSI_14_5m', '%K_14_3_5m', 'MACD_Signal_12_26_9_1h', 'MACD_12_26_1h', 'SMA_20_30m', 'EMA_20_30m', 'BB_Width_20_2_1h', 'BB_Width_Ratio_10_50_1h', 'HT_TRENDMODE_5m', 'Volume_Spike_20_2.0_5m', '3BlackCrows_1h', 'AD_5m', 'ADX_14_5m', 'ADOSC_3_10_5m', 'SAR_0.02_0.2_5m', 'unknown_1', 'SMA_20_30m']"
_RULES = ", ".join(f"('{p}', '{f}', {dict(bool=0, comparison=1, num=2)[f]}, {'NULL' if a is None else repr(a)}, {'NULL' if b is None else repr(b)})" for p, f, a, b in RULES)
_CLASSES = f"""n AS (SELECT concat_ws('_', {_NAMES}[event_id % 17 + 1], json_extract_string(props, '$.k')) AS feature FROM events), r(prefix, family, priority, low, high) AS (VALUES {_RULES}),
c AS (SELECT feature, family, prefix, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM (SELECT DISTINCT feature FROM n) LEFT JOIN r ON starts_with(feature, prefix)
      QUALIFY row_number() OVER (PARTITION BY feature ORDER BY priority, length(prefix) DESC) = 1)"""
OTHER |= {
    "classify": f"WITH {_CLASSES} SELECT feature, family, prefix, low, high FROM c",
    "feature_order": f"WITH {_CLASSES} SELECT feature, family, CAST(row_number() OVER (ORDER BY CASE family WHEN 'num' THEN 0 WHEN 'comparison' THEN 1 ELSE 2 END, feature) - 1 AS INT) AS idx FROM c WHERE family IS NOT NULL",
    "comparison_pairs": f"WITH {_CLASSES} SELECT a.feature, b.feature AS other FROM c a JOIN c b ON a.family = 'comparison' AND b.family = 'comparison' AND a.feature <> b.feature",
}

#: A tree for each user by arithmetic: three roots with two decisions each, every decision above one action.
_TREES = """t AS (SELECT user_id AS tree_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT range AS b FROM range(3)), k AS (SELECT range AS k FROM range(2)),
nodes AS (
  SELECT tree_id, CAST(b AS INT) AS node_idx, 1 AS node_type, -1 AS parent_idx, 0 AS depth, CAST(b AS DOUBLE) AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS p3, 0.0::DOUBLE AS p4 FROM t, r
  UNION ALL SELECT tree_id, CAST(3 + 4 * b + k AS INT), 2, CAST(b AS INT), 1, CAST((tree_id + b + k) % 3 AS DOUBLE), CAST((tree_id + k) % 2 AS DOUBLE), CAST(CASE WHEN (tree_id + b) % 5 = 4 THEN 1 ELSE 0 END AS DOUBLE),
    CAST(CASE WHEN (tree_id + b) % 5 = 4 THEN (tree_id + k) % 4 ELSE 20 + (tree_id * 7 + b * 11 + k * 13 + n) % 60 END AS DOUBLE) FROM t, r, k
  UNION ALL SELECT tree_id, CAST(5 + 4 * b + k AS INT), 3, CAST(3 + 4 * b + k AS INT), 2, CAST(CASE WHEN b = 1 THEN 1 + (tree_id + k) % 2 ELSE 3 + (tree_id + k) % 4 END AS DOUBLE), 0.5::DOUBLE, CAST(1 + (tree_id + n) % 100 AS DOUBLE), 0.0::DOUBLE FROM t, r, k)"""
_COHORTS = _TREES.replace("user_id AS tree_id", "user_id % 10 AS tree_id")
_COUPLES = "p AS (SELECT tree_id AS child, tree_id AS first, (tree_id * 3 + 1) % (SELECT max(user_id) + 1 FROM events) AS second FROM t)"
_X = f"x AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar, [close, high, coalesce(avg(close) {over(5)}, 0), volume] AS f FROM bars)"
_TRUE = "coalesce(CASE WHEN n.p3 = 0 THEN CASE WHEN n.p2 = 0 THEN f[CAST(n.p1 AS INT) + 1] >= n.p4 ELSE f[CAST(n.p1 AS INT) + 1] <= n.p4 END WHEN n.p3 = 1 THEN CASE WHEN n.p2 = 0 THEN f[CAST(n.p1 AS INT) + 1] >= f[CAST(n.p4 AS INT) + 1] ELSE f[CAST(n.p1 AS INT) + 1] <= f[CAST(n.p4 AS INT) + 1] END ELSE f[CAST(n.p1 AS INT) + 1] = n.p4 END, false)"
_WALK = f"""walk AS (
  SELECT symbol, bar, f, tree_id, CAST(p1 AS INT) AS branch, node_idx, node_type, [node_idx] AS path, p1, p2, p3 FROM x, nodes WHERE node_type = 1
  UNION ALL SELECT w.symbol, w.bar, w.f, w.tree_id, w.branch, n.node_idx, n.node_type, list_append(w.path, n.node_idx), n.p1, n.p2, n.p3
  FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.parent_idx = w.node_idx WHERE w.node_type <> 3 AND (n.node_type = 3 OR {_TRUE}))"""
_BROKEN = "broken AS (SELECT * FROM nodes WHERE NOT (tree_id % 5 = 1 AND node_idx = 5) AND NOT (tree_id % 5 = 2 AND node_idx = 0) AND NOT (tree_id % 5 = 3 AND node_idx IN (3, 4)))"
OTHER |= {
    "tree_predict": f"""WITH RECURSIVE {BARS}, {_X}, {_COHORTS}, {_WALK},
a AS (SELECT symbol, bar, tree_id, branch, arg_min((p1, p2, p3), (len(path), path)) AS a FROM walk WHERE node_type = 3 GROUP BY ALL)
SELECT w.symbol, w.bar, w.tree_id, w.branch, CAST(coalesce(a.a[1], 0) AS INT) AS action, a.a[2] AS ratio, a.a[3] AS leverage FROM walk w LEFT JOIN a USING (symbol, bar, tree_id, branch) WHERE w.node_type = 1""",
    "adjacency": f"WITH {_TREES} SELECT tree_id, parent_idx, count(*) AS n_children, string_agg(CAST(node_idx AS VARCHAR), ',' ORDER BY node_idx) AS children FROM nodes WHERE parent_idx >= 0 GROUP BY ALL",
    "child_overflow": f"WITH {_TREES}, c AS (SELECT tree_id, parent_idx, count(*) AS n FROM nodes WHERE parent_idx >= 0 GROUP BY ALL) SELECT tree_id, max(n) AS most_children, max(n) > 1 AS overflow FROM c GROUP BY tree_id",
    "tree_validate": f"""WITH {_TREES}, {_BROKEN},
kids AS (SELECT tree_id, parent_idx, count(*) AS n, count(*) FILTER (node_type = 3) AS acts, count(*) FILTER (node_type = 2) AS asks FROM broken WHERE parent_idx >= 0 GROUP BY ALL),
m AS (SELECT b.tree_id, b.p1, b.node_type,
  CASE WHEN b.node_type = 1 AND (b.parent_idx <> -1 OR b.depth <> 0) THEN 1 ELSE 0 END | CASE WHEN b.node_type <> 1 AND (u.depth IS NULL OR b.depth <> u.depth + 1) THEN 2 ELSE 0 END
  | CASE WHEN (b.node_type = 3 AND coalesce(n, 0) > 0) OR (b.node_type <> 3 AND coalesce(n, 0) = 0) THEN 4 ELSE 0 END | CASE WHEN acts > 0 AND asks > 0 THEN 8 ELSE 0 END | CASE WHEN acts > 0 AND n > 1 THEN 16 ELSE 0 END AS f
  FROM broken b LEFT JOIN kids k ON k.tree_id = b.tree_id AND k.parent_idx = b.node_idx LEFT JOIN broken u ON u.tree_id = b.tree_id AND u.node_idx = b.parent_idx)
SELECT tree_id, CAST(bit_or(f) | CASE WHEN count(*) FILTER (node_type = 1) = 3 AND count(DISTINCT p1) FILTER (node_type = 1) = 3 THEN 0 ELSE 1 END AS INT) AS faults FROM m GROUP BY tree_id""",
    "compact": f"""WITH {_TREES}, cut AS (SELECT * FROM nodes WHERE NOT (tree_id % 2 = 0 AND node_idx IN (4, 6))),
i AS (SELECT tree_id, node_idx, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY node_idx) - 1 AS INT) AS new FROM cut)
SELECT c.tree_id, a.new AS node_idx, c.node_type, coalesce(b.new, -1) AS parent_idx, c.depth, c.p1, c.p2, c.p3, c.p4 FROM cut c JOIN i a USING (tree_id, node_idx) LEFT JOIN i b ON b.tree_id = c.tree_id AND b.node_idx = c.parent_idx""",
    "subtree": f"WITH {_TREES} SELECT tree_id, node_idx, node_idx - (3 + CAST(tree_id % 2 AS INT)) AS step, CAST(CASE WHEN node_type = 2 THEN 0 ELSE 1 END AS INT) AS below FROM nodes WHERE node_idx = 3 + tree_id % 2 OR parent_idx = 3 + tree_id % 2",
    "root_branch_copy": f"""WITH {_TREES}, {_COUPLES},
d AS (SELECT child, b, CASE WHEN (child + b) % 2 = 0 THEN first ELSE second END AS donor FROM p, r),
n AS (SELECT *, CASE WHEN node_type = 1 THEN node_idx WHEN node_type = 2 THEN (node_idx - 3) // 4 ELSE (node_idx - 5) // 4 END AS b FROM nodes)
SELECT d.child AS tree_id, n.node_idx, n.node_type, n.parent_idx, n.depth, n.p1, n.p2, n.p3, n.p4 FROM d JOIN n ON n.tree_id = d.donor AND n.b = d.b""",
    "critical_repair": f"""WITH {_TREES}, cut AS (SELECT * FROM nodes WHERE NOT (tree_id % 5 = 3 AND node_idx IN (3, 4, 5, 6)))
SELECT tree_id, node_idx, node_type, parent_idx, p1 FROM cut UNION ALL SELECT tree_id, 15, 3, 0, 3.0 FROM t WHERE tree_id % 5 = 3""",
    "lcg": "SELECT event_id AS seed, (((event_id * 1664525 + 1013904223) & 4294967295) * 1664525 + 1013904223) & 4294967295 AS state FROM events",
}

_SCORES = "s AS (SELECT user_id % 50 AS tree_id, round(avg(value), 3) - 40 AS fitness FROM events GROUP BY 1)"
_DRAWN = "((range * 7919 + 17) * 1664525 + 1013904223 & 4294967295) / 4294967296.0::DOUBLE"
_PROFITS = "p AS (SELECT user_id % 20 AS tree_id, event_id AS bar, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE (value - 50) / 5000 END AS profit FROM events)"
_MEASURED = f"""{_PROFITS},
q AS (SELECT *, sum(profit) OVER w AS cum FROM p WINDOW w AS (PARTITION BY tree_id ORDER BY bar)),
d AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY tree_id ORDER BY bar)) - cum AS drop FROM q),
m AS (SELECT tree_id, count(*) FILTER (profit <> 0) AS n, sum(profit) / count(*) FILTER (profit <> 0) AS mean_return,
  CASE WHEN sum(greatest(-profit, 0)) > 0 THEN least(sum(greatest(profit, 0)) / (sum(greatest(-profit, 0)) + 1e-9), 100) ELSE 100 END AS profit_factor,
  count(*) FILTER (profit > 0) / count(*) FILTER (profit <> 0) AS win_rate, max(drop) AS max_drawdown, product(1 + profit) AS compound_value FROM d GROUP BY tree_id)"""
_MOST = _MEASURED.replace("user_id % 20", "CAST(length(bin(user_id)) AS BIGINT)").replace("max(drop) AS max_drawdown", "max(drop) AS max_drawdown, sum(profit * profit) AS sum_squares, sum(least(profit, 0)) AS sum_losses, count(*) FILTER (profit < 0) AS n_losses, sum(CASE WHEN profit < 0 THEN profit * profit ELSE 0 END) AS sum_square_losses")
_MATED = f"{_SCORES}, e AS (SELECT * FROM s ORDER BY fitness DESC, tree_id LIMIT 16), d AS (SELECT range AS draw, {variation_oracles.drawn(3, None, 'range')} AS u FROM range(80))"
_PAIRS = "SELECT draw // 2 AS child, arg_min(tree_id, draw) AS first, arg_max(tree_id, draw) AS second FROM drawn GROUP BY ALL"
_PART = lambda c: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
OTHER |= {
    "elites": f"WITH {_SCORES} SELECT tree_id, fitness FROM s ORDER BY fitness DESC, tree_id LIMIT 8",
    "roulette": f"""WITH {_SCORES}, w AS (SELECT tree_id, fitness - least(min(fitness) OVER (), 0) AS w FROM s), c AS (SELECT tree_id, w, sum(w) OVER (ORDER BY tree_id) AS hi, sum(w) OVER () AS a FROM w),
d AS (SELECT range AS draw, {_DRAWN} AS u FROM range(100)) SELECT draw, min(tree_id) AS tree_id FROM d JOIN c ON u * a >= hi - w AND u * a < hi GROUP BY draw""",
    "tournament": f"""WITH {_SCORES}, k AS (SELECT *, row_number() OVER (ORDER BY tree_id) - 1 AS rank, count(*) OVER () AS n FROM s),
d AS (SELECT range // 4 AS draw, range % 4 AS entry, {_DRAWN} AS u FROM range(400)) SELECT draw, arg_max(tree_id, (fitness, -entry)) AS tree_id FROM d JOIN k ON floor(u * n) = rank GROUP BY draw""",
    "best_pool": f"WITH {_SCORES}, x AS (SELECT tree_id, fitness FROM s WHERE tree_id < 5 UNION ALL SELECT tree_id, fitness FROM s WHERE tree_id >= 5 AND tree_id % 10 > 6 AND tree_id % 4 / 4.0 < 0.6) SELECT * FROM x ORDER BY fitness DESC, tree_id LIMIT 8",
    "next_generation": f"""WITH {_TREES}, e AS (SELECT tree_id AS old, row_number() OVER (ORDER BY n DESC, tree_id) - 1 AS new FROM t QUALIFY new < 3), o AS (SELECT tree_id AS old, row_number() OVER (ORDER BY tree_id) + 2 AS new FROM t WHERE tree_id % 4 = 1)
SELECT e.new AS tree_id, node_idx, node_type, parent_idx FROM nodes JOIN e ON tree_id = old UNION ALL SELECT o.new, node_idx, node_type, parent_idx FROM nodes JOIN o ON tree_id = old""",
    "permuted": f"""WITH {_TREES}, o AS (SELECT tree_id AS old, row_number() OVER (ORDER BY {variation_oracles.drawn(5, 'order', 'tree_id')}, tree_id) - 1 AS new FROM t)
SELECT o.new AS tree_id, node_idx, node_type, parent_idx, depth, p1, p2, p3, p4 FROM nodes JOIN o ON tree_id = old""",
    "mating_roulette": f"""WITH {_MATED}, w AS (SELECT tree_id, fitness - least(min(fitness) OVER (), 0) AS w FROM e), c AS (SELECT tree_id, w, sum(w) OVER (ORDER BY tree_id) AS hi, sum(w) OVER () AS a FROM w),
drawn AS (SELECT draw, min(tree_id) AS tree_id FROM d JOIN c ON u * a >= hi - w AND u * a < hi GROUP BY draw) {_PAIRS}""",
    "mating_tournament": f"""WITH {_MATED}, k AS (SELECT *, row_number() OVER (ORDER BY tree_id) - 1 AS rank, count(*) OVER () AS n FROM e), t AS (SELECT draw, entry, {variation_oracles.drawn(3, None, 'draw', 'entry')} AS u FROM d, (SELECT range AS entry FROM range(5))),
drawn AS (SELECT draw, arg_max(tree_id, (fitness, -entry)) AS tree_id FROM t JOIN k ON floor(u * n) = rank GROUP BY draw) {_PAIRS}""",
    "metrics_minimum": f"WITH {_MOST} SELECT tree_id, n, " + ", ".join(f"CASE WHEN n >= 500 THEN round({c}, 6) END AS {c}" for c in ("mean_return", "profit_factor", "win_rate", "max_drawdown", "compound_value", "sum_squares", "sum_losses", "sum_square_losses")) + ", CASE WHEN n >= 500 THEN n_losses END AS n_losses FROM m",
    "kline_files": f"WITH {BARS} SELECT symbol, {STAMP}, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume FROM bars",
    "funding_files": "SELECT 'ALL' AS symbol, strftime(time_bucket(INTERVAL '8 hours', ts), '%Y-%m-%d %H:%M:%S') AS ts, round((avg(value) - 50) / 1e5, 12) AS funding_rate FROM events GROUP BY ALL",
    "kline_range": f"WITH {BARS} SELECT symbol, {STAMP}, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume FROM bars WHERE symbol IN ('click', 'error') AND bars.ts >= TIMESTAMP '2024-01-05 12:00:00' AND bars.ts < TIMESTAMP '2024-01-20 06:30:00'",
    "funding_range": "SELECT event_type AS symbol, strftime(time_bucket(INTERVAL '8 hours', ts), '%Y-%m-%d %H:%M:%S') AS ts, round((avg(value) - 50) / 1e5, 12) AS funding_rate FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY ALL",
    "population_files": f"WITH {_TREES} SELECT tree_id, node_idx, node_type, parent_idx, depth, CASE WHEN node_type = 2 THEN 3 - p1 ELSE p1 END AS p1, p2, p3, CASE WHEN node_type = 2 AND p3 = 1 THEN 3 - p4 ELSE p4 END AS p4 FROM nodes",
    "metrics": f"WITH {_MEASURED} SELECT tree_id, n, round(mean_return, 8) AS mean_return, round(profit_factor, 6) AS profit_factor, round(win_rate, 6) AS win_rate, round(max_drawdown, 6) AS max_drawdown, round(compound_value, 6) AS compound_value FROM m",
    "fitness": f"""WITH {_MEASURED} SELECT tree_id, round(0.1 * ({_PART("mean_return")}) + 0.2 * ({_PART("profit_factor")}) + 0.15 * ({_PART("win_rate")}) + 0.15 * (1 - ({_PART("max_drawdown")})) + 0.4 * ({_PART("compound_value")}), 6) AS fitness FROM m""",
    "train_test_split": f"WITH {BARS}, {_X}, y AS (SELECT *, CAST(floor((max(bar) OVER (PARTITION BY symbol)) * 0.7::DOUBLE) AS BIGINT) AS last FROM x) SELECT symbol, CASE WHEN bar < last THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM y GROUP BY ALL",
}

OTHER["tree_predict_batched"], OTHER["streaming_bars"] = OTHER["tree_predict"], OTHER["ohlc_resample"]
_WIDE = {"BB_Lower_20_2": f"({_BB}) - 2 * ({_SD})", "BB_Mid_20_2": _BB, "BB_Upper_20_2": f"({_BB}) + 2 * ({_SD})", "BB_Width_20_2": f"4 * ({_SD}) / (({_BB}) + 1e-9)", "ROC_10": f"100 * (close / ({lag('close', 10)}) - 1)", "SMA_20": _BB}
_OF = ", ".join(f'{full(20, x)} AS "{n}"' for n, x in _WIDE.items())
OTHER["feature_pipeline"] = f"""WITH {TICKS}, {bars_cte("bars", "30 minutes")}, {bars_cte("hours", "1 hour")}, b AS (SELECT symbol, ts, {_OF} FROM bars), h AS (SELECT symbol, ts, {_OF} FROM hours)
SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, {", ".join(f'round({a}."{n}", 6) AS "{n}_{tf}"' for n in _WIDE for a, tf in (("b", "30m"), ("h", "1h")))}
FROM b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts + INTERVAL '30 minutes' >= h.ts + INTERVAL '1 hour' WHERE b."SMA_20" IS NOT NULL AND h."SMA_20" IS NOT NULL"""

_QUAD = lambda now, past: f"(0.0962 * {now} + 0.5769 * {past}[2] - 0.5769 * {past}[4] - 0.0962 * {past}[6]) * (0.075 * period + 0.54)"
_PUSH = lambda now, past, n=6: f"list_prepend({now}, {past}[1:{n - 1}])"
_ZEROS = "[0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]"
#: Dominant cycle, bar after bar: h holds the state after each bar, lists of past values the latest first.
OTHER["hilbert"] = f"""WITH RECURSIVE {BARS},
m AS (SELECT *, CASE WHEN rn >= 4 THEN (4 * close + 3 * {lag("close")} + 2 * {lag("close", 2)} + {lag("close", 3)}) / 10 ELSE 0 END AS smooth FROM bars),
b AS (SELECT symbol, ts, rn, smooth, list_reverse(list(smooth) {over(50)}) AS xs, list_reverse(list(close) {over(50)}) AS cs FROM m),
h AS (
  SELECT DISTINCT symbol, NULL::TIMESTAMP AS ts, 0::BIGINT AS rn, {_ZEROS} AS sm, {_ZEROS} AS dt, {_ZEROS} AS q1, {_ZEROS} AS i1, 0.0::DOUBLE AS i2, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS re, 0.0::DOUBLE AS im, 0.0::DOUBLE AS period, 0.0::DOUBLE AS sp,
    {_ZEROS} AS line, 0::BIGINT AS days, 0.0::DOUBLE AS phase, 0.0::DOUBLE AS s, 0.0::DOUBLE AS t, 0 AS flat FROM bars
  UNION ALL
  SELECT symbol, ts, rn, {_PUSH("smooth", "sm")}, {_PUSH("dt0", "dt")}, {_PUSH("q0", "q1")}, {_PUSH("i0", "i1")}, i2n, q2n, ren, imn, pn, spn,
    {_PUSH("CASE WHEN span = 0 THEN 0.0 ELSE l0 END", "line")}, CASE WHEN span = 0 THEN days ELSE dn END, CASE WHEN span = 0 THEN phase ELSE ph END, CASE WHEN span = 0 THEN s ELSE sn END, CASE WHEN span = 0 THEN t ELSE tn END,
    CASE WHEN tl <> 0 AND abs((smooth - tl) / tl) >= 0.015 THEN 1 WHEN dn = 1 AND turned OR dn < 0.5 * spn OR (spn <> 0 AND ph - phase > 0.67 * 360 / spn AND ph - phase < 1.5 * 360 / spn) THEN 0 ELSE 1 END
  FROM (SELECT *, CASE WHEN turned THEN 1 ELSE days + 1 END AS dn, (4 * l0 + 3 * line[1] + 2 * line[2] + line[3]) / 10 AS tl
  FROM (SELECT *, (sn > tn) <> (s > t) AS turned
  FROM (SELECT *, sin(radians(ph)) AS sn, sin(radians(ph + 45)) AS tn
  FROM (SELECT *, CASE WHEN raw > 315 THEN raw - 360 ELSE raw END AS ph
  FROM (SELECT *, CASE WHEN abs(imag) > 0.01 THEN degrees(atan(real / imag)) ELSE 90 * sign(real) END + 90 + 360 / greatest(spn, 1e-9) + CASE WHEN imag < 0 THEN 180 ELSE 0 END AS raw
  FROM (SELECT *, list_sum(list_transform(range(len), lambda k: sin(radians(360 * k / span)) * xs[k + 1])) AS real, list_sum(list_transform(range(len), lambda k: cos(radians(360 * k / span)) * xs[k + 1])) AS imag, list_avg(cs[1:len]) AS l0
  FROM (SELECT *, least(span, rn) AS len
  FROM (SELECT *, CAST(floor(spn + 0.5) AS BIGINT) AS span
  FROM (SELECT *, 0.33 * pn + 0.67 * sp AS spn
  FROM (SELECT *, 0.2 * least(greatest(CASE WHEN period <> 0 THEN least(greatest(found, 0.67 * period), 1.5 * period) ELSE found END, 6), 50) + 0.8 * period AS pn
  FROM (SELECT *, CASE WHEN imn <> 0 AND ren <> 0 THEN 360 / degrees(atan(imn / ren)) ELSE period END AS found
  FROM (SELECT *, 0.2 * (i2n * i2 + q2n * q2) + 0.8 * re AS ren, 0.2 * (i2n * q2 - q2n * i2) + 0.8 * im AS imn
  FROM (SELECT *, 0.2 * (i0 - {_QUAD("q0", "q1")}) + 0.8 * i2 AS i2n, 0.2 * (q0 + {_QUAD("i0", "i1")}) + 0.8 * q2 AS q2n
  FROM (SELECT *, {_QUAD("dt0", "dt")} AS q0, dt[3] AS i0
  FROM (SELECT h.* EXCLUDE (ts, rn, flat), b.ts, b.rn, b.smooth, b.xs, b.cs, {_QUAD("b.smooth", "sm")} AS dt0 FROM h JOIN b ON b.symbol = h.symbol AND b.rn = h.rn + 1)))))))))))))))
)
SELECT symbol, {STAMP}, CASE WHEN rn > 32 THEN round(sp, 6) END AS "HT_DCPERIOD", CASE WHEN rn > 63 THEN flat ELSE 0 END AS "HT_TRENDMODE", CASE WHEN rn > 63 THEN round(s, 6) END AS "HT_SINE", CASE WHEN rn > 63 THEN round(t, 6) END AS "HT_LEADSINE" FROM h WHERE rn > 0"""

ORACLES: dict[str, str] = FEATURES | OTHER | variation_oracles.oracles(_TREES)
