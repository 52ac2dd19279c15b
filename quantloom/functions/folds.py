"""Indicators that recur over a series, as programs of scans: small numpy helpers behind the fold features.

Arrays are float with NaN where there is no value yet; every recursion seeds itself on the first run of values, as the
usual indicator definitions do.
"""

from __future__ import annotations

import numpy as np

from .scans import PENDING, Scan


def ema(s: Scan, x: np.ndarray, n: int, at: int | None = None) -> np.ndarray:
    """Exponential mean seeded by the mean of n values, by default the first n; at: the seed's place."""
    k = 2 / (n + 1)
    return s.recursion(x, 1 - k, k, n, at=at)


def wilder(s: Scan, x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean: seeded by the mean of the first n values, then (prev * (n - 1) + x) / n."""
    return s.recursion(x, (n - 1) / n, 1 / n, n)


def wilder_sum(s: Scan, x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's sum: the first n - 1 values seed it, then s - s / n + x."""
    return s.recursion(x, 1 - 1 / n, 1.0, n - 1, mean=False)


def macd(s: Scan, close: np.ndarray, short: int, long: int, signal: int) -> list[np.ndarray]:
    short, long = sorted((short, long))
    line = ema(s, close, short, at=long - 1) - ema(s, close, long, at=long - 1)
    mean = ema(s, line, signal)
    line = np.where(np.isnan(mean), np.nan, line)
    return [line, mean, line - mean]


def rsi(s: Scan, close: np.ndarray, n: int) -> np.ndarray:
    change = close - s.lag(close)
    up, down = wilder(s, np.maximum(change, 0), n), wilder(s, np.maximum(-change, 0), n)
    both = up + down
    return np.where(np.isnan(both), np.nan, np.where(both == 0, 0.0, 100 * up / np.where(both == 0, 1, both)))


def true_range(s: Scan, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = s.lag(close)
    return np.where(np.isnan(before), np.nan, np.maximum(high, before) - np.minimum(low, before))


def atr(s: Scan, high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    return wilder(s, true_range(s, high, low, close), n)


def adx(s: Scan, high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> list[np.ndarray]:
    """ADX and both directional indicators."""
    up, down = high - s.lag(high), s.lag(low) - low
    moves = [np.where((a > b) & (a > 0), a, 0.0) for a, b in ((up, down), (down, up))]
    plus, minus = (np.where(s.places == 0, np.nan, m) for m in moves)
    spread = wilder_sum(s, true_range(s, high, low, close), n)
    ok = s.places >= n
    safe = np.where((spread == 0) | ~ok, 1, spread)
    di = [np.where(ok, np.where(spread == 0, 0.0, 100 * wilder_sum(s, x, n) / safe), np.nan) for x in (plus, minus)]
    total = di[0] + di[1]
    dx = np.where(ok, np.where(total == 0, 0.0, 100 * np.abs(di[0] - di[1]) / np.where(total == 0, 1, total)), np.nan)
    return [wilder(s, dx, n), *di]


def sar(s: Scan, high: np.ndarray, low: np.ndarray, step: float, most: float) -> np.ndarray:
    """Parabolic stop and reverse; the first move down decides for a short start."""

    def run(state: tuple, columns: list[np.ndarray], at: int) -> tuple[np.ndarray, tuple]:
        bars = list(zip(*(c.tolist() for c in columns), strict=True))
        out, rows = np.full(len(bars), np.nan), enumerate(bars)
        before, trend = state
        for i, now in rows:
            if before is None:
                before = now
                continue
            if trend is None:
                drop = before[1] - now[1]
                rising = not (drop > 0 and drop > now[0] - before[0])
                trend = (rising, *((now[0], before[1]) if rising else (now[1], before[0])), step)
                before = now
            rising, extreme, stop, speed = trend
            side = 1 if rising else -1
            if now[1] <= stop if rising else now[0] >= stop:
                rising, side = not rising, -side
                stop = max(extreme, before[0], now[0]) if side < 0 else min(extreme, before[1], now[1])
                out[i] = stop
                speed, extreme = step, now[1] if side < 0 else now[0]
            else:
                out[i] = stop
                best = now[0] if rising else now[1]
                if side * (best - extreme) > 0:
                    extreme, speed = best, min(speed + step, most)
            stop += speed * (extreme - stop)
            stop = min(stop, before[1], now[1]) if side > 0 else max(stop, before[0], now[0])
            before, trend = now, (rising, extreme, stop, speed)
        return out, (before, trend)

    return s.machine(run, lambda: (None, None), high, low)


def adosc(s: Scan, ad: np.ndarray, fast: int, slow: int) -> np.ndarray:
    means = [s.recursion(ad, 1 - 2 / (n + 1), 2 / (n + 1), 1, at=0) for n in (fast, slow)]
    return np.where(s.places >= max(fast, slow) - 1, means[0] - means[1], np.nan)


def flow(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    """Volume by the place of the close within the bar; nothing where the bar has no height."""
    spread = high - low
    return np.where(spread > 0, ((close - low) - (high - close)) / np.where(spread > 0, spread, 1) * volume, 0.0)


def obv(s: Scan, close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    """Volume summed with the sign of the close's change; a change that isn't known counts as one up."""
    sign = np.sign(close - s.lag(close))
    return s.total(np.where(np.isnan(sign), 1.0, sign) * volume)


def stoch_rsi(s: Scan, close: np.ndarray, n: int, k: int, d: int) -> list[np.ndarray]:
    x = rsi(s, close, n)
    low, high = s.rolling(x, k, np.min), s.rolling(x, k, np.max)
    fast = np.where(np.isnan(low), np.nan, np.where(high == low, 0.0, 100 * (x - low) / np.where(high == low, 1, high - low)))
    mean = s.rolling(fast, d, np.mean)
    return [np.where(np.isnan(mean), np.nan, fast), mean]


#: Rows that the longest cycle, of 50 bars, looks back on; and values of the transform that its filters do.
_CYCLE, _TAPS = 50, 6


def _hilbert_start() -> dict:
    zeros = {c: np.zeros(_TAPS) for c in ("detrend", "q1", "i1", "line")}
    return {"at": 0, "close": np.zeros(_CYCLE + 3), "smooth": np.zeros(_CYCLE), **zeros, "n": (0.0,) * 6, "phase": 0.0, "sines": (0.0, 0.0), "days": 0}


def _hilbert(state: dict, columns: list[np.ndarray], at: int) -> tuple[list[np.ndarray], dict]:
    """Ehlers' dominant cycle over the next rows."""
    chunk, n = columns[0], len(columns[0])
    rows = state["at"] + np.arange(n)  # places in what has been seen, which is shorter than the series after a warm-up
    close = np.append(state["close"], chunk)
    weighted = (4 * close[3:] + 3 * close[2:-1] + 2 * close[1:-2] + close[:-3]) / 10
    smooth = np.append(state["smooth"], np.where(rows >= 3, weighted[_CYCLE:], 0.0))
    detrend, q1, i1, line = (np.append(state[c], np.zeros(n)) for c in ("detrend", "q1", "i1", "line"))
    i2, q2, re, im, period, smooth_period = state["n"]
    phase_before, sines_before, days = state["phase"], state["sines"], state["days"]
    out = [np.full(n, np.nan) for _ in range(4)]
    out[3] = np.zeros(n)
    for r in range(n):
        i, t, c = state["at"] + r, _TAPS + r, _CYCLE + r  # place, and index into the arrays of taps and of smooth
        adjust = 0.075 * period + 0.54
        quad = lambda a, e, adjust=adjust: (0.0962 * a[e] + 0.5769 * a[e - 2] - 0.5769 * a[e - 4] - 0.0962 * a[e - 6]) * adjust
        detrend[t] = quad(smooth, c)
        q1[t], i1[t] = quad(detrend, t), detrend[t - 3]
        ji, jq = quad(i1, t), quad(q1, t)
        i2_now, q2_now = 0.2 * (i1[t] - jq) + 0.8 * i2, 0.2 * (q1[t] + ji) + 0.8 * q2
        re = 0.2 * (i2_now * i2 + q2_now * q2) + 0.8 * re
        im = 0.2 * (i2_now * q2 - q2_now * i2) + 0.8 * im
        i2, q2, earlier = i2_now, q2_now, period
        if im and re:
            period = 360 / np.degrees(np.arctan(im / re))
        period = min(max(period, 0.67 * earlier), 1.5 * earlier) if earlier else period
        period = 0.2 * min(max(period, 6), 50) + 0.8 * earlier
        smooth_period = 0.33 * period + 0.67 * smooth_period
        if np.isnan(smooth_period):  # a close is missing: there is no cycle from here on
            out[3][r] = np.nan
            continue
        span = int(smooth_period + 0.5)
        if i >= 32:
            out[0][r] = smooth_period
        k = np.arange(min(span, i + 1))
        if not len(k):
            continue
        x = smooth[c - k]
        turn = np.radians(360 * k / span)
        real, imag = (np.sin(turn) * x).sum(), (np.cos(turn) * x).sum()
        phase = np.degrees(np.arctan(real / imag)) if abs(imag) > 0.01 else 90 * np.sign(real)
        phase += 90 + 360 / max(smooth_period, 1e-9) + (180 if imag < 0 else 0)
        phase = phase - 360 if phase > 315 else phase
        sine, lead = np.sin(np.radians(phase)), np.sin(np.radians(phase + 45))
        line[t] = close[c + 3 - k].mean()
        trend_line = (4 * line[t] + 3 * line[t - 1] + 2 * line[t - 2] + line[t - 3]) / 10
        flat = 1
        if (sine > lead) != (sines_before[0] > sines_before[1]):
            days, flat = 0, 0
        days += 1
        if days < 0.5 * smooth_period:
            flat = 0
        moved = phase - phase_before
        if smooth_period and 0.67 * 360 / smooth_period < moved < 1.5 * 360 / smooth_period:
            flat = 0
        if trend_line and abs((smooth[c] - trend_line) / trend_line) >= 0.015:
            flat = 1
        phase_before, sines_before = phase, (sine, lead)
        if i >= 63:
            out[1][r], out[2][r], out[3][r] = sine, lead, flat
    keep = {"close": (close, _CYCLE + 3), "smooth": (smooth, _CYCLE), **{c: (a, _TAPS) for c, a in (("detrend", detrend), ("q1", q1), ("i1", i1), ("line", line))}}
    tails = {c: a[len(a) - m :] for c, (a, m) in keep.items()}
    return out, {"at": state["at"] + n, **tails, "n": (i2, q2, re, im, period, smooth_period), "phase": phase_before, "sines": sines_before, "days": days}


def _hilbert_states_agree(a: dict, b: dict) -> bool:
    """Equal in all that later rows depend on: places count only until the longest look back is filled."""
    from .scans import same

    full = min(a["at"], b["at"]) > 63 + _CYCLE or a["at"] == b["at"]
    return full and all(same(a[c], b[c]) for c in a if c not in ("at", "days")) and (a["days"] == b["days"] or min(a["days"], b["days"]) > 50)


def hilbert(s: Scan, close: np.ndarray) -> dict[str, np.ndarray]:
    """Dominant cycle of the price by the discrete Hilbert transform (Ehlers): period, sines, trend mode."""
    found = s.machine(_hilbert, _hilbert_start, close, agree=_hilbert_states_agree)
    names = ("HT_DCPERIOD", "HT_SINE", "HT_LEADSINE", "HT_TRENDMODE")
    return dict.fromkeys(names, PENDING) if found is PENDING else dict(zip(names, found, strict=True))
