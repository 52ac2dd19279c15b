"""Recursions over one series: small numpy helpers behind the fold features.

Arrays are float with NaN where there is no value yet; every fold seeds itself on the first run of
values, as the usual indicator definitions do.
"""

from __future__ import annotations

import numpy as np


def _first(x: np.ndarray) -> int:
    ok = np.flatnonzero(~np.isnan(x))
    return int(ok[0]) if len(ok) else len(x)


def _recursion(x: np.ndarray, start: int, seed: float, keep: float, take: float) -> np.ndarray:
    """out[start] = seed; out[i] = keep * out[i - 1] + take * x[i]."""
    out = np.full(len(x), np.nan)
    if start < len(x):
        v = out[start] = seed
        for i, new in enumerate(x[start + 1 :].tolist(), start + 1):
            v = keep * v + take * new
            out[i] = v
    return out


def ema(x: np.ndarray, n: int, at: int | None = None) -> np.ndarray:
    """Exponential mean seeded by the mean of n values, by default the first n; at: the seed's place."""
    at = _first(x) + n - 1 if at is None else at
    if at >= len(x):
        return np.full(len(x), np.nan)
    k = 2 / (n + 1)
    return _recursion(x, at, x[at - n + 1 : at + 1].mean(), 1 - k, k)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean: seeded by the mean of the first n values, then (prev * (n - 1) + x) / n."""
    at = _first(x) + n - 1
    return _recursion(x, at, x[at - n + 1 : at + 1].mean(), (n - 1) / n, 1 / n) if at < len(x) else np.full(len(x), np.nan)


def wilder_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's sum: the first n - 1 values seed it, then s - s / n + x."""
    at = _first(x) + n - 2
    return _recursion(x, at, x[at - n + 2 : at + 1].sum(), 1 - 1 / n, 1.0) if at < len(x) else np.full(len(x), np.nan)


def macd(close: np.ndarray, short: int, long: int, signal: int) -> list[np.ndarray]:
    short, long = sorted((short, long))
    line = ema(close, short, at=long - 1) - ema(close, long, at=long - 1)
    mean = ema(line, signal)
    line = np.where(np.isnan(mean), np.nan, line)
    return [line, mean, line - mean]


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    change = np.append(np.nan, np.diff(close))
    up, down = wilder(np.maximum(change, 0), n), wilder(np.maximum(-change, 0), n)
    both = up + down
    return np.where(np.isnan(both), np.nan, np.where(both == 0, 0.0, 100 * up / np.where(both == 0, 1, both)))


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.append(np.nan, close[:-1])
    return np.where(np.isnan(before), np.nan, np.maximum(high, before) - np.minimum(low, before))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    return wilder(true_range(high, low, close), n)


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> list[np.ndarray]:
    """ADX and both directional indicators."""
    up, down = np.append(np.nan, np.diff(high)), np.append(np.nan, -np.diff(low))
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    plus[:1], minus[:1] = np.nan, np.nan
    spread = wilder_sum(true_range(high, low, close), n)
    ok = np.arange(len(close)) >= n
    safe = np.where((spread == 0) | ~ok, 1, spread)
    di = [np.where(ok, np.where(spread == 0, 0.0, 100 * wilder_sum(x, n) / safe), np.nan) for x in (plus, minus)]
    total = di[0] + di[1]
    dx = np.where(ok, np.where(total == 0, 0.0, 100 * np.abs(di[0] - di[1]) / np.where(total == 0, 1, total)), np.nan)
    return [wilder(dx, n), *di]


def sar(high: np.ndarray, low: np.ndarray, step: float, most: float) -> np.ndarray:
    """Parabolic stop and reverse; the first move down decides for a short start."""
    out = np.full(len(high), np.nan)
    if len(high) < 2:
        return out
    drop = low[0] - low[1]
    rising = not (drop > 0 and drop > high[1] - high[0])
    extreme, stop, speed = (high[1], low[0], step) if rising else (low[1], high[0], step)
    before = (high[1], low[1])
    for i in range(1, len(high)):
        now = (high[i], low[i])
        side = 1 if rising else -1
        touched = now[1] <= stop if rising else now[0] >= stop
        if touched:
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
        before = now
    return out


def adosc(ad: np.ndarray, fast: int, slow: int) -> np.ndarray:
    if not len(ad):
        return ad
    means = [_recursion(ad, 0, ad[0], 1 - 2 / (n + 1), 2 / (n + 1)) for n in (fast, slow)]
    return np.where(np.arange(len(ad)) >= max(fast, slow) - 1, means[0] - means[1], np.nan)


def accumulation(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    spread = high - low
    return np.cumsum(np.where(spread > 0, ((close - low) - (high - close)) / np.where(spread > 0, spread, 1) * volume, 0.0))


def rolling(x: np.ndarray, n: int, what) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = what(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def stoch_rsi(close: np.ndarray, n: int, k: int, d: int) -> list[np.ndarray]:
    x = rsi(close, n)
    low, high = rolling(x, k, np.min), rolling(x, k, np.max)
    fast = np.where(np.isnan(low), np.nan, np.where(high == low, 0.0, 100 * (x - low) / np.where(high == low, 1, high - low)))
    mean = rolling(fast, d, np.mean)
    return [np.where(np.isnan(mean), np.nan, fast), mean]


def hilbert(close: np.ndarray) -> dict[str, np.ndarray]:
    """Dominant cycle of the price by the discrete Hilbert transform (Ehlers): period, sines, trend mode."""
    n = len(close)
    smooth = np.zeros(n)
    if n >= 4:
        smooth[3:] = (4 * close[3:] + 3 * close[2:-1] + 2 * close[1:-2] + close[:-3]) / 10
    back = lambda a, i, k: a[i - k] if i >= k else 0.0
    detrend, q1, i1, ji, jq = (np.zeros(n) for _ in range(5))
    i2 = q2 = re = im = period = smooth_period = 0.0
    cycle, sine, lead, trend = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan), np.zeros(n)
    line, days, phase_before, sines_before = np.zeros(n), 0, 0.0, (0.0, 0.0)
    for i in range(n):
        adjust = 0.075 * period + 0.54
        quad = lambda a, i=i, adjust=adjust: (0.0962 * a[i] + 0.5769 * back(a, i, 2) - 0.5769 * back(a, i, 4) - 0.0962 * back(a, i, 6)) * adjust
        detrend[i] = quad(smooth)
        q1[i], i1[i] = quad(detrend), back(detrend, i, 3)
        ji[i], jq[i] = quad(i1), quad(q1)
        i2_now, q2_now = 0.2 * (i1[i] - jq[i]) + 0.8 * i2, 0.2 * (q1[i] + ji[i]) + 0.8 * q2
        re = 0.2 * (i2_now * i2 + q2_now * q2) + 0.8 * re
        im = 0.2 * (i2_now * q2 - q2_now * i2) + 0.8 * im
        i2, q2, earlier = i2_now, q2_now, period
        if im and re:
            period = 360 / np.degrees(np.arctan(im / re))
        period = min(max(period, 0.67 * earlier), 1.5 * earlier) if earlier else period
        period = 0.2 * min(max(period, 6), 50) + 0.8 * earlier
        smooth_period = 0.33 * period + 0.67 * smooth_period
        span = int(smooth_period + 0.5)
        if i >= 32:
            cycle[i] = smooth_period
        k = np.arange(min(span, i + 1))
        if not len(k):
            continue
        x = smooth[i - k]
        turn = np.radians(360 * k / span)
        real, imag = (np.sin(turn) * x).sum(), (np.cos(turn) * x).sum()
        phase = np.degrees(np.arctan(real / imag)) if abs(imag) > 0.01 else 90 * np.sign(real)
        phase += 90 + 360 / max(smooth_period, 1e-9) + (180 if imag < 0 else 0)
        phase = phase - 360 if phase > 315 else phase
        s, t = np.sin(np.radians(phase)), np.sin(np.radians(phase + 45))
        line[i] = close[i - k].mean()
        trend_line = (4 * line[i] + 3 * back(line, i, 1) + 2 * back(line, i, 2) + back(line, i, 3)) / 10
        flat = 1
        if (s > t) != (sines_before[0] > sines_before[1]):
            days, flat = 0, 0
        days += 1
        if days < 0.5 * smooth_period:
            flat = 0
        moved = phase - phase_before
        if smooth_period and 0.67 * 360 / smooth_period < moved < 1.5 * 360 / smooth_period:
            flat = 0
        if trend_line and abs((smooth[i] - trend_line) / trend_line) >= 0.015:
            flat = 1
        phase_before, sines_before = phase, (s, t)
        if i >= 63:
            sine[i], lead[i], trend[i] = s, t, flat
    return {"HT_DCPERIOD": cycle, "HT_SINE": sine, "HT_LEADSINE": lead, "HT_TRENDMODE": trend}
