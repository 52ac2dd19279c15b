"""Candlestick patterns as boolean expressions on a bar and the four before it.

Each rule is plain SQL over columns that end in the number of bars back: o, h, l, c prices, b body,
u and w upper and lower shadow, t and m top and bottom of the body, k colour (1 or -1); and averages
over the bars before that one: a body of 10, r range of 10, n range of 5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .features import Feature, col, feature, full, lag, rows_back

_SMALL, _DOJI, _LONG = "b{0} < a{0}", "b{0} <= 0.1 * r{0}", "b{0} > a{0}"
_NO_UPPER, _NO_LOWER, _LOWER = "u{0} < 0.1 * r{0}", "w{0} < 0.1 * r{0}", "w{0} > 0.1 * r{0}"


def _all(*rules: str) -> str:
    return " AND ".join(f"({r})" for r in rules)


def _at(rule: str, *bars: int) -> str:
    return _all(*(rule.format(n) for n in bars))


_UP1, _DOWN1, _UP2, _DOWN2 = "m0 > t1", "t0 < m1", "m1 > t2", "t1 < m2"
_HAMMER = _all(_at(_SMALL, 0), "w0 > b0", _at(_NO_UPPER, 0))
_INVERTED = _all(_at(_SMALL, 0), "u0 > b0", _at(_NO_LOWER, 0))
_HARAMI = _all(_at(_LONG, 1), "b0 <= a0", "t0 <= t1", "m0 >= m1")
_STAR = _all(_at(_LONG, 2), "k2 = -1", _DOWN2, "b0 > a0", "k0 = 1", "c0 > c2 + 0.3 * b2")
_TASUKI = _all("k1 = -k0", "abs(b1 - b0) < 0.2 * n1")
_SIDE_GAP = _all("k2 = k1", "k1 = -k0", "o0 < t1", "o0 > m1", "c0 < t2", "c0 > m2")
_THREE = _all(
    _at(_LONG, 4), _at(_SMALL, 3, 2, 1), _at(_LONG, 0), "k4 = -k3", "k3 = k2", "k2 = k1", "k0 = k4", _at("m{0} < h4", 3, 2, 1), _at("t{0} > l4", 3, 2, 1),
    "c2 * k4 < c3 * k4", "c1 * k4 < c2 * k4", "o0 * k4 > c1 * k4", "c0 * k4 > c4 * k4",
)

PATTERNS = {
    "InvertedHammers": _all(_INVERTED, _DOWN1),
    "Hammers": _all(_HAMMER, "m0 <= l1 + 0.2 * n1"),
    "HangingMen": _all(_HAMMER, "m0 >= h1 - 0.2 * n1"),
    "DarkCloudCovers": _all("k1 = 1", _at(_LONG, 1), "k0 = -1", "o0 > h1", "c0 > o1", "c0 < c1 - 0.5 * b1"),
    "Dojis": _at(_DOJI, 0),
    "DragonflyDojis": _all(_at(_DOJI, 0), _at(_NO_UPPER, 0), _at(_LOWER, 0)),
    "GravestoneDojis": _all(_at(_DOJI, 0), _at(_NO_LOWER, 0), "u0 > 0.1 * r0"),
    "MorningStars": _all(_STAR, "b1 <= a1"),
    "MorningStarDojis": _all(_STAR, _at(_DOJI, 1)),
    "PiercingPatterns": _all("k1 = -1", "k0 = 1", _at(_LONG, 1, 0), "o0 < l1", "c0 < o1", "c0 > c1 + 0.5 * b1"),
    "ShootingStars": _all(_INVERTED, _UP1),
    "3BlackCrows": _all("k3 = 1", _at("k{0} = -1", 2, 1, 0), _at(_NO_LOWER, 2, 1, 0), "o1 < o2", "o1 > c2", "o0 < o1", "o0 > c1", "h3 > c2", "c2 > c1", "c1 > c0"),
    "3WhiteSoldiers": _all(
        _at("k{0} = 1", 2, 1, 0), _at(_NO_UPPER, 2, 1, 0), "c0 > c1", "c1 > c2", "o1 > o2", "o1 <= c2 + 0.2 * n2", "o0 > o1", "o0 <= c1 + 0.2 * n1",
        "b1 > b2 - 0.6 * n2", "b0 > b1 - 0.6 * n1", "b0 > a0",
    ),
    "3StarsInSouth": _all(
        _at("k{0} = -1", 2, 1, 0), _at(_LONG, 2), "w2 > b2", "b1 < b2", "o1 > c2", "o1 <= h2", "l1 < c2", "l1 >= l2", _at(_LOWER, 1),
        _at(_SMALL, 0), _at(_NO_LOWER, 0), _at(_NO_UPPER, 0), "l0 > l1", "h0 < h1",
    ),
    "BullishHarami": _all(_HARAMI, "k1 = -1"),
    "BearishHarami": _all(_HARAMI, "k1 = 1"),
    "BullishEngulfing": _all("k0 = 1", "k1 = -1", "(c0 >= o1 AND o0 < c1) OR (c0 > o1 AND o0 <= c1)"),
    "BearishEngulfing": _all("k0 = -1", "k1 = 1", "(o0 >= c1 AND c0 < o1) OR (o0 > c1 AND c0 <= o1)"),
    "BullishDojiStar": _all(_at(_LONG, 1), _at(_DOJI, 0), "k1 = -1", _DOWN1),
    "BearishDojiStar": _all(_at(_LONG, 1), _at(_DOJI, 0), "k1 = 1", _UP1),
    "BullishTasukiGap": _all(_TASUKI, _UP2, "k1 = 1", "o0 < c1", "o0 > o1", "c0 < o1", "c0 > t2"),
    "BearishTasukiGap": _all(_TASUKI, _DOWN2, "k1 = -1", "o0 < o1", "o0 > c1", "c0 > o1", "c0 < m2"),
    "BullishXSideGap3Methods": _all(_SIDE_GAP, "k2 = 1", _UP2),
    "BearishXSideGap3Methods": _all(_SIDE_GAP, "k2 = -1", _DOWN2),
    "BullishSpinningTop": _all(_at(_SMALL, 0), "u0 > b0", "w0 > b0", "k0 = 1"),
    "BearishSpinningTop": _all(_at(_SMALL, 0), "u0 > b0", "w0 > b0", "k0 = -1"),
    "BullishRise3Methods": _all(_THREE, "k4 = 1"),
    "BearishFall3Methods": _all(_THREE, "k4 = -1"),
}

_SHAPE = {
    "o": "open", "h": "high", "l": "low", "c": "close", "b": "abs(close - open)", "u": "high - greatest(open, close)", "w": "least(open, close) - low",
    "t": "greatest(open, close)", "m": "least(open, close)", "k": "CASE WHEN close >= open THEN 1 ELSE -1 END",
}


@feature
def all_candlestick_patterns() -> Feature:
    """All patterns; false where the bars they look back on aren't there."""
    before = lambda n: rows_back(n, 1)
    enough = lambda n, value: full(n + 1, value)
    spread = col("high") - col("low")
    shape = {f"_{k}0": F.expr(v) for k, v in _SHAPE.items()}
    averages = {"_a0": enough(10, F.avg("_b0").over(before(10))), "_r0": enough(10, F.avg(spread).over(before(10))), "_n0": enough(5, F.avg(spread).over(before(5)))}
    names = [*_SHAPE, "a", "r", "n"]
    lags = {f"{n}{k}": lag(f"_{n}0", k) if k else F.col(f"_{n}0") for n in names for k in range(5)}
    return Feature({n: F.coalesce(F.expr(rule), F.lit(False)) for n, rule in PATTERNS.items()}, [shape, averages, lags])
