"""Features by configured name, and their classification into families."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import candles, indicators  # noqa: F401  they register what they define
from .features import REGISTRY, Feature

#: Prefixes of numeric features and their ranges.
NUMERIC = {
    "close_change_pct": (-10, 10), "body_size": (0, 100), "upper_wick_size": (0, 100), "lower_wick_size": (0, 100), "total_range": (0, 200), "body_to_range_ratio": (0, 1),
    "RSI": (0, 100), "%K": (0, 100), "%D": (0, 100), "Williams_R": (-100, 0), "CCI": (-250, 250), "STOCHRSI_K": (0, 100), "STOCHRSI_D": (0, 100),
    "PPO": (-50, 50), "ROC": (-50, 50), "ULTOSC": (0, 100), "MOM": (-50, 50), "MACD": (-100, 100), "MACD_Signal": (-100, 100), "MACD_Hist": (-50, 50),
    "ADX": (0, 100), "DI_plus": (0, 100), "DI_minus": (0, 100), "BB_Width": (0, 1), "ATR": (0, 100), "NATR": (0, 5), "OBV": (-1e9, 1e9), "CMF": (-1, 1),
    "AD": (-1e9, 1e9), "ADOSC": (-1e9, 1e9), "HT_DCPERIOD": (0, 100), "HT_SINE": (-1, 1), "HT_LEADSINE": (-1, 1), "RSI_ADX_Ratio": (-10, 10),
    "MACD_ATR_Ratio": (-50, 50), "RSI_Ratio": (0, 5), "BB_Width_Ratio": (0, 5), "RSI_ROC": (-100, 100), "ATR_ROC": (-100, 100), "MACD_Hist_ROC": (-100, 100), "CCI_ROC": (-100, 100),
}
#: Prefixes of features that are compared with each other.
COMPARED = [
    "Open", "High", "Low", "Close", "SMA", "EMA", "VWMA", "DEMA", "TEMA", "TRIMA", "BB_Upper", "BB_Mid", "BB_Lower", "Ichimoku_Tenkan", "Ichimoku_Kijun",
    "Ichimoku_SenkouA", "Ichimoku_SenkouB", "Ichimoku_Chikou_Ratio", "SAR", "Support_MA", "Resistance_MA", "Pivot_Point", "Support1_Pivot",
    "Support2_Pivot", "Resistance1_Pivot", "Resistance2_Pivot",
]
BOOLEAN = [*candles.PATTERNS, "HT_TRENDMODE", "Volume_Spike", "Consecutive_Bullish", "Consecutive_Bearish", "Bullish_Confirmation", "Bearish_Confirmation"]
RULES = [*((p, "bool", None, None) for p in BOOLEAN), *((p, "comparison", None, None) for p in COMPARED), *((p, "num", float(a), float(b)) for p, (a, b) in NUMERIC.items())]
_PRIORITY = {"bool": 0, "comparison": 1, "num": 2}


def build(name: str, **params) -> Feature | None:
    """The feature of a configured name, with or without the prefix calculate_; unknown names warn and give none."""
    make = REGISTRY.get(name.removeprefix("calculate_"))
    if make is None:
        warnings.warn(f"no feature function is named {name}", stacklevel=2)
        return None
    made = make(**params)
    if not made.outputs:
        warnings.warn(f"{name} can't be made with {params}", stacklevel=2)
    return made


def build_all(config: dict[str, list[dict]]) -> list[Feature]:
    """All features of one timeframe's configuration: function to parameter sets."""
    made = [build(name, **params) for name, calls in config.items() for params in calls]
    return [f for f in made if f is not None and f.outputs]


def classify(names: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(feature, family, prefix, low, high) for each distinct name: the longest matching prefix of the first
    family in the order bool, comparison, num; a name without one has a null family.

    A name is met by its own prefixes, of the lengths that rules have, so rules are looked up by equality."""
    table = names.sparkSession.createDataFrame([(p, f, _PRIORITY[f], a, b) for p, f, a, b in rules], "prefix string, family string, priority int, low double, high double")
    distinct = names.select("feature").distinct()
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for p, *_ in rules})])
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("feature")), lambda n: F.substring("feature", F.lit(1), n))
    met = distinct.select("feature", F.explode(prefixes).alias("prefix")).join(table, "prefix")
    best = met.groupBy("feature").agg(F.min_by(F.struct("family", "prefix", "low", "high"), F.struct("priority", -F.length("prefix"))).alias("b"))
    return distinct.join(best, "feature", "left").select("feature", "b.*")


def feature_order(classified: DataFrame) -> DataFrame:
    """(feature, family, idx): sorted numeric, then comparison, then boolean features, numbered from 0."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p in (("num", 0), ("comparison", 1), ("bool", 2)) for x in p]), F.col("family"))
    order = Window.orderBy(rank, "feature")  # a catalogue has some hundreds of rows
    return classified.where("family IS NOT NULL").select("feature", "family", (F.row_number().over(order) - 1).alias("idx"))


def comparison_pairs(classified: DataFrame) -> DataFrame:
    """(feature, other): every comparison feature with every other one."""
    side = classified.where("family = 'comparison'").select("feature")
    return side.join(F.broadcast(side.select(F.col("feature").alias("other"))), F.expr("feature <> other"))
