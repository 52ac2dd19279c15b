"""The preprocessing pipeline: bars to one wide table of features of several timeframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..functions.features import apply, col
from ..operators.bars import align, as_of, base_interval, ordered_intervals, resample

Config = dict[str, dict[str, list[dict]]]
#: Features that need others, which a configuration in compat mode leaves out.
COMPOSITES = {"rsi_adx_ratio", "macd_atr_ratio", "short_long_ratio", "indicator_roc", "confirmation_signal"}


def _calls(config: Config, tf: str, compat: bool) -> dict[str, list[dict]]:
    return {n: c for n, c in config[tf].items() if not (compat and n.removeprefix("calculate_") in COMPOSITES)}


def feature_names(config: Config, compat: bool = False) -> list[str]:
    """The columns that feature_table gives besides symbol and ts, sorted."""
    return sorted({f"{n}_{tf}" for tf in ordered_intervals(list(config)) for f in registry.build_all(_calls(config, tf, compat)) for n in f.outputs})


def with_funding(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """bars with the funding_rate in force at their start; none before the first."""
    return as_of(bars, funding.select("symbol", "funding_ts", "funding_rate"), "ts", "funding_ts").drop("funding_ts")


def feature_table(bars: DataFrame, config: Config, compat: bool = False, complete: bool = True) -> DataFrame:
    """(symbol, ts, features...) for each bar of the shortest timeframe of config.

    config: timeframe to function to parameter sets.  Every timeframe is resampled from the bars, featured, and
    carried to the base bars from its last complete bar on.  compat: starts are matched, which looks ahead, and
    composites are left out.  complete: only rows without nulls."""
    frames = ordered_intervals(list(config))
    base = base_interval(frames)
    wide = None
    for tf in frames:
        made = registry.build_all(_calls(config, tf, compat))
        names = list(dict.fromkeys(n for f in made for n in f.outputs))
        here = apply(resample(bars, tf), made).select("symbol", "ts", *[col(n) for n in names])
        if tf == base:
            wide = here.select("symbol", "ts", *[col(n).alias(f"{n}_{tf}") for n in names])
        else:
            wide = align(wide, here, base, tf, f"_{tf}", compat)
    names = sorted(c for c in wide.columns if c not in ("symbol", "ts"))
    wide = wide.select("symbol", "ts", *[col(n) for n in names])
    return wide.where(F.forall(F.array(*[col(n).isNotNull() for n in names]), lambda x: x)) if complete and names else wide


def feature_catalog(config: Config, spark) -> DataFrame:
    """(feature, family, prefix, low, high, idx) of all features of a configuration."""
    named = spark.createDataFrame([(n,) for n in feature_names(config)], "feature string")
    classes = registry.classify(named)
    return classes.join(registry.feature_order(classes).select("feature", "idx"), "feature", "left")


def feature_array(table: DataFrame, order: list[str]) -> DataFrame:
    """(symbol, ts, features): the named columns as one array of doubles, in order; missing ones are null."""
    have = set(table.columns)
    return table.select("symbol", "ts", F.array(*[col(n).cast("double") if n in have else F.lit(None).cast("double") for n in order]).alias("features"))
