"""Time bars and as-of alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.market import seconds, spark_interval
from .segments import SEGMENT, carried, segmented, undealt


def ticks_to_bars(ticks: DataFrame, interval: str) -> DataFrame:
    """OHLCV bars (symbol, ts, open, high, low, close, volume) labelled by their start.

    First and last follow ``seq``, skipping null prices; buckets without prices vanish.  The
    aggregation combines on the map side, so a hot symbol shuffles one row a task and bar."""
    priced = ticks.where("price IS NOT NULL")
    grouped = priced.groupBy("symbol", F.window("ts", spark_interval(interval)).alias("w"))
    bars = grouped.agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Bars of a longer interval; a funding_rate column, if there is one, takes its last value."""
    value = lambda c, best: best(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ts")))
    more = [value("funding_rate", F.max_by).alias("funding_rate")] if "funding_rate" in bars.columns else []
    grouped = bars.groupBy("symbol", F.window("ts", spark_interval(interval)).alias("w"))
    out = grouped.agg(value("open", F.min_by).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), value("close", F.max_by).alias("close"), F.sum("volume").alias("volume"), *more)
    names = ["open", "high", "low", "close", "volume", *(["funding_rate"] if more else [])]
    return out.select("symbol", F.col("w.start").alias("ts"), *names).na.drop(how="any", subset=names)


def base_interval(intervals: list[str]) -> str:
    return min(intervals, key=seconds)


def ordered_intervals(intervals: list[str]) -> list[str]:
    """The intervals by length, each once; an unknown one raises ValueError."""
    return sorted(set(intervals), key=seconds)


def as_of(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: str = "symbol", segments: int | None = None) -> DataFrame:
    """Every row of left with the columns of the latest row of right not after it, or nulls.

    Both sides are stacked and dealt by ranges of (by, time) into segments.  The last right row is carried forward within
    a segment, and from segment to segment as one row a segment; so no task holds a whole series, and no range join is
    needed.  The right row travels as a struct: its null values stay null.  Of right rows with one time the greatest
    wins.  A null by or time of left meets nothing."""
    taken = [c for c in right.columns if c != by]
    carried_ = F.struct(*[F.col(f"`{c}`") for c in taken])
    key = lambda df, c: F.when(F.col(c).isNotNull(), F.col(by))
    rows = left.select(key(left, left_ts).alias("_by"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"), F.lit(None).cast(right.select(carried_.alias("r")).schema["r"].dataType).alias("_r"))
    other = right.where(F.col(by).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(by).alias("_by"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), carried_.alias("_r"))
    both = segmented(rows.unionByName(other), ["_by"], ["_ts", "_side"], segments)
    so_far = Window.partitionBy("_by", SEGMENT).orderBy("_ts", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last("_r", ignorenulls=True).over(so_far)
    latest = F.max(F.when(F.col("_side") == 0, F.struct("_ts", "_r")))
    carry = carried(both, "_by", latest).select("_by", SEGMENT, F.col("_carry._r").alias("_before"))
    met = both.withColumn("_m", own) if undealt(both) else both.join(carry, ["_by", SEGMENT], "left").withColumn("_m", F.coalesce(own, "_before"))
    met = met.where("_side = 1")
    return met.select("_l.*", *[F.col(f"_m.`{c}`").alias(c) for c in taken if c not in left.columns or c == right_ts and c != left_ts])


def align(base: DataFrame, other: DataFrame, base_tf: str, tf: str, suffix: str, compat: bool = False) -> DataFrame:
    """base with the columns of the latest complete bar of a longer timeframe, suffixed.

    A bar is complete when it ends; compat matches bar starts instead, which looks ahead."""
    names = [c for c in other.columns if c not in ("symbol", "ts")]
    end = lambda tf: F.col("ts") + F.expr(f"INTERVAL {0 if compat else seconds(tf)} SECONDS")
    right = other.select("symbol", end(tf).alias("_end"), *[F.col(f"`{c}`").alias(c + suffix) for c in names])
    return as_of(base.withColumn("_now", end(base_tf)), right, "_now", "_end").drop("_now", "_end")
