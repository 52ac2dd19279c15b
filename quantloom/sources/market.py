"""Market data sources: klines, funding rates, ticks, and the sinks that go with them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kline intervals and their lengths in seconds.
INTERVALS = {
    "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800,
    "12h": 43200, "1d": 86400, "3d": 259200, "1w": 604800, "1M": 2592000,
}
#: The columns of raw kline files, in order, and ours.
KLINE_COLUMNS = {
    "Open time": "ts", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume", "Close time": "close_ts",
    "Quote asset volume": "quote_volume", "Number of trades": "n_trades", "Taker buy base asset volume": "taker_base", "Taker buy quote asset volume": "taker_quote",
}
_PRICES = ("open", "high", "low", "close", "volume", "quote_volume", "taker_base", "taker_quote")
FUNDING = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("funding_ts", T.TimestampNTZType()), T.StructField("funding_rate", T.DoubleType())])


def seconds(interval: str) -> int:
    """The length of an interval such as 5m, 1h or 2d."""
    if interval in INTERVALS:
        return INTERVALS[interval]
    found = re.fullmatch(r"(\d+)([mhd])", interval)
    if not found:
        raise ValueError(f"unknown interval {interval!r}")
    return int(found[1]) * {"m": 60, "h": 3600, "d": 86400}[found[2]]


def spark_interval(interval: str) -> str:
    return f"{seconds(interval)} seconds"


def from_millis(ms: Column) -> Column:
    """Epoch milliseconds, in any type, as a timestamp without zone; null if it is no number."""
    return F.timestamp_millis(ms.try_cast("long")).cast("timestamp_ntz")


def _symbol(symbol: str | Column) -> Column:
    return F.lit(symbol) if isinstance(symbol, str) else symbol


def klines(raw: DataFrame, symbol: str | Column) -> DataFrame:
    """Raw kline rows with our names and types; what isn't a number becomes null.

    symbol: a name, or a column of the raw rows."""
    named = raw.select(*[F.col(f"`{a}`").alias(b) for a, b in KLINE_COLUMNS.items() if a in raw.columns], _symbol(symbol).alias("symbol"))
    kind = dict(named.dtypes)
    when = {c: from_millis(F.col(c)) if not kind[c].startswith("timestamp") else F.col(c).cast("timestamp_ntz") for c in ("ts", "close_ts") if c in kind}
    number = {c: F.col(c).try_cast("double") for c in _PRICES if c in kind} | ({"n_trades": F.col("n_trades").try_cast("long")} if "n_trades" in kind else {})
    return named.withColumns(when | number)


def read_klines(spark: SparkSession, path: str, symbol: str | Column, kind: str = "csv", rows: int | None = None) -> DataFrame:
    """Kline files of any kind that Spark reads, CSV ones with a header; rows: only so many, to look at a file."""
    raw = spark.read.option("header", True).format(kind).load(path)
    return klines(raw.limit(rows) if rows else raw, symbol)


def write_klines(bars: DataFrame, path: str, kind: str = "parquet", time: str = "ts") -> None:
    """Bars, or funding rates by their time, in a folder for each symbol and day."""
    rows = bars.withColumn("day", F.col(time).cast("date"))
    rows.repartition("symbol", "day").write.mode("overwrite").partitionBy("symbol", "day").option("header", True).format(kind).save(path)


def read_klines_between(spark: SparkSession, path: str, columns: str, start: str | None = None, end: str | None = None, symbols: list[str] | None = None, kind: str = "parquet", time: str = "ts") -> DataFrame:
    """What write_klines wrote, from start on and before end, of some symbols or all; columns: their names and types as DDL.

    Folders of other symbols and days are never listed for reading, let alone opened; within a day, the time itself is
    pushed down to the files.  Null bounds are open."""
    rows = spark.read.schema(f"{columns}, symbol string, day date").option("header", True).format(kind).load(path)
    bounds = [(start, lambda c, x: c >= x), (end, lambda c, x: c < x)]
    for at, holds in bounds:
        if at is not None:
            instant = F.lit(at).cast("timestamp_ntz")
            rows = rows.where(holds(F.col(time), instant))
    if start is not None:
        rows = rows.where(F.col("day") >= F.lit(start).cast("timestamp_ntz").cast("date"))
    if end is not None:
        rows = rows.where(F.col("day") <= F.lit(end).cast("timestamp_ntz").cast("date"))
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(symbols))
    return rows.drop("day")


def read_klines_csv(spark: SparkSession, path: str, symbol: str | Column, rows: int | None = None) -> DataFrame:
    return read_klines(spark, path, symbol, "csv", rows)


def read_funding_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.select(F.lit(symbol).alias("symbol"), from_millis(F.col("fundingTime")).alias("funding_ts"), F.col("fundingRate").try_cast("double").alias("funding_rate"))


def no_funding(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FUNDING)


def write_table(df: DataFrame, path: str, kind: str = "parquet", if_missing: bool = False, partition_by: list[str] | None = None) -> None:
    """Write a table; if_missing leaves one that exists as it is."""
    writer = df.write.mode("ignore" if if_missing else "overwrite").partitionBy(*(partition_by or []))
    writer.option("header", True).format(kind).save(path)


def event_ticks(events: DataFrame) -> DataFrame:
    """Ticks (symbol, ts, seq, price, volume) of an event table: type, value and the number k in props."""
    volume = F.get_json_object("props", "$.k").cast("double")
    return events.select(F.col("event_type").alias("symbol"), "ts", F.struct("ts", "event_id").alias("seq"), F.col("value").alias("price"), volume.alias("volume"))


def order_line_ticks(lineitem: DataFrame) -> DataFrame:
    """Daily ticks of order lines: return flag, ship date, unit price and quantity."""
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return lineitem.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), seq.alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))


def random_walk(spark: SparkSession, symbol: str, bars: int, interval: str = "1m", start: float = 2000.0, seed: int = 0) -> DataFrame:
    """Synthetic klines: a walk of normal steps, the same for the same seed."""
    from pyspark.sql import Window

    order = Window.partitionBy("symbol").orderBy("i")
    step = spark.range(bars).select(F.lit(symbol).alias("symbol"), F.col("id").alias("i"), F.randn(seed).alias("z"), F.rand(seed + 1).alias("u"))
    walk = step.withColumn("close", F.lit(start) + F.sum("z").over(order)).withColumn("open", F.coalesce(F.lag("close").over(order), F.lit(start)))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("i") * seconds(interval)).cast("timestamp_ntz")
    return walk.select("symbol", ts.alias("ts"), "open", (F.greatest("open", "close") + F.col("u")).alias("high"), (F.least("open", "close") - F.col("u")).alias("low"), "close", (100000 + 400000 * F.col("u")).alias("volume"))
