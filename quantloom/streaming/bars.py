"""Bars from a stream of ticks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import ticks_to_bars
from ..sources.market import event_ticks
from ..sources.storage import shared_folder


def bar_stream(ticks: DataFrame, interval: str, delay: str = "10 minutes") -> DataFrame:
    """Bars of a tick stream; a bar is final once ticks later than its end by delay have come.

    Watermarks need instants, so times without a zone are taken as the session's and given back as such."""
    kind = dict(ticks.dtypes)["ts"]
    bars = ticks_to_bars(ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay), interval)
    return bars.withColumn("ts", F.col("ts").cast(kind))


def write_bars(bars: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts writing a bar stream: every batch's changed bars go to a folder of their own, so a batch done again leaves nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bars.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """The bars that write_bars wrote, each as its last batch has it."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("symbol", "ts", "batch")]
    last = rows.groupBy("symbol", "ts").agg(F.max_by(F.struct(*names), "batch").alias("b"))
    return last.select("symbol", "ts", "b.*")


def streamed_bars(spark: SparkSession, path: str, interval: str, delay: str = "10 minutes") -> DataFrame:
    """Bars of all events under path, read as a stream until it is used up."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    ticks = event_ticks(spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder))
    place = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    write_bars(bar_stream(ticks, interval, delay), f"{place}/table", f"{place}/state", availableNow=True).awaitTermination()
    return read_bars(spark, f"{place}/table")
