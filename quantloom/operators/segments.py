"""Ordered series cut into segments of bounded length, whatever the length of a series.

Rows are dealt by ranges of (series, order) and written once; a physical range is a segment.  A segment may hold many
short series, but only its first one can have begun in an earlier segment.  So whatever has to travel from segment to
segment travels for one series each: at most one carry a segment, and there are at most ``MAX_SEGMENTS`` of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage

#: Rows of a segment, and segments at most; beyond that, segments grow, and tasks stream through them.
SEGMENT_ROWS, MAX_SEGMENTS = 16_384, 4_096
SEGMENT = "_segment"
_ALONE = "alone"


def segmented(rows: DataFrame, by: list[str], order: list[str], segments: int | None = None) -> DataFrame:
    """rows with _segment, in order within each partition, which is one segment; computed once.

    Rows that are equal in all of by and order stay in one segment.  What fills no more than one segment is not dealt."""
    if segments is None:
        rows = cut_lineage(rows)
        segments = min(MAX_SEGMENTS, max(1, math.ceil(rows.count() / SEGMENT_ROWS)))
    key = [F.col(f"`{c}`") for c in [*by, *order]]
    if segments == 1:
        nought = F.hash(*key).bitwiseAND(F.lit(0)).alias(SEGMENT, metadata={_ALONE: True})
        return rows.coalesce(1).sortWithinPartitions(*key).select(*[F.col(f"`{c}`") for c in rows.columns], nought)
    dealt = rows.repartitionByRange(segments, *key).sortWithinPartitions(*key)
    return cut_lineage(dealt.withColumn(SEGMENT, F.spark_partition_id()))


def undealt(rows: DataFrame) -> bool:
    """Whether what segmented() made is one segment, so that nothing is carried."""
    return bool(rows.schema[SEGMENT].metadata.get(_ALONE))


def carried(rows: DataFrame, by: str, last: Column) -> DataFrame:
    """(by, _segment, _carry) for the series of rows, which segmented() made, that go on from an earlier segment.

    last: an aggregate that gives what a segment hands on, null if nothing new; the carry is the latest one before.
    One row a segment and series is all that meets here."""
    handed = rows.groupBy(F.col(f"`{by}`"), SEGMENT).agg(last.alias("_last"))
    before = Window.partitionBy(F.col(f"`{by}`")).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    return handed.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).where("_carry IS NOT NULL").drop("_last")


def prefixed(rows: DataFrame, order: list[str], sums: dict[str, str] | None = None, segments: int | None = None) -> DataFrame:
    """rows with _rank, their number from 0 on in order, and for each name of sums a struct (before, upto): the sum of that column before and with the row.

    Local sums by segment, and each segment's start from the totals of those before it: one row a segment reaches the driver.
    One row's upto is the next one's before to the last bit.  order should tell all rows apart; a null counts nothing."""
    sums = sums or {}
    cut = segmented(rows, [], order, segments)
    here = Window.partitionBy(SEGMENT).orderBy(*[F.col(f"`{c}`") for c in order])
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_rank", F.row_number().over(here).cast("long") - 1)
    local = local.withColumns({f"_upto_{k}": F.coalesce(F.sum(F.col(f"`{c}`").cast("double")).over(so_far), F.lit(0.0)) for k, c in enumerate(sums.values())})
    local = cut_lineage(local.withColumns({f"_before_{k}": F.coalesce(F.lag(f"_upto_{k}").over(here), F.lit(0.0)) for k in range(len(sums))}))
    ends = local.groupBy(SEGMENT).agg(F.count("*").alias("n"), *[F.max_by(f"_upto_{k}", "_rank").alias(f"s{k}") for k in range(len(sums))]).orderBy(SEGMENT).collect()
    starts, at = [], [0, *[0.0] * len(sums)]
    for r in ends:
        starts.append((r[SEGMENT], *at))
        at = [a + b for a, b in zip(at, r[1:], strict=True)]
    kind = f"{SEGMENT} int, _n long" + "".join(f", _s{k} double" for k in range(len(sums)))
    met = local.join(F.broadcast(rows.sparkSession.createDataFrame(starts, kind)), SEGMENT)  # MAX_SEGMENTS rows at most
    made = {c: F.struct((F.col(f"_s{k}") + F.col(f"_before_{k}")).alias("before"), (F.col(f"_s{k}") + F.col(f"_upto_{k}")).alias("upto")).alias(c) for k, c in enumerate(sums)}
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_n") + F.col("_rank")).alias("_rank"), *made.values())


def numbered(rows: DataFrame, by: str = "symbol", order: str = "ts", name: str = "bar", segments: int | None = None) -> DataFrame:
    """rows with their number from 0 on within each series, in order: counts of earlier segments and places within one."""
    cut = segmented(rows, [by], [order], segments)
    counts = cut.groupBy(F.col(f"`{by}`"), SEGMENT).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.col(f"`{by}`")).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)  # a row a segment and series
    starts = counts.select(F.col(f"`{by}`").alias("_by"), F.col(SEGMENT).alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(F.col(f"`{by}`"), SEGMENT).orderBy(F.col(f"`{order}`"))).cast("long") - 1
    met = cut.withColumn("_here", here).join(starts, F.col(f"`{by}`").eqNullSafe(F.col("_by")) & (F.col(SEGMENT) == F.col("_at")))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_here")).alias(name))
