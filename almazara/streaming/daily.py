"""Streaming counterparts of additive daily aggregates (an addition: the batch semantics with watermarks)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(stream: DataFrame, at: str, entity: Sequence[str], value: str, lateness: str = "1 day") -> DataFrame:
    """Rows, sum and largest of ``value`` per entity and day of ``at``; rows later than ``lateness`` are left out once a day is closed."""
    return (
        stream.withWatermark(at, lateness).groupBy(*entity, F.window(at, "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"), F.max(value).alias("largest"))
        .select(*entity, F.to_date("w.start").alias("date"), "rows", "total", "largest")
    )


def deduplicated(stream: DataFrame, keys: Sequence[str], at: str, lateness: str = "1 day") -> DataFrame:
    """Each key once while its time is within the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))
