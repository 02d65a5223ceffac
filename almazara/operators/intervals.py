"""Problem 2: overlapping, nested, touching and gapped day intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_DAY = 86_400


def covered_spans(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Continuous periods and gaps of every entity, as (entity, span_kind, span_start, span_end), all bounds covered days.

    Rows are intervals of days with both bounds covered. Native session windows with a duration of their own
    per row merge what overlaps or nests; sessions that merely touch (next day) are then joined, and gaps are
    what lies between two successive periods.

    Intervals of one entity that share a start are first reduced to the longest, with map-side combination, so
    an entity with a third of all rows enters the sort with no more rows than there are calendar days.

    Defined edge cases: rows with a null entity, a null bound or an end before its start are no intervals;
    repeated rows change nothing; an empty input gives an empty result; other columns are ignored, whatever
    their names.
    """
    days = (
        df.select(
            F.col(entity).cast("string").alias("entity"),
            F.unix_date(F.col(start).cast("date")).alias("s"),
            F.unix_date(F.col(end).cast("date")).alias("e"),
        )
        .where("entity is not null and s is not null and e is not null and e >= s")
        .groupBy("entity", "s")
        .agg(F.max("e").alias("e"))
    )
    sessions = (
        days.select("entity", F.timestamp_seconds(F.col("s").cast("long") * _DAY).alias("at"), (F.col("e") - F.col("s") + 1).alias("n"))
        .groupBy("entity", F.session_window("at", F.concat((F.col("n") * 24).cast("string"), F.lit(" hours"))).alias("w"))
        .agg(F.count(F.lit(1)).alias("intervals"))
        .select(
            "entity",
            F.floor(F.unix_seconds("w.start") / _DAY).cast("int").alias("s"),
            (F.floor(F.unix_seconds("w.end") / _DAY) - 1).cast("int").alias("e"),
        )
    )
    by = Window.partitionBy("entity").orderBy("s")
    periods = (
        sessions.withColumn("new", F.when(F.col("s") > F.lag("e").over(by) + 1, 1).otherwise(0))
        .withColumn("island", F.sum("new").over(by))
        .groupBy("entity", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .withColumn("next", F.lead("s").over(by))
    )
    both = F.array(
        F.struct(F.lit("period").alias("k"), F.col("s").alias("a"), F.col("e").alias("b")),
        F.struct(F.lit("gap").alias("k"), (F.col("e") + 1).alias("a"), (F.col("next") - 1).alias("b")),
    )
    return (
        periods.select("entity", F.explode(both).alias("x"))
        .where("x.b is not null")
        .select("entity", F.col("x.k").alias("span_kind"), F.date_from_unix_date("x.a").alias("span_start"), F.date_from_unix_date("x.b").alias("span_end"))
    )
