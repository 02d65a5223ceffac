"""The article-by-period panel: deduplication, periods, masters, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almazara.operators.quality import consistent_lookup, running_sums
from almazara.session import broadcast_if_small

PERIOD = ("report_start", "report_end")


def agreed(c: str) -> Column:
    """A value if all non-null values of the group agree, else null."""
    return F.when(F.min(c) == F.max(c), F.max(c))


def dedupe_panel(df: DataFrame, entity: Sequence[str], metadata: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """One row per entity and period: units and amount added up (0 if all are unknown), flags if any, metadata if consistent.

    ``<c>__period_conflict`` marks metadata with two or more values in the group. One aggregate, combined
    before the shuffle; null keys are groups of their own.
    """
    return df.groupBy(*PERIOD, *entity).agg(
        F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"), F.count(F.lit(1)).alias("source_rows"),
        *[x for c in metadata for x in (agreed(c).alias(c), F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"{c}__period_conflict"))],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags],
    )


def expected_period_days(df: DataFrame, weight: str = "rows", tie: str = "longest", entity: Sequence[str] = ()) -> DataFrame:
    """The most frequent positive length of a period, by rows or by different periods, the longest or shortest on a tie."""
    days = F.datediff("report_end", "report_start") + 1
    rows = df.select(*entity, *PERIOD) if weight == "rows" else df.select(*entity, *PERIOD).distinct()
    counts = rows.select(*entity, days.alias("days")).where("days > 0").groupBy(*entity, "days").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (F.col("days") if tie == "longest" else -F.col("days")).alias("d")))
    picked = counts.groupBy(*entity).agg(best.alias("b")).where("b is not null")
    return picked.select(*entity, F.abs(F.col("b.d")).alias("expected_days"), F.col("b.n").alias("weight"))


def period_fields(df: DataFrame, expected: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """Days, completeness and the text id of each period; ``expected`` is small, one row an entity."""
    out = df.join(broadcast_if_small(expected.select(*entity, "expected_days")), list(entity), "left") if entity else df.withColumn("expected_days", F.lit((expected.first() or {"expected_days": None})["expected_days"]).cast("int"))
    days = F.datediff("report_end", "report_start") + 1
    return out.withColumns({
        "period_days": days, "period_is_complete": F.coalesce(days == F.col("expected_days"), F.lit(False)), "period_is_complete_week": F.coalesce(days == 7, F.lit(False)),
        "period_id": F.concat_ws("__", F.col("report_start").cast("string"), F.col("report_end").cast("string")),
    }).drop("expected_days")


def enrich(panel: DataFrame, master: DataFrame, key: str, columns: Sequence[str], suffix: str) -> DataFrame:
    """The panel's columns completed from a master's consistent values; where the period conflicts or the master disagrees, null stays.

    Columns ``<c>__<suffix>`` hold the master's value.
    """
    lookup = consistent_lookup(master, key, columns).select(key, *[F.col(c).alias(f"{c}__{suffix}") for c in columns], *[f"{c}__master_conflict" for c in columns])
    out = panel.join(broadcast_if_small(lookup), key, "left")
    add = {}
    for c in columns:
        own = F.when(~F.col(f"{c}__period_conflict"), F.col(c)) if f"{c}__period_conflict" in panel.columns else F.col(c) if c in panel.columns else F.lit(None)
        add[c] = F.coalesce(own, F.col(f"{c}__{suffix}"))
        add[f"{c}__master_conflict"] = F.coalesce(F.col(f"{c}__master_conflict"), F.lit(False))
    return out.withColumns(add)


def period_index(df: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """``period_index``: 0.. over the observed periods (of an entity) by date. Numbered on the few different periods, then joined back."""
    periods = df.select(*entity, *PERIOD).distinct()
    w = Window.partitionBy(*entity).orderBy(*PERIOD) if entity else Window.orderBy(*PERIOD)
    numbered = periods.withColumn("period_index", F.row_number().over(w) - 1)
    return df.join(broadcast_if_small(numbered), [*entity, *PERIOD])


def article_profile(panel: DataFrame, entity: Sequence[str] = (), article: str = "article_code") -> DataFrame:
    """Per article: units, amount, periods observed, coverage, share and running share (largest first, ties by code).

    The running share needs one order over all articles of an entity: it runs over the profile, one row an article;
    without an entity over range partitions of it.
    """
    period = F.struct(*PERIOD)
    profile = panel.groupBy(*entity, article).agg(
        F.coalesce(F.sum("units"), F.lit(0.0)).alias("units_total"), F.avg("units").alias("units_mean"), F.median("units").alias("units_median"), F.stddev_samp("units").alias("units_std"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount_total"), F.count_distinct(period).alias("periods_observed"),
    )
    totals = panel.groupBy(*entity).agg(F.count_distinct(period).alias("periods"), F.coalesce(F.sum("units"), F.lit(0.0)).alias("all_units"))
    if entity:
        out = profile.join(broadcast_if_small(totals), list(entity))
    else:
        one = totals.first()
        out = profile.withColumns({"periods": F.lit(one["periods"]), "all_units": F.lit(one["all_units"])})
    out = out.withColumns({"period_coverage": F.try_divide(F.col("periods_observed"), F.col("periods")), "unit_share": F.try_divide(F.col("units_total"), F.col("all_units"))}).drop("periods", "all_units")
    order = [F.desc("units_total"), F.col(article)]
    if not entity:
        return running_sums(out, order, {"cumulative_share": F.col("unit_share")})
    return out.withColumn("cumulative_share", F.sum("unit_share").over(Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def latest_metadata(panel: DataFrame, entity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per entity the latest and the most frequent value of each column, how many there were, and whether it changed."""
    at = F.struct("report_end", "report_start")
    agg = []
    for c in columns:
        agg += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at, c))).alias(f"{c}_latest"), F.mode(c, True).alias(f"{c}_mode"), F.count_distinct(c).alias(f"{c}_values")]
    out = panel.groupBy(*entity).agg(*agg)
    return out.withColumns({f"{c}_changed": F.col(f"{c}_values") > 1 for c in columns})


def period_totals(panel: DataFrame, entity: Sequence[str] = (), article: str = "article_code") -> DataFrame:
    """Per period: units, amount, different articles, and rates a day."""
    out = panel.groupBy(*entity, *PERIOD).agg(F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"), F.count_distinct(article).alias("articles"))
    days = F.datediff("report_end", "report_start") + 1
    per_day = lambda c: F.try_divide(F.col(c), F.when(days > 0, days))
    return out.withColumns({"period_days": days, "units_per_day": per_day("units"), "amount_per_day": per_day("amount"), "articles_per_day": per_day("articles")})


def latest_rows(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key by ``order``: an aggregate on the whole row, combined before the shuffle."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*key, "r.*").select(*df.columns)
