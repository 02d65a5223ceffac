"""The next period: horizon, scaffold, daily context, and ranking of a forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almazara.operators.daily import expand_days, joined_names
from almazara.operators.panel import latest_rows
from almazara.operators.quality import running_sums
from almazara.session import broadcast_if_small


def complete_rows(df: DataFrame, flag: str = "period_is_complete") -> DataFrame:
    """Rows of complete periods; all rows where there is no complete one."""
    return df.where(F.coalesce(F.col(flag), F.lit(False))) if df.where(F.col(flag)).limit(1).count() else df


def period_table(df: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """One row per period: days, and whether all its rows are complete (unknown counts as complete)."""
    return df.groupBy(*entity, "report_start", "report_end").agg(F.coalesce(F.bool_and("period_is_complete"), F.lit(True)).alias("period_is_complete")).withColumn("period_days", F.datediff("report_end", "report_start") + 1)


def cadence(periods: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """The most frequent positive distance between the starts of successive periods, the shortest on a tie."""
    w = Window.partitionBy(*entity).orderBy("report_start") if entity else Window.orderBy("report_start")
    gaps = periods.select(*entity, "report_start").distinct().select(*entity, F.datediff("report_start", F.lag("report_start").over(w)).alias("gap")).where("gap > 0")
    counts = gaps.groupBy(*entity, "gap").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*entity).agg(F.max(F.struct("n", (-F.col("gap")).alias("g"))).alias("b")).where("b is not null").select(*entity, (-F.col("b.g")).alias("cadence_days"))


def next_period(periods: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """(*entity, forecast_start, forecast_end): the first period after the latest observed end, aligned to the latest complete start.

    Closed form of stepping by the cadence; the length is the most frequent one of complete periods (shortest on a tie).
    """
    done = periods.where("period_is_complete")
    lengths = done.groupBy(*entity, "period_days").agg(F.count(F.lit(1)).alias("n")).groupBy(*entity).agg(F.max(F.struct("n", (-F.col("period_days")).alias("d"))).alias("b")).select(*entity, (-F.col("b.d")).alias("length"))
    last = periods.groupBy(*entity).agg(F.max("report_end").alias("latest_end"), F.max(F.when(F.col("period_is_complete"), F.col("report_start"))).alias("latest_start"))
    if entity:
        joined = last.join(lengths, list(entity)).join(cadence(done, entity), list(entity), "left")
    else:
        a, b = lengths.first(), cadence(done).first()
        joined = last.withColumns({"length": F.lit(a["length"] if a else None).cast("int"), "cadence_days": F.lit(b["cadence_days"] if b else None).cast("int")})
    step = F.coalesce("cadence_days", "length")
    ahead = F.datediff("latest_end", "latest_start")
    start = F.when(ahead >= 0, F.date_add("latest_start", (step * (F.floor(ahead / step) + 1)).cast("int"))).otherwise(F.col("latest_start"))
    return joined.select(*entity, start.alias("forecast_start"), F.date_add(start, F.col("length") - 1).alias("forecast_end"), "cadence_days", F.col("length").alias("period_days"))


def future_scaffold(panel: DataFrame, horizon: DataFrame, entity: Sequence[str], article: str, outcomes: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """One row per article for the coming period, from its latest row: outcomes null, flags false, period fields set."""
    latest = latest_rows(panel, [*entity, article], ["report_end", "report_start"])
    if entity:
        out = latest.join(broadcast_if_small(horizon.select(*entity, "forecast_start", "forecast_end")), list(entity))
    else:
        h = horizon.first()
        out = latest.withColumns({"forecast_start": F.lit(h["forecast_start"]), "forecast_end": F.lit(h["forecast_end"])})
    kinds = dict(panel.dtypes)
    out = out.withColumns({"report_start": F.col("forecast_start"), "report_end": F.col("forecast_end"), **{c: F.lit(None).cast(kinds[c]) for c in outcomes}, **{c: F.lit(False) for c in flags}})
    return out.select(*panel.columns)


def events_in_horizon(events: DataFrame, start: Column, end: Column, key: Sequence[str] = ()) -> DataFrame:
    """Per day of the horizon the different events, their names, and mean and largest intensity; an inverted event counts on its first day."""
    fixed = events.withColumn("event_end", F.greatest("event_end", "event_start")).where((F.col("event_start") <= end) & (F.col("event_end") >= start))
    days = expand_days(fixed, "event_start", "event_end", lower=start, upper=end)
    once = days.groupBy(*key, "date", "event_id").agg(F.max("event_intensity").alias("event_intensity"), F.min("event_name").alias("event_name"))
    return once.groupBy(*key, "date").agg(
        F.lit(True).alias("tiene_evento"), F.count("event_id").alias("num_eventos"), joined_names(F.col("event_name")).alias("eventos_nombres"),
        F.avg("event_intensity").alias("event_intensity_mean"), F.max("event_intensity").alias("event_intensity_max"),
    )


def future_context(days: DataFrame, events: DataFrame | None = None, holidays: DataFrame | None = None, weather: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Days of the horizon with events (none is 0 and false), holidays, and forecast weather where given."""
    out = days
    if events is not None:
        zero = {"tiene_evento": F.coalesce("tiene_evento", F.lit(False)), "num_eventos": F.coalesce("num_eventos", F.lit(0)), "event_intensity_mean": F.coalesce("event_intensity_mean", F.lit(0.0)), "event_intensity_max": F.coalesce("event_intensity_max", F.lit(0.0))}
        out = out.join(events, [*key, "date"], "left").withColumns(zero)
    if holidays is not None:
        out = out.join(holidays, [*key, "date"], "left").withColumns({"es_festivo": F.coalesce("es_festivo", F.lit(False)), "num_festivos": F.coalesce("num_festivos", F.lit(0))})
    return out.join(weather, [*key, "date"], "left") if weather is not None else out


def forecast_weather(df: DataFrame, start: Column, end: Column, key: Sequence[str] = ()) -> DataFrame:
    """Forecast weather per day of the horizon: rain-like measures add up, flags hold if any, the rest is averaged."""
    agg = []
    for c, t in df.dtypes:
        if c in (*key, "date"):
            continue
        if t == "boolean":
            agg.append(F.bool_or(c).alias(c))
        elif t in ("double", "float", "int", "bigint"):
            agg.append((F.sum(c) if any(x in c for x in ("rain", "precipitation", "snow", "sunshine", "lluvia")) else F.avg(c)).alias(c))
    return df.where(F.col("date").between(start, end)).groupBy(*key, "date").agg(*agg)


def compact(forecast: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """The preferred columns that exist, in that order, then all ``context_`` columns."""
    first = [c for c in preferred if c in forecast.columns]
    return forecast.select(*first, *[c for c in forecast.columns if c.startswith("context_") and c not in first])


def override_union(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by name in which ``new`` wins wherever both have a key; an anti-join, no window."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def history_profile(panel: DataFrame, entity: Sequence[str], article: str = "article_code", index: str = "period_index") -> DataFrame:
    """Per article: periods observed, first and last index, name, units (null if all are unknown), periods since the last, and recency flags."""
    named = [F.max_by("article_name", F.when(F.col("article_name").isNotNull(), F.struct("report_end", "report_start", "article_name"))).alias("article_name_last")] if "article_name" in panel.columns else []
    out = panel.groupBy(*entity, article).agg(
        *named, F.count_distinct(index).alias("periods_observed"), F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.min("report_start").alias("first_start"), F.max("report_end").alias("last_end"), F.sum("units").alias("units_total_history"),
    )
    if entity:
        out = out.join(broadcast_if_small(panel.groupBy(*entity).agg(F.max(index).alias("latest"))), list(entity))
    else:
        out = out.withColumn("latest", F.lit(panel.agg(F.max(index)).first()[0]))
    since = F.col("latest") - F.col("last_index")
    return out.withColumns({"periods_since_last_observed": since, "observed_last_4_periods": since < 4, "observed_last_8_periods": since < 8, "observed_latest_complete_period": since == 0}).drop("latest")


def combine_catalogues(master: DataFrame, menu: DataFrame, observed: DataFrame, key: str = "article_code") -> DataFrame:
    """Every code of the three sources once, with where it occurs: one union and aggregate in place of full joins."""
    tag = lambda df, m, u, h: df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.lit(m).alias("in_article_master"), F.lit(u).alias("in_menu"), F.lit(h).alias("observed_in_any_history"))
    every = tag(master, True, False, False).unionByName(tag(menu, False, True, False)).unionByName(tag(observed, False, False, True))
    return every.groupBy(key).agg(*[F.bool_or(c).alias(c) for c in ("in_article_master", "in_menu", "observed_in_any_history")])


def audit_catalogue(catalogue: DataFrame, profile: DataFrame, key: str = "article_code") -> DataFrame:
    """Every code of the catalogue with its history, if it has one; codes are compared as text."""
    return catalogue.join(profile.withColumn(key, F.col(key).cast("string")), key, "left")


def forecast_summary(forecast: DataFrame, group: Sequence[str] = (), value: str = "predicted_units", top: int = 20) -> DataFrame:
    """Per group: articles, predicted total, the largest ``top`` articles' units and share, fallbacks, articles of class A."""
    best = F.col("forecast_rank") <= top
    fallback = F.count_if(F.coalesce(F.col("used_prediction_fallback"), F.lit(False))) if "used_prediction_fallback" in forecast.columns else F.lit(None).cast("long")
    return forecast.groupBy(*group).agg(
        F.count(F.lit(1)).alias("articles"), F.sum(value).alias("predicted_total"), F.sum(F.when(best, F.col(value))).alias("top_units"), F.sum(F.when(best, F.col("forecast_share"))).alias("top_share"),
        fallback.alias("fallback_articles"), F.count_if(F.col("planning_class") == "A").alias("class_a"),
    )


def usage(forecast: DataFrame, column: str) -> DataFrame:
    """(column, articles): how often each model or regime was used."""
    return forecast.groupBy(column).agg(F.count(F.lit(1)).alias("articles"))


def rank_forecast(forecast: DataFrame, group: Sequence[str], article: str, value: str = "predicted_units", a: float = 0.8, b: float = 0.95) -> DataFrame:
    """Rank (largest first, ties by code), share, running share, class A/B/C by the running share before the row, units rounded half to even."""
    if group:
        w = Window.partitionBy(*group)
        order = w.orderBy(F.desc(value), article)
        out = forecast.withColumns({"forecast_rank": F.row_number().over(order), "forecast_share": F.try_divide(F.col(value), F.sum(value).over(w))})
        out = out.withColumn("forecast_cumulative_share", F.sum("forecast_share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    else:  # one order over all articles, summed over range partitions
        total = forecast.agg(F.sum(value)).first()[0]
        out = forecast.withColumn("forecast_share", F.try_divide(F.col(value), F.lit(total).cast("double")))
        out = running_sums(out, [F.desc(value), article], {"forecast_rank": F.lit(1), "forecast_cumulative_share": F.col("forecast_share")})
    before = F.col("forecast_cumulative_share") - F.col("forecast_share")
    return out.withColumns({"planning_class": F.when(before < a, "A").when(before < b, "B").otherwise("C"), "predicted_units_rounded": F.bround(value, 0).cast("long")})
