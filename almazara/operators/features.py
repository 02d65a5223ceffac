"""Past-only features: every window ends before the current row or period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almazara.session import broadcast_if_small

_TURN = 2 * 3.141592653589793


def _over(entity: Sequence[str], order: str):
    return Window.partitionBy(*entity).orderBy(order) if entity else Window.orderBy(order)


def daily_lags(df: DataFrame, entity: Sequence[str], columns: Sequence[str], lags: Sequence[int] = (1, 7, 14, 28), date: str = "date") -> DataFrame:
    """``<c>__lag_<k>``: the value k rows before on the continuous daily series."""
    w = _over(entity, date)
    return df.withColumns({f"{c}__lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags})


def daily_rolling(df: DataFrame, entity: Sequence[str], columns: Sequence[str], windows: Sequence[int] = (7, 14, 28), date: str = "date") -> DataFrame:
    """``<c>__rolling_{mean,std,count}_<w>`` over the w rows before the current one."""
    add = {}
    for n in windows:
        w = _over(entity, date).rowsBetween(-n, -1)
        for c in columns:
            add |= {f"{c}__rolling_mean_{n}": F.avg(c).over(w), f"{c}__rolling_std_{n}": F.stddev_samp(c).over(w), f"{c}__rolling_count_{n}": F.count(c).over(w)}
    return df.withColumns(add)


def centred_mean(df: DataFrame, entity: Sequence[str], column: str, days: int = 7, date: str = "date") -> DataFrame:
    """``<c>__centred_mean_<days>`` over as many days before as after on the continuous daily series; for profiles only, it looks ahead."""
    half = days // 2
    return df.withColumn(f"{column}__centred_mean_{days}", F.avg(column).over(_over(entity, date).rowsBetween(-half, half)))


def same_weekday(df: DataFrame, entity: Sequence[str], target: str, activity: str, date: str = "date") -> DataFrame:
    """Mean and count of the target on earlier days of the same weekday, and the share of them with activity (unknown counts as none)."""
    rows = df.withColumn("weekday_key", F.weekday(date))
    w = Window.partitionBy(*entity, "weekday_key").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    active = F.when(F.coalesce(F.col(activity), F.lit(0)) > 0, 1.0).otherwise(0.0)
    return rows.withColumns({
        f"{target}__same_weekday_mean_prior": F.avg(target).over(w), f"{target}__same_weekday_count_prior": F.count(target).over(w), f"{activity}__same_weekday_positive_rate_prior": F.avg(active).over(w),
    }).drop("weekday_key")


def feature_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """``cal_*``: parts of the date and its weekday, month and day of year on circles."""
    d = F.col(date)
    dow, m, doy = F.weekday(d), F.month(d) - 1, F.dayofyear(d) - 1
    add = {
        "cal_year": F.year(d), "cal_quarter": F.quarter(d), "cal_month": F.month(d), "cal_week_of_year": F.weekofyear(d), "cal_day_of_month": F.dayofmonth(d), "cal_day_of_year": F.dayofyear(d),
        "cal_day_of_week": dow, "cal_is_weekend": dow >= 5, "cal_is_month_start": F.dayofmonth(d) == 1, "cal_is_month_end": d == F.last_day(d),
    }
    for name, x, n in (("day_of_week", dow, 7.0), ("month", m, 12.0), ("day_of_year", doy, 365.25)):
        add |= {f"cal_{name}_sin": F.sin(x * (_TURN / n)), f"cal_{name}_cos": F.cos(x * (_TURN / n))}
    return df.withColumns(add)


def period_calendar(df: DataFrame) -> DataFrame:
    """Parts of a period's start, the month of its midpoint, and month and week on circles."""
    s = F.col("report_start")
    mid = F.date_add(s, F.floor(F.datediff("report_end", s) / 2).cast("int"))
    m, w = F.month(mid) - 1, F.weekofyear(s) - 1
    return df.withColumns({
        "period_start_year": F.year(s), "period_start_month": F.month(s), "period_start_week_of_year": F.weekofyear(s), "period_start_day_of_week": F.weekday(s), "period_mid_month": F.month(mid),
        "period_month_sin": F.sin(m * (_TURN / 12)), "period_month_cos": F.cos(m * (_TURN / 12)), "period_week_sin": F.sin(w * (_TURN / 52.1775)), "period_week_cos": F.cos(w * (_TURN / 52.1775)),
    })


def exact_lags(df: DataFrame, entity: Sequence[str], target: str = "units", lags: Sequence[int] = (1, 2, 4, 8), index: str = "period_index") -> DataFrame:
    """``<t>__lag_<k>`` of exactly k periods before, and whether that period was observed: RANGE frames, no self-join, no dense grid."""
    add = {}
    for k in lags:
        w = _over(entity, index).rangeBetween(-k, -k)
        add |= {f"{target}__lag_{k}": F.max(target).over(w), f"{target}__lag_{k}_observed": F.count(target).over(w) > 0}
    return df.withColumns(add)


def history(df: DataFrame, entity: Sequence[str], target: str = "units", windows: Sequence[int] = (4, 8), index: str = "period_index", least: int = 4, frequent: float = 0.75, regular: float = 0.5, intermittent: float = 0.25) -> DataFrame:
    """Counts, means and deviations of all earlier periods and of the last 4 and 8, periods since the last one, and the demand regime.

    The observation rate divides by all earlier periods, also those before the article first appeared.
    """
    past = _over(entity, index).rangeBetween(Window.unboundedPreceding, -1)
    n = F.count(target).over(past)
    add = {
        "history_periods_elapsed": F.col(index), "history_observed_periods": n, "history_observation_rate": F.try_divide(n, F.col(index)),
        f"{target}__expanding_mean_prior": F.avg(target).over(past), f"{target}__expanding_std_prior": F.stddev_samp(target).over(past),
        "periods_since_last_observation": F.col(index) - F.max(F.when(F.col(target).isNotNull(), F.col(index))).over(past),
    }
    for k in windows:
        w = _over(entity, index).rangeBetween(-k, -1)
        add |= {f"{target}__rolling_mean_{k}": F.avg(target).over(w), f"{target}__rolling_std_{k}": F.stddev_samp(target).over(w), f"{target}__rolling_count_{k}": F.count(target).over(w)}
    out = df.withColumns(add)
    rate = F.col("history_observation_rate")
    regime = F.when(F.col("history_observed_periods") < least, "cold_start").when(rate >= frequent, "frequent").when(rate >= regular, "regular").when(rate >= intermittent, "intermittent").otherwise("sparse")
    return out.withColumn("article_demand_regime_prior", regime)


def global_history(df: DataFrame, entity: Sequence[str] = (), target: str = "units", index: str = "period_index") -> DataFrame:
    """Total of the period before and mean of the four before, over all articles; computed on the few periods, joined back."""
    totals = df.groupBy(*entity, index).agg(F.sum(target).alias("total"))
    w = _over(entity, index)
    small = totals.select(*entity, index, F.lag("total").over(w).alias("global_target_total__lag_1"), F.avg("total").over(w.rowsBetween(-4, -1)).alias("global_target_total__rolling_mean_4"))
    return df.join(broadcast_if_small(small), [*entity, index], "left")


# Parts of names of daily columns that add up over a period.
ADDITIVE_TOKENS = ("precipitation", "rain", "sunshine", "duration", "num_", "snow")


def period_context(periods: DataFrame, daily: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Daily columns summed up over each period, as ``context_<c>__{days_true,mean,sum}``, with days available and coverage.

    The days of a period are exploded and joined by equality, instead of a join on a range; a period without
    any day keeps zero counts.
    """
    spans = periods.select(*keys, "report_start", "report_end").distinct()
    days = spans.select("*", F.explode_outer(F.when(F.col("report_start") <= F.col("report_end"), F.sequence("report_start", "report_end", F.expr("interval 1 day")))).alias(date))
    joined = days.join(daily.select(*keys, date, *columns, F.lit(1).alias("present")), [*keys, date], "left")
    agg = [F.count("present").alias("context_days_available")]
    for c, t in columns.items():
        if t == "boolean":
            agg.append(F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"context_{c}__days_true"))
        else:
            agg.append(F.avg(c).alias(f"context_{c}__mean"))
            if any(x in c for x in ADDITIVE_TOKENS):
                agg.append(F.sum(c).alias(f"context_{c}__sum"))
    out = joined.groupBy(*keys, "report_start", "report_end").agg(*agg)
    share = F.try_divide(F.col("context_days_available"), F.datediff("report_end", "report_start") + 1)
    return out.withColumn("context_coverage_fraction", F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def eligibility(df: DataFrame, target: str = "units", complete: str | None = "period_is_complete", negative: str | None = None) -> DataFrame:
    """``target_observed`` and ``training_eligible``: a known, not negative target of a complete period."""
    known = F.col(target).isNotNull()
    below = F.coalesce(F.col(negative) if negative else F.col(target) < 0, F.lit(False))
    whole = F.coalesce(F.col(complete), F.lit(False)) if complete else F.lit(True)
    return df.withColumns({"target_observed": known, "training_eligible": known & ~below & whole})


def known_context_zero(df: DataFrame, flag: str = "tiene_evento", columns: Sequence[str] = ("event_intensity_mean", "event_intensity_max")) -> DataFrame:
    """Intensity 0 where it is known that there was no event."""
    return df.withColumns({c: F.when(F.coalesce(~F.col(flag), F.lit(False)) & F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in columns if c in df.columns})
