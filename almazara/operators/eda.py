"""Profiles of tables, days, articles, reservations and events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almazara.operators.quality import exact_quantiles, is_flag, running_sums
from almazara.session import cut


def dataset_summary(tables: Mapping[str, DataFrame], days: Mapping[str, str] | None = None) -> DataFrame:
    """(dataset, rows, columns, missing_cells, duplicate_rows, first_day, last_day) of every table."""
    days, out = dict(days or {}), None
    for name, df in tables.items():
        copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies_n"))
        empty = sum((F.when(F.col(c).isNull(), F.col("copies_n")).otherwise(0) for c in df.columns[1:]), F.when(F.col(df.columns[0]).isNull(), F.col("copies_n")).otherwise(0))
        d = F.col(days[name]).cast("date") if name in days else F.lit(None).cast("date")
        row = copies.agg(F.lit(name).alias("dataset"), F.coalesce(F.sum("copies_n"), F.lit(0)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.sum(empty), F.lit(0)).alias("missing_cells"), F.coalesce(F.sum(F.col("copies_n") - 1), F.lit(0)).alias("duplicate_rows"), F.min(d).alias("first_day"), F.max(d).alias("last_day"))
        out = row if out is None else out.unionByName(row)
    return out


def cleaning_summary(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, rows_before, rows_after, removed, exact_duplicates, key_duplicates, imputed, outliers) of every cleaned table."""
    out = None
    for name, df in after.items():
        flags = lambda end, df=df: sum((F.count_if(F.col(c)) for c, t in df.dtypes if t == "boolean" and c.endswith(end)), F.lit(0).cast("long"))
        a = df.agg(F.count(F.lit(1)).alias("rows_after"), flags("quality_key_duplicate").alias("key_duplicates"), flags("__imputed").alias("imputed"), flags("__outlier").alias("outliers"))
        b = before[name].groupBy(*before[name].columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicates"))
        both = b.withColumn("dataset", F.lit(name)).join(a.withColumn("dataset", F.lit(name)), "dataset")  # a row each
        row = both.select("dataset", "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("removed"), "exact_duplicates", "key_duplicates", "imputed", "outliers")
        out = row if out is None else out.unionByName(row)
    return out


def column_role(name: str, kind: str) -> str:
    n = name.lower()
    if is_flag(n):
        return "quality_flag"
    if n in ("id", "code") or n.endswith(("_id", "_code")):
        return "identifier"
    if kind.startswith(("date", "timestamp")):
        return "datetime"
    if kind == "boolean":
        return "boolean"
    return "numeric" if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal") else "categorical"


def column_profile(df: DataFrame) -> DataFrame:
    """(column, role, non_null, missing, distinct_approx, min, q25, median, mean, q75, max, std) of every column; quantiles are exact."""
    roles = {c: column_role(c, t) for c, t in df.dtypes}
    numeric = [c for c in df.columns if roles[c] == "numeric"]
    val = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}
    q = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    agg = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        agg += [F.count(val.get(c, F.col(c))).alias(f"c{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
        if c in val:
            agg += [F.min(val[c]).alias(f"lo{i}"), F.max(val[c]).alias(f"hi{i}"), F.avg(val[c]).alias(f"m{i}"), F.stddev_samp(val[c]).alias(f"s{i}")]
    r = df.agg(*agg).first()
    rows = [(c, roles[c], r[f"c{i}"], r["n"] - r[f"c{i}"], r[f"d{i}"], *([r[f"lo{i}"], q[c][0], q[c][1], r[f"m{i}"], q[c][2], r[f"hi{i}"], r[f"s{i}"]] if c in val else [None] * 7)) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "column string, role string, non_null long, missing long, distinct_approx long, min double, q25 double, median double, mean double, q75 double, max double, std double")


def frequencies(df: DataFrame, columns: Sequence[str], most_distinct: int = 30, top: int = 15) -> DataFrame:
    """(column, value, rows, fraction): the ``top`` values of columns with at most ``most_distinct`` different ones.

    All columns are counted by one aggregate of (column, value) pairs, combined before the shuffle.
    """
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("kinds"), F.sum("rows").alias("non_null")).where(F.col("kinds") <= most_distinct)
    few = counts.join(sizes, "column")
    ranked = few.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("rows"), "value"))).where(F.col("place") <= top)
    return ranked.select("column", "value", "rows", (F.col("rows") / F.col("non_null")).alias("fraction"))


def weekday_profile(df: DataFrame, entity: Sequence[str], date: str, target: str, activity: str, low: float = 0.25, least_days: int = 4) -> DataFrame:
    """Per weekday: days, missing, mean, median, deviation, extremes, share of active days, and whether that is low."""
    t = F.col(target)
    out = df.where(F.col(date).isNotNull()).groupBy(*entity, F.weekday(date).alias("weekday")).agg(
        F.count(F.lit(1)).alias("days"), F.count_if(t.isNull()).alias("missing"), F.avg(t).alias("mean"), F.median(t).alias("median"), F.stddev_samp(t).alias("std"), F.min(t).alias("min"), F.max(t).alias("max"),
        F.avg(F.when(F.coalesce(F.col(activity), F.lit(0)) > 0, 1.0).otherwise(0.0)).alias("active_fraction"),
    )
    return out.withColumn("low_activity", (F.col("active_fraction") < low) & (F.col("days") >= least_days))


def month_profile(df: DataFrame, entity: Sequence[str], date: str, target: str) -> DataFrame:
    """Per month: days with rows, calendar days, missing, mean, median, sum, and whether the month is partial."""
    t = F.col(target)
    out = df.where(F.col(date).isNotNull()).groupBy(*entity, F.trunc(date, "MM").alias("month")).agg(
        F.count_distinct(date).alias("days"), F.count_if(t.isNull()).alias("missing"), F.avg(t).alias("mean"), F.median(t).alias("median"), F.sum(t).alias("sum"), F.stddev_samp(t).alias("std"), F.min(t).alias("min"), F.max(t).alias("max"),
    )
    return out.withColumn("calendar_days", F.dayofmonth(F.last_day("month"))).withColumn("partial", F.col("days") < F.col("calendar_days"))


def daily_summary(df: DataFrame, entity: Sequence[str], date: str, target: str, activity: str) -> DataFrame:
    """Per entity: span, rows, calendar days without a row, target statistics, zero and active days."""
    t = F.col(target)
    out = df.where(F.col(date).isNotNull()).groupBy(*entity).agg(
        F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.count(F.lit(1)).alias("rows"), F.count_distinct(date).alias("days"), F.count(t).alias("known"), F.avg(t).alias("mean"), F.sum(t).alias("sum"),
        F.count_if(t == 0).alias("zero_days"), F.count_if(F.col(activity) > 0).alias("active_days"),
    )
    return out.withColumn("missing_dates", F.datediff("last_day", "first_day") + 1 - F.col("days"))


def correlations(df: DataFrame, target: str, columns: Sequence[str], least_pairs: int = 20, leakage: float = 0.995, top: int = 25) -> DataFrame:
    """(column, pairs, pearson, spearman, possible_leakage): pairwise complete, with average ranks, strongest rank correlation first.

    Ranks come from the counts of different values: each value's average rank is its place in the running sum
    of counts. All columns take one pass: their pairs are counted once, and one running sum over range partitions of
    the different values ranks both sides of all. Columns with too few pairs or a constant are left out.
    """
    schema = "column string, pairs long, pearson double, spearman double, possible_leakage boolean"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    val = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    each = F.explode(F.array(*[F.when(val(c).isNotNull(), F.struct(F.lit(c).alias("column"), val(c).alias("x"))) for c in columns]))
    pairs = df.select(val(target).alias("y"), each.alias("p")).where("y is not null and p is not null").select("p.column", "p.x", "y")
    counts = cut(pairs.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    side = lambda v: counts.groupBy("column", F.lit(v).alias("side"), F.col(v).alias("value")).agg(F.sum("n").alias("k"))
    upto = running_sums(side("x").unionByName(side("y")), ["value"], {"upto": F.col("k")}, ["column", "side"])
    ranks = upto.select("column", "side", "value", (F.col("upto") - (F.col("k") - 1) / 2).alias("rank"))
    of = lambda v: ranks.where(F.col("side") == v).select("column", F.col("value").alias(v), F.col("rank").alias(f"rank_{v}"))
    ranked = counts.join(of("x"), ["column", "x"]).join(of("y"), ["column", "y"])
    w = F.col("n")
    s = ranked.groupBy("column").agg(F.sum(w).alias("pairs"), *[f.alias(k) for a, b, p in (("x", "y", "v"), ("rank_x", "rank_y", "r")) for k, f in _moments(a, b, w, p).items()])
    every = s.select("column", "pairs", _corr("v").alias("pearson"), _corr("r").alias("spearman"))
    good = every.where((F.col("pairs") >= least_pairs) & F.col("pearson").isNotNull() & F.col("spearman").isNotNull())
    return good.withColumn("possible_leakage", F.greatest(F.abs("pearson"), F.abs("spearman")) >= leakage).orderBy(F.desc(F.abs("spearman")), "column").limit(top)


def _moments(a: str, b: str, w, p: str) -> dict:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return {f"{p}_x": F.sum(w * x), f"{p}_y": F.sum(w * y), f"{p}_xx": F.sum(w * x * x), f"{p}_yy": F.sum(w * y * y), f"{p}_xy": F.sum(w * x * y)}


def _corr(p: str):
    n = F.col("pairs")
    cov = F.col(f"{p}_xy") - F.col(f"{p}_x") * F.col(f"{p}_y") / n
    vx, vy = F.col(f"{p}_xx") - F.col(f"{p}_x") * F.col(f"{p}_x") / n, F.col(f"{p}_yy") - F.col(f"{p}_y") * F.col(f"{p}_y") / n
    spread = F.when((vx > 1e-9 * F.col(f"{p}_xx")) & (vy > 1e-9 * F.col(f"{p}_yy")), F.sqrt(vx * vy))
    return F.try_divide(cov, spread)


def reservation_summary(df: DataFrame, people: str = "people", lead: str = "lead_time_hours", walk_in: str = "is_walk_in", no_show: Column | None = None) -> DataFrame:
    """Totals, people, walk-ins, share of no-shows, and quantiles of the lead time of all reservations: one row.

    ``no_show`` says of a row whether the guests stayed away; without it the share is null.
    """
    q = exact_quantiles(df, [lead], [0.5, 0.9, 0.99])[lead]
    share = F.lit(None).cast("double") if no_show is None else F.try_divide(F.count_if(no_show), F.count(F.lit(1)))
    walked = F.count_if(F.col(walk_in)) if walk_in in df.columns else F.lit(None).cast("long")
    out = df.agg(F.count(F.lit(1)).alias("reservations"), F.sum(people).alias("people"), F.avg(people).alias("people_mean"), F.count_if(F.col(people) <= 0).alias("people_invalid"), walked.alias("walk_ins"), share.alias("no_show_share"))
    return out.withColumns({"lead_median": F.lit(q[0]).cast("double"), "lead_p90": F.lit(q[1]).cast("double"), "lead_p99": F.lit(q[2]).cast("double")})


def unique_events(df: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per event: its span (given bounds, else its days), and the values of its earliest row."""
    at = F.struct("event_day_number", "evento_row_id") if "evento_row_id" in df.columns else F.struct("event_day_number")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min("event_start").alias("event_start"), F.max("event_end").alias("event_end"), F.min_by("event_name", at).alias("event_name"), F.min_by("event_category", at).alias("event_category"), F.max("event_intensity").alias("event_intensity"), F.count(F.lit(1)).alias("event_days_listed"),
    ).withColumn("event_duration_days", F.datediff("event_end", "event_start") + 1)


def event_summary(unique: DataFrame) -> DataFrame:
    """Durations and intensities over unique events: one row."""
    d = F.col("event_duration_days")
    return unique.agg(F.count(F.lit(1)).alias("events"), F.avg(d).alias("duration_mean"), F.median(d).alias("duration_median"), F.max(d).alias("duration_max"), F.count_if(d > 7).alias("longer_than_7"), F.count_if(d > 30).alias("longer_than_30"), F.count_if(F.col("event_intensity") >= 4).alias("strong"))


def period_panel_summary(profile: DataFrame, totals: DataFrame) -> DataFrame:
    """Articles, share of the top 10 and 20, coverage under a quarter and a half, median coverage, periods: one row."""
    best = [r["unit_share"] or 0.0 for r in profile.orderBy(F.desc_nulls_last("units_total"), "article_code").select("unit_share").limit(20).collect()]
    a = profile.agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("period_coverage") < 0.25).alias("coverage_under_25"), F.count_if(F.col("period_coverage") < 0.5).alias("coverage_under_50"), F.median("period_coverage").alias("median_coverage"))
    return a.withColumns({"top_10_share": F.lit(sum(best[:10])), "top_20_share": F.lit(sum(best)), "periods": F.lit(totals.count())})


def diagnostics(daily: Mapping[str, float | None] | None = None, panel: Mapping[str, float | None] | None = None, reservations: Mapping[str, float | None] | None = None, events: Mapping[str, float | None] | None = None) -> list[str]:
    """Findings in words from one-row summaries (as dicts) of this module; a missing summary or figure says nothing."""
    d, p, r, e = daily or {}, panel or {}, reservations or {}, events or {}
    rules = [
        ((d.get("missing_dates") or 0) > 0, "the daily table lacks {} calendar days", d.get("missing_dates")),
        ((d.get("zero_days") or 0) > 0, "the daily target is zero on {} days", d.get("zero_days")),
        ((p.get("top_20_share") or 0) > 0.8, "20 articles hold {:.0%} of the units", p.get("top_20_share")),
        ((p.get("coverage_under_25") or 0) > 0, "{} articles were seen in under a quarter of the periods", p.get("coverage_under_25")),
        ((r.get("people_invalid") or 0) > 0, "{} reservations have an impossible number of people", r.get("people_invalid")),
        ((e.get("longer_than_30") or 0) > 0, "{} events last over 30 days", e.get("longer_than_30")),
    ]
    return [text.format(x) for holds, text, x in rules if holds]


def label(df: DataFrame, name: str = "article_name", code: str = "article_code") -> DataFrame:
    """``label``: the name, or the code where there is none."""
    return df.withColumn("label", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.col(code).cast("string")) if name in df.columns else F.col(code).cast("string"))
