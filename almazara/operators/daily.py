"""One row per (entity and) day from each source, a continuous calendar, and their integration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almazara.session import broadcast_if_small

_by = lambda entity: list(entity)


def tickets_daily(df: DataFrame, entity: Sequence[str] = (), date: str = "date", document: str = "document_id", total: str = "document_total", receipts: str = "receipt_count") -> DataFrame:
    """Tickets a day: rows, different documents, and the totals' sum, mean, median, extremes; null if all are unknown."""
    t = F.col(total)
    return df.where(F.col(date).isNotNull()).groupBy(*_by(entity), date).agg(
        F.count(F.lit(1)).alias("num_tickets"), F.count_distinct(document).alias("num_tickets_unicos"), F.sum(t).alias("facturacion_tickets"),
        F.avg(t).alias("ticket_medio"), F.median(t).alias("ticket_mediano"), F.max(t).alias("ticket_maximo"), F.min(t).alias("ticket_minimo"),
        F.sum(receipts).alias("num_comprobantes"),
    )


def invoices_daily(df: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """Invoices a day: counts, five sums (null if nothing is known), rows that don't reconcile."""
    sums = {"total": "facturacion_facturas_pdf", "base": "base_facturas_pdf", "vat": "iva_facturas_pdf", "cash_amount": "efectivo_facturas_pdf", "card_amount": "tarjeta_facturas_pdf"}
    return df.where("date is not null").groupBy(*_by(entity), "date").agg(
        F.count(F.lit(1)).alias("num_facturas_pdf"), F.count_distinct("ticket_id").alias("num_facturas_pdf_unicas"), *[F.sum(c).alias(n) for c, n in sums.items()],
        F.count_if("total_reconciliation__invalid").alias("facturas_pdf_no_reconciliadas"), F.count_if("payment_reconciliation__invalid").alias("pagos_pdf_no_reconciliados"),
    )


def reservations_daily(df: DataFrame, entity: Sequence[str], date: str, status: Column, statuses: Sequence[str], people: str = "people", lead: str | None = None, flags: Mapping[str, str] | None = None) -> DataFrame:
    """Reservations a day: totals, party sizes, per status the reservations and people, rates, lead times, flags.

    People of a status are 0 where it has no reservation, null where none of its sizes is known.
    """
    p = F.col(people)
    rows = df.withColumn("grouped_status", status).where(F.col(date).isNotNull())
    of = lambda s: F.coalesce(F.col("grouped_status") == s, F.lit(False))
    aggs = [
        F.count(F.lit(1)).alias("reservas_total"), F.sum(p).alias("comensales_reservados_total"), F.avg(p).alias("tamano_grupo_medio"),
        F.median(p).alias("tamano_grupo_mediano"), F.max(p).alias("tamano_grupo_maximo"),
    ]
    for s in statuses:
        aggs += [F.count_if(of(s)).alias(f"reservas_{s}"), F.when(F.count_if(of(s)) == 0, 0).otherwise(F.sum(F.when(of(s), p))).alias(f"comensales_{s}")]
    if lead:
        aggs += [F.avg(lead).alias("lead_time_horas_medio"), F.median(lead).alias("lead_time_horas_mediano")]
    aggs += [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(n) for c, n in (flags or {}).items()]
    out = rows.groupBy(*_by(entity), date).agg(*aggs)
    rates = {"no_show": "no_show_rate", "cancelled": "cancel_rate"}
    return out.withColumns({n: F.try_divide(F.col(f"reservas_{s}"), F.col("reservas_total")) for s, n in rates.items() if s in statuses})


def shifts_pivot(df: DataFrame, entity: Sequence[str], date: str, shift: Column, values: Sequence[str]) -> DataFrame:
    """A count column ``reservas_turno_<value>`` per shift; the values are given, so no pass is spent on finding them."""
    return df.where(F.col(date).isNotNull()).groupBy(*_by(entity), date).agg(*[F.count_if(F.coalesce(shift == v, F.lit(False))).alias(f"reservas_turno_{v}") for v in values])


def tips_daily(df: DataFrame, entity: Sequence[str] = (), date: str = "date", tip: str = "tip") -> DataFrame:
    """Tips a day: sum (0 if all are unknown), mean, tickets with one."""
    return df.where(F.col(date).isNotNull()).groupBy(*_by(entity), date).agg(
        F.coalesce(F.sum(tip), F.lit(0.0)).alias("propina_total"), F.avg(tip).alias("propina_media"), F.count_if(F.col(tip) > 0).alias("tickets_con_propina")
    )


def weather_statistic(name: str, hourly: bool = False) -> str:
    """The aggregate a weather column's name calls for. Several daily rows of rain are averaged, hourly ones add up."""
    n = name.lower()
    if any(x in n for x in ("precipitation", "sunshine", "duration")) or (hourly and "rain" in n):
        return "sum"
    if "max" in n or "gust" in n:
        return "max"
    if "min" in n.split("_") and not hourly:
        return "min"
    return "avg"


def weather_daily(df: DataFrame, entity: Sequence[str], date: str, columns: Sequence[str], hourly: bool = False) -> DataFrame:
    """Weather a day, each column by the aggregate its name calls for; NaN readings count as unknown, sums of nothing are 0."""
    val = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    how = {"sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "max": F.max, "min": F.min, "avg": F.avg}
    return df.where(F.col(date).isNotNull()).groupBy(*_by(entity), date).agg(*[how[weather_statistic(c, hourly)](val[c]).alias(c) for c in columns])


def joined_names(c: Column) -> Column:
    """Different non-blank values in order, joined by `` | ``; null if there is none. Grows with distinct values only."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(c), F.lit("")))), " | "), F.lit(""))


def holidays_daily(df: DataFrame, entity: Sequence[str] = (), date: str = "date", name: str = "holiday_name") -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(*_by(entity), date).agg(F.lit(True).alias("es_festivo"), F.count(F.lit(1)).alias("num_festivos"), joined_names(F.col(name)).alias("festivo_nombre"))


def events_daily(df: DataFrame, entity: Sequence[str], date: str, name: str = "event_name", category: str = "event_category", intensity: str = "event_intensity", identifier: str | None = None) -> DataFrame:
    """Events a day: rows (or different ids, if ``identifier`` is given), names, categories, mean and largest intensity."""
    n = F.count_distinct(identifier) if identifier else F.count(F.lit(1))
    return df.where(F.col(date).isNotNull()).groupBy(*_by(entity), date).agg(
        F.lit(True).alias("tiene_evento"), n.alias("num_eventos"), joined_names(F.col(name)).alias("eventos_nombres"), joined_names(F.col(category)).alias("eventos_categorias"),
        F.avg(intensity).alias("event_intensity_mean"), F.max(intensity).alias("event_intensity_max"),
    )


def expand_days(df: DataFrame, start: str, end: str, day: str = "date", number: str = "event_day_number", duration: str = "event_duration_days", lower: Column | None = None, upper: Column | None = None) -> DataFrame:
    """One row per covered day with its number and the length of the interval; null or inverted intervals give none.

    ``lower`` and ``upper`` clip the days to a horizon; numbers and lengths stay those of the whole interval.
    """
    s, e = F.col(start).cast("date"), F.col(end).cast("date")
    a = s if lower is None else F.greatest(s, lower)
    b = e if upper is None else F.least(e, upper)
    days = F.when((s <= e) & (a <= b), F.sequence(a, b, F.expr("interval 1 day")))
    clash = [c for c in (day, number, duration) if c in df.columns]
    return df.withColumn("first_of_interval", s).withColumn(f"{duration}_new", F.datediff(e, s) + 1).select(
        *[c for c in df.columns if c not in clash], "first_of_interval", F.col(f"{duration}_new").alias(duration), F.explode(days).alias(day)
    ).withColumn(number, F.datediff(day, "first_of_interval") + 1).drop("first_of_interval")


def calendar(df: DataFrame, entity: Sequence[str], date: str) -> DataFrame:
    """Every day between each entity's first and last (the anchor source), without gaps."""
    bounds = df.where(F.col(date).isNotNull()).groupBy(*_by(entity)).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return bounds.where("a is not null").select(*_by(entity), F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date))


def anchor_source(names: Sequence[str], prefer_tickets: bool = True) -> str | None:
    """The source whose span the calendar covers: tickets, invoices, reservations in that order (invoices first if preferred), else any that is no context."""
    order = ["tickets", "facturas", "reservas"] if prefer_tickets else ["facturas", "tickets", "reservas"]
    context = {"meteo_diaria", "meteo_horaria", "festivos", "eventos"}
    return next((n for n in order if n in names), next((n for n in names if n not in context), None))


def calendar_columns(df: DataFrame, date: str = "date") -> DataFrame:
    """Year to week, weekend, month edges, and the week on a circle of 52."""
    d = F.col(date)
    w = F.weekofyear(d)
    turn = 2 * 3.141592653589793 / 52.0
    return df.withColumns({
        "year": F.year(d), "month": F.month(d), "quarter": F.quarter(d), "day_of_month": F.dayofmonth(d), "day_of_week_num": F.weekday(d), "day_of_week": F.date_format(d, "EEEE"),
        "week_of_year": w, "is_weekend": F.weekday(d) >= 5, "is_month_start": F.dayofmonth(d) == 1, "is_month_end": d == F.last_day(d), "week_sin": F.sin(w * turn), "week_cos": F.cos(w * turn),
    })


def canonical_revenue(df: DataFrame, order: Sequence[tuple[str, str]] = (("facturacion_tickets", "tickets"), ("facturacion_facturas_pdf", "facturas_pdf"))) -> DataFrame:
    """``facturacion`` from the first source that has it, and which one that was."""
    have = [(c, n) for c, n in order if c in df.columns]
    if not have:
        return df.withColumns({"facturacion": F.lit(None).cast("double"), "facturacion_source": F.lit(None).cast("string")})
    source = F.lit(None).cast("string")
    for c, n in reversed(have):
        source = F.when(F.col(c).isNotNull(), n).otherwise(source)
    return df.withColumns({"facturacion": F.coalesce(*[F.col(c) for c, _ in have]), "facturacion_source": source})


# Names of counts that are 0 on a day without activity, and endings of statistics that are not.
ZERO_PREFIXES = ("num_", "reservas_", "comensales_", "tickets_con_", "facturas_pdf_no_", "pagos_pdf_no_")
STATISTIC_SUFFIXES = ("_medio", "_media", "_mediano", "_mediana", "_maximo", "_minimo", "_rate", "_mean", "_std", "_max", "_min")


def fill_structural(df: DataFrame) -> DataFrame:
    """Counts of a day without rows are 0 and its flags false; measures and weather stay unknown."""
    add = {}
    for c, t in df.dtypes:
        if c.startswith(ZERO_PREFIXES) and not c.endswith(STATISTIC_SUFFIXES) and t in ("bigint", "int", "double"):
            add[c] = F.coalesce(F.col(c), F.lit(0).cast(t))
        elif c in ("es_festivo", "tiene_evento"):
            add[c] = F.coalesce(F.col(c), F.lit(False))
    return df.withColumns(add) if add else df


def daily_master(spine: DataFrame, sources: Mapping[str, tuple[DataFrame, Sequence[str]]], date: str = "date") -> DataFrame:
    """The spine with each source left-joined on its own keys, calendar columns, revenue and structural zeros.

    Each source has one row per key (it comes from an aggregate on it), so a join adds no rows; sources are
    broadcast only if counted to be small.
    """
    out = spine
    for source, keys in sources.values():
        clash = [c for c in source.columns if c in out.columns and c not in keys]
        out = out.join(broadcast_if_small(source.drop(*clash)), list(keys), "left")
    return fill_structural(canonical_revenue(calendar_columns(out, date)) if "facturacion" not in out.columns else calendar_columns(out, date))


def out_of_calendar(source: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the calendar lacks."""
    return source.join(spine.select(*keys).distinct(), list(keys), "left_anti")


def source_coverage(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(source, rows, columns, first_day, last_day, missing_cells) of every table; the named day columns give the span."""
    out = None
    for name, (df, days) in tables.items():
        first = F.least(*[F.min(F.col(d).cast("date")) for d in days]) if len(days) > 1 else F.min(F.col(days[0]).cast("date"))
        last = F.greatest(*[F.max(F.col(d).cast("date")) for d in days]) if len(days) > 1 else F.max(F.col(days[0]).cast("date"))
        empty = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
        row = df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), first.alias("first_day"), last.alias("last_day"), empty.alias("missing_cells"))
        out = row if out is None else out.unionByName(row)
    return out
