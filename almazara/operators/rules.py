"""Plausibility flags of the source families (arithmetic and physics; no business decisions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almazara.functions.text import fold
from almazara.operators.quality import value_flag


def reservation_flags(df: DataFrame, created: str, at: str, people: str = "people", origin: str = "origin", large_group: int = 8) -> DataFrame:
    """Party size flags and the hours between booking and visit.

    ``lead_time_hours_raw`` is the plain difference; ``lead_time_hours`` is 0 for a walk-in (by its folded
    origin) and null, with ``lead_time__invalid``, where a booking would be later than its visit.
    """
    raw = (F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.col(created).cast("timestamp"))) / 3600
    walk_in = F.coalesce(fold(F.col(origin)).rlike("walk|sin reserva|paso|puerta"), F.lit(False))
    out = df.withColumns({
        **value_flag("people__invalid", F.col(people) <= 0), **value_flag("is_large_group", F.col(people) >= large_group),
        "is_walk_in": walk_in, "lead_time_hours_raw": raw,
    })
    return out.withColumns({
        **value_flag("lead_time__invalid", ~F.col("is_walk_in") & (F.col("lead_time_hours_raw") < 0)),
        "lead_time_hours": F.when(F.col("is_walk_in"), 0.0).when(F.col("lead_time_hours_raw") >= 0, F.col("lead_time_hours_raw")),
    })


def sales_flags(df: DataFrame) -> DataFrame:
    """Negative measures, invitations, days of the report and inverted periods.

    A row is an invitation if units were given without amount, or a column named for invitations says so in words.
    """
    free = (F.coalesce(F.col("units"), F.lit(0.0)) > 0) & (F.abs(F.coalesce(F.col("amount"), F.lit(0.0))) <= 1e-12)
    for c in df.columns:
        if "invit" in c.lower() and c != "es_invitacion":
            free = free | F.coalesce(fold(F.col(c).cast("string")).rlike("^si$|^true$|invit"), F.lit(False))
    return df.withColumns({
        **value_flag("units__negative", F.col("units") < 0), **value_flag("amount__negative", F.col("amount") < 0),
        "es_invitacion": free,
        "report_days": F.datediff("report_end", "report_start") + 1, **value_flag("period__invalid", F.col("report_end") < F.col("report_start")),
    })


def ticket_flags(df: DataFrame, date: str = "date", total: str = "document_total", receipts: str = "receipt_count") -> DataFrame:
    """The day's name and ISO week, and negative totals or counts."""
    d = F.col(date).cast("date")
    return df.withColumns({
        date: d, "day_of_week": F.date_format(d, "EEEE"), "week_of_year": F.weekofyear(d),
        **value_flag(f"{total}__negative", F.col(total) < 0), **value_flag(f"{receipts}__negative", F.col(receipts) < 0),
    })


def tip_flags(df: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Amount plus tip against the total, and the tip's share of the amount."""
    difference = F.col("document_amount") + F.col("tip") - F.col("document_total")
    return df.withColumns({
        **value_flag("tip_total__invalid", F.round(F.abs(difference), 9) > tolerance),
        "tip_ratio": F.try_divide(F.col("tip"), F.abs(F.col("document_amount"))), **value_flag("tip__negative", F.col("tip") < 0),
    })


def invoice_flags(df: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Base plus tax against the total, cash plus card against the total, only where all parts are known; and files that couldn't be parsed."""
    broken = value_flag("pdf_parse__invalid", F.col("pdf_parse_error").isNotNull()) if "pdf_parse_error" in df.columns else {}
    return df.withColumns({
        **broken,
        **{k: v for c in ("base", "vat", "total") for k, v in value_flag(f"{c}__negative", F.col(c) < 0).items()},
        **value_flag("total_reconciliation__invalid", F.round(F.abs(F.col("base") + F.col("vat") - F.col("total")), 9) > tolerance),
        **value_flag("payment_reconciliation__invalid", F.round(F.abs(F.col("cash_amount") + F.col("card_amount") - F.col("total")), 9) > tolerance),
        **value_flag("pago_tarjeta", F.col("card_amount") > 0),
    })


def resolve_payment(df: DataFrame, total: str = "total", cash: str = "cash_tendered", card: str = "card_printed", tolerance: float = 0.02) -> DataFrame:
    """Change given, cash kept, card amount and the method (mixed, cash, card, none_or_zero, unknown).

    A label that was not printed is a null; with neither label the method is unknown.
    """
    paid = F.coalesce(F.col(cash), F.lit(0.0)) + F.coalesce(F.col(card), F.lit(0.0))
    over = F.greatest(F.round(paid - F.col(total), 9), F.lit(0.0))
    change = F.when(over > tolerance, over).otherwise(0.0)
    out = df.withColumn("change_amount", F.coalesce(change, F.lit(0.0)))
    out = out.withColumns({"cash_amount": F.when(F.col(cash).isNotNull(), F.greatest(F.col(cash) - F.col("change_amount"), F.lit(0.0))), "card_amount": F.col(card)})
    c, k = F.coalesce("cash_amount", F.lit(0.0)) > 0, F.coalesce("card_amount", F.lit(0.0)) > 0
    method = F.when(F.col(cash).isNull() & F.col(card).isNull(), "unknown").when(c & k, "mixed").when(c, "cash").when(k, "card").otherwise("none_or_zero")
    return out.withColumn("payment_method", method)


def weather_flags(df: DataFrame, low: float = -60.0, high: float = 60.0) -> DataFrame:
    """``<c>__physically_suspicious`` by what a column's name says it measures."""
    add = {}
    for c, t in df.dtypes:
        n = c.lower()
        if t not in ("double", "float", "int", "bigint"):
            continue
        v = F.col(c)
        if "temperature" in n:
            bad = (v < low) | (v > high)
        elif n.endswith("hours") or "_hours" in n:
            bad = (v < 0) | (v > 24)
        elif "sunshine" in n or n.endswith("_s"):
            bad = (v < 0) | (v > 86_400)
        elif any(x in n for x in ("rain", "precipitation", "wind", "snow")):
            bad = v < 0
        else:
            continue
        add |= value_flag(f"{c}__physically_suspicious", bad)
    return df.withColumns(add) if add else df


def event_flags(df: DataFrame) -> DataFrame:
    """Inverted events, durations and day numbers that can't be."""
    return df.withColumns({
        **value_flag("event_period__invalid", F.col("event_end") < F.col("event_start")), **value_flag("event_duration__invalid", F.col("event_duration_days") <= 0),
        **value_flag("event_day_number__invalid", (F.col("event_day_number") <= 0) | (F.col("event_day_number") > F.col("event_duration_days"))),
    })


def calendar_rules(df: DataFrame, date: str = "date", name: str = "holiday_name") -> DataFrame:
    """Holidays with a real day and a trimmed name; ``is_holiday`` is 1 where nothing is said."""
    flag = {"is_holiday": F.coalesce(F.col("is_holiday").try_cast("long"), F.lit(1))} if "is_holiday" in df.columns else {}
    named = {name: F.nullif(F.trim(name), F.lit(""))} if name in df.columns else {}
    return df.withColumns({date: F.col(date).try_cast("date"), **flag, **named})
