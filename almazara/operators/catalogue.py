"""The feature catalogue: what each column is, when it is known, and whether a model may use it by default."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of column names by which a family is recognised (substrings).
WEATHER = (
    "temperature", "temperatura", "precipitation", "precipitacion", "rain", "lluvia", "snow", "nieve", "wind", "viento", "sunshine", "solar", "humidity", "humedad", "weather", "meteo",
)
EVENT_OR_HOLIDAY = ("event", "evento", "festiv", "holiday")
RESERVATION = ("reserva", "reservation", "comensal", "guest", "lead_time", "tamano_grupo", "group_size", "no_show", "cancel_rate", "walk_in")
OUTCOME = ("facturacion", "revenue", "ticket_", "num_ticket", "factura", "invoice", "comprobante", "receipt", "efectivo", "tarjeta", "cash_", "card_")
CALENDAR = {"year", "month", "quarter", "day_of_month", "day_of_week_num", "day_of_week", "week_of_year", "is_weekend", "is_month_start", "is_month_end", "week_sin", "week_cos"}
SCHEMA = "dataset string, column string, dtype string, feature_dtype string, origin string, role string, availability string, safe_default boolean, reason string"


@dataclass(frozen=True)
class Entry:
    role: str
    availability: str
    safe_default: bool
    reason: str
    origin: str = "original"


def has(name: str, tokens: Sequence[str]) -> bool:
    return any(t in name.lower() for t in tokens)


def is_quality(name: str) -> bool:
    n = name.lower()
    return n.startswith("quality_") or n.endswith(("__outlier", "__negative", "__invalid", "__imputed", "__conflict", "__physically_suspicious"))


def is_engineered(name: str) -> bool:
    return name.startswith(("cal_", "context_", "period_start_", "global_target_total__", "history_")) or any(x in name for x in ("__lag_", "__rolling_", "__expanding_", "__same_weekday_")) or name in ("article_demand_regime_prior", "periods_since_last_observation")


def classify(name: str, target: str, keys: Sequence[str] = ("date", "report_start", "report_end", "article_code", "restaurant", "period_id")) -> Entry:
    """What an original column is, by its name: keys, target, quality, past-only, scheduled, forecast or outcome."""
    n = name.lower()
    if n == target:
        return Entry("target", "after_period", False, "the target itself")
    if n in keys:
        return Entry("key", "always", False, "a key")
    if is_quality(n):
        return Entry("quality", "after_period", False, "describes the record's quality")
    if is_engineered(n):
        safe = not n.endswith("_observed")
        return Entry("adaptive_demand_regime" if "regime" in n else "history", "before_period", safe, "only earlier rows enter", "engineered")
    if n in CALENDAR:
        return Entry("calendar", "always", True, "follows from the date")
    if n.endswith(("_code", "_id")):
        return Entry("categorical_identifier", "always", True, "identifies a known thing")
    if has(n, RESERVATION):
        return Entry("reservation", "partly_known", False, "complete only after the day")
    if has(n, OUTCOME):
        return Entry("outcome", "after_period", False, "a result of the day")
    if has(n, WEATHER):
        return Entry("weather", "forecast", False, "needs a forecast when used ahead")
    if has(n, EVENT_OR_HOLIDAY):
        return Entry("known_context", "scheduled", True, "known in advance")
    if n.endswith("_name"):
        return Entry("static_or_scheduled_metadata", "always", False, "text of a code")
    return Entry("unclassified", "unknown", False, "not classified")


def build_catalogue(spark: SparkSession, name: str, df: DataFrame, target: str, registered: Mapping[str, Entry] | None = None) -> DataFrame:
    """One row per column; registered features keep their entry, the others are classified by name.

    Redundancy: source calendar columns are no default where ``cal_*`` features exist, and lag 1 stands for the
    rolling counts.
    """
    registered = dict(registered or {})
    calendar = any(c.startswith("cal_") for c in df.columns)
    rows = []
    for c, t in df.dtypes:
        e = registered.get(c) or classify(c, target)
        if calendar and c in CALENDAR:
            e = replace(e, safe_default=False, reason="repeated by cal_ features")
        if "__rolling_count_" in c:
            e = replace(e, safe_default=False, reason="repeated by the observation counts")
        kind = "boolean" if t == "boolean" else "datetime" if t.startswith(("date", "timestamp")) else "categorical" if t == "string" or e.role == "categorical_identifier" else "numeric"
        rows.append((name, c, t, kind, e.origin, e.role, e.availability, e.safe_default and kind != "datetime", e.reason))
    return spark.createDataFrame(rows, SCHEMA)


def select_features(catalogue: DataFrame, development: DataFrame, most_missing: float = 0.98) -> tuple[list[str], list[str]]:
    """(categorical, numeric) safe columns that are not all missing, not nearly so, and not constant on development rows.

    One aggregate over the development rows for all columns.
    """
    safe = [r for r in catalogue.where("safe_default").collect() if r["column"] in development.columns]
    if not safe:
        return [], []
    stats = development.agg(F.count(F.lit(1)).alias("n"), *[x for i, r in enumerate(safe) for x in (F.count(r["column"]).alias(f"c{i}"), (F.min(r["column"]) != F.max(r["column"])).alias(f"d{i}"))]).first()
    kept = [r for i, r in enumerate(safe) if stats[f"c{i}"] and 1 - stats[f"c{i}"] / stats["n"] <= most_missing and stats[f"d{i}"]]
    return [r["column"] for r in kept if r["feature_dtype"] == "categorical"], [r["column"] for r in kept if r["feature_dtype"] != "categorical"]


def with_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``df`` with every missing column added as null of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}) if columns else df


def provenance(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, source) of integrated columns, by name."""
    rules = (("calendar", lambda c: c in CALENDAR), ("reservas", lambda c: has(c, RESERVATION)), ("meteo", lambda c: has(c, WEATHER)), ("eventos/festivos", lambda c: has(c, EVENT_OR_HOLIDAY)), ("tickets/facturas", lambda c: has(c, OUTCOME)))
    rows = [(n, c, next((s for s, ok in rules if ok(c)), "panel")) for n, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "table string, column string, source string")
