"""The staged run: raw to bronze, silver, gold, profiles, features, models and the next-period forecast."""

from __future__ import annotations

import os
from collections.abc import Callable, Collection, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almazara.config import CleaningRules, EDARules, FeatureRules, FutureContextRules, IntegrationRules, ModelingRules, OperationalRules, PipelineConfig
from almazara.functions.casts import assert_types, nan_to_null, null_tokens, numeric_codes
from almazara.functions.text import slug
from almazara.operators import catalogue, context, daily, eda, evaluate, features, models, panel, quality, rules
from almazara.session import cut
from almazara.sources import cells, layers, readers

# Keys that must be known, and keys that should be unique, by source family.
REQUIRED_KEYS = {
    "articulos": ("article_code",), "departamentos": ("department_code",), "eventos": ("date",), "facturas": ("ticket_id",), "festivos": ("date",), "menu": ("article_code",), "meteo_diaria": ("date",), "meteo_horaria": ("datetime",),
    "reservas": ("reservation_datetime",), "tickets": ("document_id", "date"), "tips": ("document_id",), "total_articles": ("article_code",), "ventas": ("report_start", "report_end", "article_code"),
}
BUSINESS_KEYS = {
    "articulos": ("article_code",), "departamentos": ("department_code",), "eventos": ("event_id", "date"), "facturas": ("ticket_id",), "festivos": ("date", "holiday_name"), "menu": ("article_code",), "meteo_diaria": ("date",),
    "meteo_horaria": ("datetime",), "reservas": ("reference_code",), "tickets": ("document_id",), "tips": ("document_id",), "total_articles": ("report_start", "report_end", "article_code"), "ventas": ("report_start", "report_end", "article_code"),
}
# Names never imputed, and columns no outlier is sought in.
NEVER_IMPUTED = ("source_file", "raw_text", "name", "description", "reference", "lead_time")
NO_OUTLIERS = {"eventos": {"event_duration_days", "event_day_number", "event_intensity", "is_estimated"}, "reservas": {"lead_time_hours", "lead_time_hours_raw"}}
NO_OUTLIER_TABLES = {"meteo_diaria", "meteo_horaria"}

#: Flags by family; add an entry to extend the cleaning of a family.
FAMILY_RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ventas": rules.sales_flags, "total_articles": rules.sales_flags, "tickets": rules.ticket_flags, "tips": rules.tip_flags, "facturas": rules.invoice_flags,
    "meteo_diaria": rules.weather_flags, "meteo_horaria": rules.weather_flags, "eventos": rules.event_flags,
    "reservas": lambda df: rules.reservation_flags(df, "created_datetime", "reservation_datetime"),
    "articulos": lambda df: quality.master_conflicts(df, "article_code", [c for c in ("article_name", "department_code", "price") if c in df.columns]),
    "departamentos": lambda df: quality.master_conflicts(df, "department_code", ["department_name"]),
    "festivos": rules.calendar_rules,
}


def clean(df: DataFrame, family: str, r: CleaningRules) -> DataFrame:
    """One family's cleaning in its fixed order: types, null words, duplicates, keys, flags, imputation, outliers."""
    out = numeric_codes(assert_types(nan_to_null(df)))
    out = out.withColumns({c: null_tokens(F.col(c)) for c, t in out.dtypes if t == "string" and c != "raw_text"})
    if r.drop_exact_duplicates:
        out = out.dropDuplicates()
    business = [c for c in BUSINESS_KEYS.get(family, ()) if c in out.columns]
    if business:
        out = quality.flag_key_duplicates(out, business)
    required = [c for c in REQUIRED_KEYS.get(family, ()) if c in out.columns]
    if required:
        out = quality.require_keys(out, required, r.drop_rows_missing_required_keys)
    if family in FAMILY_RULES:
        out = FAMILY_RULES[family](out)
    out = cut(out)
    keys = {*required, *business}
    free = [(c, t) for c, t in out.dtypes if c not in keys and not quality.is_flag(c) and not any(x in c for x in NEVER_IMPUTED) and not c.endswith(("_id", "_code"))]
    if r.auto_impute_low_missingness:
        out = quality.impute_low_missingness(out, [c for c, t in free if t in ("double", "bigint", "int")], [c for c, t in free if t == "string"], r.max_missing_fraction, r.categorical_missing_label)
    if r.detect_outliers and family not in NO_OUTLIER_TABLES:
        numeric = [c for c, t in free if t in ("double", "bigint", "int") and c not in NO_OUTLIERS.get(family, ())]
        numeric = quality.eligible_for_outliers(out, numeric, r.min_rows_for_outliers, r.min_unique_for_outliers)
        out = quality.outlier_columns(out, numeric, r.iqr_multiplier, r.robust_z_threshold)
    return out


# The columns without which a file of a family is refused.
REQUIRED_COLUMNS = {
    "departments": (readers.DEPARTMENT_COLUMNS, ("department_code", "department_name")),
    "reservations": (readers.RESERVATION_COLUMNS, ("reservation_date", "reservation_time", "status", "shift", "people")),
}
_SHEET_READERS = {
    "article_sales": ("ventas", readers.read_article_sales), "articles": ("articulos", readers.read_articles), "menu": ("menu", readers.read_menu), "departments": ("departamentos", readers.read_departments),
    "tickets": ("tickets", readers.read_tickets), "tips": ("tips", readers.read_tips), "reservations": ("reservas", readers.read_reservations),
}


def ingest(spark: SparkSession, directory: str, recursive: bool = False, strict: bool = False, excluded: Collection[str] = (), only: Collection[str] = (), read_sheet: Callable | None = None, read_pdf: Callable | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by family, errors): every supported file of a folder, typed by content and read by its family's reader.

    A file that can't be read, is of no known type or lacks required columns is a row of ``errors``, or with
    ``strict`` an exception; the others are read. ``only`` restricts the families. What the driver handles is
    the list of files: a row each. ``read_sheet`` and ``read_pdf`` take the place of the optional libraries.
    """
    tables: dict[str, DataFrame] = {}
    errors: list[tuple[str, str]] = []
    paths = cells.list_files(spark, directory, recursive, tuple(excluded))
    ending = lambda *ends: [p for p in paths if p.lower().endswith(ends)]
    wanted = lambda name: not only or name in only
    unknown = "the type of the file is not recognised"

    def unread(given: list[str], seen: Collection[str]) -> list[tuple[str, str]]:
        known = {*seen, *(f for f, _ in errors)}
        return [(os.path.basename(p), "the file is empty") for p in given if os.path.basename(p) not in known]

    groups: dict[str | None, list[str]] = {}
    heads = cells.csv_heads(spark, ending(".csv"))
    for path, head, _ in heads:
        groups.setdefault(cells.detect_csv_type(os.path.basename(path), head.lower().split(cells.sniff_separator(head))), []).append(path)
    full = {os.path.basename(h[0]) for h in heads}
    errors += [(os.path.basename(p), "the file is empty") for p in ending(".csv") if os.path.basename(p) not in full]
    errors += [(os.path.basename(p), unknown) for p in groups.pop(None, [])]
    if "weather" in groups:
        hourly, native = readers.read_csv_family(spark, "weather", groups["weather"])
        tables |= {"meteo_horaria": readers.all_measures(hourly), "meteo_diaria": readers.all_measures(native)}
    if "holidays" in groups:
        tables["festivos"] = readers.read_csv_family(spark, "holidays", groups["holidays"])
    if "events" in groups:
        tables["eventos"] = readers.read_csv_family(spark, "events", groups["events"])

    if ending(".xls", ".xlsx"):
        sheet, broken = cells.excel_cells(spark, ending(".xls", ".xlsx"), read_sheet)
        errors += [(r["source_file"], r["error"]) for r in broken.collect()]
        kinds = {r["source_file"]: r["file_type"] for r in cells.detect_types(sheet).collect()}
        errors += unread(ending(".xls", ".xlsx"), kinds)
        errors += [(f, unknown) for f, k in kinds.items() if k is None]
        for kind, (name, reader) in _SHEET_READERS.items():
            mine = sheet.where(F.col("source_file").isin([f for f, k in kinds.items() if k == kind]))
            if kind in REQUIRED_COLUMNS:
                bad = cells.lacking(mine, *REQUIRED_COLUMNS[kind]).collect()
                errors += [(r["source_file"], r["error"]) for r in bad]
                kinds |= {r["source_file"]: None for r in bad}
                mine = sheet.where(F.col("source_file").isin([f for f, k in kinds.items() if k == kind]))
            if kind in kinds.values():
                tables[name] = reader(mine)

    if ending(".pdf"):
        words, broken = readers.pdf_words(spark, ending(".pdf"), read_pdf)
        errors += [(r["source_file"], r["error"]) for r in broken.collect()]
        seen = [r[0] for r in words.select("ticket_id").distinct().collect()]  # a row a file
        errors += unread(ending(".pdf"), seen)
        if seen:
            tables["facturas"] = readers.read_invoices(words)
    tables = {n: t for n, t in tables.items() if wanted(n)}
    if errors and strict:
        raise ValueError("; ".join(f"{p}: {why}" for p, why in errors))
    return tables, spark.createDataFrame(errors, "file string, error string")


def load_weekly_sales(spark: SparkSession, directory: str, strict: bool = False, read_sheet: Callable | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(sales, errors) of a folder of weekly reports: article sales only, whatever else lies there."""
    tables, errors = ingest(spark, directory, strict=strict, only=("ventas",), read_sheet=read_sheet)
    return tables.get("ventas"), errors


def weather_days(silver: Mapping[str, DataFrame]) -> DataFrame | None:
    """Weather a day from the native daily rows, and from hours of files without any; a sum no file gives is unknown on days of hours only."""
    kept = lambda df: [c for c, t in df.dtypes if t == "double" and c not in ("latitude", "longitude", "elevation", "utc_offset_seconds")]
    native, hours = silver.get("meteo_diaria"), silver.get("meteo_horaria")
    if hours is None or "datetime" not in hours.columns:
        return None if native is None else daily.weather_daily(native, [], "date", [c for c, t in native.dtypes if t == "double"])
    by = ["source_file"] if "source_file" in hours.columns else []
    if native is not None and by and "source_file" in native.columns:
        hours = hours.join(native.where("date is not null").select("source_file").distinct(), "source_file", "left_anti")
    elif native is not None:
        hours = hours.join(native.select("date").distinct(), F.to_date("datetime") == F.col("date"), "left_anti")
    rows = daily.weather_daily(hours.withColumn("date", F.to_date("datetime")), by, "date", kept(hours), hourly=True).drop(*by).withColumn("__native", F.lit(False))
    if native is not None:
        columns = [c for c, t in native.dtypes if t == "double"]
        rows = rows.unionByName(native.where("date is not null").select("date", *columns, F.lit(True).alias("__native")), allowMissingColumns=True)
    names = [c for c in rows.columns if c not in ("date", "__native")]
    known = rows.groupBy("date").agg(F.bool_or("__native").alias("__native"), *[F.count(c).alias(f"__n_{c}") for c in names])
    out = daily.weather_daily(rows, [], "date", names).join(known, "date")
    return out.select("date", *[F.when(F.col("__native") | (F.col(f"__n_{c}") > 0), F.col(c)).alias(c) for c in names])


def _folded(c: str) -> F.Column:
    return slug(F.col(c))


def integrate(silver: Mapping[str, DataFrame], entity: tuple[str, ...] = (), r: IntegrationRules = IntegrationRules()) -> dict[str, DataFrame]:
    """Gold tables: the daily master and the article-by-period panel, from what sources there are."""
    gold: dict[str, DataFrame] = {}
    sources: dict[str, tuple[DataFrame, list[str]]] = {}
    key = [*entity, "date"]
    if "tickets" in silver:
        sources["tickets"] = daily.tickets_daily(silver["tickets"], entity), key
    if "facturas" in silver:
        sources["facturas"] = daily.invoices_daily(silver["facturas"], entity), key
    if "reservas" in silver:
        at = silver["reservas"].withColumn("date", F.col("reservation_datetime").cast("date"))
        status = _folded("status") if "status" in at.columns else F.lit(None).cast("string")
        flags = {c: n for c, n in (("is_walk_in", "reservas_walk_in"), ("is_large_group", "reservas_grupo_grande")) if c in at.columns}
        sources["reservas"] = daily.reservations_daily(at, list(entity), "date", status, r.statuses, lead="lead_time_hours" if "lead_time_hours" in at.columns else None, flags=flags), key
        if "shift" in at.columns and r.shifts:
            sources["turnos"] = daily.shifts_pivot(at, entity, "date", _folded("shift"), r.shifts), key
    if "tips" in silver and "date" in silver["tips"].columns:
        sources["tips"] = daily.tips_daily(silver["tips"].withColumn("date", F.col("date").try_cast("date")), entity), key
    weather = weather_days(silver)
    if weather is not None:
        sources["meteo_diaria"] = weather, ["date"]
    if "festivos" in silver:
        sources["festivos"] = daily.holidays_daily(silver["festivos"]), ["date"]
    if "eventos" in silver:
        sources["eventos"] = daily.events_daily(silver["eventos"], [], "date"), ["date"]
    anchor = daily.anchor_source([n for n in sources if n != "turnos"], r.prefer_tickets)
    if anchor and r.build_daily:
        spine = daily.calendar(sources[anchor][0], [c for c in entity if c in sources[anchor][1]], "date")
        gold["daily"] = daily.daily_master(spine, sources)
    sales = silver.get("ventas", silver.get("total_articles"))
    if sales is not None and r.build_panel:
        if not r.keep_invitations and "es_invitacion" in sales.columns:
            sales = sales.where(~F.coalesce("es_invitacion", F.lit(False)))
        flags = [c for c in sales.columns if c.endswith(("__outlier", "__invalid", "__negative")) or c.startswith("quality_")]
        p = panel.dedupe_panel(sales, [*entity, "article_code"], [c for c in ("article_name", "department_code", "department_name") if c in sales.columns], flags)
        p = panel.period_fields(p, panel.expected_period_days(sales, r.expected_days_weight, entity=entity), entity)
        if "articulos" in silver:
            p = panel.enrich(p, _as(silver["articulos"], p, "article_code"), "article_code", ["article_name", "department_code"], "articles_master")
        if "departamentos" in silver and "department_code" in p.columns:
            p = panel.enrich(p, _as(silver["departamentos"], p, "department_code"), "department_code", ["department_name"], "departments_master")
        gold["article_period"] = p
    return gold


def _as(master: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``master`` with its key in the type the table has it in; a key that doesn't fit matches nothing."""
    return master.withColumn(key, F.col(key).try_cast(dict(table.dtypes)[key]))


def integration_reports(silver: Mapping[str, DataFrame], gold: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Coverage of every source by the days it has, and where each gold column comes from."""
    days = {n: [c for c, t in df.dtypes if t in ("date", "timestamp_ntz", "timestamp") and c in ("date", "report_start", "report_end", "reservation_date", "event_start", "event_end", "datetime")] for n, df in silver.items()}
    dated = {n: (silver[n], d) for n, d in days.items() if d}
    out = {"provenance": catalogue.provenance(next(iter(gold.values())).sparkSession, gold)} if gold else {}
    return out | ({"coverage": daily.source_coverage(dated)} if dated else {})


def quality_reports(name: str, before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """What cleaning found in one table: missing values, flags, and per outlier column how many values of which severity."""
    severities = [c for c in after.columns if c.endswith("__severity")]
    out = {f"missing_{name}": quality.missingness(after), f"flags_{name}": quality.flag_summary(after)}
    if severities:
        out[f"outliers_{name}"] = eda.frequencies(after, severities).select("column", F.col("value").alias("severity"), "rows", "fraction")
    return out


def build_features(gold: Mapping[str, DataFrame], r: FeatureRules, entity: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Feature tables with past-only windows."""
    out: dict[str, DataFrame] = {}
    if "daily" in gold:
        d = features.known_context_zero(gold["daily"]) if "tiene_evento" in gold["daily"].columns else gold["daily"]
        targets = [c for c in ("facturacion", "num_tickets", "reservas_total", "comensales_reservados_total") if c in d.columns]
        f = features.daily_rolling(features.daily_lags(d, entity, targets, r.daily_lags), entity, targets, r.daily_rolling_windows)
        if "facturacion" in targets and "num_tickets" in targets:
            f = features.same_weekday(f, entity, "facturacion", "num_tickets")
        out["features_daily"] = features.feature_calendar(f)
    if "article_period" in gold:
        key = [*entity, "article_code"]
        p = panel.period_index(gold["article_period"], entity)
        f = features.history(features.exact_lags(p, key, lags=r.article_lags), key, windows=r.article_rolling_windows, least=r.min_history, frequent=r.frequent, regular=r.regular, intermittent=r.intermittent)
        f = features.period_calendar(features.global_history(f, entity))
        if "daily" in gold:
            known = {c: t for c, t in d.dtypes if c in ("tiene_evento", "es_festivo", "event_intensity_mean")}
            keys = [c for c in entity if c in d.columns]
            if known:
                f = f.join(features.period_context(gold["article_period"], d, known, keys), [*keys, "report_start", "report_end"], "left")
        out["features_article_period"] = features.eligibility(f)
    return out


def profiles(gold: Mapping[str, DataFrame], entity: tuple[str, ...] = (), r: EDARules = EDARules(), silver: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of the profile stage: summaries, columns, frequencies and correlations of each gold table, the
    daily, article, reservation and event profiles, and the findings in words."""
    silver = silver or {}
    days = {"daily": "date", "article_period": "report_start"}
    out = {"summary": eda.dataset_summary({**silver, **gold}, {n: c for n, c in days.items() if n in gold})}
    one: dict[str, Mapping] = {}
    for n, df in gold.items():
        out[f"columns_{n}"] = eda.column_profile(df)
        texts = [c for c, t in df.dtypes if eda.column_role(c, t) == "categorical" and t == "string"]
        if texts:
            out[f"frequencies_{n}"] = eda.frequencies(df, texts, r.most_categories, r.top_categories)
        target = "facturacion" if n == "daily" else "units"
        numeric = [c for c, t in df.dtypes if eda.column_role(c, t) == "numeric" and c != target]
        if target in df.columns and numeric:
            out[f"correlations_{n}"] = eda.correlations(df, target, numeric, r.min_pairs, r.leakage, r.top_correlations)
    if "daily" in gold and {"facturacion", "num_tickets"} <= set(gold["daily"].columns):
        d = gold["daily"]
        out["weekdays"] = eda.weekday_profile(d, entity, "date", "facturacion", "num_tickets", r.low_activity, r.min_weekdays)
        out["months"] = eda.month_profile(d, entity, "date", "facturacion")
        out["days"] = eda.daily_summary(d, entity, "date", "facturacion", "num_tickets")
        one["daily"] = out["days"].agg(F.sum("missing_dates").alias("missing_dates"), F.sum("zero_days").alias("zero_days")).first().asDict()
    if "article_period" in gold:
        p = gold["article_period"]
        out["articles"] = eda.label(panel.article_profile(p, entity).join(panel.latest_metadata(p, [*entity, "article_code"], ["article_name"]), [*entity, "article_code"], "left").withColumn("article_name", F.col("article_name_latest")) if "article_name" in p.columns else panel.article_profile(p, entity))
        out["periods"] = panel.period_totals(p, entity)
        overall = cut(panel.article_profile(p))
        out["panel"] = eda.period_panel_summary(overall, p.select("report_start", "report_end").distinct())
        one["panel"] = out["panel"].first().asDict()
    if "reservas" in silver and {"people", "lead_time_hours"} <= set(silver["reservas"].columns):
        s = silver["reservas"]
        gone = F.coalesce(_folded("status") == "no_show", F.lit(False)) if "status" in s.columns else None
        out["reservations"] = eda.reservation_summary(s, no_show=gone)
        one["reservations"] = out["reservations"].first().asDict()
    if "eventos" in silver and {"event_id", "event_day_number"} <= set(silver["eventos"].columns):
        out["events"] = eda.event_summary(eda.unique_events(silver["eventos"]))
        one["events"] = out["events"].first().asDict()
    if out["summary"] is not None:
        findings = eda.diagnostics(**one)
        out["diagnostics"] = out["summary"].sparkSession.createDataFrame([(i, x) for i, x in enumerate(findings)], "no int, finding string")
    return out


def train(table: DataFrame, r: ModelingRules, keys: list[str], with_candidates: bool = True) -> dict[str, DataFrame]:
    """Splits, out-of-fold predictions, metrics, the adaptive choice, and the frozen mapping with its holdout result."""
    rows = cut(table.where("training_eligible").withColumn("regime", F.col("article_demand_regime_prior")))
    split = evaluate.holdout(rows, fraction=r.final_test_fraction, least=r.min_final_test_periods, min_train=r.min_train_periods)
    development = split.where("split = 'development'")
    fold_table = evaluate.folds(development, splits=r.cv_splits, fraction=r.cv_validation_fraction, min_train=r.min_train_periods)
    baselines = evaluate.discover_baselines(rows.columns)
    preds = evaluate.baseline_predictions(rows, fold_table, baselines, keys, regime="regime")
    names = r.candidates if with_candidates else ()
    categorical: list[str] = []
    numeric: list[str] = []
    if names:
        cat = catalogue.build_catalogue(rows.sparkSession, "features_article_period", rows, "units")
        categorical, numeric = catalogue.select_features(cat, rows.join(development.select("period_index"), "period_index", "left_semi"))
        known = ("regime", "article_demand_regime_prior", *r.identifiers)  # a column a value: which codes are worth it is a rule
        categorical = [c for c in categorical if c in known]
        preds = preds.unionByName(models.cross_validate(rows, fold_table, names, categorical, numeric, keys, trees=r.trees))
    preds = cut(preds)
    frozen = cut(evaluate.frozen_mapping(preds, r.default_model, r.adaptive_min_regime_rows, r.adaptive_min_global_rows))
    overall = evaluate.global_model(preds, r.adaptive_min_global_rows) or r.default_model
    spark = rows.sparkSession
    out = {
        "frozen_global": spark.createDataFrame([(overall,)], "model string"),
        "frozen_features": spark.createDataFrame([(c, "categorical") for c in categorical] + [(c, "numeric") for c in numeric], "column string, kind string"),
        "predictions": preds, "metrics": evaluate.metrics_at_levels(preds), "summary": evaluate.cv_summary(evaluate.metrics(preds)), "frozen_mapping": frozen,
        "selection": evaluate.adaptive_selection(preds, r.default_model, r.adaptive_min_regime_rows, r.adaptive_min_global_rows), "top_k": evaluate.top_k_overlap(preds, ["fold", "model"], "period_index", keys, r.top_k),
    }
    if r.evaluate_final_test and split.where("split = 'test'").limit(1).count():
        final = split.select(F.lit(0).alias("fold"), "period_index", F.when(F.col("split") == "test", "validation").otherwise("train").alias("role"))
        test = evaluate.baseline_predictions(rows, final, baselines, keys, regime="regime")
        every = test
        if names:
            candidates = cut(models.cross_validate(rows, final, names, categorical, numeric, keys, trees=r.trees))
            out["final_test_candidates"] = evaluate.metrics(candidates, ["model"])
            every = test.unionByName(candidates)
        every = cut(every)
        require_models(frozen, overall, [x[0] for x in every.select("model").distinct().collect()])
        adaptive = evaluate.apply_selection(every, frozen.select("regime", "model"), ["regime"], [*keys, "period_index", "fold"], overall)
        out["final_test"] = evaluate.metrics(test.select("model", "target", "prediction").unionByName(adaptive.select("model", "target", "prediction")), ["model"])
    return out


def require_models(mapping: DataFrame, default: str, predicted: Collection[str]) -> list[str]:
    """The models in use, the mapped ones and the default; an error if one of them has no prediction."""
    used = sorted({default, *(x[0] for x in mapping.select("model").distinct().collect())})  # a row a regime
    missing = [m for m in used if m not in predicted]
    if missing:
        raise KeyError(f"frozen models without a prediction: {', '.join(missing)}")
    return used


def future_daily_context(silver: Mapping[str, DataFrame], horizon: DataFrame, weather: DataFrame | None = None, r: FutureContextRules = FutureContextRules(), entity: tuple[str, ...] = ()) -> DataFrame:
    """The days of the horizon (*entity, forecast_start, forecast_end) with their events, holidays and forecast weather, each where it is given."""
    bounds = horizon.agg(F.min("forecast_start").alias("a"), F.max("forecast_end").alias("b")).first()
    a, b = F.lit(bounds["a"]), F.lit(bounds["b"])
    days = horizon.select(*entity, F.explode(F.sequence("forecast_start", "forecast_end", F.expr("interval 1 day"))).alias("date"))
    events = holidays = None
    if r.include_events and "eventos" in silver:
        events = context.events_in_horizon(silver["eventos"], a, b)
    if r.include_holidays and "festivos" in silver:
        holidays = daily.holidays_daily(silver["festivos"].where(F.col("date").between(a, b)))
    sky = None
    if r.include_weather and weather is not None:
        sky = context.forecast_weather(weather.withColumn("date", F.col("date").try_cast("date")), a, b)
    return context.future_context(days, events, holidays, sky)


def forecast(
    gold_panel: DataFrame, r: FeatureRules, o: OperationalRules, mapping: DataFrame, entity: tuple[str, ...] = (), default: str = "expanding_mean", history: DataFrame | None = None, frozen_features: DataFrame | None = None,
    modeling: ModelingRules | None = None, daily_gold: DataFrame | None = None, future_days: DataFrame | None = None,
) -> DataFrame:
    """The next period per article: history plus scaffold through the same feature builder, then the mapped model and the ranking.

    ``daily_gold`` with ``future_days`` in the place of its own days goes through the builder too, so that a
    coming period has its context columns. Mapped candidates are refitted on all eligible rows of ``history``
    with the frozen features; what of these the coming period lacks is null and imputed as in training. A
    baseline without a value is replaced by the median of the eligible targets, and marked. A mapped model that
    can't be predicted is an error.
    """
    horizon = context.next_period(context.period_table(gold_panel, entity), entity)
    scaffold = context.future_scaffold(gold_panel, horizon, list(entity), "article_code", ["units", "amount"])
    future = scaffold.select(*entity, "article_code", "report_start", "report_end")
    both = {"article_period": context.complete_rows(gold_panel).unionByName(scaffold.withColumn("period_is_complete", F.lit(True)))}
    if daily_gold is not None:
        keys = [c for c in (*entity, "date") if c in daily_gold.columns]
        coming = future_days.select(*keys, *[c for c in future_days.columns if c in daily_gold.columns and c not in keys]).dropDuplicates(keys) if future_days is not None else None
        both["daily"] = daily_gold if coming is None else context.override_union(daily_gold, coming, keys)
    f = build_features(both, r, entity)["features_article_period"].join(future, future.columns, "left_semi")
    value = evaluate.discover_baselines(f.columns)
    fitted = history is not None and frozen_features is not None
    used = require_models(mapping, default, {*value, *(models.CANDIDATES if fitted else ())})
    small = F.broadcast(mapping.select(F.col("regime").alias("article_demand_regime_prior"), F.col("model").alias("selected_model")))  # a row a regime
    f = f.join(small, "article_demand_regime_prior", "left").withColumn("selected_model", F.coalesce("selected_model", F.lit(default)))
    eligible = cut((history if history is not None else build_features({"article_period": gold_panel}, r, entity)["features_article_period"]).where("training_eligible"))
    median = eligible.agg(F.median("units")).first()[0]
    f = cut(f.withColumn("own", F.coalesce(*[F.when(F.col("selected_model") == m, F.col(c)) for m, c in value.items()])))
    candidates = [m for m in used if m not in value]
    if candidates:
        kinds = {c["column"]: c["kind"] for c in frozen_features.collect()}  # a row a feature
        categorical, numeric = [c for c, k in kinds.items() if k == "categorical"], [c for c, k in kinds.items() if k == "numeric"]
        types = {c: t for c, t in eligible.dtypes if c in kinds}
        f = catalogue.with_columns(f, types)
        parts = f.where(~F.col("selected_model").isin(candidates))
        for m in candidates:
            if m == "poisson_glm" and not models.poisson_allowed(eligible, "units"):
                raise KeyError("poisson_glm is mapped, but the eligible targets allow no Poisson loss")
            model = models.fit(eligible, m, categorical, numeric, "units", trees=(modeling or ModelingRules()).trees)
            predicted = models.predict(model, f.where(F.col("selected_model") == m), m, categorical, numeric)
            parts = parts.unionByName(predicted.withColumn("own", F.col("prediction")).select(*f.columns))
        f = cut(parts)
    f = f.withColumns({"predicted_units": F.greatest(F.coalesce("own", F.lit(median).cast("double"), F.lit(0.0)), F.lit(0.0)), "used_prediction_fallback": F.col("own").isNull()}).drop("own")
    return context.rank_forecast(f, list(entity), "article_code", a=o.abc_threshold_a, b=o.abc_threshold_b)


def run(spark: SparkSession, config: PipelineConfig, silver_input: Mapping[str, DataFrame] | None = None, entity: tuple[str, ...] = ()) -> dict[str, object]:
    """The chosen stages in order; what a stage doesn't make anew is read from its layer."""
    problems = [] if silver_input else config.problems(spark)
    if problems:
        raise ValueError("; ".join(problems))
    config.paths.prepare(spark)
    o, out = config.options, {"summary": config.summary()}
    report = lambda name: os.path.join(config.paths.of("reports"), name)
    layer = lambda name: layers.read_layer(spark, config.paths.of(name), name)
    tables = lambda made: [layers.write_csv(df, report(f"{n}.csv")) for n, df in made.items()]
    bronze: Mapping[str, DataFrame] = silver_input or {}
    if not silver_input and o.do_ingest:
        bronze, errors = ingest(spark, config.paths.of("raw"), o.recursive_raw_scan, o.strict_ingestion)
        layers.write_layer(bronze, config.paths.of("bronze"), "bronze")
        bronze = layer("bronze")
        tables({"ingestion_errors": errors})
    elif not silver_input and o.do_depuration:
        bronze = layers.read_structured(spark, config.structured_inputs) if config.source() == "structured" else layer("bronze")
    if o.do_depuration:
        layers.write_layer({n: clean(df, n, config.cleaning) for n, df in bronze.items()}, config.paths.of("silver"), "silver")
        silver = {n: df for n, df in layer("silver").items() if n in bronze}
        for n, df in silver.items():
            tables(quality_reports(n, bronze[n], df))
        summary = eda.cleaning_summary(bronze, silver)
        tables({"cleaning_summary": summary})
        out["cleaning"] = {r["dataset"]: r.asDict() for r in summary.collect()}  # a row a dataset
        layers.write_layer(integrate(silver, entity, config.integration), config.paths.of("gold"), "gold")
        tables({f"integration_{n}": df for n, df in integration_reports(silver, layer("gold")).items()})
    if o.do_eda:
        tables({f"eda_{n}": df for n, df in profiles(layer("gold"), entity, config.eda, layer("silver")).items()})
    if o.do_features:
        made = build_features(layer("gold"), config.features, entity)
        layers.write_layer(made, config.paths.of("features"), "features")
        tables({f"catalogue_{n}": catalogue.build_catalogue(spark, n, df, "units" if "article" in n else "facturacion") for n, df in made.items()})
    if o.do_modeling:
        results = train(layer("features")["features_article_period"], config.modeling, [*entity, "article_code"], bool(config.modeling.candidates))
        layers.write_layer({f"model_{n}": df for n, df in results.items()}, config.paths.of("reports"), "gold")
        tables({f"modeling_{n}": results[n] for n in ("metrics", "summary", "selection", "frozen_mapping", "top_k", "final_test", "final_test_candidates") if n in results})
        out["models"] = {r["model"]: r["wape_mean"] for r in results["summary"].collect()}
        out["final_test"] = {r["model"]: {m: r[m] for m in ("rows", "mae", "rmse", "wape", "bias")} for r in results["final_test"].collect()} if "final_test" in results else {}
    if o.do_operational:
        out |= operate(spark, config, entity)
    layers.write_report(spark, out, report("run.json"))
    return out


#: Columns of the compact forecast, in this order, before its context.
COMPACT = ("article_code", "article_name", "department_name", "report_start", "report_end", "predicted_units", "predicted_units_rounded", "forecast_rank", "forecast_share", "forecast_cumulative_share", "planning_class", "article_demand_regime_prior", "selected_model", "used_prediction_fallback")


def operate(spark: SparkSession, config: PipelineConfig, entity: tuple[str, ...] = ()) -> dict[str, object]:
    """The operational stage: context of the coming days, forecast, its summaries and the audit of the catalogue."""
    reports = config.paths.of("reports")
    saved = lambda n: spark.read.parquet(os.path.join(reports, f"model_{n}.parquet"))
    gold, silver = layers.read_layer(spark, config.paths.of("gold"), "gold"), layers.read_layer(spark, config.paths.of("silver"), "silver")
    p = gold["article_period"]
    horizon = cut(context.next_period(context.period_table(p, entity), entity))
    if not horizon.where("forecast_start is not null").limit(1).count():
        return {"forecast_articles": 0}
    ahead = future_daily_context(silver, horizon, layers.read_optional(spark, config.weather_forecast), config.future, entity)
    history = layers.read_layer(spark, config.paths.of("features"), "features")["features_article_period"]
    made = forecast(p, config.features, config.operational, saved("frozen_mapping"), entity, saved("frozen_global").first()["model"], history, saved("frozen_features"), config.modeling, gold.get("daily"), ahead)
    layers.write_layer({"forecast": made}, reports, "gold")
    made = spark.read.parquet(os.path.join(reports, "forecast.parquet"))
    summary = context.forecast_summary(made, entity)
    profile = context.history_profile(panel.period_index(p, entity), entity)
    catalogue_tables = [silver.get(n) for n in ("articulos", "menu")]
    empty = spark.createDataFrame([], "article_code string")
    audit = context.audit_catalogue(context.combine_catalogues(*[empty if t is None else t for t in catalogue_tables], p), profile)
    reported = {"future_context": ahead, "forecast_compact": context.compact(made, (*entity, *COMPACT)), "forecast_summary": summary, "forecast_models": context.usage(made, "selected_model"), "forecast_regimes": context.usage(made, "article_demand_regime_prior"), "catalogue_audit": audit}
    for n, df in reported.items():
        layers.write_csv(df, os.path.join(reports, f"{n}.csv"))
    total = summary.agg(F.sum("articles").alias("n"), F.sum("predicted_total").alias("t"), F.sum("fallback_articles").alias("f")).first()
    return {"forecast_articles": total["n"] or 0, "forecast_total": total["t"], "forecast_fallbacks": total["f"], "forecast_models": {r["selected_model"]: r["articles"] for r in reported["forecast_models"].collect()}}
