"""Configuration, the staged run, models, catalogue and streaming."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from almazara.config import CleaningRules, EDARules, FeatureRules, IntegrationRules, ModelingRules, OperationalRules, Paths, PipelineConfig, RunOptions
from almazara import pipeline
from almazara.operators import catalogue, evaluate, models
from almazara.operators.models import fit
from almazara.pipeline import ingest, run
from almazara.plans import reference_queries
from almazara.session import cut
from almazara.streaming.daily import daily_totals, deduplicated

SF = "/root/testdata/sf0.001"


def test_forbidden_options():
    for bad in ({"do_ingest": True, "do_depuration": False}, {"do_ingest": True, "do_depuration": False, "do_eda": False, "do_features": False}, {"do_features": False}, {"do_features": False, "do_operational": False}, {"do_modeling": False}, {f"do_{s}": False for s in ("ingest", "depuration", "eda", "features", "modeling", "operational")}, {"source_when_ingest_disabled": "x"}):
        with pytest.raises(ValueError):
            RunOptions(**bad)
    for cls, bad in ((CleaningRules, {"max_missing_fraction": 2}), (FeatureRules, {"daily_lags": ()}), (FeatureRules, {"regular": 0.9}), (ModelingRules, {"top_k": 0}), (OperationalRules, {"abc_threshold_a": 0.99})):
        with pytest.raises(ValueError):
            cls(**bad)


def test_sources_and_problems(spark, tmp_path):
    c = PipelineConfig(Paths(str(tmp_path)))
    assert c.source() == "raw" and c.problems(spark) == ["the raw folder is missing"]
    c = PipelineConfig(Paths(str(tmp_path)), RunOptions(do_ingest=False), structured_inputs={"ventas": "nowhere.parquet"})
    assert c.source() == "structured" and "nowhere" in c.problems(spark)[0]
    only = {f"do_{x}": False for x in ("ingest", "depuration", "eda", "features", "modeling")}
    assert PipelineConfig(Paths(str(tmp_path)), RunOptions(**only)).problems(spark) == ["there is no gold layer", "there are no feature tables", "there is no frozen mapping"]
    for cls, bad in ((IntegrationRules, {"build_daily": False, "build_panel": False}), (IntegrationRules, {"expected_days_weight": "x"}), (EDARules, {"leakage": 2.0})):
        with pytest.raises(ValueError):
            cls(**bad)


def test_run_over_structured_tables(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/ventas.parquet").drop("turn")
    m = spark.read.parquet(f"{SF}/maestra_diaria.parquet").where("facturacion is not null and date is not null")
    tickets = m.select("restaurant", "date", F.col("diaria_id").cast("string").alias("document_id"), F.col("facturacion").alias("document_total"), F.lit(1.0).alias("receipt_count"))
    v.write.parquet(str(tmp_path / "v.parquet"))
    tickets.write.parquet(str(tmp_path / "t.parquet"))
    spark.read.parquet(f"{SF}/articulos.parquet").write.parquet(str(tmp_path / "a.parquet"))
    inputs = {"ventas": str(tmp_path / "v.parquet"), "tickets": str(tmp_path / "t.parquet"), "articulos": str(tmp_path / "a.parquet")}
    config = PipelineConfig(Paths(str(tmp_path)), RunOptions(do_ingest=False), modeling=ModelingRules(candidates=("poisson_glm",)), structured_inputs=inputs)
    out = run(spark, config, entity=("restaurant",))
    reports = {x.removesuffix(".csv") for x in os.listdir(tmp_path / "reports") if x.endswith(".csv")}
    assert {"missing_ventas", "flags_ventas", "outliers_ventas", "cleaning_summary", "integration_coverage", "integration_provenance", "eda_summary", "eda_articles", "eda_panel", "eda_diagnostics", "modeling_metrics", "modeling_final_test",
            "forecast_summary", "forecast_models", "forecast_regimes", "forecast_compact", "future_context", "catalogue_audit", "catalogue_features_article_period"} <= reports
    assert out["cleaning"]["ventas"]["rows_before"] >= out["cleaning"]["ventas"]["rows_after"] > 0 and sum(out["forecast_models"].values()) == out["forecast_articles"]
    assert set(out["models"]) == {"lag_1", "rolling_mean_4", "expanding_mean", "poisson_glm"} and out["forecast_articles"] > 0
    f = spark.read.parquet(str(tmp_path / "reports/forecast.parquet"))
    shares = f.groupBy("restaurant").agg(F.sum("forecast_share").alias("s")).collect()
    assert all(r.s is None or abs(r.s - 1) < 1e-9 for r in shares)
    silver = spark.read.parquet(str(tmp_path / "data/silver/ventas_silver.parquet"))
    assert {"units__outlier", "units__negative", "quality_key_duplicate"} <= set(silver.columns)
    assert json.load(open(tmp_path / "reports/run.json"))["summary"]["source"] == "structured"
    final = spark.read.parquet(str(tmp_path / "reports/model_final_test.parquet"))
    assert {r.model for r in final.collect()} == {"lag_1", "rolling_mean_4", "expanding_mean", "adaptive"}


def test_ingest_reports_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "festivos.csv").write_text("fecha,festivo\n2025-01-01,Año Nuevo\n")
    (tmp_path / "what.csv").write_text("a,b\n1,2\n")
    tables, errors = ingest(spark, str(tmp_path))
    assert set(tables) == {"festivos"} and errors.count() == 1
    with pytest.raises(ValueError):
        ingest(spark, str(tmp_path), strict=True)


def test_raw_folder_of_all_kinds(spark, tmp_path):
    """Sheets and invoices by readers of plain text in place of the optional libraries."""
    (tmp_path / "res.xlsx").write_text("Fecha|Hora|Estado|Turno|Personas\n02/03/2024|21:30|No show|Cena|4")
    (tmp_path / "res2.xlsx").write_text("Fecha|Hora|Estado|Turno|Personas|Origen\n02/03/2024|14:30|Completada|Comida|2|Walk in")
    (tmp_path / "dep.xls").write_text("Código|Descripción|Descripción abreviada\n10|Vinos|V")
    (tmp_path / "bad.xls").write_text("!")
    (tmp_path / "v.xlsx").write_text("Articulos x Departamentos Venta\nFecha Inicial: 01/03/2024\nFecha Final: 07/03/2024\n10||Vinos\n101||Tinto||3||10,50\n102||Regalo||1||0")
    (tmp_path / "f.pdf").write_text("Factura: F-1 02/03/2024 TOTAL 10,00")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "empty.xlsx").write_text("")

    def sheet(name, content):
        if content == b"!":
            raise ValueError("no workbook")
        return [line.split("|") for line in content.decode().split("\n")]

    pdf = lambda name, content: [(0, 40.0 * i, 5.0, 40.0 * i + 30, 9.0, w) for i, w in enumerate(content.decode().split())]
    tables, errors = ingest(spark, str(tmp_path), read_sheet=sheet, read_pdf=pdf)
    assert set(tables) == {"reservas", "departamentos", "ventas", "facturas"} and {r.file for r in errors.collect()} == {"bad.xls", "empty.csv", "empty.xlsx"}
    assert tables["facturas"].first().total == 10.0 and tables["reservas"].count() == 2
    sales, _ = pipeline.load_weekly_sales(spark, str(tmp_path), read_sheet=sheet)
    assert sales.count() == 2
    (tmp_path / "res3.xlsx").write_text("Fecha|Hora|Estado|Turno|Personas|Zona\n")
    silver = {n: pipeline.clean(t, n, CleaningRules()) for n, t in tables.items()}
    gold = pipeline.integrate(silver, (), IntegrationRules(keep_invitations=False, statuses=("no_show", "completada")))
    p = gold["article_period"].collect()
    assert [(str(r.article_code), r.department_name) for r in p] == [("101", "Vinos")]
    d = gold["daily"].collect()
    assert [(r.reservas_total, r.reservas_no_show, r.reservas_walk_in, r.reservas_turno_cena, r.facturacion) for r in d] == [(2, 1, 1, 1, 10.0)]
    lost = spark.createDataFrame([("r.xlsx", 0, ["Fecha", "Hora"])], "source_file string, row_no int, cells array<string>")
    from almazara.sources.cells import lacking
    assert lacking(lost, *pipeline.REQUIRED_COLUMNS["reservations"]).first().error == "required columns are missing: status, shift, people"


def test_future_context_reaches_the_features(spark):
    panel_rows = weekly_panel(spark)
    day = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i), i % 9 == 0, 1.0 if i % 9 == 0 else None, float(i)) for i in range(112)], "date date, tiene_evento boolean, event_intensity_mean double, facturacion double")
    events = spark.createDataFrame([("E", "Feria", dt.date(2024, 4, 23), dt.date(2024, 4, 24), 4.0)], "event_id string, event_name string, event_start date, event_end date, event_intensity double")
    holidays = spark.createDataFrame([(dt.date(2024, 4, 22), "x")], "date date, holiday_name string")
    horizon = spark.createDataFrame([(dt.date(2024, 4, 22), dt.date(2024, 4, 28))], "forecast_start date, forecast_end date")
    ahead = pipeline.future_daily_context({"eventos": events, "festivos": holidays}, horizon)
    got = {r.date.day: (r.tiene_evento, r.es_festivo) for r in ahead.collect()}
    assert len(got) == 7 and got[22] == (False, True) and got[23] == (True, False) and got[25] == (False, False)
    mapping = spark.createDataFrame([], "regime string, model string, source string")
    made = pipeline.forecast(panel_rows, FeatureRules(), OperationalRules(), mapping, daily_gold=day, future_days=ahead)
    r = made.first()
    assert r.report_start == dt.date(2024, 4, 22) and r.context_days_available == 7 and r.context_tiene_evento__days_true == 2


def test_baselines_are_discovered():
    assert evaluate.discover_baselines(["units__rolling_mean_8", "units__rolling_mean_12", "units__lag_1", "x"]) == {"lag_1": "units__lag_1", "rolling_mean_8": "units__rolling_mean_8"}
    with pytest.raises(ValueError):
        evaluate.discover_baselines(["x"])


def test_models_predict_and_are_named_truly(spark):
    rows = [(i, float(i % 5), None if i % 7 == 0 else "ab"[i % 2], None, float((i % 5) * 2 + i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, c string, nothing double, y double")
    for n in models.CANDIDATES:
        m = models.fit(df, n, ["c"], ["x", "nothing"], "y", trees=20, iterations=20)
        new = spark.createDataFrame([(1, 4.0, "new", None, None), (2, None, None, None, None)], df.schema)
        p = {r.id: r.prediction for r in models.predict(m, new, n, ["c"], ["x", "nothing"]).collect()}
        assert p[1] > p[2] >= 0
    with pytest.raises(ValueError):
        models.fit(df, "x", [], ["x"], "y")
    assert models.poisson_allowed(df, "y") and not models.poisson_allowed(df.withColumn("y", -F.col("y")), "y")
    assert models.unseen_share(df, spark.createDataFrame([(1, 0.0, "new", None, None), (2, 0.0, "a", None, None)], df.schema), ["c"]).collect()[0].share == 0.5


def test_catalogue(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, True, "a", None), (2, 3.0, 1.0, False, "b", None)], "article_code long, units__lag_1 double, rain_mm double, es_festivo boolean, article_demand_regime_prior string, cal_month int")
    cat = catalogue.build_catalogue(spark, "t", df, "units")
    safe = {r.column: r.safe_default for r in cat.collect()}
    assert safe == {"article_code": False, "units__lag_1": True, "rain_mm": False, "es_festivo": True, "article_demand_regime_prior": True, "cal_month": True}
    assert catalogue.select_features(cat, df) == (["article_demand_regime_prior"], ["units__lag_1", "es_festivo"])
    assert catalogue.with_columns(df, {"new": "double"}).columns[-1] == "new" and catalogue.provenance(spark, {"t": df}).count() == 6


def test_streaming_totals(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, d, 10), float(d)) for d in (1, 1, 2, 9)]
    spark.createDataFrame(rows, "e long, at timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("e long, at timestamp, v double").parquet(str(tmp_path / "in"))
    q = daily_totals(stream, "at", ["e"], "v").writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.date.day, r.rows, r.total) for r in spark.table("totals").collect()} == {(1, 2, 2.0), (2, 1, 2.0), (9, 1, 9.0)}
    assert deduplicated(stream, ["e"], "at").isStreaming and os.path.isdir(tmp_path / "in")


def weekly_panel(spark, weeks=16, articles=3):
    start = dt.date(2024, 1, 1)
    rows = [(f"a{a}", f"d{a % 2}", start + dt.timedelta(7 * w), start + dt.timedelta(7 * w + 6), float(5 * (a + 1) + (w * (a + 2)) % 4), 1.0, True) for w in range(weeks) for a in range(articles)]
    return spark.createDataFrame(rows, "article_code string, department_code string, report_start date, report_end date, units double, amount double, period_is_complete boolean")


def test_mapped_candidates_are_refitted_and_scored(spark, monkeypatch):
    panel = weekly_panel(spark)
    table = cut(pipeline.build_features({"article_period": panel}, FeatureRules())["features_article_period"])
    regimes = [r[0] for r in table.select("article_demand_regime_prior").distinct().collect()]
    mapping = spark.createDataFrame([(r, "poisson_glm", "regime") for r in regimes], "regime string, model string, source string")
    features = spark.createDataFrame([("units__lag_1", "numeric"), ("gone", "numeric")], "column string, kind string")
    history = table.withColumn("gone", F.col("period_index").cast("double"))
    made = pipeline.forecast(panel, FeatureRules(), OperationalRules(), mapping, history=history, frozen_features=features).collect()
    model = models.fit(history.where("training_eligible"), "poisson_glm", [], ["units__lag_1", "gone"], "units")
    last = panel.where("report_start = '2024-04-15'").select("article_code", F.col("units").alias("units__lag_1"), F.lit(None).cast("double").alias("gone"))
    hand = {r.article_code: r.prediction for r in models.predict(model, last, "poisson_glm", [], ["units__lag_1", "gone"]).collect()}
    assert {r.article_code for r in made} == set(hand) and all(r.selected_model == "poisson_glm" and not r.used_prediction_fallback and abs(r.predicted_units - hand[r.article_code]) < 1e-9 for r in made)
    with pytest.raises(KeyError):
        pipeline.forecast(panel, FeatureRules(), OperationalRules(), mapping)
    with pytest.raises(KeyError):
        pipeline.forecast(panel, FeatureRules(), OperationalRules(), mapping.withColumn("model", F.lit("unheard_of")), history=history, frozen_features=features)
    monkeypatch.setattr(evaluate, "frozen_mapping", lambda *a: mapping)
    out = pipeline.train(table, ModelingRules(candidates=("poisson_glm",)), ["article_code"])
    adaptive = out["final_test"].where("model = 'adaptive'").first()
    assert adaptive.wape == pytest.approx(out["final_test_candidates"].first().wape) and adaptive.rows > 0
    assert {r["column"] for r in out["frozen_features"].collect()} >= {"units__lag_1"} and out["frozen_global"].count() == 1


def test_model_queries_fit_the_full_sizes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "fit", lambda train, name, c, n, target, **sizes: seen.append((name, sizes)) or fit(train, name, c, n, target, trees=3, iterations=3))
    for q in (reference_queries.ml_random_forest, reference_queries.ml_gbt_log1p):
        q(spark, SF)
    assert seen == [("random_forest", {}), ("gbt_log1p", {})]
    df = spark.createDataFrame([(float(i), float(i * i % 97)) for i in range(200)], "x double, y double")
    assert fit(df, "random_forest", [], ["x"], "y", trees=2).stages[-1].getOrDefault("maxDepth") == 30
    assert fit(df, "random_forest", [], ["x"], "y", trees=2, depth=3).stages[-1].getOrDefault("maxDepth") == 3


def test_tips_and_hourly_weather_reach_the_daily_master(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    tickets = spark.createDataFrame([("1", d1, 10.0, 1.0), ("2", d2, 20.0, 1.0)], "document_id string, date date, document_total double, receipt_count double")
    tips = spark.createDataFrame([(d1, 1.0), (d1, 3.0)], "date date, tip double")
    hours = spark.createDataFrame([(f, dt.datetime(2024, 1, d, h), 1.0, float(h)) for f in ("native.csv", "hours.csv") for d in (1, 2) for h in (0, 12)], "source_file string, datetime timestamp_ntz, rain_mm double, temperature_2m double")
    native = spark.createDataFrame([("native.csv", d1, 6.0, 5.0)], "source_file string, date date, rain_mm double, precipitation_mm double")
    got = {r.date: r for r in pipeline.integrate({"tickets": tickets, "tips": tips, "meteo_horaria": hours})["daily"].collect()}
    assert (got[d1].propina_total, got[d1].propina_media, got[d1].rain_mm, got[d1].temperature_2m) == (4.0, 2.0, 2.0, 6.0)
    got = {r.date: r for r in pipeline.integrate({"tickets": tickets, "meteo_horaria": hours, "meteo_diaria": native})["daily"].collect()}
    assert (got[d1].rain_mm, got[d1].precipitation_mm, got[d1].temperature_2m) == (4.0, 5.0, 6.0)
    assert (got[d2].rain_mm, got[d2].precipitation_mm, got[d2].temperature_2m) == (2.0, None, 6.0)


def test_profile_stage_writes_its_tables(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = [(f"t{i}", day + dt.timedelta(i % 20), 10.0 + i, 1.0) for i in range(40)]
    tickets = spark.createDataFrame(rows, "document_id string, date date, document_total double, receipt_count double")
    config = PipelineConfig(Paths(str(tmp_path)), RunOptions(do_ingest=False, do_features=False, do_modeling=False, do_operational=False))
    run(spark, config, {"tickets": tickets})
    read = lambda n: spark.read.csv(str(tmp_path / f"reports/eda_{n}.csv"), header=True)
    assert {r.dataset: r.rows for r in read("summary").collect()} == {"tickets": "40", "daily": "20"} and read("weekdays").count() == 7
    assert {r.column for r in read("columns_daily").collect()} >= {"facturacion", "num_tickets"} and read("correlations_daily").count() > 0


def test_forecast_queries_keep_cold_articles_and_the_newest_period(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [("r", "old", day(7 * i), day(7 * i + 6), i, u) for i, u in enumerate((1.0, 2.0, 9.0))] + [("r", "new", day(14), day(20), 2, 5.0), ("r", "unknown", day(14), day(20), 2, None)]
    df = spark.createDataFrame(rows, "restaurant string, article_code string, report_start date, report_end date, period_index long, units double")
    df.withColumns({"fap_id": F.monotonically_increasing_id(), "loaded_at": F.lit("2024-02-01").cast("timestamp"), "amount": F.col("units"), "period_is_complete": F.lit(True), "article_demand_regime_prior": F.lit("sparse")}).write.parquet(str(tmp_path / "features_article_period.parquet"))
    got = {r.article_code: r.predicted_units for r in reference_queries.ops_forecast_ranking(spark, str(tmp_path)).collect()}
    assert got == {"old": 4.0, "new": 5.0, "unknown": 3.5}
    s = reference_queries.ops_forecast_summary(spark, str(tmp_path)).first()
    assert (s.articles, s.predicted_total) == (3, 12.5)
