"""Null rules, ties and boundaries of the integration, feature, evaluation and planning operators; property tests."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almazara.functions import casts
from almazara.functions.text import fold, slug, slug_name
from almazara.operators import context, daily, eda, evaluate, features, panel, quality, rules

D = dt.date
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def day(n):
    return D(2024, 1, 1) + dt.timedelta(n)


def one(spark, value, kind, *exprs):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*exprs).first()


def test_casts_never_raise(spark):
    rows = [("1.234,56 €",), ("12.5",), (" 7 ",), ("abc",), (None,), ("",), ("-3,5",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(casts.number_eu(F.col("x"))).collect()]
    assert got == [1234.56, 12.5, 7.0, None, None, None, -3.5]
    tokens = [("1.234,56",), ("1,234.56",), ("12,50",), ("-0.5",), ("x",)]
    assert [r[0] for r in spark.createDataFrame(tokens, "x string").select(casts.decimal_token(F.col("x"))).collect()] == [1234.56, 1234.56, 12.5, -0.5, None]
    days = [("2025-07-06",), ("2025/7/6",), ("6/7/2025",), ("06-07-2025",), ("2025-13-01",), ("31/02/2025",), (None,)]
    assert [r[0] for r in spark.createDataFrame(days, "x string").select(casts.day(F.col("x"))).collect()] == [D(2025, 7, 6)] * 4 + [None] * 3
    words = [("Sí",), (" TRUE",), ("y",), ("no",), ("activo",), ("?",), (None,)]
    df = spark.createDataFrame(words, "x string")
    assert [r[0] for r in df.select(casts.boolean(F.col("x"))).collect()] == [True, True, None, False, None, None, None]
    assert [r[0] for r in df.select(casts.boolean(F.col("x"), "scope")).collect()] == [True, True, True, False, True, None, None]


def test_text_folding(spark):
    assert one(spark, "  CAFÉ  Ñandú ", "string", fold(F.col("x")))[0] == "cafe nandu"
    assert one(spark, "​  ", "string", fold(F.col("x")))[0] is None
    assert one(spark, "  --Ñ & Ç! ", "string", slug(F.col("x")))[0] == "n_c" == slug_name("  --Ñ & Ç! ")
    assert casts.slug_columns(spark.createDataFrame([(1, 2, 3)], ["Día", "dia", "!"])).columns == ["dia", "dia_2", "column"]


@SLOW
@given(st.lists(st.text(alphabet=" aÁñ.,0-9€\t", max_size=8), max_size=6))
def test_cleaning_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    once = df.select(casts.null_tokens(F.col("x")).alias("x"))
    assert once.select(casts.null_tokens(F.col("x"))).collect() == once.collect()
    folded = df.select(fold(F.col("x")).alias("x"))
    assert folded.select(fold(F.col("x"))).collect() == folded.collect()


def test_types_and_codes(spark):
    df = spark.createDataFrame([("1", "x", "2024-01-02"), ("2", "3", "bad")], "article_code string, ref_code string, date string")
    out = casts.numeric_codes(casts.assert_types(df))
    assert dict(out.dtypes) == {"article_code": "bigint", "ref_code": "string", "date": "date"}
    nan = casts.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()
    assert nan.a is None and nan.b == 1


def test_outliers_by_both_criteria(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in (1, 2, 3, 4, 5, 6, 7, 100)], "x double, flat double")
    assert quality.eligible_for_outliers(df, ["x", "flat"]) == ["x"] and quality.eligible_for_outliers(df.limit(7), ["x"]) == []
    out = quality.outlier_columns(df, ["x", "flat"])
    assert [r.x__severity for r in out.orderBy("x").collect()] == ["none"] * 7 + ["strong"]
    assert not any(r.flat__outlier for r in out.collect()) and out.first().flat__robust_z is None
    assert {r.flag: r.flagged for r in quality.flag_summary(out).collect()} == {"x__outlier": 1, "flat__outlier": 0}


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=40), st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_quantiles_are_exact(spark, values, q):
    import numpy as np

    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    got = quality.exact_quantiles(df, ["x"], [q], accuracy=10)["x"][0]
    known = [v for v in values if v is not None]
    assert got is None if not known else math.isclose(got, float(np.quantile(known, q)), abs_tol=1e-9)


def test_duplicates_and_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 1), (4, None, 1), (5, "b", 2)], "id int, k string, v int")
    assert [r[0] for r in quality.flag_exact_duplicates(df, "id").orderBy("id").select("quality_exact_duplicate").collect()] == [False, True, False, True, False]
    assert [r[0] for r in quality.flag_key_duplicates(df, ["k"]).orderBy("id").select("quality_key_duplicate").collect()] == [True, True, False, False, False]
    assert quality.require_keys(df, ["k"]).count() == 3 and quality.require_keys(df, ["k"], drop=False).where("quality_missing_key").count() == 2
    with pytest.raises(ValueError):
        quality.assert_unique(df, ["k"])
    lookup = {r.v: (r.k, r.k__master_conflict) for r in quality.consistent_lookup(df, "v", ["k"]).collect()}
    assert lookup == {1: ("a", False), 2: ("b", False)}


def test_impute(spark):
    df = spark.createDataFrame([(float(i), "a") for i in range(39)] + [(None, None)], "x double, t string").withColumn("half", F.when(F.col("x") > 20, 1.0))
    out = quality.impute_low_missingness(df, ["x", "half"], ["t"])
    r = out.where("x__imputed").first()
    assert (r.x, r.t, r.half) == (19.0, "UNKNOWN", None) and "half__imputed" not in out.columns


def test_payment_and_tips(spark):
    rows = [(60.5, 65.0, None), (10.0, 5.0, 5.0), (10.0, None, None), (0.0, 0.0, 0.0), (10.0, None, 10.0)]
    got = [(r.change_amount, r.cash_amount, r.payment_method) for r in rules.resolve_payment(spark.createDataFrame(rows, "total double, cash_tendered double, card_printed double")).collect()]
    assert got == [(4.5, 60.5, "cash"), (0.0, 5.0, "mixed"), (0.0, None, "unknown"), (0.0, 0.0, "none_or_zero"), (0.0, None, "card")]
    tips = rules.tip_flags(spark.createDataFrame([(10.0, 1.0, 11.02), (10.0, 1.0, 11.03), (0.0, 1.0, 1.0)], "document_amount double, tip double, document_total double")).collect()
    assert [(t.tip_total__invalid, t.tip_ratio) for t in tips] == [(False, 0.1), (True, 0.1), (False, None)]


def test_reservation_hours(spark):
    t = dt.datetime(2024, 1, 2, 12)
    rows = [(4, "web", t, t - dt.timedelta(hours=5)), (0, "Sín reserva", t, t + dt.timedelta(hours=1)), (9, "web", t, t + dt.timedelta(hours=1)), (None, None, t, None)]
    got = rules.reservation_flags(spark.createDataFrame(rows, "people int, origin string, at timestamp, made timestamp"), "made", "at").collect()
    assert [(r.lead_time_hours, r.lead_time__invalid, r.is_walk_in, r.people__invalid, r.is_large_group) for r in got] == [(5.0, False, False, False, False), (0.0, False, True, True, False), (None, True, False, False, True), (None, False, False, False, False)]


def test_daily_null_rules(spark):
    rows = [(day(0), "1", None, None), (day(0), "1", None, 1), (day(1), "2", 5.0, 1), (None, "3", 1.0, 1)]
    got = {r.date: r for r in daily.tickets_daily(spark.createDataFrame(rows, "date date, document_id string, document_total double, receipt_count int")).collect()}
    assert got[day(0)].facturacion_tickets is None and got[day(0)].num_tickets == 2 and got[day(0)].num_tickets_unicos == 1 and got[day(1)].facturacion_tickets == 5.0 and len(got) == 2
    tips = daily.tips_daily(spark.createDataFrame([(day(0), None)], "date date, tip double")).first()
    assert tips.propina_total == 0.0 and tips.propina_media is None
    res = spark.createDataFrame([(day(0), "c", None), (day(0), "n", 3)], "d date, s string, people int")
    r = daily.reservations_daily(res, [], "d", F.col("s"), ["c", "n", "p"]).first()
    assert (r.comensales_c, r.comensales_n, r.comensales_p, r.reservas_total) == (None, 3, 0, 2)
    names = daily.holidays_daily(spark.createDataFrame([(day(0), " b"), (day(0), "a"), (day(0), "a"), (day(0), " ")], "date date, holiday_name string")).first()
    assert (names.festivo_nombre, names.num_festivos) == ("a | b", 4)


@SLOW
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 12)), max_size=8))
def test_expansion_has_one_row_a_day(spark, spans):
    df = spark.createDataFrame([(day(a), day(a + n)) for a, n in spans], "s date, e date")
    out = daily.expand_days(df, "s", "e")
    assert out.count() == sum(n + 1 for _, n in spans)
    assert daily.expand_days(df.select(F.col("e").alias("s"), F.date_sub("s", 1).alias("e")), "s", "e").count() == 0


def test_calendar_revenue_and_structural_zeros(spark):
    base = spark.createDataFrame([(day(0), 1.0), (day(3), None)], "date date, facturacion_tickets double")
    spine = daily.calendar(base, [], "date")
    out = daily.daily_master(spine, {"tickets": (base.withColumn("num_tickets", F.lit(2)), ["date"]), "pdf": (spark.createDataFrame([(day(1), 7.0)], "date date, facturacion_facturas_pdf double"), ["date"])}).orderBy("date").collect()
    assert [(r.facturacion, r.facturacion_source, r.num_tickets) for r in out] == [(1.0, "tickets", 2), (7.0, "facturas_pdf", 0), (None, None, 0), (None, None, 2)]
    assert daily.anchor_source(["eventos", "reservas", "tickets"]) == "tickets" and daily.anchor_source(["eventos", "x"]) == "x" and daily.anchor_source(["eventos"]) is None
    assert daily.out_of_calendar(spark.createDataFrame([(day(9),)], "date date"), spine, ["date"]).count() == 1


HISTORY = "article_code int, report_start date, report_end date, units double, period_index int"


def test_history_panel_of_the_blueprint(spark):
    rows = [(1, day(7 * i), day(7 * i + 6), float(u), i) for i, u in ((0, 10), (2, 20), (3, 30))]
    df = features.history(features.exact_lags(spark.createDataFrame(rows, HISTORY), ["article_code"]), ["article_code"])
    r = df.where("period_index = 3").first()
    assert (r.units__lag_1, r.units__lag_1_observed, r.units__lag_2, r.units__lag_2_observed) == (20.0, True, None, False)
    assert (r.units__rolling_mean_4, r.units__expanding_mean_prior, r.history_observed_periods, r.periods_since_last_observation, r.article_demand_regime_prior) == (15.0, 15.0, 2, 1, "cold_start")
    assert math.isclose(r.history_observation_rate, 2 / 3)
    first = df.where("period_index = 0").first()
    assert first.history_observation_rate is None and first.units__rolling_count_4 == 0 and first.units__expanding_mean_prior is None


@pytest.mark.parametrize("seen, at, regime", [(6, 8, "frequent"), (4, 8, "regular"), (4, 16, "intermittent"), (4, 17, "sparse"), (3, 3, "cold_start")])
def test_regime_boundaries_are_inclusive(spark, seen, at, regime):
    df = spark.createDataFrame([(1, day(i), day(i), 1.0, i) for i in [*range(seen), at]], HISTORY)
    assert features.history(df, ["article_code"]).where(f"period_index = {at}").first().article_demand_regime_prior == regime


@SLOW
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 12), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=25), st.integers(0, 12))
def test_no_feature_looks_ahead(spark, rows, cut_at):
    unique = {(a, i): u for a, i, u in rows}
    make = lambda f: spark.createDataFrame([(a, day(i), day(i), None if f(i, u) is None else float(f(i, u)), i) for (a, i), u in unique.items()], HISTORY)
    build = lambda df: {(r.article_code, r.period_index): r.asDict() for r in features.global_history(features.history(features.exact_lags(df, ["article_code"]), ["article_code"])).drop("units").collect() if r.period_index <= cut_at}
    assert build(make(lambda i, u: u)) == build(make(lambda i, u: 99 if i >= cut_at and u is not None else u))


def test_period_context_counts_days(spark):
    periods = spark.createDataFrame([(day(0), day(2)), (day(10), day(11)), (day(5), day(4))], "report_start date, report_end date")
    d = spark.createDataFrame([(day(0), True, 2.0), (day(1), None, None), (day(2), True, 4.0)], "date date, f boolean, rain_mm double")
    got = {r.report_start: r for r in features.period_context(periods, d, {"f": "boolean", "rain_mm": "double"}).collect()}
    r = got[day(0)]
    assert (r.context_days_available, r.context_f__days_true, r.context_rain_mm__mean, r.context_rain_mm__sum, r.context_coverage_fraction) == (3, 2, 3.0, 6.0, 1.0)
    assert got[day(10)].context_days_available == 0 and got[day(10)].context_rain_mm__sum is None and got[day(5)].context_coverage_fraction == 0.0


def test_panel_sums_and_conflicts(spark):
    rows = [(day(0), day(6), 1, None, None, "a"), (day(0), day(6), 1, None, 2.0, "b"), (day(0), day(6), 2, 3.0, 1.0, "c"), (day(7), day(10), 2, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "report_start date, report_end date, article_code int, units double, amount double, article_name string")
    p = panel.dedupe_panel(df, ["article_code"], ["article_name"])
    r = p.where("article_code = 1").first()
    assert (r.units, r.amount, r.article_name, r.article_name__period_conflict) == (0.0, 2.0, None, True)
    fields = panel.period_fields(p, panel.expected_period_days(p))
    assert {(r.period_id, r.period_is_complete) for r in fields.collect()} == {("2024-01-01__2024-01-07", True), ("2024-01-08__2024-01-11", False)}
    tie = spark.createDataFrame([(day(0), day(6)), (day(0), day(2))], "report_start date, report_end date")
    assert panel.expected_period_days(tie).first().expected_days == 7 and panel.expected_period_days(tie, tie="shortest").first().expected_days == 3
    master = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "article_code int, article_name string")
    e = {(r.article_code, r.report_start): r for r in panel.enrich(p, master, "article_code", ["article_name"], "m").collect()}
    assert e[1, day(0)].article_name == "x" and e[2, day(0)].article_name == "c" and e[2, day(7)].article_name is None and e[2, day(7)].article_name__master_conflict


def test_splits_of_the_blueprint():
    assert evaluate.test_periods(39) == 6 and 4507 + 789 == 5296
    plan = evaluate.plan_folds(33)
    assert [(f.first, f.last - f.first + 1) for f in plan] == [(17, 4), (21, 4), (25, 4), (29, 4)]
    assert evaluate.plan_folds(8) == [] and evaluate.test_periods(9) == 0


@SLOW
@given(st.integers(0, 60))
def test_folds_never_train_on_what_they_test(spark, n):
    for f in evaluate.plan_folds(n):
        assert 8 <= f.first <= f.last < n
    df = spark.range(n).select(F.col("id").alias("period_index"))
    rows = evaluate.folds(df).collect()
    for fold in {r.fold for r in rows}:
        assert max(r.period_index for r in rows if r.fold == fold and r.role == "train") < min(r.period_index for r in rows if r.fold == fold and r.role == "validation")


def test_metrics(spark):
    df = spark.createDataFrame([("m", 1, 2.0), ("m", 3, 2.0), ("z", 0, 1.0), ("m", None, 1.0), ("m", 4, None)], "model string, target int, prediction double")
    got = {r.model: r for r in evaluate.metrics(df, ["model"]).collect()}
    assert (got["m"].mae, got["m"].wape, got["m"].bias, got["m"].coverage) == (1.0, 0.5, 0.0, 0.75) and got["z"].wape is None


@SLOW
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=12))
def test_bias_lies_within_wape(spark, pairs):
    r = evaluate.metrics(spark.createDataFrame([("m", float(a), float(b)) for a, b in pairs], "model string, target double, prediction double"), ["model"]).first()
    assert r.wape is None or (r.wape >= 0 and abs(r.bias) <= r.wape + 1e-12)


def test_top_k_ties(spark):
    rows = [("m", 1, e, t, p) for e, t, p in ((1, 5.0, 1.0), (2, 5.0, 9.0), (3, 5.0, 8.0), (4, 1.0, None))]
    r = evaluate.top_k_overlap(spark.createDataFrame(rows, "model string, p int, e int, target double, prediction double"), ["model"], "p", ["e"], 2).first()
    assert r.top_k_overlap == 0.5 and evaluate.top_k_overlap(spark.createDataFrame(rows, "model string, p int, e int, target double, prediction double"), ["model"], "p", ["e"], 20).first().top_k_overlap == 1.0


def test_selector(spark):
    rows = []
    for fold, n in ((1, 19), (2, 20), (3, 1)):
        for i in range(n):
            rows += [(fold, "a", "good", 10.0, 10.0), (fold, "a", "base", 10.0, 5.0)]
    rows += [(f, "b", m, 1.0, 9.0 if m == "good" else 1.0) for f in (1, 2, 3) for m in ("good", "base")]
    df = spark.createDataFrame(rows, "fold int, regime string, model string, target double, prediction double")
    got = {(r.fold, r.regime): (r.model, r.source) for r in evaluate.adaptive_selection(df, "base", 20, 1000).collect()}
    assert got == {(1, "a"): ("base", "default"), (1, "b"): ("base", "default"), (2, "a"): ("base", "default"), (2, "b"): ("base", "default"), (3, "a"): ("good", "regime"), (3, "b"): ("base", "default")}
    frozen = {r.regime: (r.model, r.source) for r in evaluate.frozen_mapping(df, "base", 20, 40).collect()}
    assert frozen == {"a": ("good", "regime"), "b": ("good", "global")}


def test_next_period_after_an_incomplete_tail(spark):
    rows = [(day(7 * i), day(7 * i + 6), True) for i in range(4)] + [(day(28), day(31), False)]
    p = context.period_table(spark.createDataFrame(rows, "report_start date, report_end date, period_is_complete boolean"))
    r = context.next_period(p).first()
    assert (r.forecast_start, r.forecast_end, r.cadence_days) == (day(35), day(41), 7)


def test_ranking_classes_and_rounding(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 2.5), (4, 2.5)], "article_code int, predicted_units double")
    got = {r.article_code: r for r in context.rank_forecast(df, [], "article_code").collect()}
    assert [got[i].predicted_units_rounded for i in (1, 2, 3)] == [0, 2, 2] and got[3].forecast_rank == 1 and got[4].forecast_rank == 2
    abc = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.125), (4, 0.125)], "article_code int, predicted_units double")
    assert [r.planning_class for r in context.rank_forecast(abc, [], "article_code", a=0.75, b=0.875).orderBy("article_code").collect()] == ["A", "A", "B", "C"]
    none = context.rank_forecast(spark.createDataFrame([(1, 0.0)], "article_code int, predicted_units double"), [], "article_code").first()
    assert none.forecast_share is None and none.planning_class == "C"


def test_context_scaffold_and_union(spark):
    ev = spark.createDataFrame([("x", day(3), day(1), 2.0, "n"), ("x", day(3), day(3), 4.0, "n"), ("y", day(2), day(20), None, "m"), ("z", day(30), day(31), 1.0, "o")], "event_id string, event_start date, event_end date, event_intensity double, event_name string")
    e = context.events_in_horizon(ev, F.lit(day(2)), F.lit(day(4)))
    days = spark.createDataFrame([(day(i),) for i in (1, 2, 3, 4)], "date date")
    got = {r.date: (r.tiene_evento, r.num_eventos, r.event_intensity_max) for r in context.future_context(days, e).collect()}
    assert got == {day(1): (False, 0, 0.0), day(2): (True, 1, 0.0), day(3): (True, 2, 4.0), day(4): (True, 1, 0.0)}
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert {tuple(r) for r in context.override_union(old, new, ["k"]).collect()} == {(1, "o"), (2, "n"), (3, "n")}
    p = spark.createDataFrame([(1, day(0), day(6), 5.0, True), (1, day(7), day(13), 6.0, True)], "article_code int, report_start date, report_end date, units double, period_is_complete boolean")
    s = context.future_scaffold(p, context.next_period(context.period_table(p)), [], "article_code", ["units"]).collect()
    assert [(r.report_start, r.report_end, r.units) for r in s] == [(day(14), day(20), None)]
    codes = {r.article_code: (r.in_article_master, r.in_menu, r.observed_in_any_history) for r in context.combine_catalogues(*[spark.createDataFrame([(c,)], "article_code int") for c in (1, 2, 1)]).collect()}
    assert codes == {"1": (True, False, True), "2": (False, True, False)}


def test_correlation_with_ties_and_constants(spark):
    rows = [(float(i), float(i // 2), 1.0, None) for i in range(40)]
    df = spark.createDataFrame(rows, "y double, x double, flat double, nothing double")
    got = eda.correlations(df, "y", ["x", "flat", "nothing"]).collect()
    assert [r.column for r in got] == ["x"] and got[0].possible_leakage and 0.99 < got[0].spearman < 1


def test_profiles(spark):
    df = spark.createDataFrame([(day(i), float(i), i % 2) for i in range(14)], "date date, t double, a int")
    w = {r.weekday: r for r in eda.weekday_profile(df, [], "date", "t", "a").collect()}
    assert len(w) == 7 and w[0].days == 2 and not w[0].low_activity
    assert eda.daily_summary(df, [], "date", "t", "a").first().missing_dates == 0
    assert {r.column: r.role for r in eda.column_profile(df).collect()} == {"date": "datetime", "t": "numeric", "a": "numeric"}
    s = eda.dataset_summary({"d": df.union(df)}, {"d": "date"}).first()
    assert (s.rows, s.duplicate_rows, s.columns, s.missing_cells) == (28, 14, 3, 0)
    f = eda.frequencies(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int"), ["k"]).collect()
    assert [(r.value, r.rows, r.fraction) for r in f] == [("a", 2, 1.0)]


def test_running_sum_over_many_parts(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), F.lit(1).alias("n"))
    got = {r.k: r.s for r in quality.running_sum(df, "k", "n", "s").collect()}
    assert got == {k: k + 1 for k in range(500)}
    assert quality.running_sum(df.limit(0), "k", "n", "s").collect() == []


def test_words_labels_and_weather(spark):
    assert eda.diagnostics() == [] and eda.diagnostics({"missing_dates": 3}, {"top_20_share": 0.9}) == ["the daily table lacks 3 calendar days", "20 articles hold 90% of the units"]
    assert [r.label for r in eda.label(spark.createDataFrame([("a", 1), (" ", 2)], "article_name string, article_code int")).collect()] == ["a", "2"]
    w = spark.createDataFrame([(day(0), 1.0, 5.0, True), (day(0), 2.0, 7.0, None), (day(9), 9.0, 9.0, None)], "date date, rain_mm double, temp double, storm boolean")
    assert [tuple(r) for r in context.forecast_weather(w, F.lit(day(0)), F.lit(day(1))).collect()] == [(day(0), 3.0, 6.0, True)]
    assert context.compact(w.withColumn("context_x", F.lit(1)), ["temp", "nope"]).columns == ["temp", "context_x"]


def test_no_event_is_no_intensity(spark):
    df = spark.createDataFrame([(False, None), (True, None), (None, None), (False, 2.0)], "tiene_evento boolean, event_intensity_mean double")
    assert [r.event_intensity_mean for r in features.known_context_zero(df).collect()] == [0.0, None, None, 2.0]


def test_quantiles_in_narrow_brackets(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(8)
    rows = [(rng.choice([None, 5.0, float("nan"), rng.gauss(0, 1)]), float(rng.randint(0, 3))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "x double, y double")
    want = {c: [float(np.quantile([v for v in col if v is not None and v == v], q)) for q in (0.0, 0.25, 0.5, 0.9, 1.0)] for c, col in zip("xy", zip(*rows))}
    for most, accuracy in ((200_000, 10_000), (40, 50), (1, 20)):
        monkeypatch.setattr(quality, "MOST_RANKED", most)
        got = quality.exact_quantiles(df, ["x", "y"], (0.0, 0.25, 0.5, 0.9, 1.0), accuracy)
        assert all(abs(a - b) < 1e-9 for c in "xy" for a, b in zip(got[c], want[c]))
    assert quality.exact_quantiles(df.where("x is null"), ["x"], [0.5]) == {"x": [None]} and quality.exact_quantiles(df, [], [0.5]) == {}


def test_running_sums_and_medians_by_group(spark):
    import statistics

    rows = [("ab"[i % 2] if i % 7 else None, (i * 37) % 101, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    sums = quality.running_sums(df.groupBy("g", "v").agg(F.sum("k").alias("k")), ["v"], {"upto": F.col("k"), "place": F.lit(1)}, ["g"]).collect()
    for g in ("a", "b", None):
        total = place = 0
        for v in sorted({x[1] for x in rows if x[0] == g}):
            total, place = total + sum(x[2] for x in rows if x[0] == g and x[1] == v), place + 1
            assert [(r.upto, r.place) for r in sums if r.g == g and r.v == v] == [(total, place)]
    got = {r.g: r["median"] for r in quality.group_medians(df.where("g is not null"), ["g"], "v").collect()}
    assert got == {g: statistics.median(x[1] for x in rows if x[0] == g) for g in "ab"}


def test_ranking_without_a_group_needs_no_single_task(spark):
    rows = [(f"a{i:03}", float((i * 31) % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "article_code string, predicted_units double")
    a = {r.article_code: r for r in context.rank_forecast(df, [], "article_code").collect()}
    b = {r.article_code: r for r in context.rank_forecast(df.withColumn("g", F.lit(1)), ["g"], "article_code").collect()}
    assert all(a[c].forecast_rank == b[c].forecast_rank and abs(a[c].forecast_cumulative_share - b[c].forecast_cumulative_share) < 1e-9 and a[c].planning_class == b[c].planning_class for c in b)


def test_invitations_in_words_and_fence_distances(spark):
    df = spark.createDataFrame([(1.0, 5.0, "Sí"), (1.0, 0.0, None), (None, 5.0, "no"), (1.0, 5.0, "Invitación casa")], "units double, amount double, invitacion string").withColumns({c: F.lit(day(0)) for c in ("report_start", "report_end")})
    assert [r.es_invitacion for r in rules.sales_flags(df).collect()] == [True, True, False, True]
    x = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)] + [(None,)], "x double")
    got = {r.x: (r.x__fence_distance, r.x__fence_distance_iqr) for r in quality.outlier_columns(x, ["x"]).collect()}
    assert got[100.0] == (93.0, 46.5) and got[3.0] == (0.0, 0.0) and got[None] == (0.0, 0.0)
    same = spark.createDataFrame([(1.0,)] * 9 + [(9.0,)], "x double")
    assert all(r.x__fence_distance == 0.0 for r in quality.outlier_columns(same, ["x"]).collect())
    broken = spark.createDataFrame([(1.0, 0.2, 1.2, 1.2, 0.0, "bad"), (1.0, 0.2, 1.2, 1.2, 0.0, None)], "base double, vat double, total double, cash_amount double, card_amount double, pdf_parse_error string")
    assert [r.pdf_parse__invalid for r in rules.invoice_flags(broken).collect()] == [True, False]


def test_forest_grows_spark_trees_in_as_many_jobs_at_any_depth(spark):
    import random

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from almazara.operators import forest
    from almazara.operators.models import fit, predict

    rng = random.Random(5)
    rows = [(i, float(rng.randrange(60) ** 2 // 50), float(rng.randrange(3)), rng.choice("uv"), rng.random() + i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, y double").repartition(3, "id").cache()
    jobs, _ = {}, df.count()
    for depth in (2, 30):
        spark.sparkContext.setJobGroup(f"forest {depth}", "")
        predict(fit(df, "random_forest", ["c"], ["a", "b"], "y", trees=5, depth=depth), df, "random_forest", ["c"], ["a", "b"]).collect()
        jobs[depth] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest {depth}"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[2] == jobs[30]  # a forest that passes the rows once a level needs more for depth

    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).withColumn("label", F.col("y")).cache()
    tree = dict(numTrees=1, bootstrap=False, featureSubsetStrategy="all", minInstancesPerNode=2, seed=1)
    for depth in (1, 4, 30):
        mine, spark_tree = ({r.id: r.prediction for r in m(maxDepth=depth, **tree).fit(vectors).transform(vectors).collect()} for m in (forest.Forest, RandomForestRegressor))
        assert mine == pytest.approx(spark_tree, abs=1e-9)
    many = dict(numTrees=40, featureSubsetStrategy="sqrt", minInstancesPerNode=2, maxDepth=30, seed=1)
    model = forest.Forest(**many).fit(vectors)
    mine, again, other = ({r.id: r.prediction for r in m.transform(vectors).collect()} for m in (model, model, RandomForestRegressor(**many).fit(vectors)))
    assert mine == pytest.approx(again, abs=1e-12) and len(mine) == 3000
    assert sum(abs(mine[i] - other[i]) for i in mine) / 3000 < 0.1  # other draws, the same forest; labels deviate by 2
    assert model.transform(vectors.where("false")).count() == 0
