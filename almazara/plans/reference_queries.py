"""Queries of the cleaning, integration, feature, evaluation and profiling operators over whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almazara.functions import casts
from almazara.functions.text import slug, strip_accents
from almazara.operators import context, daily, eda, evaluate, features, panel, quality, rules, timestamps
from almazara.plans import data_problems
from almazara.plans.tables import table
from almazara.session import broadcast_if_small, shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL counterpart if there is one."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


_R = lambda c, n=4: F.round(c, n).alias(c)

# ------------------------------------------------------------------------------------------------ cleaning


_RESERVATION_COLUMNS = ("restaurant", "source_file", "reservation_datetime", "created_datetime", "reservation_date", "status", "shift", "people", "origin", "reference_code")


@query(f"select {', '.join(_RESERVATION_COLUMNS)}, count(*) as copies from reservas group by all")
def clean_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows equal in all columns but the row id, which is unique by definition."""
    return quality.exact_duplicates(table(spark, d, "reservas"), _RESERVATION_COLUMNS)


@query("""select venta_id, row_number() over (partition by restaurant, source_file, report_start, report_end, report_generated_on, terminal_start, terminal_end, turn, department_code, department_name, article_code, article_name, units, amount order by venta_id) > 1 as quality_exact_duplicate from ventas""")
def clean_flag_duplicates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "ventas")
    others = [c for c in v.columns if c != "venta_id"]
    key = F.xxhash64(*others)
    return quality.flag_exact_duplicates(v.select("venta_id", F.sha2(F.to_json(F.struct(*others)), 256).alias("content"), key.alias("h")), "venta_id").select("venta_id", "quality_exact_duplicate")


@query("""select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey, l_linenumber) > 1 as quality_key_duplicate from lineitem""")
def clean_key_duplicates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return quality.flag_key_duplicates(li, ["l_orderkey", "l_linenumber"])


@query("""select reserva_id, case when lower(trim(created_datetime)) not in ('', 'nan', 'none', 'null', 'n/a', 'na', '<na>') then trim(created_datetime) end as created_clean,
  nullif(trim(status), '') as status_clean from reservas""")
def clean_null_tokens(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reservas")
    return r.select("reserva_id", casts.null_tokens(F.col("created_datetime")).alias("created_clean"), casts.clean_text(F.col("status")).alias("status_clean"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_extendedprice as price from lineitem""")
def clean_numeric_eu(spark: SparkSession, d: str) -> DataFrame:
    """Prices written the European way and read back."""
    li = table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    text = F.concat(F.translate(F.format_number(F.floor(cents / 100), 0), ",", "."), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", casts.number_eu(text).alias("price"))


_DAY_SQL = """coalesce(
  case when regexp_matches(trim(date), '^\\d{4}-\\d{1,2}-\\d{1,2}$') then cast(try_strptime(trim(date), '%Y-%m-%d') as date) end,
  case when regexp_matches(trim(date), '^[1-9]\\d{4}(\\.0*)?$') then date '1899-12-30' + cast(regexp_extract(trim(date), '^\\d+') as int) end,
  case when regexp_matches(trim(date), '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?$') then cast(try_strptime(trim(date)[1:10], '%Y-%m-%d') as date) end,
  case when regexp_matches(trim(date), '^\\d{4}/\\d{1,2}/\\d{1,2}$') then cast(try_strptime(trim(date), '%Y/%m/%d') as date) end,
  case when regexp_matches(trim(date), '^\\d{1,2}/\\d{1,2}/\\d{4}$') then cast(try_strptime(trim(date), '%d/%m/%Y') as date) end,
  case when regexp_matches(trim(date), '^\\d{1,2}-\\d{1,2}-\\d{4}$') then cast(try_strptime(trim(date), '%d-%m-%Y') as date) end)"""


@query(f"select evento_row_id, {_DAY_SQL} as day from eventos")
def clean_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eventos").select("evento_row_id", casts.day(F.col("date")).alias("day"))


@query("""select diaria_id, case when w in ('true','1','yes','si','sí') then true when w in ('false','0','no') then false end as flag
  from (select diaria_id, lower(case when tiene_evento is null then 'quizá' when tiene_evento then ' Sí ' else 'NO' end).trim() as w from maestra_diaria)""")
def clean_bool_tokens(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("tiene_evento").isNull(), "quizá").when(F.col("tiene_evento"), " Sí ").otherwise("NO")
    return table(spark, d, "maestra_diaria").select("diaria_id", casts.boolean(word).alias("flag"))


@query("""select article_code, nullif(regexp_replace(regexp_replace(strip_accents(lower(article_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') as slug, count(*) as n from articulos group by all""")
def clean_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articulos").groupBy("article_code", slug(F.col("article_name")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query("select venta_id, article_code from ventas where report_start is not null and report_end is not null and article_code is not null")
def clean_required_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.require_keys(table(spark, d, "ventas"), ["report_start", "report_end", "article_code"]).select("venta_id", "article_code")


@query("""with f as (select count(*) n, count(units) u, count(amount) a, count(article_name) s, median(units) mu, median(amount) ma from ventas)
select venta_id, case when u < n and (n - u) / n::double <= 0.05 then coalesce(units, mu) else units end as units, case when a < n and (n - a) / n::double <= 0.05 then coalesce(amount, ma) else amount end as amount,
  case when s < n and (n - s) / n::double <= 0.05 then coalesce(article_name, 'UNKNOWN') else article_name end as article_name from ventas, f""")
def clean_impute(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "ventas").select("venta_id", "units", "amount", "article_name")
    return quality.impute_low_missingness(v, ["units", "amount"], ["article_name"]).select("venta_id", "units", "amount", "article_name")


@query("""with c as (select department_name as m from ventas where department_name is not null group by 1 order by count(*) desc, 1 limit 1), f as (select count(*) n, count(department_name) s from ventas)
select venta_id, case when s < n and (n - s) / n::double <= 0.5 then coalesce(department_name, m) else department_name end as department_name from ventas, f, c""")
def clean_impute_mode(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "ventas").select("venta_id", "department_name")
    return quality.impute_low_missingness(v, [], ["department_name"], most=0.5, mode=True).select("venta_id", "department_name")


def _outlier_sql(t: str, i: str, cols: list[str]) -> str:
    q = ", ".join(f"quantile_cont({c}, 0.25) a{c}, median({c}) m{c}, quantile_cont({c}, 0.75) b{c}" for c in cols)
    mad = ", ".join(f"median(abs({c} - m{c})) d{c}" for c in cols)
    out = []
    for c in cols:
        fence = f"coalesce(b{c} <> a{c} and ({c} < a{c} - 1.5 * (b{c} - a{c}) or {c} > b{c} + 1.5 * (b{c} - a{c})), false)"
        far = f"coalesce(d{c} <> 0 and abs(0.6745 * ({c} - m{c}) / d{c}) > 3.5, false)"
        beyond = f"case when b{c} <> a{c} then greatest(a{c} - 1.5 * (b{c} - a{c}) - {c}, {c} - (b{c} + 1.5 * (b{c} - a{c})), 0) else 0 end"
        out.append(f"round(case when {c} is null then 0 else {beyond} end, 6) as {c}__fence_distance, round(case when d{c} <> 0 then 0.6745 * ({c} - m{c}) / d{c} end, 6) as {c}__robust_z, {fence} or {far} as {c}__outlier, case {fence}::int + {far}::int when 0 then 'none' when 1 then 'candidate' else 'strong' end as {c}__severity")
    return f"with q as (select {q} from {t}), m as (select {mad} from {t}, q) select {i}, {', '.join(out)} from {t}, q, m"


@query(_outlier_sql("ventas", "venta_id", ["units", "amount"]))
def clean_outliers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "ventas").select("venta_id", "units", "amount")
    cols = quality.eligible_for_outliers(v, ["units", "amount"])
    return quality.outlier_columns(v, cols).select("venta_id", *[_R(f"{c}__{x}", 6) for c in cols for x in ("robust_z", "fence_distance")], *[f"{c}__{x}" for c in cols for x in ("outlier", "severity")])


@query(f"""select 'units__outlier' as flag, count(*) filter (units__outlier) as flagged, count(*) filter (units__outlier) / count(*)::double as fraction from ({_outlier_sql("ventas", "venta_id", ["units", "amount"])})
union all select 'amount__outlier', count(*) filter (amount__outlier), count(*) filter (amount__outlier) / count(*)::double from ({_outlier_sql("ventas", "venta_id", ["units", "amount"])})""")
def clean_flag_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_summary(clean_outliers(spark, d))


_VENTAS_COLUMNS = "venta_id restaurant source_file report_start report_end report_generated_on terminal_start terminal_end turn department_code department_name article_code article_name units amount".split()


@query("with n as (select count(*) n from ventas) " + " union all ".join(f"select '{c}' as \"column\", (select n from n) - (select count({c}) from ventas) as missing, ((select n from n) - (select count({c}) from ventas)) / (select n from n)::double as fraction" for c in _VENTAS_COLUMNS))
def clean_missingness(spark: SparkSession, d: str) -> DataFrame:
    return quality.missingness(table(spark, d, "ventas"))


@query("""select source_file, article_code, price, coalesce(c.pc, false) as price__conflict, coalesce(c.nc, false) as article_name__conflict from articulos a left join
 (select article_code, min(price) <> max(price) as pc, min(article_name) <> max(article_name) as nc from articulos where article_code is not null group by 1) c using (article_code)""")
def rules_master_conflict(spark: SparkSession, d: str) -> DataFrame:
    return quality.master_conflicts(table(spark, d, "articulos"), "article_code", ["price", "article_name"]).select("source_file", "article_code", "price", "price__conflict", "article_name__conflict")


@query("""select venta_id, coalesce(units < 0, false) as units__negative, coalesce(amount < 0, false) as amount__negative, coalesce(units, 0) > 0 and abs(coalesce(amount, 0)) <= 1e-12 as es_invitacion,
  report_end - report_start + 1 as report_days, coalesce(report_end < report_start, false) as period__invalid from ventas""")
def rules_sales(spark: SparkSession, d: str) -> DataFrame:
    return rules.sales_flags(table(spark, d, "ventas")).select("venta_id", "units__negative", "amount__negative", "es_invitacion", "report_days", "period__invalid")


@query("""select o_orderkey, cast(o_orderdate as date) as date, dayname(o_orderdate) as day_of_week, week(o_orderdate) as week_of_year, o_totalprice < 0 as document_total__negative from orders""")
def rules_tickets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("document_total"), F.lit(1).alias("receipt_count"))
    return rules.ticket_flags(o).select("o_orderkey", "date", "day_of_week", F.col("week_of_year").cast("long").alias("week_of_year"), "document_total__negative")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(l_extendedprice + l_tax - round(l_extendedprice + l_tax + case when l_linenumber % 2 = 0 then 0.02 else 0.03 end, 2)), 9) > 0.02 as tip_total__invalid,
  round(l_tax / abs(l_extendedprice), 9) as tip_ratio from lineitem""")
def rules_tips(spark: SparkSession, d: str) -> DataFrame:
    add = F.when(F.col("l_linenumber") % 2 == 0, 0.02).otherwise(0.03)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("document_amount"), F.col("l_tax").alias("tip"), F.round(F.col("l_extendedprice") + F.col("l_tax") + add, 2).alias("document_total"))
    return rules.tip_flags(li).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tip_total__invalid", _R("tip_ratio", 9))


@query("""select o_orderkey, change_amount, cash_amount, case when paid = 'n' then 'unknown' when cash_amount > 0 and coalesce(card, 0) > 0 then 'mixed' when cash_amount > 0 then 'cash' when coalesce(card, 0) > 0 then 'card' else 'none_or_zero' end as payment_method from
 (select *, case when cash is not null then greatest(cash - change_amount, 0) end as cash_amount from (select *, case when round(coalesce(cash, 0) + coalesce(card, 0) - o_totalprice, 9) > 0.02 then round(coalesce(cash, 0) + coalesce(card, 0) - o_totalprice, 9) else 0 end as change_amount from
 (select o_orderkey, o_totalprice, case o_orderkey % 4 when 0 then 'n' else 'p' end as paid, case o_orderkey % 4 when 1 then o_totalprice + 4.5 when 2 then 10.0 end as cash, case o_orderkey % 4 when 3 then o_totalprice when 2 then o_totalprice - 10.0 end as card from orders)))""")
def rules_payment(spark: SparkSession, d: str) -> DataFrame:
    o, t = table(spark, d, "orders"), F.col("o_totalprice")
    m = F.col("o_orderkey") % 4
    rows = o.select("o_orderkey", t.alias("total"), F.when(m == 1, t + 4.5).when(m == 2, 10.0).alias("cash_tendered"), F.when(m == 3, t).when(m == 2, t - 10.0).alias("card_printed"))
    return rules.resolve_payment(rows).select("o_orderkey", "change_amount", "cash_amount", "payment_method")


@query("""select md_id, coalesce(temperature_max < -60 or temperature_max > 60, false) as temperature_max__physically_suspicious, coalesce(rain_mm < 0, false) as rain_mm__physically_suspicious,
 coalesce(precipitation_hours < 0 or precipitation_hours > 24, false) as precipitation_hours__physically_suspicious, coalesce(sunshine_duration_s < 0 or sunshine_duration_s > 86400, false) as sunshine_duration_s__physically_suspicious from meteo_diaria""")
def rules_weather(spark: SparkSession, d: str) -> DataFrame:
    return rules.weather_flags(table(spark, d, "meteo_diaria")).select("md_id", *[f"{c}__physically_suspicious" for c in ("temperature_max", "rain_mm", "precipitation_hours", "sunshine_duration_s")])


@query("""select evento_row_id, coalesce(event_end < event_start, false) as event_period__invalid, coalesce(event_duration_days <= 0, false) as event_duration__invalid, coalesce(event_day_number <= 0 or event_day_number > event_duration_days, false) as event_day_number__invalid from eventos""")
def rules_events(spark: SparkSession, d: str) -> DataFrame:
    return rules.event_flags(table(spark, d, "eventos")).select("evento_row_id", "event_period__invalid", "event_duration__invalid", "event_day_number__invalid")


_WALK_IN_SQL = "coalesce(regexp_matches(trim(regexp_replace(strip_accents(lower(origin)), '\\s+', ' ', 'g')), 'walk|sin reserva|paso|puerta'), false)"
_BOOKED_SQL = data_problems.P4_STEPS_SQL + f""", booked as (select row_id, timezone(zone, to_timestamp(uu)) as created from final where table_name = 'reservas' and u is not null),
 raw as (select r.*, {_WALK_IN_SQL} as is_walk_in, date_diff('second', b.created, cast(r.reservation_datetime as timestamp)) / 3600.0 as raw_lead from reservas r left join booked b on b.row_id = r.reserva_id),
 led as (select *, not is_walk_in and coalesce(raw_lead < 0, false) as lead_time__invalid, case when is_walk_in then 0 when raw_lead >= 0 then raw_lead end as lead_time_hours from raw)"""


def _booked(spark: SparkSession, d: str) -> DataFrame:
    """Reservations with their flags; the booking time is the normalised one on the clock of the place."""
    zones = table(spark, d, "locales").where("restaurant is not null").groupBy("restaurant").agg(F.max("timezone").alias("zone"))
    r = table(spark, d, "reservas").join(broadcast_if_small(zones), "restaurant", "left").withColumn("typed_file", F.concat_ws("/", F.lit("reservas"), "source_file"))
    keep = ("restaurant", "people", "origin", "status", "reservation_datetime", "place")
    out = timestamps.normalise(r.withColumn("place", F.col("zone")), timestamps.Typed("created_datetime", "reserva_id", "typed_file", "zone", keep=keep), F.unix_date("reservation_date"))
    created = F.timestamp_seconds(timestamps.utc_to_local(F.col("utc_seconds"), F.col("place")))
    return rules.reservation_flags(out.withColumn("created", created).withColumnRenamed("row_id", "reserva_id"), "created", "reservation_datetime")


@query(_BOOKED_SQL + """ select reserva_id, coalesce(people <= 0, false) as people__invalid, coalesce(people >= 8, false) as is_large_group, is_walk_in, round(lead_time_hours, 6) as lead_time_hours, lead_time__invalid from led""")
def rules_reservations(spark: SparkSession, d: str) -> DataFrame:
    return _booked(spark, d).select("reserva_id", "people__invalid", "is_large_group", "is_walk_in", _R("lead_time_hours", 6), "lead_time__invalid")


@query(f"select evento_row_id, {_DAY_SQL} as date, event_start, event_intensity, cast(event_id as varchar) as event_id from eventos")
def clean_types(spark: SparkSession, d: str) -> DataFrame:
    """Columns typed by name, from text."""
    e = table(spark, d, "eventos").select("evento_row_id", "date", F.col("event_start").cast("string").alias("event_start"), F.col("event_intensity").cast("string").alias("event_intensity"), "event_id")
    return casts.assert_types(e)


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice as european, -l_extendedprice as english from lineitem")
def src_decimal_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Amounts printed in two conventions and read back by their last separator."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rest, whole = F.lpad((cents % 100).cast("string"), 2, "0"), F.format_number(F.floor(cents / 100), 0)
    read = {"european": F.concat(F.translate(whole, ",", "."), F.lit(","), rest, F.lit(" €")), "english": F.concat(F.lit("-"), whole, F.lit("."), rest)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[casts.decimal_token(c).alias(n) for n, c in read.items()])


@query("select count(*) as rows from ventas")
def clean_unique_key(spark: SparkSession, d: str) -> DataFrame:
    """The row id of the sales, guarded against repeats."""
    return quality.assert_unique(table(spark, d, "ventas").select("venta_id"), ["venta_id"], "ventas").agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------------------------------------------ daily


@query("""select cast(o_orderdate as date) as date, count(*) as num_tickets, count(distinct o_orderkey) as num_tickets_unicos, round(sum(o_totalprice), 2) as facturacion_tickets, round(avg(o_totalprice), 8) as ticket_medio, round(median(o_totalprice), 4) as ticket_mediano,
 max(o_totalprice) as ticket_maximo, min(o_totalprice) as ticket_minimo from orders group by 1""")
def daily_tickets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("document_id"), F.col("o_totalprice").alias("document_total"), F.lit(1).alias("receipt_count"))
    return daily.tickets_daily(o).select("date", "num_tickets", "num_tickets_unicos", _R("facturacion_tickets", 2), _R("ticket_medio", 8), _R("ticket_mediano"), "ticket_maximo", "ticket_minimo")


@query("""select year(o_orderdate) as y, cast(o_orderdate as date) as date, count(*) as num_facturas_pdf, round(sum(o_totalprice), 2) as facturacion_facturas_pdf, round(sum(case when o_orderkey % 3 > 0 then o_totalprice - 1 end), 2) as efectivo_facturas_pdf,
 count(*) filter (o_orderkey % 3 > 0 and o_orderkey % 5 = 0) as pagos_pdf_no_reconciliados from orders group by 1, 2""")
def daily_invoices(spark: SparkSession, d: str) -> DataFrame:
    """Orders as invoices: of every third no cash is known, and every fifth is paid one too much."""
    t, k = F.col("o_totalprice"), F.col("o_orderkey")
    inv = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderdate").cast("date").alias("date"), k.alias("ticket_id"), t.alias("total"), (t * 0.8).alias("base"), (t * 0.2).alias("vat"),
                                            F.when(k % 3 > 0, t - 1).alias("cash_amount"), F.when(k % 5 == 0, 2.0).otherwise(1.0).alias("card_amount"))
    return daily.invoices_daily(rules.invoice_flags(inv), ["y"]).select("y", "date", "num_facturas_pdf", _R("facturacion_facturas_pdf", 2), _R("efectivo_facturas_pdf", 2), "pagos_pdf_no_reconciliados")


@query("""select cast(l_shipdate as date) as date, round(coalesce(sum(tip), 0), 4) as propina_total, round(avg(tip), 8) as propina_media, count(*) filter (tip > 0) as tickets_con_propina from (select l_shipdate, case when l_linenumber <> 3 then l_tax end as tip from lineitem) group by 1""")
def daily_tips(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("tip"))
    return daily.tips_daily(li).select("date", _R("propina_total"), _R("propina_media", 8), "tickets_con_propina")


_STATUS_SQL = "case when status is null then null else nullif(trim(regexp_replace(regexp_replace(strip_accents(lower(status)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), '') end"
_STATUSES = ["completada", "cancelada", "no_show", "confirmada"]


@query(f"""select restaurant, reservation_date, count(*) as reservas_total, sum(people) as comensales_reservados_total, round(avg(people), 4) as tamano_grupo_medio, median(people) as tamano_grupo_mediano, max(people) as tamano_grupo_maximo,
 {', '.join(f"count(*) filter (s = '{s}') as reservas_{s}, case when count(*) filter (s = '{s}') = 0 then 0 else sum(people) filter (s = '{s}') end as comensales_{s}" for s in _STATUSES)},
 round(count(*) filter (s = 'no_show') / count(*)::double, 6) as no_show_rate from (select *, {_STATUS_SQL} as s from reservas) where reservation_date is not null group by 1, 2""")
def daily_reservations(spark: SparkSession, d: str) -> DataFrame:
    out = daily.reservations_daily(table(spark, d, "reservas"), ["restaurant"], "reservation_date", slug(F.col("status")), _STATUSES)
    return out.withColumns({"tamano_grupo_medio": F.round("tamano_grupo_medio", 4), "no_show_rate": F.round("no_show_rate", 6)})


@query("""select restaurant, reservation_date, count(*) filter (lower(trim(shift)) = 'comida') as reservas_turno_comida, count(*) filter (lower(trim(shift)) = 'cena') as reservas_turno_cena from reservas where reservation_date is not null group by 1, 2""")
def daily_reservations_pivot(spark: SparkSession, d: str) -> DataFrame:
    return daily.shifts_pivot(table(spark, d, "reservas"), ["restaurant"], "reservation_date", F.lower(F.trim("shift")), ["comida", "cena"])


def local_hours(hours: DataFrame, places: DataFrame) -> DataFrame:
    """Hourly weather with ``date``, the local day; the zone is the row's, else the file's most frequent, else the place's."""
    files = hours.groupBy("source_file").agg(F.mode("timezone", True).alias("file_zone"))
    zones = places.where("event_location is not null").groupBy("event_location").agg(F.max("timezone").alias("place_zone"))
    rows = hours.join(broadcast_if_small(files), "source_file", "left").join(broadcast_if_small(zones), "event_location", "left").withColumn("zone", F.coalesce("timezone", "file_zone", "place_zone"))
    typed = timestamps.Typed("time", "mh_id", "source_file", "zone", keep=("event_location", "rain_mm", "temperature_2m"))
    return timestamps.normalise(rows, typed).where("time_status = 'normal'").withColumnRenamed("local_day", "date")


@query(data_problems.P4_STEPS_SQL + """, h as (
  select m.event_location, cast(case when f.stated then timezone(f.zone, to_timestamp(f.uu)) else to_timestamp(f.wall) at time zone 'UTC' end as date) as date,
    case when isnan(m.rain_mm) then null else m.rain_mm end as rain_mm, case when isnan(m.temperature_2m) then null else m.temperature_2m end as temperature_2m
  from final f join meteo_horaria m on f.table_name = 'meteo_horaria' and f.row_id = m.mh_id where f.u is not null)
select event_location, date, round(coalesce(sum(rain_mm), 0), 4) as rain_mm, round(avg(temperature_2m), 4) as temperature_2m from h where date is not null group by 1, 2""")
def daily_weather_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Every readable hour, whatever its format, on the local day of its place."""
    h = local_hours(table(spark, d, "meteo_horaria"), table(spark, d, "locales"))
    return daily.weather_daily(h, ["event_location"], "date", ["rain_mm", "temperature_2m"], hourly=True).select("event_location", "date", _R("rain_mm"), _R("temperature_2m"))


@query("""with m as (select event_location, date, case when isnan(temperature_max) then null else temperature_max end as temperature_max, case when isnan(temperature_min) then null else temperature_min end as temperature_min, case when isnan(precipitation_mm) then null else precipitation_mm end as precipitation_mm, case when isnan(rain_mm) then null else rain_mm end as rain_mm from meteo_diaria where date is not null)
select event_location, date, max(temperature_max) as temperature_max, min(temperature_min) as temperature_min, round(coalesce(sum(precipitation_mm), 0), 4) as precipitation_mm, round(avg(rain_mm), 4) as rain_mm from m group by 1, 2""")
def daily_weather(spark: SparkSession, d: str) -> DataFrame:
    return daily.weather_daily(table(spark, d, "meteo_diaria"), ["event_location"], "date", ["temperature_max", "temperature_min", "precipitation_mm", "rain_mm"]).select("event_location", "date", "temperature_max", "temperature_min", _R("precipitation_mm"), _R("rain_mm"))


@query("""select event_location, event_start as date, true as es_festivo, count(*) as num_festivos, nullif(string_agg(distinct nullif(trim(event_name), ''), ' | ' order by nullif(trim(event_name), '')), '') as festivo_nombre from eventos where event_start is not null group by 1, 2""")
def daily_holidays(spark: SparkSession, d: str) -> DataFrame:
    return daily.holidays_daily(table(spark, d, "eventos"), ["event_location"], "event_start", "event_name").withColumnRenamed("event_start", "date")


@query("""with u as (select event_location, event_id, min(event_name) as event_name, min(event_category) as event_category, max(event_intensity) as event_intensity, min(event_start) as s, max(event_end) as e from eventos where event_id is not null group by 1, 2),
x as (select *, unnest(generate_series(s, e, interval 1 day))::date as date from u where s <= e)
select event_location, date, count(*) as num_eventos, nullif(string_agg(distinct nullif(trim(event_name), ''), ' | ' order by nullif(trim(event_name), '')), '') as eventos_nombres, round(avg(event_intensity), 4) as event_intensity_mean, max(event_intensity) as event_intensity_max from x group by 1, 2""")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "eventos").where("event_id is not null").groupBy("event_location", "event_id").agg(F.min("event_name").alias("event_name"), F.min("event_category").alias("event_category"), F.max("event_intensity").alias("event_intensity"), F.min("event_start").alias("s"), F.max("event_end").alias("e"))
    return daily.events_daily(daily.expand_days(u, "s", "e"), ["event_location"], "date").select("event_location", "date", "num_eventos", "eventos_nombres", _R("event_intensity_mean"), "event_intensity_max")


@query("""select o_orderkey, d::date as date, (d::date - s) + 1 as event_day_number, (e - s) + 1 as event_duration_days from (select o_orderkey, s, e, unnest(generate_series(s, e, interval 1 day)) as d from
 (select o_orderkey, cast(o_orderdate as date) as s, cast(o_orderdate as date) + (o_orderkey % 5)::int as e from orders))""")
def events_expand(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 5).cast("int")).alias("e"))
    return daily.expand_days(o, "s", "e").select("o_orderkey", "date", "event_day_number", "event_duration_days")


@query("""select restaurant, unnest(generate_series(min(date), max(date), interval 1 day))::date as date from maestra_diaria where date is not null group by 1""")
def daily_calendar(spark: SparkSession, d: str) -> DataFrame:
    return daily.calendar(table(spark, d, "maestra_diaria"), ["restaurant"], "date")


_LATEST_DAY_SQL = "select * from maestra_diaria where restaurant is not null and date is not null qualify row_number() over (partition by restaurant, date order by loaded_at desc nulls last, diaria_id desc) = 1"
_RES_DAY_SQL = "select restaurant, reservation_date as date, count(*) as reservas_dia from reservas where reservation_date is not null group by 1, 2"


def _latest_days(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "maestra_diaria").where("restaurant is not null and date is not null")
    return panel.latest_rows(casts.nan_to_null(rows), ["restaurant", "date"], ["loaded_at", "diaria_id"])


@query(f"""with l as ({_LATEST_DAY_SQL}), s as (select restaurant, unnest(generate_series(min(date), max(date), interval 1 day))::date as date from l group by 1), r as ({_RES_DAY_SQL})
select s.restaurant, s.date, coalesce(l.num_tickets, 0) as num_tickets, case when isnan(l.facturacion) then null else l.facturacion end as facturacion, coalesce(r.reservas_dia, 0) as reservas_dia, coalesce(l.tiene_evento, false) as tiene_evento, year(s.date) as year, week(s.date) as week_of_year, isodow(s.date) >= 6 as is_weekend,
 round(sin(week(s.date) * 2 * 3.141592653589793 / 52.0), 9) as week_sin from s left join l using (restaurant, date) left join r using (restaurant, date)""")
def daily_master(spark: SparkSession, d: str) -> DataFrame:
    latest = _latest_days(spark, d)
    spine = daily.calendar(latest, ["restaurant"], "date")
    res = table(spark, d, "reservas").where("reservation_date is not null").groupBy("restaurant", F.col("reservation_date").alias("date")).agg(F.count(F.lit(1)).alias("num_res"))
    out = daily.daily_master(spine, {"diaria": (latest.select("restaurant", "date", "num_tickets", "facturacion", "tiene_evento"), ["restaurant", "date"]), "reservas": (res, ["restaurant", "date"])})
    return out.select("restaurant", "date", "num_tickets", "facturacion", F.col("num_res").alias("reservas_dia"), "tiene_evento", F.col("year").cast("long").alias("year"), F.col("week_of_year").cast("long").alias("week_of_year"), "is_weekend", _R("week_sin", 9))


@query("""select diaria_id, coalesce(a, b) as facturacion, case when a is not null then 'tickets' when b is not null then 'facturas_pdf' end as facturacion_source from
 (select diaria_id, case when not isnan(facturacion) and facturacion_source = 'tickets' then facturacion end as a, case when not isnan(facturacion) then facturacion end as b from maestra_diaria)""")
def daily_canonical_revenue(spark: SparkSession, d: str) -> DataFrame:
    m = casts.nan_to_null(table(spark, d, "maestra_diaria").select("diaria_id", "facturacion", "facturacion_source"))
    rows = m.select("diaria_id", F.when(F.col("facturacion_source") == "tickets", F.col("facturacion")).alias("facturacion_tickets"), F.col("facturacion").alias("facturacion_facturas_pdf"))
    return daily.canonical_revenue(rows).select("diaria_id", "facturacion", "facturacion_source")


def _missing_sql(columns: tuple[str, ...]) -> str:
    return " + ".join(f"(count(*) - count({c}))" for c in columns)


@query(f"""select 'reservas' as source, count(*) as rows, 11 as columns, min(reservation_date) as first_day, max(reservation_date) as last_day, {_missing_sql(("reserva_id", *_RESERVATION_COLUMNS))} as missing_cells from reservas
union all select 'ventas', count(*), 15, least(min(report_start), min(report_end)), greatest(max(report_start), max(report_end)), {_missing_sql(tuple(_VENTAS_COLUMNS))} from ventas""")
def daily_source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return daily.source_coverage({"reservas": (table(spark, d, "reservas"), ["reservation_date"]), "ventas": (table(spark, d, "ventas"), ["report_start", "report_end"])})


# ------------------------------------------------------------------------------------------------ panel

_VALID = "report_start is not null and report_end >= report_start and restaurant is not null and article_code is not null"
_PANEL_SQL = f"""panel as (select report_start, report_end, restaurant, article_code, coalesce(sum(units), 0) as units, coalesce(sum(amount), 0) as amount, count(*) as source_rows,
 case when min(department_code) = max(department_code) then max(department_code) end as department_code, coalesce(min(department_code) <> max(department_code), false) as department_code__period_conflict from ventas where {_VALID} group by 1, 2, 3, 4)"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.dedupe_panel(table(spark, d, "ventas").where(_VALID), ["restaurant", "article_code"], ["department_code"])


@query(f"with {_PANEL_SQL} select report_start, report_end, restaurant, article_code, round(units, 2) as units, round(amount, 2) as amount, source_rows, department_code, department_code__period_conflict from panel")
def panel_article_period(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).withColumns({"units": F.round("units", 2), "amount": F.round("amount", 2)})


_DAYS = "report_end - report_start + 1"


@query(" union all ".join(
    f"(select '{w}_{t}' as variant, {_DAYS} as expected_days, count(*) as weight from (select {'distinct' if w == 'periods' else ''} report_start, report_end from ventas where report_end >= report_start) group by {_DAYS} order by 3 desc, 2 {'desc' if t == 'longest' else 'asc'} limit 1)"
    for w in ("rows", "periods") for t in ("longest", "shortest")))
def panel_expected_days(spark: SparkSession, d: str) -> DataFrame:
    v, out = table(spark, d, "ventas"), None
    for w in ("rows", "periods"):
        for t in ("longest", "shortest"):
            x = panel.expected_period_days(v, w, t).select(F.lit(f"{w}_{t}").alias("variant"), F.col("expected_days"), "weight")
            out = x if out is None else out.unionByName(x)
    return out


_EXPECTED_SQL = f"expected as (select restaurant, arg_max(days, (n, days)) as expected_days from (select restaurant, {_DAYS} as days, count(*) as n from panel group by 1, 2) group by 1)"


@query(f"""with {_PANEL_SQL}, {_EXPECTED_SQL} select restaurant, article_code, report_start, {_DAYS} as period_days, coalesce({_DAYS} = expected_days, false) as period_is_complete, {_DAYS} = 7 as period_is_complete_week,
 cast(report_start as varchar) || '__' || cast(report_end as varchar) as period_id from panel join expected using (restaurant)""")
def panel_period_fields(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    out = panel.period_fields(p, panel.expected_period_days(p, entity=["restaurant"]), ["restaurant"])
    return out.select("restaurant", "article_code", "report_start", "period_days", "period_is_complete", "period_is_complete_week", "period_id")


@query(f"""with {_PANEL_SQL}, m as (select article_code, case when min(department_code) = max(department_code) then max(department_code) end as mc, coalesce(min(department_code) <> max(department_code), false) as mcon from articulos where article_code is not null group by 1)
select restaurant, article_code, report_start, report_end, coalesce(case when not department_code__period_conflict then department_code end, mc) as department_code, coalesce(mcon, false) as department_code__master_conflict from panel left join m using (article_code)""")
def panel_enriched(spark: SparkSession, d: str) -> DataFrame:
    out = panel.enrich(_panel(spark, d), table(spark, d, "articulos"), "article_code", ["department_code"], "articles_master")
    return out.select("restaurant", "article_code", "report_start", "report_end", "department_code", "department_code__master_conflict")


# ------------------------------------------------------------------------------------------------ features

_SPINE_SQL = f"l as ({_LATEST_DAY_SQL}), spine as (select restaurant, unnest(generate_series(min(date), max(date), interval 1 day))::date as date from l group by 1), days as (select s.restaurant, s.date, l.num_tickets, case when isnan(l.facturacion) then null else l.facturacion end as facturacion from spine s left join l using (restaurant, date))"
_DAILY_SQL = f"l as ({_LATEST_DAY_SQL}), days as (select restaurant, date, num_tickets, tiene_evento, case when isnan(facturacion) then null else facturacion end as facturacion from l)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    """The days of each restaurant without holes, from the latest version of each; a day without a row is unknown."""
    latest = _latest_days(spark, d).select("restaurant", "date", "num_tickets", "facturacion")
    return daily.calendar(latest, ["restaurant"], "date").join(latest, ["restaurant", "date"], "left")


@query(f"with {_SPINE_SQL} select restaurant, date, " + ", ".join(f"lag(num_tickets, {k}) over w as num_tickets__lag_{k}" for k in (1, 7, 14, 28)) + " from days window w as (partition by restaurant order by date)")
def feat_daily_lags(spark: SparkSession, d: str) -> DataFrame:
    return features.daily_lags(_series(spark, d), ["restaurant"], ["num_tickets"]).select("restaurant", "date", *[f"num_tickets__lag_{k}" for k in (1, 7, 14, 28)])


@query(f"with {_SPINE_SQL} select restaurant, date, " + ", ".join(f"round(avg(num_tickets) over w{k}, 6) as mean_{k}, round(stddev_samp(num_tickets) over w{k}, 6) as std_{k}, count(num_tickets) over w{k} as count_{k}" for k in (7, 14, 28)) + " from days window " + ", ".join(f"w{k} as (partition by restaurant order by date rows between {k} preceding and 1 preceding)" for k in (7, 14, 28)))
def feat_daily_rolling(spark: SparkSession, d: str) -> DataFrame:
    out = features.daily_rolling(_series(spark, d), ["restaurant"], ["num_tickets"])
    return out.select("restaurant", "date", *[x for k in (7, 14, 28) for x in (F.round(f"num_tickets__rolling_mean_{k}", 6).alias(f"mean_{k}"), F.round(f"num_tickets__rolling_std_{k}", 6).alias(f"std_{k}"), F.col(f"num_tickets__rolling_count_{k}").alias(f"count_{k}"))])


@query(f"with {_SPINE_SQL} select restaurant, date, round(avg(facturacion) over w, 8) as mean_prior, count(facturacion) over w as count_prior, round(avg(case when coalesce(num_tickets, 0) > 0 then 1.0 else 0.0 end) over w, 6) as rate_prior from days window w as (partition by restaurant, isodow(date) order by date rows between unbounded preceding and 1 preceding)")
def feat_same_weekday(spark: SparkSession, d: str) -> DataFrame:
    out = features.same_weekday(_series(spark, d), ["restaurant"], "facturacion", "num_tickets")
    return out.select("restaurant", "date", F.round("facturacion__same_weekday_mean_prior", 8).alias("mean_prior"), F.col("facturacion__same_weekday_count_prior").alias("count_prior"), F.round("num_tickets__same_weekday_positive_rate_prior", 6).alias("rate_prior"))


@query("select distinct date, year(date) as cal_year, month(date) as cal_month, week(date) as cal_week_of_year, isodow(date) - 1 as cal_day_of_week, day(date) = 1 as cal_is_month_start, date = last_day(date) as cal_is_month_end, round(sin((dayofyear(date) - 1) * (2 * 3.141592653589793 / 365.25)), 9) as cal_day_of_year_sin, round(cos((month(date) - 1) * (2 * 3.141592653589793 / 12)), 9) as cal_month_cos from maestra_diaria")
def feat_daily_calendar(spark: SparkSession, d: str) -> DataFrame:
    out = features.feature_calendar(table(spark, d, "maestra_diaria").select("date").distinct())
    return out.select("date", *[F.col(c).cast("long").alias(c) for c in ("cal_year", "cal_month", "cal_week_of_year", "cal_day_of_week")], "cal_is_month_start", "cal_is_month_end", _R("cal_day_of_year_sin", 9), _R("cal_month_cos", 9))


_INDEX_SQL = f"{_PANEL_SQL}, indexed as (select p.*, dense_rank() over (partition by restaurant order by report_start, report_end) - 1 as period_index from panel p)"
_E = ["restaurant", "article_code"]


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return panel.period_index(_panel(spark, d), ["restaurant"])


@query(f"with {_INDEX_SQL} select restaurant, article_code, period_index, " + ", ".join(f"round(max(units) over (partition by restaurant, article_code order by period_index range between {k} preceding and {k} preceding), 2) as units__lag_{k}" for k in (1, 2, 4, 8)) + " from indexed")
def feat_exact_lags(spark: SparkSession, d: str) -> DataFrame:
    return features.exact_lags(_indexed(spark, d), _E).select(*_E, F.col("period_index").cast("long").alias("period_index"), *[_R(f"units__lag_{k}", 2) for k in (1, 2, 4, 8)])


_HISTORY_SQL = f"""{_INDEX_SQL}, past as (select *, count(units) over u as n, avg(units) over u as em, stddev_samp(units) over u as es, period_index - max(period_index) over u as since, avg(units) over r4 as r4, count(units) over r8 as c8 from indexed
 window u as (partition by restaurant, article_code order by period_index range between unbounded preceding and 1 preceding), r4 as (partition by restaurant, article_code order by period_index range between 4 preceding and 1 preceding), r8 as (partition by restaurant, article_code order by period_index range between 8 preceding and 1 preceding)),
 regimes as (select *, case when n < 4 then 'cold_start' when n / period_index::double >= 0.75 then 'frequent' when n / period_index::double >= 0.5 then 'regular' when n / period_index::double >= 0.25 then 'intermittent' else 'sparse' end as regime from past)"""


@query(f"with {_HISTORY_SQL} select restaurant, article_code, period_index, n as history_observed_periods, round(em, 4) as expanding_mean, round(es, 4) as expanding_std, since, round(r4, 4) as rolling_mean_4, c8 as rolling_count_8, regime from regimes")
def feat_history(spark: SparkSession, d: str) -> DataFrame:
    h = features.history(_indexed(spark, d), _E)
    return h.select(*_E, F.col("period_index").cast("long").alias("period_index"), "history_observed_periods", F.round("units__expanding_mean_prior", 4).alias("expanding_mean"), F.round("units__expanding_std_prior", 4).alias("expanding_std"),
                    F.col("periods_since_last_observation").cast("long").alias("since"), F.round("units__rolling_mean_4", 4).alias("rolling_mean_4"), F.col("units__rolling_count_8").alias("rolling_count_8"), F.col("article_demand_regime_prior").alias("regime"))


_FLAG_SQL = """panel as (select l_partkey as article_code, date_trunc('month', l_shipdate)::date as report_start, last_day(l_shipdate::date) as report_end, sum(l_quantity) as units from lineitem group by 1, 2, 3),
 indexed as (select *, dense_rank() over (order by report_start, report_end) - 1 as period_index from panel),
 past as (select *, count(units) over (partition by article_code order by period_index range between unbounded preceding and 1 preceding) as n from indexed)"""


@query(f"with {_FLAG_SQL} select case when n < 4 then 'cold_start' when n / period_index::double >= 0.75 then 'frequent' when n / period_index::double >= 0.5 then 'regular' when n / period_index::double >= 0.25 then 'intermittent' else 'sparse' end as regime, count(*) as n from past group by 1")
def demand_regime_counts(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: article-by-month panel of all line items, history features, rows per demand regime."""
    day = F.col("l_shipdate").cast("date")
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("article_code"), F.trunc(day, "MM").alias("report_start"), F.last_day(day).alias("report_end"), F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("amount"))
    h = features.history(panel.period_index(panel.dedupe_panel(li, ["article_code"])), ["article_code"])
    return h.groupBy(F.col("article_demand_regime_prior").alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_INDEX_SQL}, t as (select restaurant, period_index, sum(units) as total from indexed group by 1, 2) select restaurant, period_index, round(lag(total) over w, 2) as lag_1, round(avg(total) over (partition by restaurant order by period_index rows between 4 preceding and 1 preceding), 4) as mean_4 from t window w as (partition by restaurant order by period_index)")
def feat_global_history(spark: SparkSession, d: str) -> DataFrame:
    out = features.global_history(_indexed(spark, d), ["restaurant"])
    return out.select("restaurant", F.col("period_index").cast("long").alias("period_index"), F.round("global_target_total__lag_1", 2).alias("lag_1"), F.round("global_target_total__rolling_mean_4", 4).alias("mean_4")).distinct()


@query(f"with {_PANEL_SQL} select distinct report_start, report_end, month(report_start + ((report_end - report_start) // 2)::int) as period_mid_month, week(report_start) as period_start_week_of_year, round(sin((week(report_start) - 1) * (2 * 3.141592653589793 / 52.1775)), 9) as period_week_sin from panel")
def feat_period_calendar(spark: SparkSession, d: str) -> DataFrame:
    out = features.period_calendar(_panel(spark, d).select("report_start", "report_end").distinct())
    return out.select("report_start", "report_end", F.col("period_mid_month").cast("long").alias("period_mid_month"), F.col("period_start_week_of_year").cast("long").alias("period_start_week_of_year"), _R("period_week_sin", 9))


@query(f"""with {_PANEL_SQL}, {_DAILY_SQL}, p as (select distinct restaurant, report_start, report_end from panel)
select p.restaurant, p.report_start, p.report_end, count(d.date) as context_days_available, count(*) filter (coalesce(d.tiene_evento, false)) as context_tiene_evento__days_true, round(avg(d.num_tickets), 4) as context_num_tickets__mean, sum(d.num_tickets) as context_num_tickets__sum,
 round(least(count(d.date) / (p.report_end - p.report_start + 1)::double, 1), 6) as context_coverage_fraction from p left join days d on d.restaurant = p.restaurant and d.date between p.report_start and p.report_end group by 1, 2, 3""")
def feat_period_context(spark: SparkSession, d: str) -> DataFrame:
    out = features.period_context(_panel(spark, d), _latest_days(spark, d), {"tiene_evento": "boolean", "num_tickets": "bigint"}, ["restaurant"])
    return out.select("restaurant", "report_start", "report_end", "context_days_available", "context_tiene_evento__days_true", _R("context_num_tickets__mean"), "context_num_tickets__sum", _R("context_coverage_fraction", 6))


@query("select fap_id, units is not null as target_observed, units is not null and not coalesce(units < 0, false) and coalesce(period_is_complete, false) as training_eligible from features_article_period")
def feat_training_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return features.eligibility(table(spark, d, "features_article_period")).select("fap_id", "target_observed", "training_eligible")


@query("select diaria_id, coalesce(case when reservas_total % 3 = 0 then 2.5 end, case when not tiene_evento then 0.0 end) as event_intensity_mean from maestra_diaria")
def feat_known_context(spark: SparkSession, d: str) -> DataFrame:
    """Intensity is 0 where it is known that there was no event; given for every third number of reservations."""
    rows = table(spark, d, "maestra_diaria").select("diaria_id", "tiene_evento", F.when(F.col("reservas_total") % 3 == 0, 2.5).alias("event_intensity_mean"))
    return features.known_context_zero(rows).select("diaria_id", "event_intensity_mean")


# ------------------------------------------------------------------------------------------------ evaluation

_FAP_SQL = """fap as (select restaurant, article_code, report_start, report_end, period_index, units, amount, coalesce(article_demand_regime_prior, 'unknown') as regime, case when isnan(units__lag_1) then null else units__lag_1 end as lag_1,
 period_is_complete from features_article_period qualify row_number() over (partition by restaurant, article_code, report_start, report_end order by loaded_at desc nulls last, fap_id desc) = 1),
 feats as (select *, avg(units) over (partition by restaurant, article_code order by period_index range between unbounded preceding and 1 preceding) as expanding from fap)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    rows = casts.nan_to_null(table(spark, d, "features_article_period"))
    rows = panel.latest_rows(rows, [*_E, "report_start", "report_end"], ["loaded_at", "fap_id"])
    rows = rows.withColumn("regime", F.coalesce("article_demand_regime_prior", F.lit("unknown"))).drop("article_demand_regime_prior")
    return features.history(rows, _E)


_PLACES_SQL = "places as (select period_index, row_number() over (order by period_index) - 1 as place, count(*) over () as n from (select distinct period_index from features_article_period where period_index is not null))"
_SIZES_SQL = """sizes as (select *, least(greatest(ceil(0.15 * n), 2), greatest(0, n - 9))::int as test from places),
 dev as (select period_index, place, n - test as m, greatest(1, ceil(0.1 * (n - test)))::int as size from sizes where place < n - test),
 plan as (select *, least(4, greatest(0, (m - 8) // size))::int as k from dev),
 foldt as (select f.fold, p.period_index, case when p.place >= p.m - p.k * p.size + (f.fold - 1) * p.size then 'validation' else 'train' end as role from plan p, (select unnest(range(1, 5))::int as fold) f where f.fold <= p.k and p.place < p.m - p.k * p.size + f.fold * p.size)"""


@query(f"with {_PLACES_SQL}, {_SIZES_SQL} select period_index, case when place >= n - test then 'test' else 'development' end as split from sizes")
def eval_holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.holdout(table(spark, d, "features_article_period"))


def _folds(spark: SparkSession, d: str) -> DataFrame:
    periods = table(spark, d, "features_article_period")
    split = evaluate.holdout(periods)
    return evaluate.folds(split.where("split = 'development'"))


@query(f"with {_PLACES_SQL}, {_SIZES_SQL} select fold, period_index, role from foldt")
def eval_cv_folds(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d)


_BASE_SQL = f"""{_FAP_SQL}, {_PLACES_SQL}, {_SIZES_SQL}, known as (select * from feats where units is not null),
 med as (select fold, median(units) as fallback from known join foldt using (period_index) where role = 'train' group by 1),
 val as (select f.fold, k.*, m.fallback from known k join foldt f using (period_index) left join med m on m.fold = f.fold where role = 'validation'),
 preds as (select fold, 'lag_1' as model, restaurant, article_code, period_index, regime, units as target, greatest(coalesce(lag_1, fallback), 0) as prediction, lag_1 is null as used_fallback from val
  union all select fold, 'expanding_mean', restaurant, article_code, period_index, regime, units, greatest(coalesce(expanding, fallback), 0), expanding is null from val)"""
_BASELINES = {"lag_1": "units__lag_1", "expanding_mean": "units__expanding_mean_prior"}


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.baseline_predictions(_features(spark, d), _folds(spark, d), _BASELINES, _E, regime="regime")


@query(f"with {_BASE_SQL} select fold, model, restaurant, article_code, period_index, regime, target, round(prediction, 6) as prediction, used_fallback from preds")
def eval_baselines(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).withColumn("prediction", F.round("prediction", 6))


_METRIC_SQL = "count(*) as rows, round(avg(abs(prediction - target)), 6) as mae, round(sqrt(avg((prediction - target) ** 2)), 6) as rmse, round(sum(abs(prediction - target)) / sum(abs(target)), 6) as wape, round(sum(prediction - target) / sum(abs(target)), 6) as bias"


@query(f"with {_BASE_SQL} select fold, model, regime, period_index, case when regime is not null then 'regime' when period_index is not null then 'period_index' else 'model' end as level, {_METRIC_SQL} from preds group by grouping sets ((fold, model), (fold, model, regime), (fold, model, period_index))")
def eval_metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics_at_levels(_predictions(spark, d)).select("fold", "model", "regime", "period_index", "level", "rows", *[_R(c, 6) for c in ("mae", "rmse", "wape", "bias")])


@query(f"""with {_BASE_SQL}, r as (select fold, model, period_index, row_number() over (partition by fold, model, period_index order by target desc, restaurant, article_code) <= 20 as t, row_number() over (partition by fold, model, period_index order by round(prediction, 6) desc, restaurant, article_code) <= 20 as p from preds),
 per as (select fold, model, period_index, count(*) filter (t and p) / least(20, count(*))::double as overlap from r group by 1, 2, 3) select fold, model, round(avg(overlap), 6) as top_k_overlap, count(*) as periods from per group by 1, 2""")
def eval_topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    preds = _predictions(spark, d).withColumn("prediction", F.round("prediction", 6))
    return evaluate.top_k_overlap(preds, ["fold", "model"], "period_index", _E).withColumn("top_k_overlap", F.round("top_k_overlap", 6))


@query(f"with {_BASE_SQL}, m as (select fold, model, avg(abs(prediction - target)) as mae, sum(abs(prediction - target)) / sum(abs(target)) as wape from preds group by 1, 2) select model, count(*) as folds, round(avg(wape), 6) as wape_mean, round(stddev_samp(wape), 6) as wape_std, row_number() over (order by avg(wape), avg(mae), model) as rank from m group by 1")
def eval_cv_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cv_summary(evaluate.metrics(_predictions(spark, d))).select("model", "folds", _R("wape_mean", 6), _R("wape_std", 6), F.col("rank").cast("long").alias("rank"))


@query(f"""with {_BASE_SQL}, e as (select fold, regime, model, sum(abs(prediction - target)) as err, sum(abs(target)) as scale, count(*) as n from preds group by 1, 2, 3),
 grid as (select * from (select distinct fold from e), (select distinct regime from e), (select distinct model from e)),
 before as (select g.*, coalesce(sum(err) over w, 0) as err, coalesce(sum(scale) over w, 0) as scale, coalesce(sum(n) over w, 0) as n from grid g left join e using (fold, regime, model) window w as (partition by g.regime, g.model order by g.fold rows between unbounded preceding and 1 preceding)),
 own as (select fold, regime, arg_min(model, (err / scale, err / n, model)) as own from before where n >= 20 and scale > 0 group by 1, 2),
 pooled as (select fold, model, sum(err) as err, sum(scale) as scale, sum(n) as n from before group by 1, 2),
 overall as (select fold, arg_min(model, (err / scale, err / n, model)) as overall from pooled where n >= 50 and scale > 0 group by 1)
 select fold, regime, coalesce(own, overall, 'expanding_mean') as model, case when own is not null then 'regime' when overall is not null then 'global' else 'default' end as source from (select distinct fold, regime from e) left join own using (fold, regime) left join overall using (fold)""")
def eval_adaptive_selection(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.adaptive_selection(_predictions(spark, d), "expanding_mean")


@query(f"""with {_BASE_SQL}, e as (select regime, model, sum(abs(prediction - target)) as err, sum(abs(target)) as scale, count(*) as n from preds group by 1, 2),
 own as (select regime, arg_min(model, (err / scale, err / n, model)) as own from e where n >= 20 and scale > 0 group by 1), o as (select arg_min(model, (err / scale, err / n, model)) as overall from (select model, sum(err) err, sum(scale) as scale, sum(n) n from e group by 1) where n >= 50 and scale > 0)
 select regime, coalesce(own, overall, 'expanding_mean') as model, case when own is not null then 'regime' when overall is not null then 'global' else 'default' end as source from (select distinct regime from e) left join own using (regime), o""")
def eval_frozen_mapping(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.frozen_mapping(_predictions(spark, d), "expanding_mean")


# ------------------------------------------------------------------------------------------------ next period

_PT_SQL = "pt as (select restaurant, report_start, report_end, coalesce(bool_and(period_is_complete), true) as period_is_complete, report_end - report_start + 1 as days from features_article_period where report_start is not null and report_end is not null group by 1, 2, 3)"
_NEXT_SQL = f"""{_PT_SQL}, done as (select * from pt where period_is_complete), len as (select restaurant, arg_max(days, (n, -days)) as length from (select restaurant, days, count(*) as n from done group by 1, 2) group by 1),
 gaps as (select restaurant, report_start - lag(report_start) over (partition by restaurant order by report_start) as gap from (select distinct restaurant, report_start from done)), cad as (select restaurant, arg_max(gap, (n, -gap)) as cadence from (select restaurant, gap, count(*) as n from gaps where gap > 0 group by 1, 2) group by 1),
 ends as (select restaurant, max(report_end) as le, max(report_start) filter (period_is_complete) as ls from pt group by 1),
 nxt as (select restaurant, length, cadence, case when le >= ls then ls + (coalesce(cadence, length) * ((le - ls) // coalesce(cadence, length) + 1))::int else ls end as s from ends join len using (restaurant) left join cad using (restaurant))"""


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return context.period_table(table(spark, d, "features_article_period").where("report_start is not null and report_end is not null"), ["restaurant"])


@query(f"with {_NEXT_SQL} select restaurant, s as forecast_start, s + length::int - 1 as forecast_end, cadence as cadence_days, length as period_days from nxt")
def ops_next_period(spark: SparkSession, d: str) -> DataFrame:
    return context.next_period(_periods(spark, d), ["restaurant"])


@query("select restaurant, article_code, report_start, report_end, fap_id from features_article_period qualify row_number() over (partition by restaurant, article_code order by report_end desc, report_start desc, loaded_at desc, fap_id desc) = 1")
def ops_latest_rows(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "features_article_period").select("restaurant", "article_code", "report_start", "report_end", "loaded_at", "fap_id")
    return panel.latest_rows(f, _E, ["report_end", "report_start", "loaded_at", "fap_id"]).drop("loaded_at")


@query(f"with {_NEXT_SQL} select f.restaurant, f.article_code, n.s as report_start, n.s + n.length::int - 1 as report_end from (select distinct restaurant, article_code from features_article_period) f join nxt n using (restaurant)")
def ops_future_scaffold(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "features_article_period").select("restaurant", "article_code", "report_start", "report_end", "units", "amount")
    return context.future_scaffold(f, context.next_period(_periods(spark, d), ["restaurant"]), ["restaurant"], "article_code", ["units", "amount"]).select("restaurant", "article_code", "report_start", "report_end")


_HORIZON = ("2024-07-01", "2024-07-14")


@query(f"""with h as (select event_location, unnest(generate_series(date '{_HORIZON[0]}', date '{_HORIZON[1]}', interval 1 day))::date as date from (select distinct event_location from eventos)),
 e as (select *, greatest(event_end, event_start) as ee from eventos where event_start is not null and event_end is not null), x as (select *, unnest(generate_series(greatest(event_start, date '{_HORIZON[0]}'), least(ee, date '{_HORIZON[1]}'), interval 1 day))::date as day from e where event_start <= date '{_HORIZON[1]}' and ee >= date '{_HORIZON[0]}'),
 o as (select event_location, day, event_id, max(event_intensity) as event_intensity from x group by 1, 2, 3), a as (select event_location, day as date, count(event_id) as n, avg(event_intensity) as m, max(event_intensity) as mx from o group by 1, 2)
 select event_location, date, a.date is not null as tiene_evento, coalesce(n, 0) as num_eventos, round(coalesce(m, 0), 6) as event_intensity_mean, coalesce(mx, 0) as event_intensity_max from h left join a using (event_location, date)""".replace("a.date is not null as tiene_evento", "n is not null as tiene_evento"))
def ops_future_context(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.lit(x).cast("date") for x in _HORIZON)
    e = table(spark, d, "eventos").where("event_start is not null and event_end is not null")
    days = table(spark, d, "eventos").select("event_location").distinct().select("event_location", F.explode(F.sequence(a, b, F.expr("interval 1 day"))).alias("date"))
    out = context.future_context(days, context.events_in_horizon(e, a, b, ["event_location"]).drop("eventos_nombres"), key=["event_location"])
    return out.select("event_location", "date", "tiene_evento", "num_eventos", _R("event_intensity_mean", 6), "event_intensity_max")


@query("""with i as (select *, dense_rank() over (partition by restaurant order by report_start, report_end) - 1 as pi from features_article_period), m as (select restaurant, max(pi) as latest from i group by 1)
 select restaurant, article_code, count(distinct pi) as periods_observed, min(pi) as first_index, max(pi) as last_index, round(sum(units), 2) as units_total_history, max(latest) - max(pi) as periods_since_last_observed, max(latest) - max(pi) < 4 as observed_last_4_periods from i join m using (restaurant) group by 1, 2""")
def ops_history_profile(spark: SparkSession, d: str) -> DataFrame:
    f = panel.period_index(table(spark, d, "features_article_period").drop("period_index"), ["restaurant"])
    out = context.history_profile(f, ["restaurant"])
    return out.select("restaurant", "article_code", "periods_observed", *[F.col(c).cast("long").alias(c) for c in ("first_index", "last_index")], _R("units_total_history", 2), F.col("periods_since_last_observed").cast("long").alias("periods_since_last_observed"), "observed_last_4_periods")


@query("""select cast(article_code as varchar) as article_code, bool_or(src = 'a') as in_article_master, bool_or(src = 'm') as in_menu, bool_or(src = 'h') as observed_in_any_history from
 (select article_code, 'a' as src from articulos union all select article_code, 'm' from menu union all select article_code, 'h' from features_article_period) where article_code is not null group by 1""")
def ops_catalogue_union(spark: SparkSession, d: str) -> DataFrame:
    return context.combine_catalogues(table(spark, d, "articulos"), table(spark, d, "menu"), table(spark, d, "features_article_period"))


@query("""with new as (select restaurant, date, 0 as num_tickets, 'future' as origin from maestra_diaria where date >= date '2024-12-01' and date is not null group by all), old as (select restaurant, date, num_tickets, 'history' as origin from maestra_diaria)
 select * from old where not exists (select 1 from new where new.restaurant = old.restaurant and new.date = old.date) union all select * from new""")
def ops_override_union(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "maestra_diaria")
    old = m.select("restaurant", "date", "num_tickets", F.lit("history").alias("origin"))
    new = m.where("date >= date '2024-12-01'").select("restaurant", "date", F.lit(0).cast("long").alias("num_tickets"), F.lit("future").alias("origin")).distinct()
    return context.override_union(old, new, ["restaurant", "date"])


_FORECAST_SQL = f"with {_FAP_SQL}, f as (select restaurant, article_code, round(greatest(coalesce(avg(units), (select median(units) from fap), 0), 0), 4) as predicted_units from fap group by 1, 2), r as (select *, row_number() over w as forecast_rank, predicted_units / nullif(sum(predicted_units) over (partition by restaurant), 0) as share from f window w as (partition by restaurant order by predicted_units desc, article_code)), c as (select *, sum(share) over (partition by restaurant order by forecast_rank) as cum from r)"


def _forecast(spark: SparkSession, d: str) -> DataFrame:
    """The coming period of every article: the mean of all its known periods, the latest included, or the median target where none is known.

    This is the expanding mean of a scaffold row behind the latest period.
    """
    rows = casts.nan_to_null(table(spark, d, "features_article_period"))
    rows = panel.latest_rows(rows, [*_E, "report_start", "report_end"], ["loaded_at", "fap_id"])
    ahead = context.future_scaffold(rows, context.next_period(context.period_table(rows, ["restaurant"]), ["restaurant"]), ["restaurant"], "article_code", ["units", "amount"])
    places = rows.groupBy("restaurant").agg((F.max("period_index") + 1).alias("place"))
    ahead = ahead.join(broadcast_if_small(places), "restaurant").withColumn("period_index", F.col("place").cast(dict(rows.dtypes)["period_index"])).withColumn("future", F.lit(True))
    both = rows.withColumn("future", F.lit(False)).unionByName(ahead.select(*rows.columns, "future"))
    f = features.history(both.select(*_E, "period_index", "units", "future"), _E).where("future")
    median = rows.agg(F.median("units")).first()[0]
    p = F.greatest(F.coalesce("units__expanding_mean_prior", F.lit(median).cast("double"), F.lit(0.0)), F.lit(0.0))
    return context.rank_forecast(f.select(*_E, F.round(p, 4).alias("predicted_units")), ["restaurant"], "article_code")


@query(_FORECAST_SQL + " select restaurant, article_code, predicted_units, forecast_rank, round(share, 6) as forecast_share, round(cum, 6) as forecast_cumulative_share, case when cum - share < 0.8 then 'A' when cum - share < 0.95 then 'B' else 'C' end as planning_class, cast(round_even(predicted_units, 0) as bigint) as predicted_units_rounded from c")
def ops_forecast_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _forecast(spark, d).select(*_E, "predicted_units", F.col("forecast_rank").cast("long").alias("forecast_rank"), _R("forecast_share", 6), _R("forecast_cumulative_share", 6), "planning_class", "predicted_units_rounded")


@query(_FORECAST_SQL + " select restaurant, count(*) as articles, round(sum(predicted_units), 2) as predicted_total, round(sum(predicted_units) filter (forecast_rank <= 20), 2) as top_units, round(sum(share) filter (forecast_rank <= 20), 6) as top_share, count(*) filter (cum - share < 0.8) as class_a from c group by 1")
def ops_forecast_summary(spark: SparkSession, d: str) -> DataFrame:
    out = context.forecast_summary(_forecast(spark, d), ["restaurant"])
    return out.select("restaurant", "articles", _R("predicted_total", 2), _R("top_units", 2), _R("top_share", 6), "class_a")


@query("select fap_id from features_article_period where coalesce(period_is_complete, false)")
def ops_complete_rows(spark: SparkSession, d: str) -> DataFrame:
    return context.complete_rows(table(spark, d, "features_article_period")).select("fap_id")


@query(f"""with w as (select event_location, date, case when isnan(rain_mm) then null else rain_mm end as rain_mm, case when isnan(temperature_mean) then null else temperature_mean end as temperature_mean from meteo_diaria where date between date '{_HORIZON[0]}' and date '{_HORIZON[1]}')
select event_location, date, round(sum(rain_mm), 4) as rain_mm, round(avg(temperature_mean), 4) as temperature_mean from w group by 1, 2""")
def ops_future_weather(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.lit(x).cast("date") for x in _HORIZON)
    w = casts.nan_to_null(table(spark, d, "meteo_diaria").select("event_location", "date", "rain_mm", "temperature_mean"))
    return context.forecast_weather(w, a, b, ["event_location"]).select("event_location", "date", _R("rain_mm"), _R("temperature_mean"))


#: A mapping of regimes to baselines, as a run would have frozen it; regimes outside it take the default.
_MAPPING = {"cold_start": "lag_1", "intermittent": "rolling_mean_4", "regular": "expanding_mean"}
_OWN_PT_SQL = "pt as (select restaurant, report_start, report_end, coalesce(bool_and(complete), true) as period_is_complete, report_end - report_start + 1 as days from pf group by 1, 2, 3)"
_CASES = " ".join(f"when '{r}' then '{m}'" for r, m in _MAPPING.items())


@query(f"""with {_PANEL_SQL}, {_EXPECTED_SQL}, pf as (select p.*, coalesce({_DAYS} = expected_days, false) as complete from panel p left join expected using (restaurant)), {_NEXT_SQL.replace(_PT_SQL, _OWN_PT_SQL)},
 idx as (select *, dense_rank() over (partition by restaurant order by report_start, report_end) - 1 as i from pf where complete), last as (select restaurant, max(i) + 1 as i from idx group by 1),
 ahead as (select a.restaurant, a.article_code, coalesce(l.i, 0) as i from (select distinct restaurant, article_code from pf) a join nxt using (restaurant) left join last l using (restaurant)),
 f as (select a.restaurant, a.article_code, any_value(a.i) as i, count(x.units) as n, avg(x.units) as expanding_mean, max(x.units) filter (x.i = a.i - 1) as lag_1, avg(x.units) filter (x.i >= a.i - 4) as rolling_mean_4 from ahead a left join idx x using (restaurant, article_code) group by 1, 2),
 r as (select *, case when n < 4 then 'cold_start' when n / i::double >= 0.75 then 'frequent' when n / i::double >= 0.5 then 'regular' when n / i::double >= 0.25 then 'intermittent' else 'sparse' end as regime from f),
 m as (select *, case regime {_CASES} else 'expanding_mean' end as selected_model from r), o as (select *, case selected_model when 'lag_1' then lag_1 when 'rolling_mean_4' then rolling_mean_4 else expanding_mean end as own from m)
 select restaurant, article_code, regime, selected_model, round(greatest(coalesce(own, (select median(units) from pf where complete and units >= 0), 0), 0), 4) as predicted_units, own is null as used_prediction_fallback from o""")
def ops_forecast_selected(spark: SparkSession, d: str) -> DataFrame:
    """The forecast of the staged run with a mapping of regimes to baselines: scaffold, features, the mapped model, the fallback."""
    from almazara import pipeline
    from almazara.config import FeatureRules, OperationalRules

    p = _panel(spark, d)
    gold = panel.period_fields(p, panel.expected_period_days(p, entity=["restaurant"]), ["restaurant"])
    mapping = spark.createDataFrame([(r, m, "regime") for r, m in _MAPPING.items()], "regime string, model string, source string")
    out = pipeline.forecast(gold, FeatureRules(), OperationalRules(), mapping, ("restaurant",))
    return out.select(*_E, F.col("article_demand_regime_prior").alias("regime"), "selected_model", _R("predicted_units"), "used_prediction_fallback")


# ------------------------------------------------------------------------------------------------ profiles


_ARTICLE_COLUMNS = ("source_file", "article_code", "article_name", "article_short_name", "department_code", "price", "valid_from", "valid_to")


@query(f"""select 'reservas' as dataset, count(*) as rows, 11 as columns, {_missing_sql(("reserva_id", *_RESERVATION_COLUMNS))} as missing_cells, count(*) - (select count(*) from (select distinct * from reservas)) as duplicate_rows, min(reservation_date) as first_day, max(reservation_date) as last_day from reservas
 union all select 'articulos', count(*), 8, {_missing_sql(_ARTICLE_COLUMNS)}, count(*) - (select count(*) from (select distinct * from articulos)), min(valid_from), max(valid_from) from articulos""")
def eda_dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return eda.dataset_summary({"reservas": table(spark, d, "reservas"), "articulos": table(spark, d, "articulos")}, {"reservas": "reservation_date", "articulos": "valid_from"})


_NUM = ("units", "amount")


@query(" union all ".join(f"select '{c}' as \"column\", 'numeric' as role, count({c}) as non_null, count(*) - count({c}) as missing, min({c}) as min, quantile_cont({c}, 0.25) as q25, median({c}) as median, round(avg({c}), 6) as mean, quantile_cont({c}, 0.75) as q75, max({c}) as max, round(stddev_samp({c}), 6) as std from ventas" for c in _NUM))
def eda_column_profile(spark: SparkSession, d: str) -> DataFrame:
    return eda.column_profile(table(spark, d, "ventas").select(*_NUM)).select("column", "role", "non_null", "missing", "min", "q25", "median", _R("mean", 6), "q75", "max", _R("std", 6))


_CATS = ("status", "shift", "origin")


@query("with v as (" + " union all ".join(f"select '{c}' as \"column\", {c} as value, count(*) as rows from reservas where {c} is not null group by 2" for c in _CATS) + """), n as (select "column", count(*) as kinds, sum(rows) as total from v group by 1)
 select "column", value, rows, round(rows / total::double, 9) as fraction from (select v.*, n.total, row_number() over (partition by v."column" order by rows desc, value) as place from v join n using ("column") where kinds <= 30) where place <= 15""")
def eda_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return eda.frequencies(table(spark, d, "reservas"), _CATS).withColumn("fraction", F.round("fraction", 9))


@query(f"with {_DAILY_SQL} select restaurant, isodow(date) - 1 as weekday, count(*) as days, count(*) - count(facturacion) as missing, round(avg(facturacion), 8) as mean, median(facturacion) as median, min(facturacion) as min, max(facturacion) as max, round(avg(case when coalesce(num_tickets, 0) > 0 then 1.0 else 0.0 end), 6) as active_fraction from days group by 1, 2")
def eda_weekday_profile(spark: SparkSession, d: str) -> DataFrame:
    out = eda.weekday_profile(_latest_days(spark, d), ["restaurant"], "date", "facturacion", "num_tickets")
    return out.select("restaurant", F.col("weekday").cast("long").alias("weekday"), "days", "missing", _R("mean", 8), "median", "min", "max", _R("active_fraction", 6))


@query(f"with {_DAILY_SQL} select restaurant, date_trunc('month', date)::date as month, count(distinct date) as days, round(sum(facturacion), 2) as sum, median(facturacion) as median, day(last_day(date_trunc('month', date)::date)) as calendar_days, count(distinct date) < day(last_day(date_trunc('month', date)::date)) as partial from days group by 1, 2")
def eda_month_profile(spark: SparkSession, d: str) -> DataFrame:
    out = eda.month_profile(_latest_days(spark, d), ["restaurant"], "date", "facturacion")
    return out.select("restaurant", "month", "days", _R("sum", 2), "median", F.col("calendar_days").cast("long").alias("calendar_days"), "partial")


@query(f"with {_DAILY_SQL} select restaurant, min(date) as first_day, max(date) as last_day, count(*) as rows, round(sum(facturacion), 2) as sum, count(*) filter (facturacion = 0) as zero_days, count(*) filter (num_tickets > 0) as active_days, max(date) - min(date) + 1 - count(distinct date) as missing_dates from days group by 1")
def eda_daily_summary(spark: SparkSession, d: str) -> DataFrame:
    out = eda.daily_summary(_latest_days(spark, d), ["restaurant"], "date", "facturacion", "num_tickets")
    return out.select("restaurant", "first_day", "last_day", "rows", _R("sum", 2), "zero_days", "active_days", "missing_dates")


_CORR_COLUMNS = ("amount", "article_code", "department_code")


@query("with " + ", ".join(f"r_{c} as (select rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as rx, rank() over (order by units) + (count(*) over (partition by units) - 1) / 2.0 as ry, {c}::double as x, units as y from ventas where {c} is not null and units is not null)" for c in _CORR_COLUMNS) + " " + " union all ".join(f"select '{c}' as \"column\", count(*) as pairs, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r_{c}" for c in _CORR_COLUMNS))
def eda_correlations(spark: SparkSession, d: str) -> DataFrame:
    return eda.correlations(table(spark, d, "ventas"), "units", _CORR_COLUMNS).select("column", "pairs", _R("pearson", 6), _R("spearman", 6))


@query(f"""with {_PANEL_SQL}, p as (select restaurant, article_code, round(sum(units), 2) as units_total, median(units) as units_median, count(distinct (report_start, report_end)) as periods_observed, sum(units) as u from panel group by 1, 2), t as (select restaurant, count(distinct (report_start, report_end)) as periods, sum(units) as au from panel group by 1)
 select restaurant, article_code, units_total, units_median, periods_observed, round(periods_observed / periods::double, 6) as period_coverage, round(u / au, 6) as unit_share, round(sum(u / au) over (partition by restaurant order by u desc, article_code rows unbounded preceding), 6) as cumulative_share from p join t using (restaurant)""")
def eda_article_profile(spark: SparkSession, d: str) -> DataFrame:
    out = panel.article_profile(_panel(spark, d), ["restaurant"])
    return out.select("restaurant", "article_code", _R("units_total", 2), "units_median", "periods_observed", _R("period_coverage", 6), _R("unit_share", 6), _R("cumulative_share", 6))


@query(f"""with n as (select restaurant, article_code, article_name, count(*) as n from ventas where {_VALID} and article_name is not null group by 1, 2, 3), m as (select restaurant, article_code, article_name as article_name_mode from n qualify row_number() over (partition by restaurant, article_code order by n desc, article_name) = 1)
 select v.restaurant, v.article_code, arg_max(article_name, (report_end, report_start, article_name)) filter (article_name is not null) as article_name_latest, max(article_name_mode) as article_name_mode, count(distinct article_name) as article_name_values, count(distinct article_name) > 1 as article_name_changed
 from ventas v left join m using (restaurant, article_code) where {_VALID} group by 1, 2""")
def eda_latest_metadata(spark: SparkSession, d: str) -> DataFrame:
    return panel.latest_metadata(table(spark, d, "ventas").where(_VALID), _E, ["article_name"]).select(*_E, "article_name_latest", "article_name_mode", "article_name_values", "article_name_changed")


@query(f"with {_PANEL_SQL} select restaurant, report_start, report_end, round(sum(units), 2) as units, round(sum(amount), 2) as amount, count(distinct article_code) as articles, report_end - report_start + 1 as period_days, round(sum(units) / (report_end - report_start + 1), 6) as units_per_day from panel group by 1, 2, 3")
def eda_period_totals(spark: SparkSession, d: str) -> DataFrame:
    out = panel.period_totals(_panel(spark, d), ["restaurant"])
    return out.select("restaurant", "report_start", "report_end", _R("units", 2), _R("amount", 2), "articles", "period_days", _R("units_per_day", 6))


@query(_BOOKED_SQL + f""" select count(*) as reservations, sum(people) as people, count(*) filter (people <= 0) as people_invalid, count(*) filter (is_walk_in) as walk_ins, round(count(*) filter (s = 'no_show') / count(*)::double, 6) as no_show_share,
 round(quantile_cont(lead_time_hours, 0.5), 6) as lead_median, round(quantile_cont(lead_time_hours, 0.9), 6) as lead_p90, round(quantile_cont(lead_time_hours, 0.99), 6) as lead_p99 from (select *, {_STATUS_SQL} as s from led)""")
def eda_reservation_summary(spark: SparkSession, d: str) -> DataFrame:
    out = eda.reservation_summary(_booked(spark, d), no_show=F.coalesce(slug(F.col("status")) == "no_show", F.lit(False)))
    return out.select("reservations", "people", "people_invalid", "walk_ins", _R("no_show_share", 6), *[_R(c, 6) for c in ("lead_median", "lead_p90", "lead_p99")])


@query("""with u as (select event_id, max(event_end) - min(event_start) + 1 as d, max(event_intensity) as i from eventos where event_id is not null group by 1) select count(*) as events, round(avg(d), 6) as duration_mean, median(d) as duration_median, max(d) as duration_max, count(*) filter (d > 7) as longer_than_7, count(*) filter (d > 30) as longer_than_30, count(*) filter (i >= 4) as strong from u""")
def eda_event_summary(spark: SparkSession, d: str) -> DataFrame:
    out = eda.event_summary(eda.unique_events(table(spark, d, "eventos")))
    return out.withColumn("duration_mean", F.round("duration_mean", 6))


@query("select venta_id, coalesce(nullif(trim(article_name), ''), cast(article_code as varchar)) as label from ventas")
def eda_labels(spark: SparkSession, d: str) -> DataFrame:
    return eda.label(table(spark, d, "ventas")).select("venta_id", "label")


# ------------------------------------------------------------------------------------------------ sets


@query("select article_code, article_name, price, cast(null as date) as exported_on, 'articulos' as origin from articulos union all select article_code, article_name, price, exported_on, 'menu' from menu")
def setop_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articulos").select("article_code", "article_name", "price", F.lit("articulos").alias("origin"))
    m = table(spark, d, "menu").select("price", "article_name", "article_code", "exported_on", F.lit("menu").alias("origin"))
    return a.unionByName(m, allowMissingColumns=True).select("article_code", "article_name", "price", "exported_on", "origin")


@query("select article_code from menu except select article_code from articulos")
def setop_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "menu").select("article_code").subtract(table(spark, d, "articulos").select("article_code"))


@query("select article_code from menu intersect select article_code from articulos")
def setop_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "menu").select("article_code").intersect(table(spark, d, "articulos").select("article_code"))


# ------------------------------------------------------------------------------------------------ models (no SQL counterpart: rows only)

_NUMERIC = ["units__lag_1", "units__rolling_mean_4", "units__rolling_mean_8", "units__expanding_mean_prior", "history_observation_rate", "periods_since_last_observation"]


def _candidate(spark: SparkSession, d: str, name: str, **sizes: int) -> DataFrame:
    """Holdout predictions of one candidate fitted on all development rows."""
    from almazara.operators import models

    rows = _features(spark, d).where("units is not null and units >= 0")
    split = evaluate.holdout(rows)
    both = rows.join(F.broadcast(split), "period_index").select("split", "regime", *_NUMERIC, "units")  # one row a period
    both.write.parquet(path := shared_path(spark, "candidate"))  # read by each step of the preparation
    both = spark.read.schema(both.schema).parquet(path)
    model = models.fit(both.where("split = 'development'"), name, ["regime"], _NUMERIC, "units", **sizes)
    out = models.predict(model, both.where("split = 'test'"), name, ["regime"], _NUMERIC)
    return evaluate.metrics(out.withColumn("target", F.col("units")), ["regime"]).select(F.lit(name).alias("model"), "regime", "rows", _R("mae", 6), _R("wape", 6), _R("bias", 6))


@query()
def ml_poisson_glm(spark: SparkSession, d: str) -> DataFrame:
    return _candidate(spark, d, "poisson_glm")


@query()
def ml_random_forest(spark: SparkSession, d: str) -> DataFrame:
    return _candidate(spark, d, "random_forest")


@query()
def ml_gbt_log1p(spark: SparkSession, d: str) -> DataFrame:
    return _candidate(spark, d, "gbt_log1p")


_FINAL_SQL = f"""{_BASE_SQL}, e as (select regime, model, sum(abs(prediction - target)) as err, sum(abs(target)) as scale, count(*) as n from preds group by 1, 2), own as (select regime, arg_min(model, (err / scale, err / n, model)) as own from e where n >= 20 and scale > 0 group by 1),
 o as (select arg_min(model, (err / scale, err / n, model)) as overall from (select model, sum(err) err, sum(scale) as scale, sum(n) n from e group by 1) where n >= 50 and scale > 0), frozen as (select regime, coalesce(own, overall, 'expanding_mean') as model from (select distinct regime from e) left join own using (regime), o),
 split as (select period_index, place >= n - test as is_test from sizes), fmed as (select median(units) as fallback from known join split using (period_index) where not is_test),
 tests as (select k.*, greatest(coalesce(lag_1, fallback), 0) as p1, greatest(coalesce(expanding, fallback), 0) as p2 from known k join split using (period_index), fmed where is_test),
 long as (select 'lag_1' as model, units as target, p1 as prediction from tests union all select 'expanding_mean', units, p2 from tests union all select 'adaptive', units, case when coalesce(f.model, 'expanding_mean') = 'lag_1' then p1 else p2 end from tests left join frozen f using (regime))"""


@query(f"with {_FINAL_SQL} select model, count(*) as rows, round(avg(abs(prediction - target)), 6) as mae, round(sum(abs(prediction - target)) / sum(abs(target)), 6) as wape, round(sum(prediction - target) / sum(abs(target)), 6) as bias from long group by 1")
def eval_final_test(spark: SparkSession, d: str) -> DataFrame:
    """The holdout scored once by the baselines and by the mapping frozen on development predictions."""
    rows = _features(spark, d)
    split = evaluate.holdout(table(spark, d, "features_article_period"))
    final = split.select(F.lit(0).alias("fold"), "period_index", F.when(F.col("split") == "test", "validation").otherwise("train").alias("role"))
    test = evaluate.baseline_predictions(rows, final, _BASELINES, [*_E, "report_start", "report_end"], regime="regime")
    frozen = evaluate.frozen_mapping(_predictions(spark, d), "expanding_mean")
    adaptive = evaluate.apply_selection(test, frozen, ["regime"], [*_E, "report_start", "report_end", "period_index"], "expanding_mean")
    out = evaluate.metrics(test.select("model", "target", "prediction").unionByName(adaptive.select("model", "target", "prediction")), ["model"])
    return out.select("model", "rows", _R("mae", 6), _R("wape", 6), _R("bias", 6))


# ------------------------------------------------------------------------------------------------ sorts, tops and smoothing


@query("""select restaurant, article_code, units, place from (select restaurant, article_code, units, row_number() over (partition by restaurant order by units desc nulls last, article_code asc nulls last, venta_id) as place from ventas) where place <= 20""")
def sort_top_with_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """The 20 largest sales rows of each restaurant: mixed directions, nulls last, ties by code and row."""
    from pyspark.sql import Window

    w = Window.partitionBy("restaurant").orderBy(F.desc_nulls_last("units"), F.asc_nulls_last("article_code"), "venta_id")
    top = table(spark, d, "ventas").withColumn("place", F.row_number().over(w)).where("place <= 20")
    return top.select("restaurant", "article_code", "units", F.col("place").cast("long").alias("place"))


@query(f"with {_SPINE_SQL} select restaurant, date, round(avg(facturacion) over (partition by restaurant order by date rows between 3 preceding and 3 following), 8) as centred_7 from days")
def eda_centred_mean(spark: SparkSession, d: str) -> DataFrame:
    out = features.centred_mean(_series(spark, d), ["restaurant"], "facturacion", 7)
    return out.select("restaurant", "date", F.round("facturacion__centred_mean_7", 8).alias("centred_7"))


@query(f"""with {_PANEL_SQL}, a as (select article_code, sum(units) as u, count(distinct (restaurant, report_start, report_end)) as n from panel group by 1), t as (select count(distinct (restaurant, report_start, report_end)) as n, sum(units) as u from panel), r as (select article_code, a.u / t.u as share, a.n / t.n::double as cov, row_number() over (order by a.u desc, article_code) as place from a, t)
 select count(*) as articles, round(sum(share) filter (place <= 10), 6) as top_10_share, round(sum(share) filter (place <= 20), 6) as top_20_share, count(*) filter (cov < 0.25) as coverage_under_25, round(median(cov), 6) as median_coverage from r""")
def eda_panel_summary(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    period = F.struct("restaurant", "report_start", "report_end")
    total = p.agg(F.count_distinct(period).alias("n"), F.sum("units").alias("u")).first()
    profile = p.groupBy("article_code").agg(F.sum("units").alias("units_total"), F.count_distinct(period).alias("k")).select("article_code", "units_total", (F.col("units_total") / F.lit(total["u"])).alias("unit_share"), (F.col("k") / F.lit(total["n"])).alias("period_coverage"))
    out = eda.period_panel_summary(profile, p.select(period).distinct())
    return out.select("articles", _R("top_10_share", 6), _R("top_20_share", 6), "coverage_under_25", _R("median_coverage", 6))
