"""Queries of problems 1 to 7 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almazara.functions.text import fold
from almazara.operators import drift
from almazara.operators.fill import ABSURD_DAYS, ABSURD_FACTOR, STAND_IN_DAYS, Dependency, Fallback, fill, keep, mine, usable_day, usable_pair
from almazara.operators.history import delta_store, reconstruct, snapshots, write_store
from almazara.operators.intervals import covered_spans
from almazara.operators.rolling import latest_versions, trailing_sums, unfold
from almazara.operators.references import ForeignKey, orphan_cascade, orphan_report
from almazara.operators.timestamps import ABBREVIATIONS, MONTHS, Typed, instant_text, normalise
from almazara.plans.tables import table
from almazara.session import broadcast_if_small, shared_path

# ---------------------------------------------------------------------------------------------- problem 2


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    sales = covered_spans(table(spark, d, "ventas"), "restaurant", "report_start", "report_end")
    events = covered_spans(table(spark, d, "eventos"), "event_location", "event_start", "event_end")
    return sales.select(F.lit("ventas").alias("table_name"), "*").unionByName(events.select(F.lit("eventos").alias("table_name"), "*")).select(
        "table_name", "entity", "span_kind", F.col("span_start").cast("string").alias("span_start"), F.col("span_end").cast("string").alias("span_end")
    )


P2_FOUND_SQL = """
with days as (
  select 'ventas' as table_name, restaurant as entity, report_start as s, report_end as e from ventas
  union all select 'eventos', event_location, event_start, event_end from eventos),
valid as (select distinct * from days where entity is not null and s is not null and e is not null and e >= s),
marked as (select *, case when s > max(e) over (partition by table_name, entity order by s, e rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from valid),
numbered as (select *, sum(new) over (partition by table_name, entity order by s, e rows unbounded preceding) as island from marked),
periods as (select table_name, entity, min(s) as s, max(e) as e from numbered group by table_name, entity, island),
following as (select *, lead(s) over (partition by table_name, entity order by s) as nxt from periods)
select table_name, entity, 'period' as span_kind, cast(s as varchar) as span_start, cast(e as varchar) as span_end from following
union all
select table_name, entity, 'gap', cast(e + 1 as varchar), cast(nxt - 1 as varchar) from following where nxt is not null
"""

# ---------------------------------------------------------------------------------------------- problem 3

#: The foreign keys of the domain: menus and sales refer to the master, feature rows to the sales of their period.
DOMAIN_KEYS = (
    ForeignKey("menu", "articulos", ["article_code"], ["article_code"], ["exported_on", "exported_on"], ["valid_from", "valid_to"], "menu.article_code"),
    ForeignKey("ventas", "articulos", ["article_code"], ["article_code"], ["report_start", "report_end"], ["valid_from", "valid_to"], "ventas.article_code"),
    ForeignKey("features_article_period", "ventas", ["restaurant", "article_code", "report_start", "report_end"], ["restaurant", "article_code", "report_start", "report_end"], name="features_article_period.sales"),
)
#: The day whose month a report goes by.
_REPORT_DAY = {"menu": "exported_on", "ventas": "report_start", "features_article_period": "report_start"}
_IDS = {"menu": "menu_id", "ventas": "venta_id", "features_article_period": "fap_id", "articulos": "article_code"}


def _orphans(spark: SparkSession, d: str, keys: tuple[ForeignKey, ...]) -> DataFrame:
    names = {n for k in keys for n in (k.child, k.parent)}
    return orphan_cascade({n: table(spark, d, n) for n in names}, keys, _IDS, {n: F.date_format(c, "yyyy-MM") for n, c in _REPORT_DAY.items()})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d, DOMAIN_KEYS[:2]).where("origin = 'direct'").select("table_name", "row_id", "reason")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, reference, period (month), reason and origin, features rows by their orphaned sales included."""
    only_inherited = _orphans(spark, d, DOMAIN_KEYS)
    return orphan_report(only_inherited)


_P3_DIRECT_SQL = """
rows as (
  select 'ventas' as table_name, venta_id as row_id, article_code as code, report_start as a, report_end as b, strftime(report_start, '%Y-%m') as period from ventas
  where article_code is not null and report_start is not null and report_end is not null and report_end >= report_start
  union all
  select 'menu', menu_id, article_code, exported_on, exported_on, strftime(exported_on, '%Y-%m') from menu where article_code is not null and exported_on is not null),
spans as (select article_code as code, coalesce(valid_from, date '0001-01-01') as f, coalesce(valid_to, date '9999-12-31') as t from articulos where article_code is not null),
judged as (
  select r.table_name, r.row_id, r.period, count(s.code) as n, bool_or(s.f <= r.b and s.t >= r.a) as valid, bool_or(s.t < r.a) as before, bool_or(s.f > r.b) as after
  from rows r left join spans s on s.code = r.code group by all),
direct as (
  select table_name, row_id, period, case when n = 0 then 'missing' when before and after then 'between' when after then 'later' else 'deleted' end as reason
  from judged where n = 0 or not valid)
"""
P3_FOUND_SQL = f"with {_P3_DIRECT_SQL} select table_name, row_id, reason from direct"
P3_REPORT_SQL = f"""
with {_P3_DIRECT_SQL},
sold as (
  select distinct restaurant, article_code, report_start, report_end from ventas
  where restaurant is not null and article_code is not null and report_start is not null and report_end is not null),
alive as (
  select distinct v.restaurant, v.article_code, v.report_start, v.report_end from ventas v
  left join direct d on d.table_name = 'ventas' and d.row_id = v.venta_id where d.row_id is null),
features as (
  select f.fap_id, strftime(f.report_start, '%Y-%m') as period, s.restaurant is null as unsold, a.restaurant is null as dead
  from features_article_period f
  left join sold s on f.restaurant = s.restaurant and f.article_code = s.article_code and f.report_start = s.report_start and f.report_end = s.report_end
  left join alive a on f.restaurant = a.restaurant and f.article_code = a.article_code and f.report_start = a.report_start and f.report_end = a.report_end
  where f.restaurant is not null and f.article_code is not null and f.report_start is not null and f.report_end is not null),
everything as (
  select table_name, table_name || '.article_code' as reference, period, reason, 'direct' as origin from direct
  union all
  select 'features_article_period', 'features_article_period.sales', period, case when unsold then 'missing' else 'orphaned_parent' end, case when unsold then 'direct' else 'inherited' end
  from features where unsold or dead)
select table_name, reference, period, reason, origin, count(*) as orphans from everything group by all
"""

# ---------------------------------------------------------------------------------------------- problem 4


def _zones(spark: SparkSession, d: str, key: str) -> DataFrame:
    return broadcast_if_small(table(spark, d, "locales").where(F.col(key).isNotNull()).groupBy(key).agg(F.max("timezone").alias("zone")))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """The written values of the three fields as one table; a file belongs to its table."""
    r = table(spark, d, "reservas").join(_zones(spark, d, "restaurant"), "restaurant", "left")
    e = table(spark, d, "eventos").join(_zones(spark, d, "event_location"), "event_location", "left")
    m = table(spark, d, "meteo_horaria")
    files = m.groupBy("source_file").agg(F.mode("timezone", True).alias("file_zone"))
    m = m.join(broadcast_if_small(files), "source_file", "left")

    def part(df: DataFrame, name: str, row_id: str, value: str, zone: F.Column, position: F.Column, hint: F.Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), F.col(value).alias("value"), F.concat_ws("/", F.lit(name), "source_file").alias("file"),
            zone.alias("zone"), position.cast("long").alias("position"), hint.cast("long").alias("hint"),
        )

    none = F.lit(None)
    return (
        part(r, "reservas", "reserva_id", "created_datetime", F.col("zone"), none, F.unix_date("reservation_date"))
        .unionByName(part(e, "eventos", "evento_row_id", "date", F.col("zone"), none, F.unix_date("event_start") + F.coalesce(F.col("event_day_number"), F.lit(1)) - 1))
        .unionByName(part(m, "meteo_horaria", "mh_id", "time", F.coalesce("timezone", "file_zone"), F.col("row_no"), none))
    )


def p4_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the three fields with its status, and its normal form if it has one."""
    out = normalise(_typed(spark, d), Typed("value", "row_id", "file", "zone", "position", ("table_name",)), F.col("hint")).where("value is not null")
    form = F.when(F.col("table_name") == "eventos", F.col("local_day").cast("string")).otherwise(instant_text(F.col("utc_seconds")))
    return out.select("table_name", "row_id", "value", form.alias("normal_form"), F.col("time_status").alias("status"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_normalised(spark, d).where("value <> normal_form").select("table_name", "row_id", "normal_form")


_MONTH_ROWS = ", ".join(f"('{w}', {k})" for k, names in MONTHS.items() for w in names)
_ZONE_ROWS = ", ".join(f"('{a}', {h * 3600})" for a, h in ABBREVIATIONS.items())
_CLOCK = r"^(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,]\d+)?)?(?: ?([ap])\.? ?m\.?)?(?: ?h)?(?: ?(z|[+-]\d{2}:?\d{2}|[a-z]{3,4}|[a-z]+/[a-z_]+))?$"
_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?:,? (.*))?$"
P4_STEPS_SQL = f"""
with months(word, n) as (values {_MONTH_ROWS}), zones(abbr, secs) as (values {_ZONE_ROWS}),
vals as (
  select 'reservas' as table_name, reserva_id as row_id, created_datetime as v, source_file as file, l.timezone as zone, null::bigint as pos from reservas r left join (select restaurant, max(timezone) as timezone from locales group by 1) l using (restaurant)
  union all select 'eventos', evento_row_id, date, source_file, l.timezone, null from eventos e left join (select event_location, max(timezone) as timezone from locales group by 1) l using (event_location)
  union all select 'meteo_horaria', mh_id, time, source_file, coalesce(m.timezone, f.tz), row_no from meteo_horaria m left join (select source_file, max(timezone) as tz from meteo_horaria group by 1) f using (source_file)),
flat as (select *, trim(regexp_replace(strip_accents(lower(v)), '\\s+', ' ', 'g')) as t from vals where v is not null),
orders as (
  select table_name, file, count(*) filter (try_cast(regexp_extract(t, '{_LAST}', 1) as int) > 12) as da, count(*) filter (try_cast(regexp_extract(t, '{_LAST}', 2) as int) > 12) as mb from flat where regexp_matches(t, '{_LAST}') group by 1, 2),
shape as (
  select f.*, coalesce(mb > da, false) as mf,
    case when regexp_matches(t, '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}([t ]|$)') then 1 when regexp_matches(t, '^\\d{{8}}(t?\\d{{6}}z?)?$') then 2 when regexp_matches(t, '{_LAST}') then 3
      when regexp_matches(t, '^\\d{{1,2}} (de )?[a-z]+ (de )?\\d{{4}}') then 4 when regexp_matches(t, '^(\\d{{10}}|\\d{{13}})$') then 5 when regexp_matches(t, '^\\d{{5}}([.]\\d+)?$') then 6 end as f
  from flat f left join orders o on o.table_name = f.table_name and o.file = f.file),
cut as (
  select *, case f when 1 then regexp_extract(t, '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}[t ](.*)$', 1) when 2 then case when length(t) > 8 then regexp_replace(regexp_extract(t, '^\\d{{8}}t?(.*)$', 1), '^(..)(..)(..)', '\\1:\\2:\\3') else '' end
      when 3 then regexp_extract(t, '{_LAST}', 4) when 4 then regexp_extract(t, '^\\d{{1,2}} (?:de )?[a-z]+ (?:de )?\\d{{4}},? ?(.*)$', 1) end as c,
    case f when 1 then [regexp_extract(t, '^(\\d+)', 1), regexp_extract(t, '^\\d+[-/.](\\d+)', 1), regexp_extract(t, '^\\d+[-/.]\\d+[-/.](\\d+)', 1)] when 2 then [t[1:4], t[5:6], t[7:8]]
      when 3 then [case when length(regexp_extract(t, '{_LAST}', 3)) = 2 then '20' else '' end || regexp_extract(t, '{_LAST}', 3), case when mf then regexp_extract(t, '{_LAST}', 1) else regexp_extract(t, '{_LAST}', 2) end, case when mf then regexp_extract(t, '{_LAST}', 2) else regexp_extract(t, '{_LAST}', 1) end]
      when 4 then [regexp_extract(t, '(\\d{{4}})', 1), (select cast(n as varchar) from months where word = regexp_extract(t, '^\\d+ (?:de )?([a-z]+)', 1)), regexp_extract(t, '^(\\d+)', 1)] end as ymd
  from shape),
timed as (
  select *, try_cast(lpad(ymd[1], 4, '0') || '-' || lpad(ymd[2], 2, '0') || '-' || lpad(ymd[3], 2, '0') as date) as day, coalesce(c, '') = '' or regexp_matches(c, '{_CLOCK}') as fits,
    try_cast(regexp_extract(c, '{_CLOCK}', 1) as int) as h0, coalesce(try_cast(regexp_extract(c, '{_CLOCK}', 2) as int), 0) as mi, coalesce(try_cast(regexp_extract(c, '{_CLOCK}', 3) as int), 0) as se, regexp_extract(c, '{_CLOCK}', 4) as half, coalesce(regexp_extract(c, '{_CLOCK}', 5), '') as z
  from cut),
walled as (
  select *, case when f = 6 then round((t::double - 25569) * 86400)::bigint when f < 5 and fits and day is not null and hh between 0 and 23 and mi < 60 and se < 60 then epoch(day::timestamp)::bigint + hh * 3600 + mi * 60 + se end as wall
  from (select *, case when coalesce(half, '') = '' then coalesce(h0, 0) when h0 between 1 and 12 then h0 % 12 + case when half = 'p' then 12 else 0 end else 99 end as hh from timed)),
zoned as (
  select w.*, secs, case when z like '%/%' then array_to_string(list_transform(string_split(z, '/'), lambda x: upper(x[1]) || x[2:]), '/') else zone end as lz,
    case when regexp_matches(z, '^[+-]') then (substr(replace(z, ':', ''), 2, 2)::int * 3600 + substr(replace(z, ':', ''), 4, 2)::int * 60) * case when z like '-%' then -1 else 1 end end as off from walled w left join zones on abbr = z),
guess as (select *, epoch(timezone(lz, to_timestamp(wall)::timestamptz at time zone 'UTC'))::bigint as g from zoned),
fixed as (
  select *, case when epoch(timezone(lz, to_timestamp(g - 3600)))::bigint = wall then g - 3600 else g end as first_utc from guess),
utc as (
  select *, f = 5 or z <> '' as stated, case when f = 5 then case when length(t) = 13 then t::bigint // 1000 else t::bigint end when secs is not null then wall - secs when off is not null then wall - off when z = '' or z like '%/%' then first_utc end as u from fixed),
shown as (select *, case when stated then epoch(timezone(zone, to_timestamp(u)))::bigint else wall end as seen_at from utc),
placed as (select *, min(case when u is not null then pos end) over (partition by table_name, file, zone, seen_at) as low, max(case when u is not null then pos end) over (partition by table_name, file, zone, seen_at) as high from shown),
final as (
  select *, case when table_name = 'meteo_horaria' and not stated and high > low and pos = high and epoch(timezone(zone, to_timestamp(u + 3600)))::bigint = wall then u + 3600 else u end as uu from placed)
"""
P4_NORMALISED_SQL = P4_STEPS_SQL + """
select table_name, row_id, v as value, case when table_name = 'eventos' then strftime(case when stated then timezone(zone, to_timestamp(uu)) when u is not null then to_timestamp(wall) at time zone 'UTC' end, '%Y-%m-%d')
  else strftime(to_timestamp(uu) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') end as normal_form,
  case when f is null or (f < 5 and not fits) or (f = 4 and ymd[2] is null) then 'unreadable' when f <> 5 and wall is null then 'out_of_range' when u is null then 'zone_unknown' else 'normal' end as status from final
"""
P4_FOUND_SQL = f"select table_name, row_id, normal_form from ({P4_NORMALISED_SQL}) where value <> normal_form"

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_normalised": p4_normalised}
SQL = {"p2_found": P2_FOUND_SQL, "p3_found": P3_FOUND_SQL, "p3_report": P3_REPORT_SQL, "p4_found": P4_FOUND_SQL, "p4_normalised": P4_NORMALISED_SQL}

# ---------------------------------------------------------------------------------------------- problem 1

_TICKETS, _MONEY = "num_tickets", "facturacion"


#: A restaurant's revenue a ticket is taken for fixed if it deviates by at most this share of its mean.
_RATIO_WITHIN = 0.1


def _daily_rules() -> tuple[list[Dependency], list[Fallback]]:
    """Candidates and fallbacks for the days of restaurants.

    The same day loaded again; the revenue a ticket by restaurant and weekday, or by restaurant, which gives
    either measure from the other; the measure itself by restaurant and weekday. Then plain group means.
    """
    dependencies, fallbacks = [], []
    for target, other in ((_TICKETS, _MONEY), (_MONEY, _TICKETS)):
        good = {c: F.when(F.col(f"{c}__reason").isNull() & (F.col(c) > 0), F.col(c).cast("double")) for c in (target, other)}
        known = F.when(F.col(f"{other}__reason").isNull(), F.col(other).cast("double"))
        tidy = (lambda c: F.round(c)) if target == _TICKETS else (lambda c: F.round(c, 2))
        back = lambda ratio, known=known, tidy=tidy: tidy(known * ratio)
        dependencies.append(Dependency(target, ("restaurant", "date")))
        dependencies += [Dependency(target, det, good[target] / good[other], back, _RATIO_WITHIN, f"{target}/{other}", good[other]) for det in (("restaurant", "day_name"), ("restaurant",))]
        dependencies.append(Dependency(target, ("restaurant", "day_name"), good[target], tidy, _RATIO_WITHIN))
        mean = F.avg(F.when(F.col(f"{target}__reason").isNull(), F.col(target).cast("double")))
        groups = (("restaurant_weekday", ("restaurant", "day_name")), ("restaurant", ("restaurant",)), ("date", ("date",)), ("all", ()))
        fallbacks += [Fallback(target, name, group, mean, tidy) for name, group in groups]
    return dependencies, fallbacks


def _fill_daily(rows: DataFrame) -> DataFrame:
    return fill(rows, (_TICKETS, _MONEY), *_daily_rules())


def _daily_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "maestra_diaria").select("diaria_id", "restaurant", "date", "day_name", _TICKETS, _MONEY)
    return keep(usable_pair(rows, "restaurant", _TICKETS, _MONEY))


#: Rows of a file that lie in one block of so many share their distance between place and day, but for absent
#: days; a second set of blocks lies half a block further.
_ROW_BLOCKS = (4, 8, 16)
_BLOCKS = {f"block_{n}{'_shifted' * h}": (n, h * n // 2) for n in _ROW_BLOCKS for h in (0, 1)}


def _weather_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "meteo_diaria").select("md_id", "source_file", "row_no", "date")
    return keep(usable_day(rows, "source_file", "date").withColumns({b: F.floor((F.col("row_no") + ahead) / n) for b, (n, ahead) in _BLOCKS.items()}))


def _weather_rules() -> tuple[list[Dependency], list[Fallback]]:
    """A row delivered again, and the distance between day and place by file and block; then its mean by block and file."""
    offset = F.when(F.col("date__reason").isNull(), F.unix_date("date") - F.col("row_no"))
    place = lambda entry: F.date_from_unix_date((F.col("row_no") + F.round(entry)).cast("int"))
    dependencies = [Dependency("date", ("source_file", "row_no"))] + [Dependency("date", ("source_file", b), offset, place, label="date-row_no") for b in _BLOCKS]
    groups = (("place_in_16", ("source_file", "block_16")), ("place_in_file", ("source_file",)))
    return dependencies, [Fallback("date", name, group, F.avg(offset), place) for name, group in groups]


def _fill_weather(rows: DataFrame) -> DataFrame:
    return fill(rows, ("date",), *_weather_rules())


def _long(df: DataFrame, name: str, row_id: str, targets: tuple[str, ...]) -> DataFrame:
    each = [
        F.when(F.col(f"{t}__reason").isNotNull(), F.struct(F.lit(t).alias("field_name"), F.col(f"{t}__reason").alias("reason"), F.col(f"{t}__filled_value").cast("string").alias("filled_value"), F.col(f"{t}__source").alias("source"), F.col(f"{t}__filled").alias("filled")))
        for t in targets
    ]
    lost = df.where(" or ".join(f"`{t}__reason` is not null" for t in targets))
    return lost.select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*each))).alias("x")).select("table_name", "row_id", "x.*")


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every missing value with its reason, the value filled in, and where that came from."""
    days = _long(_fill_daily(_daily_rows(spark, d)), "maestra_diaria", "diaria_id", (_TICKETS, _MONEY))
    return days.unionByName(_long(_fill_weather(_weather_rows(spark, d)), "meteo_diaria", "md_id", ("date",)))


def p1_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with its groups and violations, whether it holds, and how many values it filled."""
    out = []
    for name, rows, (dependencies, _), fill_rows in (("maestra_diaria", _daily_rows(spark, d), _daily_rules(), _fill_daily), ("meteo_diaria", _weather_rows(spark, d), _weather_rules(), _fill_weather)):
        targets = tuple(dict.fromkeys(x.target for x in dependencies))
        ids = "diaria_id" if name == "maestra_diaria" else "md_id"
        used = _long(fill_rows(rows), name, ids, targets).groupBy("field_name", "source").agg(F.count(F.lit(1)).alias("filled"))
        said = [(name, e.dependency.target, e.dependency.name, e.dependency.within, e.groups, e.violations, e.holds(0.05)) for e in mine(rows, dependencies)[2]]
        facts = spark.createDataFrame(said, "table_name string, field_name string, source string, within double, groups long, violations long, holds boolean")
        out.append(facts.join(used, ["field_name", "source"], "left").fillna(0, ["filled"]))
    return out[0].unionByName(out[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The values that were filled, and those for which no similar record gave one."""
    rows = p1_filled(spark, d).withColumn("unfillable", F.col("source") == "none")
    return rows.where("filled or unfillable").select("table_name", "row_id", "field_name")


_P1_REASONS_SQL = f"""
pair as (
  select *, case when isnan(facturacion) then null else facturacion end as money from maestra_diaria),
mid as (
  select restaurant, median(num_tickets) filter (num_tickets > 0) as mt, median(money) filter (money > 0) as mm from pair group by restaurant),
own as (
  select p.*, (num_tickets is null or num_tickets < 0 or coalesce(num_tickets > 0 and num_tickets >= {ABSURD_FACTOR} * mt, false)) as bad_t,
    (money is null or money < 0 or coalesce(money > 0 and money >= {ABSURD_FACTOR} * mm, false)) as bad_m
  from pair p left join mid using (restaurant)),
reasons as (
  select *, bad_t or (num_tickets = 0 and not bad_m and money > 0) as lost_t, bad_m or (money = 0 and not bad_t and num_tickets > 0) as lost_m from own)
"""
P1_FOUND_SQL = f"""
with {_P1_REASONS_SQL},
files as (
  select source_file, median(date - date '1970-01-01') as mid from meteo_diaria where date not in ({', '.join(f"date '{x}'" for x in STAND_IN_DAYS)}) group by source_file)
select 'maestra_diaria' as table_name, diaria_id as row_id, 'num_tickets' as field_name from reasons where lost_t
union all select 'maestra_diaria', diaria_id, 'facturacion' from reasons where lost_m
union all select 'meteo_diaria', md_id, 'date' from meteo_diaria m left join files f using (source_file)
where date is null or date in ({', '.join(f"date '{x}'" for x in STAND_IN_DAYS)}) or abs((date - date '1970-01-01') - mid) > {ABSURD_DAYS}
"""

def _candidate_sql(i: int, rows: str, ids: str, target: str, determinant: tuple[str, ...], of: str, value: str, within: float, name: str, weight: str = "1") -> str:
    """The dictionary of a candidate, its evidence, and what it offers to the rows without ``target`` if it holds."""
    det = ", ".join(determinant)
    entry, apart = (f"sum({of} * {weight}) / sum(case when {of} is not null then {weight} end)", f"stddev_samp({of}) > {within} * abs(avg({of}))") if within else (f"min({of})", f"min({of}) <> max({of})")
    known = " and ".join(f"{c} is not null" for c in determinant)
    return f"""
d{i} as (select {det}, count({of}) as n, {entry} as entry, coalesce({apart}, false) as apart from {rows} where {known} group by {det}),
e{i} as (select count(*) filter (n > 1) as g, count(*) filter (n > 1 and apart) as v from d{i}),
c{i} as (
  select {ids} as row_id, '{target}' as field_name, {within}::double as within, v / g::double as rate, -g as fewer, {i} as i, '{name}' as source, {value} as val
  from {rows} join d{i} using ({det}), e{i} where lost_{target} and g > 0 and v <= 0.05 * g and not apart and n > 0)"""


def _fallback_sql(i: int, rows: str, ids: str, target: str, group: tuple[str, ...], statistic: str, value: str, name: str) -> str:
    by = ", ".join(group)
    table = f"(select {by}, {statistic} as entry from {rows} where {' and '.join(f'{c} is not null' for c in group)} group by {by})" if group else f"(select {statistic} as entry from {rows})"
    return f"""
c{i} as (
  select {ids} as row_id, '{target}' as field_name, 9.0::double as within, {i}::double as rate, 0 as fewer, {i} as i, 'group:{name}' as source, {value} as val
  from {rows} join {table} s {f'using ({by})' if group else 'on true'} where lost_{target})"""


def _p1_filled_sql() -> str:
    """The candidates and fallbacks of both tables, judged by their evidence in SQL; the best offer a value fills it."""
    parts, i = [], 0

    def add(make, *args) -> None:
        nonlocal i
        parts.append(make(i, *args))
        i += 1

    for target, other in ((_TICKETS, _MONEY), (_MONEY, _TICKETS)):
        digits = "0" if target == _TICKETS else "2"
        shown = (lambda x, d=digits: f"cast(cast(round({x}, {d}) as bigint) as varchar)" if d == "0" else f"cast(round({x}, {d}) as varchar)")
        plain = "cast(cast(entry as bigint) as varchar)" if target == _TICKETS else "cast(entry as varchar)"
        good, known = f"case when not lost_{target} then v_{target} end", f"case when not lost_{other} then v_{other} end"
        ratio = f"case when not lost_{target} and v_{target} > 0 and not lost_{other} and v_{other} > 0 then v_{target} / v_{other} end"
        add(_candidate_sql, "days", "diaria_id", target, ("restaurant", "date"), good, plain, 0.0, "fd:restaurant+date")
        for det in (("restaurant", "day_name"), ("restaurant",)):
            add(_candidate_sql, "days", "diaria_id", target, det, ratio, shown(f"({known}) * entry"), _RATIO_WITHIN, f"fd:{'+'.join(det)}->{target}/{other}", f"v_{other}")
        add(_candidate_sql, "days", "diaria_id", target, ("restaurant", "day_name"), f"case when not lost_{target} and v_{target} > 0 then v_{target} end", shown("entry"), _RATIO_WITHIN, "fd:restaurant+day_name")
        for name, group in (("restaurant_weekday", ("restaurant", "day_name")), ("restaurant", ("restaurant",)), ("date", ("date",)), ("all", ())):
            add(_fallback_sql, "days", "diaria_id", target, group, f"avg({good})", shown("entry"), name)
    days = i
    offset, place = "case when not lost_date then (date - date '1970-01-01') - row_no end", "cast(date '1970-01-01' + cast(row_no + round(entry) as int) as varchar)"
    add(_candidate_sql, "weather", "md_id", "date", ("source_file", "row_no"), "case when not lost_date then date end", "cast(entry as varchar)", 0.0, "fd:source_file+row_no")
    for b in _BLOCKS:
        add(_candidate_sql, "weather", "md_id", "date", ("source_file", b), offset, place, 0.0, f"fd:source_file+{b}->date-row_no")
    for name, group in (("place_in_16", ("source_file", "block_16")), ("place_in_file", ("source_file",))):
        add(_fallback_sql, "weather", "md_id", "date", group, f"avg({offset})", place, name)
    offers = " union all ".join(f"select '{'maestra_diaria' if k < days else 'meteo_diaria'}' as table_name, * from c{k} where val is not null" for k in range(i))
    blocks = ", ".join(f"(row_no + {ahead}) // {n} as {b}" for b, (n, ahead) in _BLOCKS.items())
    stand_ins = ", ".join(f"date '{x}'" for x in STAND_IN_DAYS)
    return f"""
with {_P1_REASONS_SQL},
days as (
  select *, num_tickets::double as v_num_tickets, money as v_facturacion, lost_t as lost_num_tickets, lost_m as lost_facturacion,
    case when num_tickets is null then 'null' when num_tickets < 0 then 'impossible' when bad_t then 'absurd' else 'contradicted' end as why_num_tickets,
    case when facturacion is null then 'null' when isnan(facturacion) then 'nan' when facturacion < 0 then 'impossible' when bad_m then 'absurd' else 'contradicted' end as why_facturacion from reasons),
files as (select source_file, median(date - date '1970-01-01') as mid from meteo_diaria where date not in ({stand_ins}) group by source_file),
weather as (
  select md_id, source_file, row_no, date, {blocks}, case when date is null then 'null' when date in ({stand_ins}) then 'stand_in' when abs((date - date '1970-01-01') - mid) > {ABSURD_DAYS} then 'absurd' end as why_date, why_date is not null as lost_date
  from meteo_diaria left join files using (source_file)),
{','.join(parts)},
offers as ({offers}),
best as (select table_name, row_id, field_name, arg_min(val, (within, rate, fewer, i)) as filled_value, arg_min(source, (within, rate, fewer, i)) as source from offers group by 1, 2, 3),
wanted as (
  select 'maestra_diaria' as table_name, diaria_id as row_id, 'num_tickets' as field_name, why_num_tickets as reason from days where lost_num_tickets
  union all select 'maestra_diaria', diaria_id, 'facturacion', why_facturacion from days where lost_facturacion
  union all select 'meteo_diaria', md_id, 'date', why_date from weather where lost_date)
select w.*, b.filled_value, coalesce(b.source, 'none') as source, b.filled_value is not null as filled from wanted w left join best b using (table_name, row_id, field_name)
"""


# ---------------------------------------------------------------------------------------------- problem 5


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.footers(drift.readable(table(spark, d, "crudos")))).select("feed", "source_file", "field_name", "change_kind")


_ALIAS_ROWS = ", ".join(f"('{d}', '{n}', '{c}')" for d, fields in drift.ALIASES.items() for c, names in fields.items() for n in names)
P5_FOUND_SQL = f"""
with aliases(dataset, field, canon) as (values {_ALIAS_ROWS}),
good as (select * from crudos where json_valid(payload) and json_type(payload) = 'OBJECT' and feed is not null and source_file is not null and file_date is not null),
firsts as (select * from good qualify received_at is not distinct from min(received_at) over (partition by feed, source_file)),
keyed as (select dataset, feed, source_file, file_date, payload, unnest(json_keys(payload)) as k from firsts),
shaped as (
  select dataset, feed, source_file, file_date, nullif(regexp_replace(regexp_replace(strip_accents(lower(k)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') as field,
    case json_type(payload, '$."' || k || '"') when 'NULL' then null when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' else 'number' end as kind from keyed),
counted as (select dataset, feed, source_file, file_date, field, kind, count(*) as n from shaped where field is not null group by all),
foot as (select dataset, feed, source_file, file_date, field, arg_max(kind, (n, kind)) filter (kind is not null) as kind from counted group by 1, 2, 3, 4, 5),
files as (select feed, source_file, row_number() over (partition by feed order by file_date, source_file) as no from (select distinct feed, source_file, file_date from foot)),
lines as (select f.dataset, f.feed, f.field, f.kind, no, coalesce(canon, f.field) as line from foot f join files using (feed, source_file) left join aliases a on a.dataset = f.dataset and a.field = f.field),
born as (select *, coalesce(lag(no) over w <> no - 1, true) as born, lag(field) over w as before, coalesce(lead(no) over w <> no + 1, true) as ends from lines window w as (partition by dataset, feed, line order by no)),
lives as (select *, sum(born::int) over (partition by dataset, feed, line order by no) as life from born),
kinds as (select *, last_value(kind ignore nulls) over (partition by dataset, feed, line, life order by no rows between unbounded preceding and 1 preceding) as was from lives),
events as (
  select feed, no, field, 'added' as change_kind from kinds where born and no > 1
  union all select feed, no, field, 'renamed' from kinds where not born and before <> field
  union all select feed, no, field, 'retyped' from kinds where not born and kind <> was
  union all select feed, no + 1, field, 'removed' from kinds where ends)
select feed, source_file, field as field_name, change_kind from events join files using (feed, no)
"""


def p5_ventas(spark: SparkSession, d: str) -> DataFrame:
    """The sales records of all files as one table."""
    return drift.consistent(drift.records(table(spark, d, "crudos")), "ventas")


def p5_eventos(spark: SparkSession, d: str) -> DataFrame:
    """The event records of all files as one table."""
    return drift.consistent(drift.records(table(spark, d, "crudos")), "eventos")


def _columns(df: DataFrame) -> DataFrame:
    """The columns of the one table, and which fields went to ``other``."""
    return df.withColumn("other_names", F.array_join(F.sort_array(F.map_keys("other")), "+")).drop("other")


def p5_ventas_columns(spark: SparkSession, d: str) -> DataFrame:
    return _columns(p5_ventas(spark, d))


def p5_eventos_columns(spark: SparkSession, d: str) -> DataFrame:
    return _columns(p5_eventos(spark, d))


def _one_table_sql(dataset: str) -> str:
    """One table of a dataset in SQL, from the same alias table and casts."""
    rows = ", ".join(f"('{n}', '{c}', {i})" for c, names in drift.ALIASES[dataset].items() for i, n in enumerate(names))
    words = " ".join(f"when '{w}' then {v}" for w, v in drift.WORD_NUMBERS.items())
    plain = "case when nc > 0 and (np = 0 or lc < lp) then replace(replace(bare, '.', ''), ',', '.') when nc > 0 or np > 1 then replace(bare, ',', '') else bare end"
    cast = {
        "text": "nullif(trim(t), '')", "long": "case when regexp_full_match(trim(t), '[+-]?\\d+') then try_cast(trim(t) as bigint) end", "day": "try_cast(trim(t) as date)",
        "number": f"coalesce(try_cast(nullif({plain}, '') as double), case trim(lower(t)) {words} end)",
    }
    kinds = drift.CASTS[dataset]
    fits = " ".join(f"when '{c}' then {cast[k]} is not null" for c, k in kinds.items())
    return f"""
with aliases(name, canon, rank) as (values {rows}),
good as (select * from crudos where json_valid(payload) and json_type(payload) = 'OBJECT' and feed is not null and source_file is not null and file_date is not null),
firsts as (select * from good qualify received_at is not distinct from min(received_at) over (partition by feed, source_file)),
recs as (select feed, source_file, cast(file_date as date) as file_date, min(line_no) as line_no, payload, row_number() over () as id from firsts where dataset = '{dataset}' group by feed, source_file, file_date, payload),
keys as (select id, payload, unnest(json_keys(payload)) as k from recs),
fields as (
  select id, k, nullif(regexp_replace(regexp_replace(strip_accents(lower(k)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') as name, json_type(payload, '$."' || k || '"') as kind, json_extract(payload, '$."' || k || '"') as j from keys),
texts as (
  select f.*, a.canon, a.rank, kind in ('OBJECT', 'ARRAY') as wrapped,
    case kind when 'OBJECT' then coalesce(json_extract_string(j, '$.valor'), json_extract_string(j, '$.es'), json_extract_string(j, '$.cod'), json_extract_string(j, '$.nombre')) when 'ARRAY' then json_extract_string(j, '$[0]') else json_extract_string(j, '$') end as t
  from fields f left join aliases a using (name) where kind <> 'NULL'),
best as (select *, row_number() over (partition by id, canon order by rank, k) = 1 and canon is not null as chosen from texts where t is not null),
bared as (select *, regexp_replace(lower(t), '[^0-9,.\\-]', '', 'g') as bare from best),
counted as (select *, length(regexp_replace(bare, '[^,]', '', 'g')) as nc, length(regexp_replace(bare, '[^.]', '', 'g')) as np, instr(reverse(bare), ',') as lc, instr(reverse(bare), '.') as lp from bared),
judged as (select *, case canon {fits} end as fits from counted),
kept as (select id, {', '.join(f"max({cast[k]}) filter (chosen and canon = '{c}') as {c}" for c, k in kinds.items())} from judged group by id),
rest as (select t.id, t.name from texts t left join judged j on j.id = t.id and j.k = t.k where not coalesce(j.chosen and not j.wrapped and (j.fits or trim(j.t) = ''), false)),
others as (select id, string_agg(name, '+' order by name) as other_names from rest group by id)
select r.feed, r.source_file, r.file_date, r.line_no, {', '.join(f'k.{c}' for c in kinds)}, coalesce(o.other_names, '') as other_names from recs r left join kept k using (id) left join others o using (id)
"""


# ---------------------------------------------------------------------------------------------- problem 6

_ENTITY, _ATTRIBUTES = ["restaurant", "article_code"], ["article_name", "department_code", "department_name"]


_TEXTS = ("article_name", "department_name")


def _compared() -> dict[str, F.Column]:
    return {c: fold(F.col(c)) for c in _TEXTS}


def _sales_store(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoints and patches of all articles, written and read from the shared folder."""
    told = lambda c: F.when(F.col(c).rlike(r"[^\p{Z}\s\u200B\uFEFF\p{M}]"), F.col(c)).alias(c)
    rows = table(spark, d, "ventas").where("report_start is not null and report_end is not null and report_end >= report_start").select(
        *_ENTITY, "report_start", "report_generated_on", "venta_id", "department_code", *[told(c) for c in _TEXTS]
    )
    snaps = snapshots(rows, _ENTITY, "report_start", _ATTRIBUTES, ["report_generated_on", "venta_id"])
    return write_store(delta_store(snaps, _ENTITY, "report_start", _ATTRIBUTES, _compared()), shared_path(spark, "history"))


def p6_history(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every article of a restaurant with the days it was valid."""
    return reconstruct(_sales_store(spark, d), _ENTITY, _ATTRIBUTES, _compared()).withColumn("changed", F.array_join("changed", "+"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The versions, folded from the store, that differ from the one before."""
    rows = reconstruct(_sales_store(spark, d), _ENTITY, _ATTRIBUTES, _compared()).where(F.size("changed") > 0)
    return rows.select("restaurant", "article_code", F.col("valid_from").cast("string").alias("valid_from"))


_FOLD = lambda c: f"nullif(trim(regexp_replace(strip_accents(lower({c})), '\\s+', ' ', 'g')), '')"
_P6_SQL = f"""
with rows as (
  select restaurant, article_code, report_start, report_generated_on as g, venta_id as i, department_code as dc,
    case when {_FOLD('article_name')} is not null then article_name end as an, case when {_FOLD('department_name')} is not null then department_name end as dn
  from ventas where restaurant is not null and article_code is not null and report_start is not null and report_end >= report_start),
snaps as (
  select restaurant, article_code, report_start, arg_max(an, (g, i)) filter (an is not null) as an, arg_max(dc, (g, i)) filter (dc is not null) as dc, arg_max(dn, (g, i)) filter (dn is not null) as dn
  from rows group by all),
cmp as (select *, {_FOLD('an')} as can, {_FOLD('dn')} as cdn from snaps),
was as (
  select *, last_value(can ignore nulls) over w as wan, last_value(dc ignore nulls) over w as wdc, last_value(cdn ignore nulls) over w as wdn,
    last_value(an ignore nulls) over u as fan, last_value(dc ignore nulls) over u as fdc, last_value(dn ignore nulls) over u as fdn,
    row_number() over u as seen
  from cmp window w as (partition by restaurant, article_code order by report_start rows between unbounded preceding and 1 preceding),
    u as (partition by restaurant, article_code order by report_start rows between unbounded preceding and current row)),
marked as (
  select *, coalesce(can <> wan, false) as man, coalesce(dc <> wdc, false) as mdc, coalesce(cdn <> wdn, false) as mdn,
    (can is not null and wan is null) or (dc is not null and wdc is null) or (cdn is not null and wdn is null) as fresh from was)
"""
P6_FOUND_SQL = _P6_SQL + "select restaurant, article_code, cast(report_start as varchar) as valid_from from marked where man or mdc or mdn"

P6_HISTORY_SQL = _P6_SQL.rstrip() + """,
touched as (
  select *, man or (can is not null and wan is null) as tan, mdc or (dc is not null and wdc is null) as tdc, mdn or (cdn is not null and wdn is null) as tdn from marked),
kept as (
  select *, last_value(case when tan then an end ignore nulls) over u as article_name, last_value(case when tdc then dc end ignore nulls) over u as department_code, last_value(case when tdn then dn end ignore nulls) over u as department_name
  from touched window u as (partition by restaurant, article_code order by report_start rows between unbounded preceding and current row))
select restaurant, article_code, report_start as valid_from, lead(report_start) over (partition by restaurant, article_code order by report_start) - 1 as valid_to,
  row_number() over (partition by restaurant, article_code order by report_start) - 1 as version,
  concat_ws('+', case when man then 'article_name' end, case when mdc then 'department_code' end, case when mdn then 'department_name' end) as changed, article_name, department_code, department_name
from kept where tan or tdc or tdn or seen = 1
"""

# ---------------------------------------------------------------------------------------------- problem 7


def _daily_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "maestra_diaria").select("diaria_id", "restaurant", "date", _TICKETS, _MONEY, "loaded_at").where("restaurant is not null and date is not null")
    rows = usable_pair(rows, "restaurant", _TICKETS, _MONEY)
    good = {c: F.when(F.col(f"{c}__reason").isNull(), F.col(c)) for c in (_TICKETS, _MONEY)}
    return latest_versions(rows.withColumns(good), ["restaurant", "date"], ["loaded_at", "diaria_id"], [_TICKETS, _MONEY])


def _periods_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "features_article_period").select("fap_id", "restaurant", "article_code", "report_start", "report_end", "loaded_at", F.nanvl("units", F.lit(None).cast("double")).alias("units"))
    rows = rows.where("restaurant is not null and article_code is not null and report_end is not null")
    return latest_versions(rows, ["restaurant", "article_code", "report_start", "report_end"], ["loaded_at", "fap_id"], ["units"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    out = []
    days = trailing_sums(_daily_latest(spark, d), ["restaurant"], "date", {"active": (F.col(_TICKETS) > 0).cast("long")}, [7, 30])
    for w in (7, 30):
        out.append(_idle(days.withColumn("article_code", F.lit(0).cast("long")), "maestra_diaria", w))
    periods = trailing_sums(_periods_latest(spark, d), ["restaurant", "article_code"], "report_end", {"active": (F.col("units") > 0).cast("long")}, [30])
    out.append(_idle(periods, "features_article_period", 30))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _idle(sums: DataFrame, name: str, window: int) -> DataFrame:
    keys = ["restaurant", "article_code"]
    return unfold(sums, keys, [f"active_{window}"]).where(F.col(f"active_{window}") == 0).select(
        F.lit(name).alias("table_name"), *keys, F.col("on_day").cast("string").alias("on_day"), F.lit(window).alias("window_days")
    )


def p7_daily(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages per calendar day of tickets and revenue of a restaurant over the last 7 and 30 days, for every day."""
    measures = {"tickets": F.col(_TICKETS).cast("long"), "revenue": F.col(_MONEY), "usable": F.col(_TICKETS).isNotNull().cast("long")}
    names = [f"{m}_{w}" for m in measures for w in (7, 30)]
    rows = unfold(trailing_sums(_daily_latest(spark, d), ["restaurant"], "date", measures, [7, 30]), ["restaurant"], names)
    return rows.select(
        "restaurant", "on_day", *[F.col(f"tickets_{w}") for w in (7, 30)], *[F.round(f"revenue_{w}", 2).alias(f"revenue_{w}") for w in (7, 30)],
        *[F.col(f"usable_{w}") for w in (7, 30)], *[F.round(F.col(f"{m}_{w}") / w, 4).alias(f"{m}_avg_{w}") for m in ("tickets", "revenue") for w in (7, 30)],
    )


def p7_articles(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages per calendar day of an article's units in a restaurant over the last 7 and 30 days, for every day."""
    keys = ["restaurant", "article_code"]
    rows = unfold(trailing_sums(_periods_latest(spark, d), keys, "report_end", {"units": F.col("units")}, [7, 30]), keys, ["units_7", "units_30"])
    return rows.select(*keys, "on_day", "units_7", "units_30", *[F.round(F.col(f"units_{w}") / w, 4).alias(f"units_avg_{w}") for w in (7, 30)])


_P7_SQL = f"""
with {_P1_REASONS_SQL},
daily as (
  select restaurant, date as on_day, case when not lost_t then num_tickets end as tickets, case when not lost_m then money end as revenue from reasons
  where restaurant is not null and date is not null qualify row_number() over (partition by restaurant, date order by loaded_at desc nulls last, diaria_id desc) = 1),
periods as (
  select restaurant, article_code, report_end as on_day, case when isnan(units) then null else units end as units from features_article_period
  where restaurant is not null and article_code is not null and report_end is not null
  qualify row_number() over (partition by restaurant, article_code, report_start, report_end order by loaded_at desc nulls last, fap_id desc) = 1),
booked as (select restaurant, article_code, on_day, sum(units) as units, count(*) filter (units > 0) as active from periods group by all),
rspan as (select restaurant, unnest(generate_series(min(on_day), max(on_day), interval 1 day))::date as on_day from daily group by restaurant),
pspan as (select restaurant, article_code, unnest(generate_series(min(on_day), max(on_day), interval 1 day))::date as on_day from booked group by restaurant, article_code),
rdays as (
  select s.*, coalesce(tickets, 0) as tickets, coalesce(revenue, 0) as revenue, (tickets is not null)::bigint as usable, coalesce(tickets > 0, false)::bigint as active
  from rspan s left join daily d using (restaurant, on_day)),
pdays as (select s.*, coalesce(units, 0) as units, coalesce(active, 0) as active from pspan s left join booked b using (restaurant, article_code, on_day)),
"""
_W = lambda what, part, n: f"sum({what}) over (partition by {part} order by on_day rows between {n - 1} preceding and current row)"
P7_FOUND_SQL = _P7_SQL + f"""
ract as (select restaurant, on_day, {_W('active', 'restaurant', 7)} as a7, {_W('active', 'restaurant', 30)} as a30 from rdays),
pact as (select restaurant, article_code, on_day, {_W('active', 'restaurant, article_code', 30)} as a30 from pdays)
select 'maestra_diaria' as table_name, restaurant, 0::bigint as article_code, cast(on_day as varchar) as on_day, 7 as window_days from ract where a7 = 0
union all select 'maestra_diaria', restaurant, 0, cast(on_day as varchar), 30 from ract where a30 = 0
union all select 'features_article_period', restaurant, article_code, cast(on_day as varchar), 30 from pact where a30 = 0
"""
P7_DAILY_SQL = _P7_SQL + f"""
sums as (select restaurant, on_day, {', '.join(f"{_W(m, 'restaurant', w)} as {m}_{w}" for m in ('tickets', 'revenue', 'usable') for w in (7, 30))} from rdays)
select restaurant, on_day, cast(tickets_7 as bigint) as tickets_7, cast(tickets_30 as bigint) as tickets_30, round(revenue_7, 2) as revenue_7, round(revenue_30, 2) as revenue_30,
  cast(usable_7 as bigint) as usable_7, cast(usable_30 as bigint) as usable_30,
  {', '.join(f"round({m}_{w} / {w}.0::double, 4) as {m}_avg_{w}" for m in ('tickets', 'revenue') for w in (7, 30))} from sums
"""
P7_ARTICLES_SQL = _P7_SQL + f"""
sums as (select restaurant, article_code, on_day, {', '.join(f"{_W('units', 'restaurant, article_code', w)} as units_{w}" for w in (7, 30))} from pdays)
select restaurant, article_code, on_day, units_7, units_30, {', '.join(f"round(units_{w} / {w}.0::double, 4) as units_avg_{w}" for w in (7, 30))} from sums
"""

QUERIES |= {
    "p1_found": p1_found, "p1_filled": p1_filled, "p1_evidence": p1_evidence, "p5_found": p5_found, "p5_ventas": p5_ventas, "p5_eventos": p5_eventos, "p5_ventas_columns": p5_ventas_columns, "p5_eventos_columns": p5_eventos_columns,
    "p6_found": p6_found, "p6_history": p6_history, "p7_found": p7_found, "p7_daily": p7_daily, "p7_articles": p7_articles,
}
SQL |= {"p5_ventas_columns": _one_table_sql("ventas"), "p5_eventos_columns": _one_table_sql("eventos"), "p1_found": P1_FOUND_SQL, "p1_filled": _p1_filled_sql(), "p5_found": P5_FOUND_SQL, "p6_history": P6_HISTORY_SQL, "p6_found": P6_FOUND_SQL, "p7_found": P7_FOUND_SQL, "p7_daily": P7_DAILY_SQL, "p7_articles": P7_ARTICLES_SQL}
