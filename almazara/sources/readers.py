"""Readers of the source families from cells: reports, masters, reservations, weather, holidays, events, invoices."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almazara.functions.casts import clean_text, day, decimal_token, number_eu
from almazara.functions.text import fold, slug
from almazara.operators.daily import expand_days
from almazara.operators.rules import resolve_payment
from almazara.sources.cells import csv_cells, files_read, header_table

# Source headers (slugs) and the columns they become.
ARTICLE_COLUMNS = {
    "articulo": "article_code", "codigo": "article_code", "cod_articulo": "article_code", "codigo_articulo": "article_code", "descripcion": "article_name",
    "descripcion_abreviada": "article_short_name", "cod_departamento_venta": "department_code", "departamento": "department_code", "codigo_departamento": "department_code", "precio": "price", "pvp": "price",
}
DEPARTMENT_COLUMNS = {
    "codigo": "department_code", "codigo_departamento": "department_code", "descripcion": "department_name", "departamento": "department_name",
    "nombre_corto": "department_short_name", "descripcion_corta": "department_short_name", "descripcion_abreviada": "department_short_name",
}
RESERVATION_COLUMNS = {
    "fecha": "reservation_date", "hora": "reservation_time", "estado": "status", "turno": "shift", "personas": "people", "origen": "origin", "prescriptor": "referrer", "fecha_anadida": "created_date",
    "hora_anadida": "created_time", "restaurante": "restaurant", "tipo": "reservation_type", "mesa": "table", "zona": "zone", "anotado_por": "entered_by", "grupo": "group", "referencia": "reference", "codigo_de_referencia": "reference_code",
}
HOLIDAY_COLUMNS = {"fecha": "date", "date": "date", "festivo": "holiday_name", "festivo_nombre": "holiday_name", "nombre": "holiday_name", "descripcion": "holiday_name", "holiday_name": "holiday_name", "es_festivo": "is_holiday", "is_holiday": "is_holiday", "dia_semana": "day_name", "nivel": "holiday_level"}
EVENT_COLUMNS = {
    "fecha": "date", "fecha_inicio": "event_start", "event_start": "event_start", "fecha_fin": "event_end", "event_end": "event_end", "event_id": "event_id", "id_evento": "event_id", "evento": "event_name", "nombre_evento": "event_name",
    "nombre": "event_name", "event_name": "event_name", "categoria": "event_category", "tipo": "event_category", "subcategoria": "event_subcategory", "ambito": "event_scope", "ubicacion": "event_location", "impacto_esperado": "expected_impact",
    "impacto": "expected_impact", "intensidad_sugerida": "event_intensity", "intensidad": "event_intensity", "direccion_demanda": "demand_direction", "direccion": "demand_direction", "confianza_fecha": "date_confidence",
    "confianza": "date_confidence", "estimado": "is_estimated", "fuente_tipo": "source_type", "fuente": "source_type", "notas_modelado": "modeling_notes",
}
#: Columns every report carries.
METADATA = ("report_start", "report_end", "report_generated_on", "terminal_start", "terminal_end", "turn")


def report_metadata(cells: DataFrame) -> DataFrame:
    """(source_file, *METADATA) from the label cells of each report: one aggregate over exploded cells."""
    flat = cells.select("source_file", F.explode("cells").alias("c")).where("c like '%:%'").select("source_file", fold(F.col("c")).alias("label"), clean_text(F.regexp_replace("c", "^[^:]*:", "")).alias("value"))
    starts = {"terminal_start": "^terminal inicial", "terminal_end": "^terminal final", "report_start": "^fecha inicial", "report_end": "^fecha final", "report_generated_on": r"^fecha\s*:", "turn": "^turno"}
    agg = flat.groupBy("source_file").agg(*[F.max(F.when(F.col("label").rlike(p), F.col("value"))).alias(n) for n, p in starts.items()])
    at = lambda c: day(F.regexp_extract(c, r"(\d{1,4}[-/]\d{1,2}[-/]\d{1,4})", 1))
    return agg.select("source_file", *[at(n).alias(n) if n.startswith("report") else F.col(n) for n in METADATA])


def with_metadata(rows: DataFrame, cells: DataFrame) -> DataFrame:
    return rows.join(report_metadata(cells), "source_file", "left").select("source_file", *METADATA, *[c for c in rows.columns if c != "source_file"])


def read_article_sales(cells: DataFrame) -> DataFrame:
    """Sales of a banded report: department rows (code and name, no measures) carry down to the article rows below; subtotals have no code.

    The carry is a window within a file, which one export bounds.
    """
    at = lambda i: F.get("cells", F.lit(i))
    rows = cells.select("source_file", "row_no", at(0).try_cast("double").alias("code"), clean_text(at(2)).alias("name"), number_eu(at(4)).alias("units"), number_eu(at(6)).alias("amount")).where("code is not null and name is not null")
    head = F.col("units").isNull() & F.col("amount").isNull()
    down = Window.partitionBy("source_file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"department_code": F.last(F.when(head, F.col("code").cast("long")), True).over(down), "department_name": F.last(F.when(head, F.col("name")), True).over(down)})
    out = rows.where("units is not null and amount is not null").select("source_file", "department_code", "department_name", F.col("code").cast("long").alias("article_code"), F.col("name").alias("article_name"), "units", "amount")
    return with_metadata(out, cells)


def read_articles(cells: DataFrame, keep_null_codes: bool = False) -> DataFrame:
    t = header_table(cells, ARTICLE_COLUMNS).drop("row_no")
    t = t.withColumns({"article_code": F.col("article_code").try_cast("double").cast("long"), "department_code": F.col("department_code").try_cast("double").cast("long"), "price": number_eu(F.col("price"))})
    return t if keep_null_codes else t.dropna(subset=["article_code"])


def read_menu(cells: DataFrame) -> DataFrame:
    return read_articles(cells, keep_null_codes=True).drop("article_short_name")


def read_departments(cells: DataFrame) -> DataFrame:
    t = header_table(cells, DEPARTMENT_COLUMNS).drop("row_no").withColumn("department_code", F.col("department_code").try_cast("double").cast("long"))
    return t.dropna(subset=["department_code", "department_name"])


def read_tickets(cells: DataFrame) -> DataFrame:
    """Positional columns 1, 3, 5, 7; a row counts only if all four can be read."""
    at = lambda i: F.get("cells", F.lit(i))
    t = cells.select("source_file", day(at(1)).alias("date"), clean_text(at(3)).alias("document_id"), number_eu(at(5)).alias("document_total"), number_eu(at(7)).cast("long").alias("receipt_count"))
    return with_metadata(t.dropna(subset=["date", "document_id", "document_total", "receipt_count"]), cells)


def read_tips(cells: DataFrame) -> DataFrame:
    """Positional columns 0, 2, 4, 6; total rows are left out."""
    at = lambda i: F.get("cells", F.lit(i))
    t = cells.select("source_file", clean_text(at(0)).alias("document_id"), number_eu(at(2)).alias("document_amount"), number_eu(at(4)).alias("tip"), number_eu(at(6)).alias("document_total"))
    t = t.where("document_id is not null and not startswith(upper(document_id), 'TOTAL') and document_amount is not null and tip is not null")
    return with_metadata(t, cells)


def read_reservations(cells: DataFrame) -> DataFrame:
    """Reservations with day-first dates and their times joined to timestamps."""
    t = header_table(cells, RESERVATION_COLUMNS).drop("row_no")
    joined = lambda d, h: F.try_to_timestamp(F.concat_ws(" ", day(F.col(d)).cast("string"), F.coalesce(F.regexp_extract(h, r"(\d{1,2}:\d{2})", 1), F.lit("00:00"))), F.lit("yyyy-MM-dd H:mm")).cast("timestamp_ntz")
    t = t.withColumns({"reservation_datetime": joined("reservation_date", "reservation_time"), "created_datetime": joined("created_date", "created_time")})
    return t.withColumns({"reservation_date": day(F.col("reservation_date")), "created_date": day(F.col("created_date")), "people": F.col("people").try_cast("double").cast("long")}).dropna(subset=["reservation_date"])


#: First names of a header row in weather files; each begins a block.
BLOCK_STARTS = ("latitude", "time")


def _blocks(cells: DataFrame) -> DataFrame:
    """Rows of a file split into blocks, each beginning with a header row, with the row's place in its block."""
    blank = F.size(F.filter("cells", lambda c: c.isNotNull())) == 0
    w = Window.partitionBy("source_file").orderBy("row_no")
    starts = F.coalesce(fold(F.get("cells", F.lit(0))).isin(*BLOCK_STARTS), F.lit(False))
    rows = cells.where(~blank).withColumn("block", F.sum(starts.cast("int")).over(w))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source_file", "block").orderBy("row_no")) - 1)


def read_weather(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hourly, daily) rows of weather files made of a metadata, an hourly and a daily block, long form: (source_file, time, measure, value) and metadata.

    A block is hourly if its ``time`` has a clock. Sunshine seconds are also given as hours.
    """
    rows = _blocks(cells)
    names = rows.where("place = 0").select("source_file", "block", F.transform("cells", lambda c: F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "_"), "^_+|_+$", "")).alias("names"))
    body = rows.where("place > 0").join(names, ["source_file", "block"])
    each = F.transform("names", lambda n, i: F.struct(n.alias("k"), F.get("cells", i).alias("v"), (F.array_position("names", n) == i + 1).alias("first")))
    pairs = F.map_from_entries(F.transform(F.filter(each, lambda x: x["k"].isNotNull() & x["first"]), lambda x: F.struct(x["k"], x["v"])))
    body = body.select("source_file", pairs.alias("m")).withColumn("time", F.try_element_at("m", F.lit("time")))
    meta = body.where("time is null").groupBy("source_file").agg(*[F.max(F.try_element_at("m", F.lit(c))).alias(c) for c in ("latitude", "longitude", "elevation", "utc_offset_seconds", "timezone", "timezone_abbreviation")])
    full = body.where("time is not null").join(meta, "source_file", "left")
    hourly = full.where("time like '%T%'").withColumn("datetime", F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz"))
    daily = full.where("time not like '%T%'").withColumn("date", day(F.col("time")))
    hours = F.try_element_at("m", F.lit("sunshine_duration_s")).try_cast("double") / 3600
    return hourly.drop("time"), daily.drop("time").withColumn("sunshine_hours", hours)


def measures(long: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Measures of ``read_weather`` as columns: source slug to column name."""
    return long.select(*[c for c in long.columns if c != "m"], *[F.try_element_at("m", F.lit(s)).try_cast("double").alias(n) for s, n in columns.items()])


#: Columns of ``read_weather`` that are no measures.
_NO_MEASURES = ("time", "latitude", "longitude", "elevation", "utc_offset_seconds", "timezone", "timezone_abbreviation")
# Names of measures that other tables use without their unit, by the slug of the header.
MEASURE_NAMES = {
    "temperature_2m_c": "temperature_2m", "temperature_2m_max_c": "temperature_max", "temperature_2m_min_c": "temperature_min", "temperature_2m_mean_c": "temperature_mean", "precipitation_sum_mm": "precipitation_mm", "rain_sum_mm": "rain_mm",
    "precipitation_hours_h": "precipitation_hours", "wind_speed_10m_max_km_h": "wind_speed_max_kmh", "weather_code_wmo_code": "weather_code",
}


def all_measures(long: DataFrame) -> DataFrame:
    """Every measure of ``read_weather`` as a column, under its name in MEASURE_NAMES or its slug; the names of all files come to the driver."""
    found = [r[0] for r in long.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect()]
    taken = set(long.columns)
    return measures(long, {k: MEASURE_NAMES.get(k, k) for k in sorted(found) if k and k not in _NO_MEASURES and MEASURE_NAMES.get(k, k) not in taken})


def read_holidays(cells: DataFrame) -> DataFrame:
    t = header_table(cells, HOLIDAY_COLUMNS).drop("row_no")
    return t.withColumns({"date": day(F.col("date")), "is_holiday": F.coalesce(F.col("is_holiday").try_cast("long"), F.lit(1))}).dropna(subset=["date"])


def read_events(cells: DataFrame) -> DataFrame:
    """Events expanded to one row a day, numbered from 1; inverted events are left out, and without an id the folded name and start make one. Columns outside the map are kept."""
    t = header_table(cells, EVENT_COLUMNS, rest=True).drop("row_no")
    start = F.coalesce(day(F.col("event_start")), day(F.col("date")))
    t = t.withColumns({"event_start": start, "event_end": F.coalesce(day(F.col("event_end")), start), "event_intensity": number_eu(F.col("event_intensity"))}).drop("date")
    t = t.withColumn("event_id", F.coalesce("event_id", F.concat_ws("_", slug(F.col("event_name")), F.col("event_start").cast("string"))))
    return expand_days(t, "event_start", "event_end")


def read_csv_family(spark: SparkSession, kind: str, paths: Sequence[str]) -> DataFrame | tuple[DataFrame, DataFrame]:
    cells = csv_cells(spark, paths)
    return {"weather": read_weather, "holidays": read_holidays, "events": read_events}[kind](cells)


# ------------------------------------------------------------------------------------------------ invoices from positioned words

WORDS = "ticket_id string, page int, x0 double, y0 double, x1 double, y1 double, word string"
_MONEY = r"^[+-]?\d{1,6}[.,]\d{2}$"


def amount_on_label_line(words: DataFrame, label: str, tolerance: float = 3.0) -> DataFrame:
    """(ticket_id, label_found, amount): the nearest money word right of the first word matching ``label``, on its line.

    Ties in place go to the first by page, line and column. A join on (ticket, page) within a ticket's few words.
    """
    w = words.withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    first = w.where(F.col("word").rlike(f"(?i)^(?:{label})$")).groupBy("ticket_id").agg(F.min_by(F.struct("page", "x1", "y"), F.struct("page", "y0", "x0")).alias("l"))
    right = w.where(F.col("word").rlike(_MONEY)).join(first.select("ticket_id", "l.*").toDF("ticket_id", "page", "lx1", "ly"), ["ticket_id", "page"]).where((F.col("x0") > F.col("lx1")) & (F.abs(F.col("y") - F.col("ly")) <= tolerance))
    near = right.groupBy("ticket_id").agg(F.min_by("word", "x0").alias("token"))
    found = first.select("ticket_id", F.lit(True).alias("label_found"))
    return words.select("ticket_id").distinct().join(found, "ticket_id", "left").join(near, "ticket_id", "left").select("ticket_id", F.coalesce("label_found", F.lit(False)).alias("label_found"), decimal_token(F.col("token")).alias("amount"))


def total_from_words(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """(ticket_id, total): the rightmost money word on the line of the lowest TOTAL that has one."""
    w = words.withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    labels = w.where("upper(trim(word)) = 'TOTAL'").select("ticket_id", "page", F.col("x1").alias("lx1"), F.col("y").alias("ly"), F.col("y0").alias("ly0"))
    money = w.where(F.col("word").rlike(_MONEY)).join(labels, ["ticket_id", "page"]).where((F.col("x0") > F.col("lx1")) & (F.abs(F.col("y") - F.col("ly")) <= tolerance))
    return money.groupBy("ticket_id").agg(F.max_by("word", F.struct("page", "ly0", "x0")).alias("token")).select("ticket_id", decimal_token(F.col("token")).alias("total"))


def tax_summary_from_words(words: DataFrame, low: float = 3.0, high: float = 30.0) -> DataFrame:
    """(ticket_id, base, vat_rate, vat): the first three number words, left to right, under the header Base."""
    head = words.where(F.lower(F.trim("word")) == "base").groupBy("ticket_id").agg(F.min_by(F.struct("page", "y1"), F.struct("page", "y0")).alias("h")).select("ticket_id", F.col("h.page").alias("page"), F.col("h.y1").alias("hy"))
    below = words.where(F.col("word").rlike(r"^[+-]?\d{1,6}(?:[.,]\d{1,2})?%?$")).join(head, ["ticket_id", "page"]).where((F.col("y0") - F.col("hy")).between(low, high))
    place = F.row_number().over(Window.partitionBy("ticket_id").orderBy("x0", "y0"))
    n = below.withColumn("place", place).where("place <= 3")
    pick = lambda i: F.max(F.when(F.col("place") == i, decimal_token(F.col("word"))))
    return n.groupBy("ticket_id").agg(pick(1).alias("base"), pick(2).alias("vat_rate"), pick(3).alias("vat"))


def invoice_identity(texts: DataFrame) -> DataFrame:
    """(ticket_id, number, date, table, served_by) from the raw text of invoices (ticket_id, raw_text)."""
    grab = lambda p: clean_text(F.regexp_extract("raw_text", p, 1))
    return texts.select("ticket_id", grab(r"(?i)(?:factura|ticket|n[ºo°])\s*[:.]?\s*([A-Z0-9/-]*\d[A-Z0-9/-]*)").alias("number"), day(grab(r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})")).alias("date"), grab(r"(?i)mesa\s*[:.]?\s*(\w+)").alias("table"), grab(r"(?i)(?:atendido por|le atendi[oó])\s*[:.]?\s*([^\n]+)").alias("served_by"))


def texts_of_words(words: DataFrame) -> DataFrame:
    """(ticket_id, raw_text): the words of each invoice line by line; an invoice's few words are put together."""
    at = F.struct("page", F.floor((F.col("y0") + F.col("y1")) / 8).alias("line"), "x0", "word")
    line = words.groupBy("ticket_id", "page", F.floor((F.col("y0") + F.col("y1")) / 8).alias("line")).agg(F.sort_array(F.collect_list(at)).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    lines = line.groupBy("ticket_id").agg(F.sort_array(F.collect_list(F.struct("page", "line", text.alias("t")))).alias("l"))
    return lines.select("ticket_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("raw_text"))


def read_invoices(words: DataFrame) -> DataFrame:
    """Invoices from positioned words, one row each: identity, tax summary, total, payment and text.

    The ticket is the printed number, or the file where none is printed. Where the geometry gives no total or
    no tax summary, the text does.
    """
    texts = texts_of_words(words)
    t = texts.join(invoice_identity(texts).drop("raw_text"), "ticket_id", "left")
    for part in (tax_summary_from_words(words), total_from_words(words)):
        t = t.join(part, "ticket_id", "left")
    for label, name in (("EFECTIVO:?", "cash"), ("TARJETA:?", "card")):
        found = amount_on_label_line(words, label)
        t = t.join(found.select("ticket_id", F.col("label_found").alias(f"{name}_label_found"), F.col("amount").alias(f"{name}_printed")), "ticket_id", "left")
    grab = lambda p, i=1: decimal_token(clean_text(F.regexp_extract("raw_text", p, i)))
    three = r"(?is)\bBase\s*%\s*IVA\s*Total\s*IVA\s*" + r"([0-9]+[.,][0-9]{2})\s*" * 3
    t = t.withColumns({
        "total": F.coalesce("total", grab(r"(?im)\bTOTAL\b[^0-9]{0,20}([0-9]+[.,][0-9]{2})")),
        **{c: F.coalesce(c, grab(three, i)) for i, c in enumerate(("base", "vat_rate", "vat"), 1)},
    }).withColumn("cash_tendered", F.col("cash_printed"))
    out = resolve_payment(t).withColumnRenamed("ticket_id", "source_file")
    return out.select(
        "source_file", F.coalesce("number", F.regexp_replace("source_file", r"\.[^.]*$", "")).alias("ticket_id"), "date", "table", "served_by", "base", "vat_rate", "vat", "total",
        "cash_tendered", "change_amount", "cash_amount", "card_amount", "payment_method", "cash_label_found", "card_label_found", "raw_text",
    )


def _read_pdf(name: str, content: bytes) -> list[tuple]:
    import fitz

    return [(n, *map(float, w[:4]), w[4]) for n, page in enumerate(fitz.open(stream=content, filetype="pdf")) for w in page.get_text("words")]


def pdf_words(spark: SparkSession, paths: Sequence[str], read: Callable[[str, bytes], list[tuple]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(words, errors) of PDF files, read on the executors; a file that can't be read or has no words is a row (source_file, error).

    Needs PyMuPDF, which is optional; without it the files are errors. ``read`` takes another reader of (name,
    content) in its place.
    """
    take = read or _read_pdf

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name = os.path.basename(path)
                try:
                    rows = [(name, *w, None) for w in take(name, bytes(content))] or [(name, *[None] * 6, "no words in the file")]
                except Exception as e:  # whatever a broken file does, it is this file's error
                    rows = [(name, *[None] * 6, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["ticket_id", "page", "x0", "y0", "x1", "y1", "word", "error"])
                yield out.astype({"page": "Int32"})

    if not paths:
        return spark.createDataFrame([], WORDS), spark.createDataFrame([], "source_file string, error string")
    kept = files_read(spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, WORDS + ", error string"))
    return kept.where("error is null").drop("error"), kept.where("error is not null").select(F.col("ticket_id").alias("source_file"), "error")
