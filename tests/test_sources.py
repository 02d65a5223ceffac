"""Readers on small files."""

import datetime as dt

import pytest

from almazara.sources import readers as R
from almazara.sources.cells import csv_cells, detect_csv_type, detect_types, excel_cells, list_files, sniff_separator
from almazara.sources.layers import first_table, load_catalogue, read_layer, read_optional, read_report, read_structured, write_csv, write_layer, write_report


def _cells(spark, rows, name="f.xls"):
    width = max((len(r) for r in rows), default=1)
    return spark.createDataFrame([(name, i, list(r) + [None] * (width - len(r))) for i, r in enumerate(rows)], "source_file string, row_no int, cells array<string>")


SALES = [
    ["Articulos x Departamentos Venta"], ["Terminal Inicial: T1", None, "Terminal Final: T2"], ["Fecha Inicial: 01/03/2024", None, "Fecha Final: 07/03/2024"], ["Fecha : 08/03/2024", None, "Turno: Cena"],
    ["10", None, "Vinos", None, None, None, None], ["101", None, "Tinto", None, "3", None, "10,50"], ["102", None, "Blanco", None, "1.200,5", None, "4"], [None, None, "Subtotal", None, "4", None, "14,5"],
    ["20", None, "Postres", None, None, None, None], ["201", None, "Flan", None, "-1", None, "0"],
]


def test_banded_report(spark):
    c = _cells(spark, SALES)
    assert detect_types(c).collect()[0].file_type == "article_sales"
    rows = {r.article_code: r for r in R.read_article_sales(c).collect()}
    assert set(rows) == {101, 102, 201}
    assert rows[102].department_name == "Vinos" and rows[102].units == 1200.5 and rows[201].department_code == 20 and rows[201].units == -1
    assert rows[101].report_start == dt.date(2024, 3, 1) and rows[101].report_end == dt.date(2024, 3, 7) and rows[101].report_generated_on == dt.date(2024, 3, 8)
    assert (rows[101].terminal_start, rows[101].terminal_end, rows[101].turn) == ("T1", "T2", "Cena")


def test_masters_and_types(spark):
    art = _cells(spark, [["Artículo", "Descripción", "Descripción abreviada", "Cod. departamento venta", "PVP"], ["7", "Café", "Caf", "10", "1,20 €"], [None, "sin código", None, None, None]])
    assert detect_types(art).collect()[0].file_type == "articles"
    got = R.read_articles(art).collect()
    assert [(r.article_code, r.article_name, r.price) for r in got] == [(7, "Café", 1.2)] and R.read_menu(art).count() == 2
    dep = _cells(spark, [["Código", "Descripción", "Descripción abreviada"], ["10", "Vinos", "Vin"], ["x", "?", ""]])
    assert detect_types(dep).collect()[0].file_type == "departments" and [r.department_code for r in R.read_departments(dep).collect()] == [10]
    assert detect_types(_cells(spark, [["Artículo", "Descripción"], ["1", "a"]])).collect()[0].file_type == "menu"
    assert detect_types(_cells(spark, [["?"]])).collect()[0].file_type is None


def test_tickets_and_tips(spark):
    t = _cells(spark, [[None, "01/03/2024", None, "A1", None, "10,50", None, "2"], [None, "x", None, "A2", None, "1", None, "1"]])
    assert [(r.document_id, r.document_total, r.receipt_count) for r in R.read_tickets(t).collect()] == [("A1", 10.5, 2)]
    p = _cells(spark, [["A1", None, "10", None, "1", None, "11"], ["TOTAL", None, "10", None, "1", None, "11"]])
    assert [r.document_id for r in R.read_tips(p).collect()] == ["A1"]


def test_reservations(spark):
    c = _cells(spark, [["Fecha", "Hora", "Estado", "Turno", "Personas", "Fecha añadida", "Hora añadida"], ["02/03/2024", "21:30", "Confirmada", "Cena", "4", "01/03/2024", "9:05"], ["?", "", "", "", "", "", ""]])
    assert detect_types(c).collect()[0].file_type == "reservations"
    r = R.read_reservations(c).collect()
    assert len(r) == 1 and r[0].reservation_datetime == dt.datetime(2024, 3, 2, 21, 30) and r[0].created_datetime == dt.datetime(2024, 3, 1, 9, 5) and r[0].people == 4


def test_csv_files(spark, tmp_path):
    (tmp_path / "meteo.csv").write_text('latitude,longitude,elevation,utc_offset_seconds,timezone,timezone_abbreviation\n41.6,2.3,200.0,3600,Europe/Madrid,CET\n\ntime,temperature_2m (°C),rain (mm)\n2025-01-01T00:00,5.1,0.2\n2025-01-01T01:00,,0.0\n\ntime,temperature_2m_max (°C),sunshine_duration (s)\n2025-01-01,9.5,7200\n')
    (tmp_path / "festivos.csv").write_text("fecha;festivo\n2025-07-06;Fiesta\nbad;x\n")
    (tmp_path / "eventos.csv").write_text('evento,fecha_inicio,fecha_fin,intensidad\n"Feria, gran",2025-03-01,2025-03-03,"2,5"\nMal,2025-03-05,2025-03-01,1\n')
    (tmp_path / "~$tmp.csv").write_text("x")
    assert [p.split("/")[-1] for p in list_files(spark, str(tmp_path))] == ["eventos.csv", "festivos.csv", "meteo.csv"]
    assert detect_csv_type("meteo", []) == "weather" and detect_csv_type("x", ["impacto"]) == "events" and detect_csv_type("x", []) is None and sniff_separator("a;b\n") == ";"
    hourly, daily = R.read_weather(csv_cells(spark, [str(tmp_path / "meteo.csv")]))
    h = R.measures(hourly, {"temperature_2m_c": "temperature_2m", "rain_mm": "rain_mm"}).orderBy("datetime").collect()
    assert [(r.temperature_2m, r.rain_mm, r.timezone) for r in h] == [(5.1, 0.2, "Europe/Madrid"), (None, 0.0, "Europe/Madrid")]
    assert [(r.date, r.sunshine_hours) for r in daily.select("date", "sunshine_hours").collect()] == [(dt.date(2025, 1, 1), 2.0)]
    assert [(r.date, r.holiday_name) for r in R.read_holidays(csv_cells(spark, [str(tmp_path / "festivos.csv")])).collect()] == [(dt.date(2025, 7, 6), "Fiesta")]
    e = R.read_events(csv_cells(spark, [str(tmp_path / "eventos.csv")])).orderBy("date").collect()
    assert [(r.event_name, r.event_day_number, r.event_duration_days, r.event_intensity) for r in e] == [("Feria, gran", n, 3, 2.5) for n in (1, 2, 3)]


def test_invoice_geometry(spark):
    words = [("t", 0, 10, 10, 40, 14, "TOTAL"), ("t", 0, 50, 10, 60, 14, "IVA"), ("t", 0, 10, 50, 40, 54, "TOTAL"), ("t", 0, 60, 51, 70, 55, "50,00"), ("t", 0, 80, 51, 90, 55, "60,50"),
             ("t", 0, 10, 60, 40, 64, "Efectivo"), ("t", 0, 60, 62, 70, 66, "65,00"), ("t", 0, 10, 20, 20, 24, "Base"), ("t", 0, 10, 30, 20, 34, "50,00"), ("t", 0, 30, 30, 40, 34, "21%"), ("t", 0, 50, 30, 60, 34, "10,50"), ("u", 0, 1, 1, 2, 2, "nada")]
    w = spark.createDataFrame([tuple([a, b, *map(float, c), d]) for a, b, *c, d in words], R.WORDS)
    assert [(r.ticket_id, r.total) for r in R.total_from_words(w).collect()] == [("t", 60.5)]
    assert {r.ticket_id: (r.label_found, r.amount) for r in R.amount_on_label_line(w, "efectivo").collect()} == {"t": (True, 65.0), "u": (False, None)}
    assert [(r.base, r.vat_rate, r.vat) for r in R.tax_summary_from_words(w).collect()] == [(50.0, 21.0, 10.5)]
    t = R.invoice_identity(spark.createDataFrame([("t", "Factura: F-12\n03/04/2024 Mesa: 7\nAtendido por: Ana")], "ticket_id string, raw_text string")).collect()[0]
    assert (t.number, t.date, t.table, t.served_by) == ("F-12", dt.date(2024, 4, 3), "7", "Ana")


def test_csv_quotes_breaks_and_encodings(spark, tmp_path):
    (tmp_path / "eventos.csv").write_text('\ufeffevento;fecha_inicio;notas;franja_probable\n"Feria; ""grande""\nde marzo";2025-03-01;"a,b";noche\n\nMercado;2025-03-02;;\n', encoding="utf-8")
    (tmp_path / "otros_eventos.csv").write_text("evento,fecha_inicio,color\nBaile,2025-03-05,rojo\n")
    c = csv_cells(spark, [str(tmp_path / "eventos.csv"), str(tmp_path / "otros_eventos.csv")])
    got = {(r.source_file, r.row_no): [x for x in r.cells if x] for r in c.collect()}
    assert got["eventos.csv", 1] == ['Feria; "grande"\nde marzo', "2025-03-01", "a,b", "noche"] and got["otros_eventos.csv", 1] == ["Baile", "2025-03-05", "rojo"] and len(got) == 5
    e = {r.event_name: r for r in R.read_events(c).collect()}
    assert e["Mercado"].franja_probable is None and e['Feria; "grande"\nde marzo'].franja_probable == "noche" and e["Baile"].color == "rojo"
    assert csv_cells(spark, []).collect() == []


def test_all_measures_are_kept(spark, tmp_path):
    (tmp_path / "meteo.csv").write_text("latitude,longitude,timezone\n41.6,2.3,Europe/Madrid\n\ntime,temperature_2m (°C),cloud_cover (%)\n2025-01-01T00:00,5.1,80\n")
    hourly, daily = R.read_weather(csv_cells(spark, [str(tmp_path / "meteo.csv")]))
    r = R.all_measures(hourly).collect()
    assert [(x.temperature_2m, x.cloud_cover, x.timezone) for x in r] == [(5.1, 80.0, "Europe/Madrid")] and R.all_measures(daily).collect() == []


def test_a_broken_file_is_a_row_of_errors(spark, tmp_path):
    (tmp_path / "a.xlsx").write_text("x|y\n1|")
    (tmp_path / "b.xls").write_text("broken")
    (tmp_path / "c.pdf").write_text("TOTAL 12,00")
    (tmp_path / "d.pdf").write_text(" ")

    def sheet(name, content):
        if content == b"broken":
            raise ValueError("no workbook")
        return [line.split("|") for line in content.decode().split("\n")]

    rows, errors = excel_cells(spark, [str(tmp_path / "a.xlsx"), str(tmp_path / "b.xls")], sheet)
    assert {(r.source_file, r.row_no, tuple(r.cells)) for r in rows.collect()} == {("a.xlsx", 0, ("x", "y")), ("a.xlsx", 1, ("1", None))}
    assert [tuple(r) for r in errors.collect()] == [("b.xls", "ValueError: no workbook")]
    words, errors = R.pdf_words(spark, [str(tmp_path / "c.pdf"), str(tmp_path / "d.pdf")], lambda name, content: [(0, 10.0 * i, 5.0, 10.0 * i + 9, 9.0, w) for i, w in enumerate(content.decode().split())])
    assert [(r.word, r.page) for r in words.orderBy("x0").collect()] == [("TOTAL", 0), ("12,00", 0)] and [r.source_file for r in errors.collect()] == ["d.pdf"]
    for lib, take, end in (("openpyxl", excel_cells, ".xlsx"), ("fitz", R.pdf_words, ".pdf")):
        try:
            __import__(lib)
        except ImportError:  # without the optional library its files are errors that name it
            (tmp_path / f"e{end}").write_text("x")
            assert lib in take(spark, [str(tmp_path / f"e{end}")])[1].first().error


def test_invoices_are_composed(spark):
    lines = ["Factura: F-12", "03/04/2024 Mesa: 7", "Base % IVA Total IVA", "50,00 21,00 10,50", "TOTAL 60,50", "EFECTIVO: 20,00", "TARJETA: 45,00"]
    words = [("f.pdf", 0, 40.0 * i, 40.0 * n, 40.0 * i + 30, 40.0 * n + 4, w) for n, line in enumerate(lines) for i, w in enumerate(line.split())] + [("g.pdf", 0, 1.0, 1.0, 2.0, 2.0, "nada")]
    got = {r.source_file: r for r in R.read_invoices(spark.createDataFrame(words, R.WORDS)).collect()}
    f = got["f.pdf"]
    assert (f.ticket_id, f.date, f.table, f.base, f.vat_rate, f.vat, f.total) == ("F-12", dt.date(2024, 4, 3), "7", 50.0, 21.0, 10.5, 60.5)
    assert (f.cash_tendered, f.change_amount, f.cash_amount, f.card_amount, f.payment_method) == (20.0, 4.5, 15.5, 45.0, "mixed") and f.raw_text.startswith("Factura: F-12\n")
    assert (got["g.pdf"].ticket_id, got["g.pdf"].total, got["g.pdf"].payment_method) == ("g", None, "unknown")


def test_layers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    write_layer({"ventas": df}, str(tmp_path), "silver")
    assert read_layer(spark, str(tmp_path), "silver")["ventas"].collect() == df.collect()
    write_csv(df, str(tmp_path / "r.csv"))
    assert read_structured(spark, {"r": str(tmp_path / "r.csv")})["r"].collect()[0].t == "a"
    with pytest.raises(ValueError):
        read_structured(spark, {"r": "x.foo"})
    assert read_optional(spark, None) is None and read_optional(spark, str(tmp_path / "no.csv")) is None and read_optional(spark, str(tmp_path / "r.csv")).count() == 1
    write_report(spark, {"a": [1, "ñ"]}, str(tmp_path / "r.json"))
    assert read_report(spark, str(tmp_path / "r.json")) == {"a": [1, "ñ"]}
    assert first_table({"b": df}, ["a", "b"]) is df and first_table({}, ["a"]) is None
    with pytest.raises(KeyError):
        first_table({}, ["a"], required=True)
    with pytest.raises(ValueError):
        load_catalogue(spark, str(tmp_path / "r.csv"))
