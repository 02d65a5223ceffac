"""Files as cells: every tabular file becomes (source_file, row_no, cells array<string>), whatever its format."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almazara.functions.text import fold, slug
from almazara.sources import files

CELLS = "source_file string, row_no int, cells array<string>"
SUPPORTED = (".csv", ".xls", ".xlsx", ".pdf")


def list_files(spark: SparkSession, directory: str, recursive: bool = False, excluded: Sequence[str] = ()) -> list[str]:
    """Supported files of a directory, sorted, without temporary files (~$) and excluded folders."""
    found = files.below(spark, directory, recursive)
    skip = tuple(f"/{x.strip('/')}/" for x in excluded)
    return [p for p in found if p.lower().endswith(SUPPORTED) and not os.path.basename(p).startswith("~$") and not any(x in p for x in skip)]


SEPARATORS = (",", ";", "\t")


def sniff_separator(head: str) -> str:
    """The first of comma, semicolon and tab that splits the first line; comma if none does."""
    line = next((x for x in head.splitlines() if x.strip()), "")
    return next((s for s in SEPARATORS if len(line.split(s)) > 1), ",")


def csv_heads(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str, dict[str, int]]]:
    """(path, first line that isn't blank, cells a line at most by separator) of each file, by one pass over the lines.

    A file without any text is left out. What comes to the driver is a row a file.
    """
    if not paths:
        return []
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), F.regexp_replace("value", "^\\uFEFF", "").alias("line"))
    per = lines.where(F.trim("line") != "").groupBy("path").agg(F.min_by("line", "at").alias("head"), *[F.max(F.size(F.split("line", s))).alias(f"n{i}") for i, s in enumerate(SEPARATORS)])
    return sorted((r["path"], r["head"], {s: r[f"n{i}"] for i, s in enumerate(SEPARATORS)}) for r in per.collect())


def csv_cells(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of CSV files as cells; the separator is found per file from its first line.

    Spark's own CSV reader takes the files apart, one separator at a time and as wide as their widest line, so
    quotes, separators and line breaks within quotes are read as meant. Blank lines are no rows.
    """
    groups: dict[str, list[tuple[str, int]]] = {}
    for path, head, widths in csv_heads(spark, paths):
        sep = sniff_separator(head)
        groups.setdefault(sep, []).append((path, widths[sep]))
    parts = []
    for sep, found in groups.items():
        columns = [f"c{i}" for i in range(max(n for _, n in found))]
        rows = spark.read.csv([p for p, _ in found], schema=", ".join(f"{c} string" for c in columns), sep=sep, quote='"', escape='"', multiLine=True, header=False)
        cell = lambda c: F.nullif(F.trim(F.regexp_replace(c, "^\\uFEFF", "")), F.lit(""))
        parts.append(rows.select(F.col("_metadata.file_name").alias("source_file"), F.monotonically_increasing_id().alias("at"), F.array(*[cell(c) for c in columns]).alias("cells")))
    if not parts:
        return spark.createDataFrame([], CELLS)
    rows = reduce(DataFrame.unionByName, parts)  # a file is read by one task, so its rows are numbered without gaps
    first = rows.groupBy("source_file").agg(F.min("at").alias("first"))
    return rows.join(first, "source_file").select("source_file", (F.col("at") - F.col("first")).cast("int").alias("row_no"), "cells")


def _read_sheet(name: str, content: bytes) -> list[list]:
    """The rows of the first sheet: .xlsx by openpyxl, .xls by calamine."""
    import io

    if name.lower().endswith(".xls"):
        import python_calamine

        return python_calamine.CalamineWorkbook.from_filelike(io.BytesIO(content)).get_sheet_by_index(0).to_python()
    import openpyxl

    return [list(r) for r in openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True).worksheets[0].iter_rows(values_only=True)]


def excel_cells(spark: SparkSession, paths: Sequence[str], read: Callable[[str, bytes], list[list]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, errors) of Excel files, read on the executors; a file that can't be read is a row (source_file, error).

    .xlsx needs openpyxl, .xls python-calamine; both are optional, and without them their files are errors.
    ``read`` takes another reader of (name, content) in their place.
    """
    sheet = read or _read_sheet

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name = os.path.basename(path)
                try:
                    rows = [(name, i, [None if v is None else str(v) for v in r], None) for i, r in enumerate(sheet(name, bytes(content)))]
                except Exception as e:  # whatever a broken file does, it is this file's error
                    rows = [(name, -1, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["source_file", "row_no", "cells", "error"])

    if not paths:
        return spark.createDataFrame([], CELLS), spark.createDataFrame([], "source_file string, error string")
    read_once = spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, CELLS + ", error string")
    kept = files_read(read_once)
    blank = F.transform("cells", lambda c: F.nullif(F.trim(c), F.lit("")))
    return kept.where("error is null").select("source_file", "row_no", blank.alias("cells")), kept.where("error is not null").select("source_file", "error")


def files_read(df: DataFrame) -> DataFrame:
    """What was read from files by Python, written once, since several readers look at it."""
    from almazara.session import cut

    return cut(df)


# Cell texts and header sets by which a report is recognised.
REPORT_TITLES = {"articulos x departamentos venta": "article_sales", "documentos con emision de comprobante": "tickets", "resumen propinas": "tips"}
HEADERS = (
    ("reservations", {"fecha", "hora", "estado", "turno", "personas"}, False),
    ("articles", {"articulo", "descripcion", "descripcion_abreviada", "cod_departamento_venta"}, False),
    ("departments", {"codigo", "descripcion", "descripcion_abreviada"}, False),
    ("menu", {"articulo", "descripcion"}, True),
)


def detect_types(cells: DataFrame, preview_rows: int = 30) -> DataFrame:
    """(source_file, file_type): by a title among the first rows, else by the header row; null if unknown."""
    head = cells.where(F.col("row_no") < preview_rows)
    texts = head.select("source_file", "row_no", F.explode("cells").alias("c")).where("c is not null").select("source_file", "row_no", fold(F.col("c")).alias("c"))
    per = texts.groupBy("source_file").agg(
        *[F.bool_or(F.col("c") == t).alias(f"t_{n}") for t, n in REPORT_TITLES.items()],
        F.collect_set(F.when(F.col("row_no") == 0, F.regexp_replace("c", "[^a-z0-9]+", "_"))).alias("header"),
    )
    kind = F.lit(None).cast("string")
    for name, need, exact in reversed(HEADERS):
        want = F.array(*[F.lit(x) for x in sorted(need)])
        ok = F.size(F.array_except(want, F.col("header"))) == 0
        kind = F.when(ok & (F.size("header") == len(need)) if exact else ok, name).otherwise(kind)
    for n in reversed(list(REPORT_TITLES.values())):
        kind = F.when(F.col(f"t_{n}"), n).otherwise(kind)
    return per.select("source_file", kind.alias("file_type"))


def detect_csv_type(name: str, columns: Sequence[str]) -> str | None:
    """weather, holidays or events, by the file's name or its columns."""
    n = name.lower()
    has = lambda *tokens: any(t in c for c in columns for t in tokens)
    if "meteo" in n or has("temperature", "precipitation", "weather_code", "wind_speed"):
        return "weather"
    if "festiv" in n or "holiday" in n:
        return "holidays"
    if "event" in n or has("evento", "event", "impacto", "intensidad"):
        return "events"
    return None


def clean_header(c: Column) -> Column:
    return F.coalesce(slug(c), F.lit(""))


def headers(cells: DataFrame) -> list[str]:
    """The different names in the headers of all files; a header a file comes together here."""
    found = cells.where("row_no = 0").select(F.explode(F.transform("cells", clean_header)).alias("h")).where("h <> ''").distinct()
    return sorted(r[0] for r in found.collect())


def lacking(cells: DataFrame, wanted: dict[str, str], required: Sequence[str]) -> DataFrame:
    """(source_file, error) of the files whose header has no name for a required column."""
    head = cells.where("row_no = 0").select("source_file", F.transform("cells", clean_header).alias("header"))
    known = {c: F.arrays_overlap("header", F.array(*[F.lit(h) for h, t in wanted.items() if t == c])) for c in required}
    absent = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in known.items()]))
    return head.select("source_file", absent.alias("a")).where(F.size("a") > 0).select("source_file", F.concat(F.lit("required columns are missing: "), F.array_join("a", ", ")).alias("error"))


def header_table(cells: DataFrame, names: dict[str, str], rest: bool = False) -> DataFrame:
    """Rows below the header as columns, renamed by ``names`` (slug of the header to column).

    Other columns are dropped, or with ``rest`` kept under their slug. The header may differ from file to file;
    positions are looked up per file.
    """
    head = cells.where("row_no = 0").select("source_file", F.transform("cells", clean_header).alias("header"))
    joined = cells.where("row_no > 0").join(head, "source_file")
    targets: dict[str, list[str]] = {}
    for h, c in names.items():
        targets.setdefault(c, []).append(h)
    if rest:
        for h in headers(cells):
            if h not in names:
                targets.setdefault(h if h not in ("source_file", "row_no") else f"{h}_", []).append(h)

    def pick(options: list[str]) -> Column:
        found = [F.try_element_at("cells", F.nullif(F.array_position("header", h), F.lit(0)).cast("int")) for h in options]
        return F.coalesce(*found)

    return joined.select("source_file", "row_no", *[pick(o).alias(c) for c, o in targets.items()])
