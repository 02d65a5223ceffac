"""Layers on disk: reading and writing tables, catalogues and reports."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from almazara.sources import files
from almazara.sources.cells import excel_cells, header_table

LAYER_SUFFIXES = {"bronze": "_raw", "silver": "_silver", "gold": "", "features": ""}


def write_layer(tables: Mapping[str, DataFrame], directory: str, layer: str, partition_by: Mapping[str, Sequence[str]] | None = None) -> dict[str, str]:
    """Each table as Parquet ``<name><suffix>.parquet``, optionally partitioned; the paths written."""
    out = {}
    for name, df in tables.items():
        path = os.path.join(directory, f"{name}{LAYER_SUFFIXES[layer]}.parquet")
        w = df.write.mode("overwrite")
        cols = (partition_by or {}).get(name)
        (w.partitionBy(*cols) if cols else w).parquet(path)
        out[name] = path
    return out


def read_layer(spark: SparkSession, directory: str, layer: str) -> dict[str, DataFrame]:
    """Every Parquet table of a layer by name, without the layer's suffix."""
    suffix = LAYER_SUFFIXES[layer]
    names = [x for x in files.names(spark, directory) if x.endswith(".parquet")]
    return {n[: -len(".parquet")].removesuffix(suffix): spark.read.parquet(os.path.join(directory, n)) for n in names}


def _excel_table(spark: SparkSession, path: str) -> DataFrame:
    cells, errors = excel_cells(spark, [path])
    bad = errors.first()
    if bad:
        raise ValueError(f"{path}: {bad['error']}")
    return header_table(cells, {}, rest=True).drop("row_no")


def read_structured(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """User tables by format: Parquet, ORC, JSON, CSV (with header, types by inference left to declared casts) or Excel (names as slugs)."""
    excel = lambda p: _excel_table(spark, p)
    readers = {".parquet": spark.read.parquet, ".orc": spark.read.orc, ".json": spark.read.json, ".csv": lambda p: spark.read.csv(p, header=True), ".xlsx": excel, ".xls": excel}
    out = {}
    for name, p in paths.items():
        kind = os.path.splitext(p.rstrip("/"))[1].lower()
        if kind not in readers:
            raise ValueError(f"{name}: no reader for {kind or 'a path without ending'}")
        out[name] = readers[kind](p)
    return out


def read_optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A table by its ending, or None where no path is given or nothing is there (a weather forecast, a saved choice)."""
    return read_structured(spark, {"table": path})["table"] if path and files.exists(spark, path) else None


def first_table(tables: Mapping[str, DataFrame], names: Sequence[str], required: bool = False) -> DataFrame | None:
    """The first of several names under which a table may be stored."""
    found = next((tables[n] for n in names if n in tables), None)
    if found is None and required:
        raise KeyError(f"none of {', '.join(names)} is there")
    return found


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file in a folder."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_report(spark: SparkSession, report: Mapping, path: str) -> None:
    files.write_text(spark, path, json.dumps(report, indent=2, default=str, sort_keys=True))


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(files.read_text(spark, path))


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A feature catalogue from CSV; its required columns are checked."""
    df = spark.read.csv(path, header=True)
    lost = {"dataset", "column", "feature_dtype", "role", "availability", "safe_default"} - set(df.columns)
    if lost:
        raise ValueError(f"the catalogue lacks {', '.join(sorted(lost))}")
    return df
