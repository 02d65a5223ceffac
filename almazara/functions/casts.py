"""Casts of typed text under ANSI mode: what can't be read is null, never an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almazara.functions.text import slug_name

# Texts that stand for a null (compared in lower case, trimmed).
NULL_TOKENS = ("", "nan", "none", "null", "n/a", "na", "<na>")
# Boolean words, by dialect.
BOOLEAN_WORDS: dict[str, dict[bool, tuple[str, ...]]] = {
    "features": {True: ("true", "1", "yes", "si", "sí"), False: ("false", "0", "no")},
    "context": {True: ("true", "1", "yes", "y", "si", "sí"), False: ("false", "0", "no", "n")},
    "scope": {
        True: ("true", "1", "yes", "y", "si", "sí", "active", "activo", "enabled", "habilitado"),
        False: ("false", "0", "no", "n", "inactive", "inactivo", "disabled", "deshabilitado"),
    },
}
# Calendar patterns in the order they are tried.
DAY_PATTERNS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column; Spark's aggregates skip the one and spread the other."""
    return df.select(*[F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def clean_text(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def null_tokens(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Trimmed, with the tokens for null (in any case) turned into null and the case of the rest kept."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*tokens), t)


def number_eu(c: Column) -> Column:
    """A number written the European way only if it holds a comma; currency sign and blanks are dropped."""
    bare = F.regexp_replace(c, r"[\s ]|€", "")
    return F.when(bare.contains(","), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare).try_cast("double")


def decimal_token(c: Column) -> Column:
    """A money token in which the last separator is the decimal one."""
    bare = F.regexp_replace(c, r"[^0-9,.\-]", "")
    comma, point = F.locate(",", F.reverse(bare)), F.locate(".", F.reverse(bare))
    european = (comma > 0) & ((point == 0) | (comma < point))
    return F.when(european, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit(""))).try_cast("double")


def day(c: Column) -> Column:
    """A day by the first pattern of DAY_PATTERNS that fits; ISO text is never read day first.

    A timestamp in ISO form is its day, and a bare number of five digits the day a spreadsheet counts from 1899-12-30.
    """
    t = F.regexp_replace(F.trim(c), r"^(\d{4}-\d{2}-\d{2})[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$", "$1")
    counted = F.when(t.rlike(r"^[1-9]\d{4}(\.0*)?$"), F.regexp_extract(t, r"^(\d+)", 1).try_cast("int"))
    out = F.date_add(F.lit("1899-12-30").cast("date"), counted)
    for shape, pattern in reversed(DAY_PATTERNS):
        out = F.when(t.rlike(shape), F.try_to_date(t, pattern)).otherwise(out)
    return out


def boolean(c: Column, dialect: str = "features") -> Column:
    """A boolean word of the dialect; other text is null."""
    t = F.lower(F.trim(c))
    words = BOOLEAN_WORDS[dialect]
    return F.when(t.isin(*words[True]), True).when(t.isin(*words[False]), False)


def slug_columns(df: DataFrame) -> DataFrame:
    """Columns renamed to slugs; a clash gets a running number."""
    names, seen = [], {}
    for c in df.columns:
        s = slug_name(c) or "column"
        seen[s] = seen.get(s, 0) + 1
        names.append(s if seen[s] == 1 else f"{s}_{seen[s]}")
    return df.toDF(*names)


#: How columns are typed by name.
NAMED_TYPES: dict[str, str] = {
    **dict.fromkeys(("date", "report_start", "report_end", "report_generated_on", "reservation_date", "created_date", "event_start", "event_end"), "date"),
    **dict.fromkeys(("datetime", "reservation_datetime", "created_datetime"), "timestamp_ntz"),
    **dict.fromkeys(("units", "amount", "price", "people", "tip", "document_total", "document_amount", "receipt_count", "base", "vat", "total", "cash_amount", "card_amount", "event_intensity", "confidence"), "double"),
}


def is_identifier(name: str) -> bool:
    n = name.lower()
    return n in ("id", "code") or n.endswith(("_id", "_code"))


def assert_types(df: DataFrame, types: Mapping[str, str] = NAMED_TYPES) -> DataFrame:
    """Columns cast by name; text days by pattern, the rest by try_cast."""
    have = dict(df.dtypes)
    cast = lambda c: day(F.col(c)) if types[c] == "date" and have[c] == "string" else F.col(c).try_cast(types[c])
    return df.select(*[cast(c).alias(c) if c in types and have[c] != types[c] else F.col(c) for c in df.columns])


def numeric_codes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text identifier columns turned to long where every non-null value is a whole number that reads back as it was written
    (one aggregate for all); others stay text, so no code is lost. ``12.0``, as spreadsheets write it, counts as 12."""
    cols = [c for c, t in df.dtypes if t == "string" and (c in columns if columns is not None else is_identifier(c))]
    if not cols:
        return df
    bare = lambda c: F.regexp_replace(F.trim(c), r"\.0$", "")
    number = lambda c: F.when(bare(c).rlike(r"^(0|-?[1-9]\d{0,17})$"), bare(c)).try_cast("long")
    ok = df.agg(*[((F.count(number(c)) == F.count(c)) & (F.count(c) > 0)).alias(c) for c in cols]).first()
    return df.withColumns({c: number(c) for c in cols if ok[c]})
