"""Problem 4: typed timestamps of mixed formats, precisions and zones brought to one form."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almazara.functions.text import BLANKS, strip_accents
from almazara.session import broadcast_if_small, shared_path

# Month names and their usual shortenings (Spanish, Catalan, English), without accents.
MONTHS = {
    1: ("enero", "ene", "gener", "gen", "january", "jan"),
    2: ("febrero", "feb", "febrer", "february"),
    3: ("marzo", "mar", "marc", "march"),
    4: ("abril", "abr", "april", "apr"),
    5: ("mayo", "may", "maig", "mai"),
    6: ("junio", "jun", "juny", "june"),
    7: ("julio", "jul", "juliol", "july"),
    8: ("agosto", "ago", "agost", "ag", "august", "aug"),
    9: ("septiembre", "setiembre", "sep", "sept", "set", "setembre", "september"),
    10: ("octubre", "oct", "october"),
    11: ("noviembre", "nov", "novembre", "november"),
    12: ("diciembre", "dic", "desembre", "des", "december", "dec"),
}
# Hours east of UTC that a written abbreviation states, whatever else the zone database knows by it.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3}

#: Day 0 of the bare count of days, as days from 1970-01-01.
SERIAL_ZERO = -25_569
_DAY = 86_400

_MONTH_WORDS = "|".join(sorted((w for names in MONTHS.values() for w in names), key=len, reverse=True))
_ZONE = "z|[+-]\\d{2}:?\\d{2}|[+-]\\d{2}|[a-z]{3,4}|[a-z]+(?:/[a-z_]+)+"


def _clock(n: int) -> str:
    return (
        f"(?<H{n}>\\d{{1,2}})[:.](?<M{n}>\\d{{2}})(?:[:.](?<S{n}>\\d{{2}})(?:[.,]\\d+)?)?"
        f"(?: ?(?<P{n}>[ap])\\.? ?m\\.?)?(?: ?hs?\\.?)?(?: ?(?<Z{n}>{_ZONE}))?"
    )


#: Every format as one alternation; the groups of an alternative carry its number.
#: 1 year first, 2 digits only, 3 year last in digits, 4 month in words, 5 counted from 1970, 6 bare count of days.
PATTERN = "^(?:" + "|".join([
    f"(?<Y1>\\d{{4}})(?<q1>[-/.])(?<m1>\\d{{1,2}})\\k<q1>(?<d1>\\d{{1,2}})(?:[t ]{_clock(1)})?",
    f"(?<Y2>\\d{{4}})(?<m2>\\d{{2}})(?<d2>\\d{{2}})(?:[t ]?(?<H2>\\d{{2}})(?<M2>\\d{{2}})(?<S2>\\d{{2}})?(?:[.,]\\d+)?(?: ?(?<Z2>{_ZONE}))?)?",
    f"(?<A3>\\d{{1,2}})(?<q3>[-/.])(?<B3>\\d{{1,2}})\\k<q3>(?<Y3>\\d{{4}}|\\d{{2}})(?:,? {_clock(3)})?",
    f"(?<d4>\\d{{1,2}}) (?:de |d ?['’] ?)?(?<W4>{_MONTH_WORDS})\\.? (?:de |del )?(?<Y4>\\d{{4}})(?:,? {_clock(4)})?",
    "(?<E5>\\d{9,10}|\\d{12,13})",
    "(?<N6>\\d{5})(?<F6>[.,]\\d+)?",
]) + ")$"

#: Blanks, and the two marks by which the groups are written and split.
_IGNORED = BLANKS[:-2] + r"\x01\x02]+"
_NAMES = {
    "year": "Y1 Y2 Y3 Y4", "month": "m1 m2", "day": "d1 d2 d4", "first": "A3", "second": "B3", "word": "W4",
    "hour": "H1 H2 H3 H4", "minute": "M1 M2 M3 M4", "sec": "S1 S2 S3 S4", "half": "P1 P3 P4", "zone": "Z1 Z2 Z3 Z4",
    "epoch": "E5", "serial": "N6", "fraction": "F6",
}


_AT = {n: i for i, n in enumerate(_NAMES)}


def parts(value: Column) -> Column:
    """The written components as an array of strings (empty where absent), to be exploded; no element where no format fits.

    The alternation is matched once a row: one replacement writes every named group, and its result is split.
    Plain text is only put in lower case; accents and odd blanks are folded where there are any.
    """
    low = F.lower(value)
    plain = ~value.rlike("[^!-~ ]|^ | $|  ")
    flat = F.when(plain, low).otherwise(F.trim(F.regexp_replace(strip_accents(low), _IGNORED, " ")))
    groups = "\x02".join("".join(f"${{{g}}}" for g in names.split()) for names in _NAMES.values())
    out = F.split(F.regexp_replace(flat, F.lit(PATTERN), F.lit(groups)), "\x02")
    return F.filter(F.array(out), lambda x: F.size(x) == len(_NAMES))


def _part(name: str) -> Column:
    return F.col("p")[_AT[name]]


def _settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` with column ``name`` passed through a generator with a lambda.

    It ends the stage of generated code, so that no method outgrows what the JVM compiles, and keeps the
    optimiser from copying the column's expression into later uses and filters.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.transform(F.array(name), lambda x: x)).alias(name))


_WHOLE = ("year", "month", "day", "first", "second", "hour", "minute", "sec", "epoch")


def _numbers() -> Column:
    """All components that are whole numbers, read once. They are digits or empty; a try_cast of empty text would cost an exception each."""
    return F.array(*[F.when(_part(n) != "", _part(n)).cast("long") for n in _WHOLE])


def _number(name: str) -> Column:
    return F.col("n")[_WHOLE.index(name)].cast("int")


def day_number(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 of a civil date by integer arithmetic (proleptic Gregorian)."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    yy = F.when(m <= 2, y - 1).otherwise(y).cast("long")
    era = div(yy, 400)
    yoe = yy - era * 400
    doy = div(F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2, 5) + d - 1
    doe = yoe * 365 + div(yoe, 4) - div(yoe, 100) + doy
    return era * 146_097 + doe - 719_468


def _days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def local_to_utc(seconds: Column, zone: Column) -> Column:
    """Wall-clock seconds of a zone to UTC seconds; a time that occurred twice is its first occurrence, and
    one that the clock skipped is read with the offset from before the change. Independent of the session zone."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(seconds), zone))


def utc_to_local(seconds: Column, zone: Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone))


def day_order(parsed: DataFrame) -> DataFrame:
    """Per file, whether its year-last dates in digits put the month first, as (file, month_first), from their
    components (file, a, b, y, hint).

    A number over 12 decides. In a file without one, ``hint`` (the day number a row should be near to) decides
    by the nearer reading summed over the file; with nothing to tell, the day comes first. One aggregation
    with map-side combination, so the size of a file does not matter.
    """
    off = lambda m, d: F.when(F.col("hint").isNotNull() & m.between(1, 12) & d.between(1, 31), F.least(F.abs(day_number(F.col("y"), m, d) - F.col("hint")), F.lit(400)))
    votes = parsed.where("a is not null").groupBy("file").agg(
        F.count_if(F.col("a") > 12).alias("day_first"),
        F.count_if(F.col("b") > 12).alias("month_first"),
        F.sum(off(F.col("b"), F.col("a"))).alias("off_day_first"),
        F.sum(off(F.col("a"), F.col("b"))).alias("off_month_first"),
    )
    told = F.col("day_first") != F.col("month_first")
    return votes.select(
        F.col("file"),
        F.when(told, F.col("month_first") > F.col("day_first")).otherwise(F.coalesce(F.col("off_month_first") < F.col("off_day_first"), F.lit(False))).alias("month_first"),
    )


def _year() -> Column:
    """A year of two digits lies in 1970-2069."""
    y = _number("year")
    return F.when(F.length(_part("year")) == 2, F.when(y < 70, y + 2000).otherwise(y + 1900)).otherwise(y)


@dataclass(frozen=True)
class Typed:
    """Columns of an input to ``normalise``: the value, the row id, the file, the zone of local times, where a
    repeated local hour is told apart by position the place of the row in its file (null where it isn't), and
    columns that are passed through."""

    value: str
    row_id: str
    file: str
    zone: str
    position: str | None = None
    keep: tuple[str, ...] = ()


def _parsed(df: DataFrame, t: Typed, hint: Column | None) -> DataFrame:
    """Every row with the numbers its value is made of, written to the shared folder.

    Columns kept, row_id, value, file, zone, position, hint, fits, and of values in a format y, m, d (year
    first or month in words), a, b (year last), clock (second of the day; null if out of range), z (the zone as
    written), epoch, serial. Written, since the order of day and month is voted on by all values of a file.
    """
    base = df.select(
        (F.struct(*t.keep) if t.keep else F.lit(None).cast("int")).alias("kept"), F.col(t.row_id).cast("long").alias("row_id"), F.col(t.value).alias("value"), F.col(t.file).alias("file"), F.col(t.zone).alias("zone"),
        (F.col(t.position).cast("long") if t.position else F.lit(None).cast("long")).alias("position"), (F.lit(None).cast("long") if hint is None else hint.cast("long")).alias("hint"), F.explode_outer(parts(F.col(t.value))).alias("p"),
    )
    months = [(w, k) for k, names in MONTHS.items() for w in names]
    word = F.map_from_arrays(F.split(F.lit(",".join(w for w, _ in months)), ","), F.split(F.lit(",".join(str(k) for _, k in months)), ",").cast("array<int>"))
    half, hour = _part("half"), F.coalesce(_number("hour"), F.lit(0))
    hh = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    mi, ss = F.coalesce(_number("minute"), F.lit(0)), F.coalesce(_number("sec"), F.lit(0))
    read = _settled(base.withColumn("n", _numbers()), "n")
    read = read.select(
        "kept", "row_id", "value", "file", "zone", "position", "hint", F.col("p").isNotNull().alias("fits"),
        _year().alias("y"), F.when(_part("word") != "", word[_part("word")]).otherwise(_number("month")).alias("m"), _number("day").alias("d"), _number("first").alias("a"), _number("second").alias("b"),
        F.when((hh <= 23) & (mi <= 59) & (ss <= 59), hh * 3600 + mi * 60 + ss).alias("clock"), _part("zone").alias("z"), F.col("n")[_WHOLE.index("epoch")].alias("epoch"),
        F.nullif(F.concat(_part("serial"), F.translate(_part("fraction"), ",", ".")), F.lit("")).try_cast("double").alias("serial"),
    )
    path = shared_path(df.sparkSession, "parsed")
    read.write.parquet(path)
    return df.sparkSession.read.schema(read.schema).parquet(path)


def normalise(df: DataFrame, t: Typed, hint: Column | None = None) -> DataFrame:
    """(*keep, row_id, value, utc_seconds, local_day, stated, time_status) of every row.

    All formats are one regular expression, matched once a row; its components are written, the order of day
    and month is voted on per file from them, calendar ranges are checked (month, day of that month, hour,
    minute, second), and the instant is put together from integer days and seconds.

    What states a zone (Z, an offset, an abbreviation, a region) is taken at its word; seconds or milliseconds
    from 1970 are UTC; the rest, bare counts of days included, is local to column ``zone``. An abbreviation
    that several zones use is that of the row's own zone if it uses it too. ``stated`` is true where the value
    itself fixed the instant.

    ``time_status``: ``normal``; ``null``; ``unreadable`` (blank, or in no format); ``out_of_range`` (a date or
    clock that doesn't exist); ``zone_unknown`` (a zone no one knows or several might be, or a local time of
    an unknown zone). Only normal rows have an instant and a day; local_day is null too where the value states
    its zone and the row has none.

    Defined edge cases: blanks around or within are no difference; very long texts fit no format; repeated rows
    come out as often as they went in.
    """
    parsed = _parsed(df, t, hint)
    read = parsed.join(broadcast_if_small(day_order(parsed)), "file", "left")
    mf = F.coalesce(F.col("month_first"), F.lit(False))
    last = F.col("a").isNotNull()
    y, m, d = F.col("y"), F.when(last, F.when(mf, F.col("a")).otherwise(F.col("b"))).otherwise(F.col("m")), F.when(last, F.when(mf, F.col("b")).otherwise(F.col("a"))).otherwise(F.col("d"))
    kept = ["kept", "row_id", "value", "file", "zone", "position", "fits", "clock", "z", "epoch", "serial"]
    read = _settled(read.select(*kept, F.struct(y.alias("y"), m.alias("m"), d.alias("d")).alias("c")), "c").select(*kept, "c.*")
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    real = y.between(1, 9999) & m.between(1, 12) & d.between(1, _days_in_month(y, m)) & F.col("clock").isNotNull()
    wall = F.when(F.col("serial").isNotNull(), F.round((F.col("serial") + SERIAL_ZERO) * _DAY).cast("long")).when(real, day_number(y, m, d) * _DAY + F.col("clock"))
    z = F.col("z")
    read = read.select("kept", "row_id", "value", "file", "zone", "position", "fits", "epoch", "z", *_zone_columns(z, F.col("zone")), wall.alias("wall"))
    read = _settled(read, "wall")
    stated = F.col("epoch").isNotNull() | (z != "")
    read = read.withColumn("stated", F.coalesce(stated, F.lit(False)))
    utc = (
        F.when(F.col("epoch").isNotNull(), F.when(F.col("epoch") >= 100_000_000_000, F.floor(F.col("epoch") / 1000)).otherwise(F.col("epoch")))
        .when(F.col("offset").isNotNull(), F.col("wall") - F.col("offset"))
        .when((z == "") | F.col("region").isNotNull(), local_to_utc(F.col("wall"), F.coalesce("region", "zone")))
    )
    read = _settled(read.withColumn("utc", utc.cast("long")), "utc")
    if t.position:
        read = _second_occurrences(read)
    status = (
        F.when(F.col("value").isNull(), "null").when(~F.col("fits"), "unreadable").when(F.col("epoch").isNull() & F.col("wall").isNull(), "out_of_range")
        .when(F.col("utc").isNull(), "zone_unknown").otherwise("normal")
    )
    day = F.floor(F.when(F.col("stated"), utc_to_local(F.col("utc"), F.col("zone"))).when(F.col("utc").isNotNull(), F.col("wall")) / _DAY)
    return read.select(*[F.col("kept")[c].alias(c) for c in t.keep], "row_id", "value", F.col("utc").alias("utc_seconds"), F.date_from_unix_date(day.cast("int")).alias("local_day"), "stated", status.alias("time_status"))


@lru_cache(maxsize=1)
def zone_names() -> tuple[dict[str, str], dict[str, int], dict[str, int]]:
    """(regions, abbreviations, abbreviations of zones) of the zone database, in lower case.

    Regions by name; abbreviations that mean one offset wherever they are used, in seconds; and those that
    several zones use for different offsets as ``<region> <abbreviation>``. Offsets are those of a winter and a
    summer day of one year.
    """
    regions, meanings, own = {}, {}, {}
    for name in sorted(zoneinfo.available_timezones()):
        if "/" not in name or name.startswith(("posix/", "right/")):
            continue
        zone = zoneinfo.ZoneInfo(name)
        regions[name.lower()] = name
        for at in (dt.datetime(2024, 1, 15, 12, tzinfo=zone), dt.datetime(2024, 7, 15, 12, tzinfo=zone)):
            word = (at.tzname() or "").lower()
            if word.isalpha() and word not in ABBREVIATIONS:
                seconds = int(at.utcoffset().total_seconds())
                meanings.setdefault(word, set()).add(seconds)
                own[f"{name.lower()} {word}"] = seconds
    sure = {w: next(iter(s)) for w, s in meanings.items() if len(s) == 1}
    return regions, {k: v * 3600 for k, v in ABBREVIATIONS.items()} | sure, {k: v for k, v in own.items() if k.split(" ")[1] not in sure}


def _lookup(table: dict[str, object], key: Column, kind: str) -> Column:
    """``key`` in a table of texts or numbers; two texts in the plan, folded to a constant map."""
    split = lambda x: F.split(F.lit(",".join(map(str, x))), ",")
    return F.try_element_at(F.map_from_arrays(split(table), split(table.values()).cast(f"array<{kind}>")), key)


def _zone_columns(z: Column, zone: Column) -> list[Column]:
    """(offset, region): what a written zone says, as seconds east of UTC or as the name of a region."""
    regions, sure, of_zone = zone_names()
    digits = F.regexp_replace(z, "[+:-]", "")
    signed = (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0)) * 60) * F.when(z.startswith("-"), -1).otherwise(1)
    offset = F.when(z == "z", 0).when(z.rlike("^[+-]"), signed).when(z.rlike("^[a-z]+$"), F.coalesce(_lookup(sure, z, "int"), _lookup(of_zone, F.concat_ws(" ", F.lower(zone), z), "int")))
    return [offset.alias("offset"), F.when(z.contains("/"), _lookup(regions, z, "string")).alias("region")]


def _second_occurrences(read: DataFrame) -> DataFrame:
    """Within a file, of two rows of one repeated local time the one of the higher position is the second.

    Only local times that occurred twice take part (an hour a year and zone), so the groups are small however
    large the file is; rows that state their zone count for the order, but keep their instant.
    """
    later = F.col("utc") + 3600
    wall = F.when(F.col("stated"), utc_to_local(F.col("utc"), F.col("zone"))).otherwise(F.col("wall"))
    shown = F.when(F.col("position").isNotNull(), wall)  # other rows need no conversion
    read = read.withColumn("shown", shown).withColumn("first_utc", local_to_utc(F.col("shown"), F.col("zone")))
    twice = F.coalesce(F.col("utc").isNotNull() & (utc_to_local(F.col("first_utc") + 3600, F.col("zone")) == F.col("shown")), F.lit(False))
    read = read.withColumn("twice", twice)
    ends = read.where("twice and position is not null").groupBy("file", "zone", "shown").agg(F.min("position").alias("low"), F.max("position").alias("high")).where("high > low")
    joined = read.join(broadcast_if_small(ends.withColumn("twice", F.lit(True))), ["file", "zone", "shown", "twice"], "left")
    second = (~F.col("stated")) & (F.col("position") == F.col("high"))
    return joined.withColumn("utc", F.when(F.coalesce(second, F.lit(False)), later).otherwise(F.col("utc")))


def instant_text(seconds: Column) -> Column:
    """UTC seconds as ``YYYY-MM-DDTHH:MM:SSZ``, independent of the session zone."""
    day, rest = F.floor(seconds / _DAY).cast("int"), F.pmod(seconds, F.lit(_DAY))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("Z"))
