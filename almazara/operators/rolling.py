"""Problem 7: totals and averages over trailing days by binary doubling, days without a row included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_versions(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of rows sharing ``keys`` the values of the one latest by ``order`` (nulls first); combined before the shuffle."""
    rank = F.struct(*order)
    picked = F.max_by(F.struct(*values), rank).alias("picked")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("picked")[v].alias(v) for v in values])


def _blocks(window: int) -> list[int]:
    """The powers of two of which the window is the sum, largest first."""
    return [1 << b for b in reversed(range(window.bit_length())) if window >> b & 1]


def trailing_sums(df: DataFrame, entity: Sequence[str], day: str, measures: Mapping[str, Column], windows: Sequence[int]) -> DataFrame:
    """One row per entity: ``entity``, ``first_day`` (day number), ``days``, and for each measure and window an array.

    ``<measure>_<window>`` holds, for each day from the entity's first to its last, the measure's sum over the
    ``window`` days that end that day. Sums of 1, 2, 4, ... days are doubled (a block plus the block before it),
    and a window is put together from the blocks of its binary digits, so any number of windows costs
    log2(longest) passes over the days.

    ``measures`` maps names to row expressions; null counts as nothing. Rows are first added up per entity and
    day with map-side combination; what is then gathered per entity is one number a day, bounded by the
    calendar, however many rows the entity has.

    Defined edge cases: rows with a null entity column or a null day are left out; an empty input gives no
    row; a window longer than the history sums what there is; a window must be positive.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows must be positive numbers of days")
    named = [f"e{i}" for i in range(len(entity))]
    rows = df.select(
        *[F.col(c).alias(n) for c, n in zip(entity, named)],
        F.unix_date(F.col(day).cast("date")).alias("on"),
        *[c.alias(f"v{j}") for j, c in enumerate(measures.values())],
    ).dropna(subset=[*named, "on"])
    values = [f"v{j}" for j in range(len(measures))]
    daily = rows.groupBy(*named, "on").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
    # one number a day, sparse and sorted
    out = daily.groupBy(*named).agg(F.sort_array(F.collect_list(F.struct("on", *values))).alias("s"))
    out = out.select(*named, F.col("s")[0]["on"].alias("first_day"), F.explode(F.array("s")).alias("s"))
    dense = []
    for v in values:
        kind = "double" if rows.schema[v].dataType.typeName() in ("double", "float") else "long"
        dense.append(_dense(v, kind).alias(f"{v}_b1"))
    out = out.select(*named, "first_day", *dense)
    top = max(windows)
    size = 1
    while size * 2 <= top:
        size *= 2
        doubled = [_plus_earlier(f"{v}_b{size // 2}", f"{v}_b{size // 2}", size // 2).alias(f"{v}_b{size}") for v in values]
        out = out.select("*", *doubled)
    for w in windows:
        blocks = _blocks(w)
        out = out.withColumns({f"{v}_w{w}": F.col(f"{v}_b{blocks[0]}") for v in values})
        at = blocks[0]
        for b in blocks[1:]:
            out = out.select(*[c for c in out.columns if c not in {f"{v}_w{w}" for v in values}], *[_plus_earlier(f"{v}_w{w}", f"{v}_b{b}", at).alias(f"{v}_w{w}") for v in values])
            at += b
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(named, entity)], "first_day", F.size("v0_b1").alias("days"),
        *[F.col(f"{v}_w{w}").alias(f"{m}_{w}") for v, m in zip(values, measures) for w in windows],
    )


def _dense(value: str, kind: str) -> Column:
    """The sorted sparse days of column ``s`` as one element a day, with zeros between two days."""

    def run(x: Column, i: Column) -> Column:
        gap = F.coalesce(F.try_element_at(F.col("s"), i + 2)["on"] - x["on"] - 1, F.lit(0))
        return F.concat(F.array(x[value].cast(kind)), F.array_repeat(F.lit(0).cast(kind), gap))

    return F.flatten(F.transform("s", run))


def _plus_earlier(a: str, b: str, shift: int) -> Column:
    """Element i of ``a`` plus element i - shift of ``b`` (nothing before the first)."""
    return F.transform(a, lambda x, i: F.when(i < shift, x).otherwise(x + F.get(F.col(b), i - shift)))


def unfold(sums: DataFrame, entity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per entity and day from the arrays of ``trailing_sums``, as (*entity, on_day, *columns)."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return sums.select(*entity, "first_day", F.posexplode(zipped).alias("i", "x")).select(
        *entity, F.date_from_unix_date(F.col("first_day") + F.col("i")).alias("on_day"), *[F.col("x")[c].alias(c) for c in columns]
    )
