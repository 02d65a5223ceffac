"""Cleaning that flags rather than deletes: duplicates, keys, imputation, outliers, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almazara.session import cut

FLAG_SUFFIXES = ("__outlier", "__negative", "__invalid", "__imputed", "__conflict", "__physically_suspicious")


def is_flag(name: str) -> bool:
    return name.endswith(FLAG_SUFFIXES) or name.startswith("quality_")


def exact_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(*columns, copies): each distinct row once, with how often it occurs; combined before the shuffle."""
    return df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("copies"))


def flag_exact_duplicates(df: DataFrame, row_id: str) -> DataFrame:
    """``quality_exact_duplicate`` on every copy after the first by ``row_id`` of rows equal in all other columns.

    The first copy is found by an aggregate over the other columns and joined back by row id, so that a row
    copied a million times is no window of a million rows.
    """
    others = [c for c in df.columns if c != row_id]
    firsts = df.groupBy(*others).agg(F.min(row_id).alias(row_id)).select(row_id, F.lit(False).alias("quality_exact_duplicate"))
    return df.join(firsts, row_id, "left").withColumn("quality_exact_duplicate", F.coalesce("quality_exact_duplicate", F.lit(True)))


def flag_key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``quality_key_duplicate`` on every row whose complete key repeats; a null in the key is never a repeat."""
    repeated = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit(True).alias("quality_key_duplicate"))
    return df.join(repeated, list(keys), "left").withColumn("quality_key_duplicate", F.coalesce("quality_key_duplicate", F.lit(False)))


def require_keys(df: DataFrame, keys: Sequence[str], drop: bool = True) -> DataFrame:
    """Rows with a null in a required key dropped, or flagged ``quality_missing_key``."""
    if drop:
        return df.dropna(subset=list(keys))
    return df.withColumn("quality_missing_key", reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))


def assert_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    """``df``, or an error if a key repeats."""
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"{label}: the key {', '.join(keys)} is not unique")
    return df


#: Values ranked exactly at once at most, if they differ; more are bracketed again first.
MOST_RANKED = 200_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several columns, by a few aggregates over all of them at once.

    A sketch brackets each quantile and the values below and in the bracket are counted; a bracket with more
    than MOST_RANKED values is bracketed again, each round a fraction of about 4 / accuracy of the one before,
    and one that missed is widened. The last aggregate ranks what is left. Only a few numbers a column come to
    the driver.
    """
    val = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    if not columns:
        return {}
    total = df.agg(*[F.count(val[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    out = {c: [None] * len(at) for c in columns}
    # per quantile: bracket (None: everything), values below it, values in it, share of the bracket looked at
    open_ = {(i, j): (None, None, 0, total[f"n{i}"], 2.0 / accuracy) for i in range(len(columns)) for j in range(len(at)) if total[f"n{i}"]}
    done: dict[tuple[int, int], tuple] = {}
    within = lambda i, lo, hi: F.lit(True) if lo is None else val[columns[i]].between(lo, hi)
    place = lambda i, j: at[j] * (total[f"n{i}"] - 1)
    while open_:
        sketches = []
        for (i, j), (lo, hi, below, inside, eps) in open_.items():
            p = (place(i, j) - below) / max(1, inside - 1)
            around = F.array(F.lit(max(0.0, p - eps)), F.lit(min(1.0, p + eps)))
            sketches.append(F.percentile_approx(F.when(within(i, lo, hi), val[columns[i]]), around, F.lit(accuracy)).alias(f"b_{i}_{j}"))
        got = df.agg(*sketches).first()
        counts = []
        for i, j in open_:
            lo, hi = got[f"b_{i}_{j}"]
            counts += [F.count_if(val[columns[i]] < lo).alias(f"below_{i}_{j}"), F.count_if(val[columns[i]].between(lo, hi)).alias(f"in_{i}_{j}")]
        n = df.agg(*counts).first()
        following = {}
        for (i, j), old in open_.items():
            (lo, hi), below, inside = got[f"b_{i}_{j}"], n[f"below_{i}_{j}"], n[f"in_{i}_{j}"]
            if not below <= place(i, j) <= below + inside - 1:
                following[i, j] = (*old[:4], min(1.0, old[4] * 8))  # the sketch missed by more than its accuracy
            elif inside <= MOST_RANKED or lo == hi or inside == old[3]:
                done[i, j] = (lo, hi, below, inside)
            else:
                following[i, j] = (lo, hi, below, inside, 2.0 / accuracy)
        open_ = following
    exact = []
    for (i, j), (lo, hi, below, inside) in done.items():
        if lo == hi:
            out[columns[i]][j] = lo
        else:
            share = (place(i, j) - below) / (inside - 1) if inside > 1 else 0.0
            exact.append(F.percentile(F.when(val[columns[i]].between(lo, hi), val[columns[i]]), F.lit(min(1.0, max(0.0, share)))).alias(f"q_{i}_{j}"))
    if exact:
        got = df.agg(*exact).first()
        for i, j in done:
            if f"q_{i}_{j}" in got.asDict():
                out[columns[i]][j] = got[f"q_{i}_{j}"]
    return out


def running_sums(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of each expression over all rows up to each by ``order`` (unique), within few groups ``by``, without
    one task for all rows of a group.

    Rows are range-partitioned and written once; each part is summed by itself, and the totals of the parts
    before (one row a part and group) are added.
    """
    own, part = {n: f"__value_{n}" for n in sums}, "__part"
    keyed = df.withColumns({own[n]: c for n, c in sums.items()})
    spread = cut(keyed.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    totals = spread.groupBy(part, *by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in own.items()])
    rows, so_far = [], {}
    for r in sorted(totals.collect(), key=lambda r: r[part]):
        group = tuple(r[c] for c in by)
        before = so_far.get(group, {n: type(r[n])(0) for n in sums})
        rows.append((r[part], *group, *[before[n] for n in sums]))
        so_far[group] = {n: before[n] + r[n] for n in sums}
    kinds = dict(totals.dtypes)
    names = [f"__by_{i}" for i in range(len(by))]
    schema = ", ".join([f"`{part}_before` int", *[f"`{n}` {kinds[c]}" for n, c in zip(names, by)], *[f"`__before_{n}` {kinds[n]}" for n in sums]])
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a row a partition and group
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(c)) for n, c in zip(names, by)], F.col(part) == F.col(f"{part}_before"))
    w = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = spread.withColumns({f"__inner_{n}": F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in own.items()}).join(offsets, on)
    return out.select(*df.columns, *[(F.col(f"__inner_{n}") + F.col(f"__before_{n}")).alias(n) for n in sums])


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each by ``order`` (unique)."""
    return running_sums(df, [order], {name: F.col(value)})


def group_medians(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(*by, name): the exact median of each of few groups (one column at least), from running counts of its different values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sums(counts, [value], {"__upto": F.col("__n")}, by)
    total = ranked.groupBy(*by).agg(F.max("__upto").alias("__all"))
    both = ranked.join(total, list(by))
    low = F.min(F.when(F.col("__upto") >= F.floor((F.col("__all") + 1) / 2), F.col(value)))
    high = F.min(F.when(F.col("__upto") >= F.ceil((F.col("__all") + 1) / 2), F.col(value)))
    return both.groupBy(*by).agg(((low + high) / 2).cast("double").alias(name))


def impute_low_missingness(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], most: float = 0.05, label: str = "UNKNOWN", mode: bool = False) -> DataFrame:
    """Nulls filled in columns of which at most a share ``most`` is missing, each with ``<c>__imputed``.

    Numbers by the column's median, categories by ``label`` or their mode (lowest on a tie). A column
    without any value, or with more missing, is left alone. One aggregate counts, one ranks.
    """
    cols = [*numeric, *categorical]
    if not cols:
        return df
    n = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(c).alias(c) for c in cols]).first()
    few = [c for c in cols if 0 < n[c] < n["all"] and (n["all"] - n[c]) / n["all"] <= most]
    medians = exact_quantiles(df, [c for c in few if c in set(numeric)], [0.5])
    values = {c: m[0] for c, m in medians.items()}
    texts = [c for c in few if c in set(categorical)]
    if texts and mode:
        for c in texts:
            values[c] = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), c).first()[c]
    else:
        values |= dict.fromkeys(texts, label)
    kinds = dict(df.dtypes)
    return df.withColumns({f"{c}__imputed": F.col(c).isNull() for c in few}).withColumns({c: F.coalesce(F.col(c), F.lit(values[c]).cast(kinds[c])) for c in few})


def eligible_for_outliers(df: DataFrame, columns: Sequence[str], min_rows: int = 8, min_distinct: int = 5) -> list[str]:
    """Columns with enough values and enough different ones, by one aggregate.

    Distinct values are only counted up to ``min_distinct``: the smallest few of an open set per partition
    say as much, without the expansion of a distinct aggregate per column.
    """
    if not columns:
        return []
    got = df.agg(*[F.count(c).alias(f"n_{c}") for c in columns], *[F.approx_count_distinct(c, 0.01).alias(f"d_{c}") for c in columns]).first()
    sure = [c for c in columns if got[f"n_{c}"] >= min_rows and got[f"d_{c}"] >= min_distinct + 2]
    near = [c for c in columns if got[f"n_{c}"] >= min_rows and abs(got[f"d_{c}"] - min_distinct) < 2]
    return [c for c in columns if c in sure or (c in near and df.where(F.col(c).isNotNull()).select(c).distinct().limit(min_distinct).count() >= min_distinct)]


def outlier_columns(df: DataFrame, columns: Sequence[str], iqr_multiplier: float = 1.5, z_limit: float = 3.5) -> DataFrame:
    """For each column ``<c>__robust_z``, ``<c>__fence_distance``, ``<c>__fence_distance_iqr``, ``<c>__outlier`` and ``<c>__severity`` (none, candidate, strong).

    The distance is how far a value lies beyond the nearer quartile fence, 0 within and for unknown values, and
    the same in quartile distances, null where the quartiles are equal. Two criteria: beyond the quartile fences (infinite where the quartiles are equal), and |0.6745 (x - median)
    / MAD| over ``z_limit`` (null where the MAD is 0). Severity counts how many hold. The quantiles of all
    columns take three aggregates, the MADs three more, then one projection flags all.
    """
    val = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    deviations = df.select(*[F.abs(val[c] - F.lit(q[c][1])).alias(c) for c in columns])
    mad = exact_quantiles(deviations, columns, [0.5])
    add = {}
    for c in columns:
        q1, median, q3 = q[c]
        m = mad[c][0]
        z = F.lit(0.6745) * (val[c] - F.lit(median)) / F.lit(m) if m else F.lit(None).cast("double")
        fenced = q1 is not None and q3 != q1
        low, high = (q1 - iqr_multiplier * (q3 - q1), q3 + iqr_multiplier * (q3 - q1)) if fenced else (None, None)
        out = F.coalesce((val[c] < low) | (val[c] > high), F.lit(False)) if fenced else F.lit(False)
        beyond = F.coalesce(F.greatest(F.lit(low) - val[c], val[c] - F.lit(high), F.lit(0.0)), F.lit(0.0)) if fenced else F.lit(0.0)
        far = F.coalesce(F.abs(z) > z_limit, F.lit(False))
        n = out.cast("int") + far.cast("int")
        add |= {f"{c}__fence_distance": beyond, f"{c}__fence_distance_iqr": beyond / F.lit(q3 - q1) if fenced else F.lit(None).cast("double")}
        add |= {f"{c}__robust_z": z, f"{c}__outlier": out | far, f"{c}__severity": F.element_at(F.array(F.lit("none"), F.lit("candidate"), F.lit("strong")), n + 1)}
    return df.withColumns(add)


def missingness(df: DataFrame) -> DataFrame:
    """(column, missing, fraction): one aggregate, then unpivoted."""
    cols = df.columns
    lost = lambda c, t: F.col(c).isNull() | F.isnan(c) if t in ("double", "float") else F.col(c).isNull()
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(lost(c, t)).alias(f"m{i}") for i, (c, t) in enumerate(df.dtypes)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(cols)]))
    return row.select("n", each.alias("x")).select("x.column", "x.missing", F.try_divide(F.col("x.missing"), F.col("n")).alias("fraction"))


def flag_summary(df: DataFrame) -> DataFrame:
    """(flag, flagged, fraction) of every quality flag of a table."""
    flags = [c for c in df.columns if is_flag(c)]
    if not flags:
        return df.sparkSession.createDataFrame([], "flag string, flagged long, fraction double")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(f"f{i}") for i, c in enumerate(flags)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(f"f{i}").alias("flagged")) for i, c in enumerate(flags)]))
    return row.select("n", each.alias("x")).select("x.flag", "x.flagged", F.try_divide(F.col("x.flagged"), F.col("n")).alias("fraction"))


def master_conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``<c>__conflict`` on every row of a key that has two or more different values of ``c``; nulls don't differ."""
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[(F.min(c) != F.max(c)).alias(f"{c}__conflict") for c in columns])
    return df.join(stats, key, "left").withColumns({f"{c}__conflict": F.coalesce(F.col(f"{c}__conflict"), F.lit(False)) for c in columns})


def consistent_lookup(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per key with each value only if all non-null values agree, else null and ``<c>__master_conflict``."""
    agg = [x for c in columns for x in (F.when(F.min(c) == F.max(c), F.max(c)).alias(c), F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"{c}__master_conflict"))]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*agg)


def value_flag(name: str, condition: Column) -> dict[str, Column]:
    """A flag column that is false where the condition is unknown."""
    return {name: F.coalesce(condition, F.lit(False))}
