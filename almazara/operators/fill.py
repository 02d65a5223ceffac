"""Problem 1: values that are missing in any guise, filled from similar records and marked."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almazara.session import broadcast_if_small, shared_path, value_bytes

#: A value this many times the median of its group is absurd there.
ABSURD_FACTOR = 25.0
#: A day this far from the median day of its file is absurd there.
ABSURD_DAYS = 400
#: The dictionaries of one fill that are broadcast take at most so many measured bytes together: the driver builds
#: them and holds all of them at once. Their files say little of that, being compressed and shared by all.
BROADCAST_BYTES = 8 << 20
# Days that stand for "unknown" in exports (zero day of spreadsheets, of Unix, end of time).
STAND_IN_DAYS = ("1900-01-01", "1970-01-01", "9999-12-31")


@dataclass(frozen=True)
class Dependency:
    """A candidate: the columns ``determinant`` fix ``of``, the target itself or a quantity derived from it.

    ``value`` leads from the dictionary's entry back to the target, and may use the record's own columns (a
    derived ``of`` that is null for a record says nothing about it). With ``within`` 0 the records of a group
    must agree; above 0 the dependency is metric: a group agrees if its standard deviation is at most that
    share of its mean, and the entry is the mean, weighted by ``weight`` (a quotient by its divisor, say).
    ``label`` names a derived quantity.
    """

    target: str
    determinant: tuple[str, ...]
    of: Column | None = None
    value: Callable[[Column], Column] = lambda entry: entry
    within: float = 0.0
    label: str = ""
    weight: Column | None = None

    @property
    def name(self) -> str:
        return "fd:" + "+".join(self.determinant) + (f"->{self.label}" if self.label else "")


@dataclass(frozen=True)
class Fallback:
    """An estimate from a group: ``statistic`` is an aggregate over complete records, ``value`` leads from it to the target."""

    target: str
    name: str
    group: tuple[str, ...]
    statistic: Column
    value: Callable[[Column], Column] = lambda statistic: statistic


@dataclass(frozen=True)
class Evidence:
    """What complete records say of a candidate: groups of two or more, and how many of them disagree."""

    dependency: Dependency
    groups: int
    violations: int

    def holds(self, tolerance: float) -> bool:
        return self.groups > 0 and self.violations <= tolerance * self.groups


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, like ``name``."""
    while name in df.columns:
        name += "_"
    return name


def usable_pair(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """``df`` with ``<a>__reason`` and ``<b>__reason``: why a value of two companion measures is missing, or null.

    Reasons: ``null``, ``nan``, ``impossible`` (negative), ``absurd`` (ABSURD_FACTOR times the group's median
    of positive values or more), ``contradicted`` (zero beside a usable positive value of the other). A zero
    beside another zero, or beside a missing value, is a real zero of a closed day.

    The group medians are sketches, combined before the shuffle, one row a group.
    """
    val = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (a, b)}
    key, mid = _free(df, "group_key"), {c: _free(df, f"{c}__median") for c in (a, b)}
    own = {c: _free(df, f"{c}__own") for c in (a, b)}
    stats = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias(key)).agg(
        *[F.percentile_approx(F.when(val[c] > 0, val[c]), F.lit(0.5), F.lit(200)).alias(mid[c]) for c in (a, b)]
    )
    rows = df.join(broadcast_if_small(stats), F.col(group) == F.col(key), "left")
    rows = rows.withColumns({
        own[c]: F.when(F.col(c).isNull(), "null").when(F.isnan(F.col(c).cast("double")), "nan").when(F.col(c) < 0, "impossible")
        .when(F.coalesce(F.col(c) >= ABSURD_FACTOR * F.col(mid[c]), F.lit(False)) & (F.col(c) > 0), "absurd")
        for c in (a, b)
    })

    def reason(c: str, other: str) -> Column:
        contradicted = (F.col(c) == 0) & F.col(own[other]).isNull() & (F.col(other) > 0)
        return F.when(F.col(own[c]).isNotNull(), F.col(own[c])).when(contradicted, "contradicted")

    return rows.withColumns({f"{a}__reason": reason(a, b), f"{b}__reason": reason(b, a)}).drop(key, *mid.values(), *own.values())


def usable_day(df: DataFrame, file: str, day: str) -> DataFrame:
    """``df`` with ``<day>__reason``: ``null``, ``stand_in`` (a fixed day for unknown) or ``absurd`` (ABSURD_DAYS from the file's median day)."""
    n = F.unix_date(F.col(day).cast("date"))
    stand_in = F.col(day).cast("date").isin(*[F.lit(x).cast("date") for x in STAND_IN_DAYS])
    key, mid = _free(df, "group_key"), _free(df, "median_day")
    stats = df.where(~stand_in & F.col(file).isNotNull()).groupBy(F.col(file).alias(key)).agg(F.percentile_approx(n, F.lit(0.5), F.lit(200)).alias(mid))
    rows = df.join(broadcast_if_small(stats), F.col(file) == F.col(key), "left")
    reason = F.when(F.col(day).isNull(), "null").when(stand_in, "stand_in").when(F.abs(n - F.col(mid)) > ABSURD_DAYS, "absurd")
    return rows.withColumn(f"{day}__reason", reason).drop(key, mid)


def _complete(target: str) -> Column:
    return F.when(F.col(f"{target}__reason").isNull(), F.col(target))


def _dictionaries(df: DataFrame, dependencies: Sequence[Dependency], fallbacks: Sequence[Fallback]) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """All dictionaries as one written table, and their determinants in order of ``__set``.

    A determinant is aggregated once for every candidate and fallback that uses it: for candidate i the columns
    ``n<i>`` (records), ``entry<i>`` and ``apart<i>`` (the group disagrees), for fallback j ``stat<j>``. The
    aggregates are combined before the shuffle. The table is written, since evidence and lookups read it.
    """
    sets: dict[tuple[str, ...], list[Column]] = {}
    for i, d in enumerate(dependencies):
        of = _complete(d.target) if d.of is None else d.of
        if d.within:
            x = of.cast("double")
            mean = F.avg(x) if d.weight is None else F.try_divide(F.sum(x * d.weight), F.sum(F.when(x.isNotNull(), d.weight)))
            entry, apart = mean, F.coalesce(F.stddev_samp(x) > d.within * F.abs(F.avg(x)), F.lit(False))
        else:
            entry, apart = F.min(of), F.coalesce(F.min(of) != F.max(of), F.lit(False))
        sets.setdefault(d.determinant, []).extend([F.count(of).alias(f"n{i}"), F.when(~apart, entry).alias(f"entry{i}"), apart.alias(f"apart{i}")])
    for j, f in enumerate(fallbacks):
        sets.setdefault(tuple(f.group), []).append(f.statistic.alias(f"stat{j}"))
    parts = []
    for k, (determinant, aggregates) in enumerate(sets.items()):
        keys = [F.col(c).alias(f"key_{k}_{n}") for n, c in enumerate(determinant)]
        rows = df.dropna(subset=list(determinant)) if determinant else df
        parts.append(rows.groupBy(*keys).agg(*aggregates).withColumn("__set", F.lit(k)))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    path = shared_path(df.sparkSession, "dictionaries")
    table.write.partitionBy("__set").parquet(path)
    return df.sparkSession.read.schema(table.schema).parquet(path), list(sets)


def mine(df: DataFrame, dependencies: Sequence[Dependency], fallbacks: Sequence[Fallback] = ()) -> tuple[DataFrame, list[tuple[str, ...]], list[Evidence], dict[int, int]]:
    """The dictionaries of all candidates, the evidence for each, from complete records, and the bytes of each dictionary.

    A group counts if it has two or more records, and is a violation if they disagree. One job makes all
    dictionaries, one counts and measures; a row a dictionary comes to the driver.
    """
    if not dependencies and not fallbacks:
        return df.limit(0), [], [], {}
    table, sets = _dictionaries(df, dependencies, fallbacks)
    counts = [x for i in range(len(dependencies)) for x in (F.count_if(F.col(f"n{i}") > 1).alias(f"g{i}"), F.count_if((F.col(f"n{i}") > 1) & F.col(f"apart{i}")).alias(f"v{i}"))]
    width = sum((F.when(F.col(c).isNotNull(), value_bytes(c, t)).otherwise(0) for c, t in table.dtypes if c != "__set"), F.lit(64).cast("long"))
    said = {r["__set"]: r for r in table.groupBy("__set").agg(F.sum(width).alias("bytes"), *counts).collect()}
    evidence = [Evidence(d, sum(r[f"g{i}"] for r in said.values()), sum(r[f"v{i}"] for r in said.values())) for i, d in enumerate(dependencies)]
    return table, sets, evidence, {k: r["bytes"] for k, r in said.items()}


def _small(sizes: dict[int, int]) -> set[int]:
    """The dictionaries to broadcast: the smallest first, as long as they take BROADCAST_BYTES together."""
    small, total = set(), 0
    for k, size in sorted(sizes.items(), key=lambda x: x[1]):
        total += size
        if total > BROADCAST_BYTES:
            break
        small.add(k)
    return small


def fill(df: DataFrame, targets: Sequence[str], dependencies: Sequence[Dependency], fallbacks: Sequence[Fallback] = (), tolerance: float = 0.05) -> DataFrame:
    """``df`` (with ``<target>__reason``) with ``<target>__filled_value``, ``__filled`` and ``__source`` for each target.

    1. The candidates are mined from complete records and verified: one holds if at most ``tolerance`` of its
       groups with two or more records disagree.
    2. The dictionaries of those that hold (entries of agreeing groups only) are left-joined to the incomplete
       records, one join a determinant for all targets; exact ones come first, then the strongest evidence.
       Source ``fd:<columns>``, with the derived quantity if it isn't the target.
    3. What is still missing is estimated by the group fallbacks, in order. Source ``group:<name>``.

    Only incomplete records are joined; complete ones pass through. A group with a third of the rows is no hot
    spot: it is combined before the shuffle, and what is joined to it is one row. Dictionaries are broadcast if they
    were measured to be small together (BROADCAST_BYTES), else merged, never by an estimate from their files.

    Defined edge cases: a missing value without any similar record stays null, source ``none``, and is still
    marked by its reason; an empty input passes through; a null in a determinant or group column matches nothing.
    """
    table, sets, evidence, sizes = mine(df, dependencies, fallbacks)
    small = _small(sizes)
    held = [(i, e) for i, e in enumerate(evidence) if e.holds(tolerance)]
    held.sort(key=lambda x: (x[1].dependency.within, x[1].violations / x[1].groups, -x[1].groups))
    missing = reduce(lambda a, b: a | b, [F.col(f"{t}__reason").isNotNull() for t in targets])
    lost, own = df.where(missing), "__"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    for k, determinant in enumerate(sets):
        wanted = [(f"entry{i}", i) for i, e in held if e.dependency.determinant == determinant] + [(f"stat{j}", j) for j, f in enumerate(fallbacks) if tuple(f.group) == determinant]
        if not wanted:
            continue
        if determinant:
            names = [f"{own}key_{k}_{n}" for n in range(len(determinant))]
            side = table.where(F.col("__set") == k).select(*[F.col(f"key_{k}_{n}").alias(c) for n, c in enumerate(names)], *[F.col(c).alias(own + c) for c, _ in wanted])
            side = side.hint("broadcast" if k in small else "merge")
            lost = lost.join(side, reduce(lambda a, b: a & b, [lost[c] == side[n] for c, n in zip(determinant, names)]), "left").drop(*names)
        else:
            overall = table.where(F.col("__set") == k).first()
            lost = lost.withColumns({own + c: F.lit(overall[c] if overall else None).cast(table.schema[c].dataType) for c, _ in wanted})
    made = {}
    for t in targets:
        kind = df.schema[t].dataType
        options = [(e.dependency.value(F.col(f"{own}entry{i}")).cast(kind), e.dependency.name) for i, e in held if e.dependency.target == t]
        options += [(f.value(F.col(f"{own}stat{j}")).cast(kind), f"group:{f.name}") for j, f in enumerate(fallbacks) if f.target == t]
        value = F.coalesce(*[c for c, _ in options]) if options else F.lit(None).cast(kind)
        source = reduce(lambda w, o: w.when(o[0].isNotNull(), o[1]), options, F.when(F.lit(False), "")).otherwise("none")
        absent = F.col(f"{t}__reason").isNotNull()
        made |= {f"{t}__filled_value": F.when(absent, value).otherwise(F.col(t)), f"{t}__source": F.when(absent, source)}
    filled = lost.withColumns(made).select(*df.columns, *made)
    passed = df.where(~missing).withColumns({c: F.col(c.removesuffix("__filled_value")) if c.endswith("__filled_value") else F.lit(None).cast("string") for c in made})
    return passed.unionByName(filled).withColumns({f"{t}__filled": F.col(f"{t}__reason").isNotNull() & F.col(f"{t}__filled_value").isNotNull() for t in targets})


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, for inputs that several passes of ``fill`` read."""
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
