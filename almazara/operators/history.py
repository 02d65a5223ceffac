"""Problem 6: history of changing attributes, stored as checkpoints and deltas, and read by folding them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Every so many versions of an entity one is stored in full.
CHECKPOINT_EVERY = 8


def snapshots(df: DataFrame, entity: Sequence[str], at: str, attributes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The state reported at each time: per attribute the non-null value latest by ``order``, or null.

    One aggregation with map-side combination; afterwards an entity has one row per reported time. Rows that
    state every attribute compete as a whole, so that the shuffle carries their order once; only rows with a
    null compete attribute by attribute.
    """
    rows = df.dropna(subset=[*entity, at])
    whole = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in attributes])
    rank = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    best = F.max(F.when(whole, F.struct(*rank, *[F.col(a).alias(f"a{i}") for i, a in enumerate(attributes)]))).alias("__whole")
    single = [F.max(F.when(~whole & F.col(a).isNotNull(), F.struct(*rank, F.col(a).alias("a")))).alias(f"__part_{i}") for i, a in enumerate(attributes)]
    out = rows.groupBy(*entity, at).agg(best, *single)
    place = lambda c: F.struct(*[F.col(c)[f"o{i}"] for i in range(len(order))])
    later = lambda c: F.col(c).isNotNull() & (F.col("__whole").isNull() | (place(c) > place("__whole")))
    return out.select(*entity, at, *[F.when(later(f"__part_{i}"), F.col(f"__part_{i}")["a"]).otherwise(F.col("__whole")[f"a{i}"]).alias(a) for i, a in enumerate(attributes)])


def _compared(attributes: Sequence[str], compare: Mapping[str, Column] | None) -> list[Column]:
    return [(compare or {}).get(a, F.col(a)).alias(f"__cmp_{a}") for a in attributes]


def _deltas(states: DataFrame, entity: Sequence[str], at: str, attributes: Sequence[str], compare: Mapping[str, Column] | None, every: int) -> DataFrame:
    """The rows to store of ``states`` (*entity, at, attributes, __base): snapshots, and where a history goes on
    the state it had reached, with its version number in ``__base``, which is not stored again."""
    by = Window.partitionBy(*entity).orderBy(at)
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    # repartitioned by hand, so that what values are compared by is not shuffled beside them
    known = states.repartition(*entity).select("*", *_compared(attributes, compare)).select(
        "*", *[F.last(f"__cmp_{a}", True).over(before).alias(f"__was_{a}") for a in attributes], F.row_number().over(by).alias("__seen"), F.first("__base", True).over(upto).alias("__from"),
    )
    # null-safe: an attribute that is null now keeps its value; one that was null becomes known
    touched = {a: F.col(f"__cmp_{a}").isNotNull() & ~F.col(f"__cmp_{a}").eqNullSafe(F.col(f"__was_{a}")) for a in attributes}
    rows = known.withColumns({f"__new_{a}": F.when(c, F.col(a)) for a, c in touched.items()}).withColumn("__any", F.array_contains(F.array(*touched.values()), True))
    rows = rows.where("__any or __seen = 1").withColumn("version", F.row_number().over(by) - 1 + F.coalesce("__from", F.lit(0)))
    full = F.col("version") % every == 0
    rows = rows.select(
        *entity, F.col(at).alias("valid_from"), "version", F.floor(F.col("version") / every).cast("int").alias("segment"), F.when(full, "checkpoint").otherwise("patch").alias("kind"),
        *[F.when(full, F.last(f"__new_{a}", True).over(upto)).otherwise(F.col(f"__new_{a}")).alias(a) for a in attributes], "__base",
    )
    return rows.where("__base is null").drop("__base")


def delta_store(snaps: DataFrame, entity: Sequence[str], at: str, attributes: Sequence[str], compare: Mapping[str, Column] | None = None, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """The compact store: one row per version, as (*entity, valid_from, version, segment, kind, attributes).

    Version 0 and every ``every``-th after it are checkpoints and hold all attributes; the versions between are
    patches and hold only what became other or known, null elsewhere. ``compare`` gives the expressions by which
    values are compared (default: the values). A time at which nothing differs and nothing becomes known has no
    row. What changed is not stored: ``reconstruct`` finds it by folding.
    """
    return _deltas(snaps.select(*entity, at, *attributes, F.lit(None).cast("int").alias("__base")), entity, at, attributes, compare, every)


def write_store(store: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """``store`` written as Parquet below ``path``, checkpoints and patches in folders of their own, and read from there."""
    store.write.mode(mode).partitionBy("kind").parquet(path)
    return store.sparkSession.read.schema(store.schema).parquet(path).select(store.columns)


def append(store: DataFrame, snaps: DataFrame, entity: Sequence[str], at: str, attributes: Sequence[str], compare: Mapping[str, Column] | None = None, every: int = CHECKPOINT_EVERY) -> tuple[DataFrame, DataFrame]:
    """(rows to add to the store, late snapshots) of newer snapshots, without reading more than each entity's last segment.

    The state reached is folded from the last checkpoint of the entities that have new snapshots; versions go on
    from there. A snapshot not after its entity's last version is late: it is returned and not stored, since
    the times between versions that confirmed them are not in the store.
    """
    last = store.groupBy(*entity).agg(F.max("segment").alias("segment")).join(snaps.select(*entity).distinct(), list(entity), "left_semi")
    state = store.join(last, [*entity, "segment"], "left_semi").groupBy(*entity).agg(
        F.max("valid_from").alias(at), *[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("version"))).alias(a) for a in attributes], F.max("version").alias("__base"),
    )
    reached = state.select(*entity, F.col(at).alias("__reached"))
    dated = snaps.join(reached, list(entity), "left")
    late = F.coalesce(F.col(at) <= F.col("__reached"), F.lit(False))
    fresh = dated.where(~late).select(*entity, at, *attributes, F.lit(None).cast("int").alias("__base"))
    return _deltas(fresh.unionByName(state), entity, at, attributes, compare, every), dated.where(late).select(snaps.columns)


def reconstruct(store: DataFrame, entity: Sequence[str], attributes: Sequence[str], compare: Mapping[str, Column] | None = None) -> DataFrame:
    """The validity rows: every version in full, as (*entity, valid_from, valid_to, version, changed, attributes).

    Patches are folded forward from the nearest checkpoint, that is within a segment of bounded length.
    ``changed`` lists the attributes in which a folded version differs from the folded version before; becoming
    known for the first time is no change. ``valid_to`` is the day before the next version, null for the last.
    All windows share one shuffle, by entity, and one sort, by segment and version within it.
    """
    along = Window.partitionBy(*entity).orderBy("segment", "version")
    fold = Window.partitionBy(*entity, "segment").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    rows = store.repartition(*entity).withColumn("valid_to", F.date_sub(F.lead("valid_from").over(along), 1))
    rows = rows.withColumns({a: F.last(a, True).over(fold) for a in attributes})
    rows = rows.select("*", *_compared(attributes, compare))
    was = {a: F.lag(f"__cmp_{a}").over(along) for a in attributes}
    moved = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"__cmp_{a}") != was[a], F.lit(False)), F.lit(a)) for a in attributes]))
    return rows.withColumn("changed", moved).select(*entity, "valid_from", "valid_to", "version", "changed", *attributes)
