"""Problem 3: references to records that do not exist, directly or through an orphaned parent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almazara.session import broadcast_if_small, cut

#: A bound that is open lies beyond every calendar day.
_OPEN_PAST, _OPEN_FUTURE = -2_000_000_000, 2_000_000_000


@dataclass(frozen=True)
class ForeignKey:
    """``child.child_key`` refers to ``parent.parent_key``; with spans, at the time of the child.

    ``child_span`` names the columns with the first and last day of a child (the same column twice for a
    single day), ``parent_span`` those of a parent's validity, where null is open. Without spans only
    existence counts.
    """

    child: str
    parent: str
    child_key: Sequence[str]
    parent_key: Sequence[str]
    child_span: Sequence[str] = ()
    parent_span: Sequence[str] = ()
    name: str = field(default="")

    @property
    def label(self) -> str:
        return self.name or f"{self.child}({','.join(self.child_key)})->{self.parent}"


def _day(c: str) -> F.Column:
    return F.unix_date(F.col(c).cast("date"))


def _parent_spans(parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """One row per parent key with its spans of validity, as k0, k1, ..., spans.

    Spans that begin on one day are first reduced to the longest (of inverted ones to the earliest end), so
    a key holds at most two spans a calendar day, however many parent rows it has.
    """
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(fk.parent_key)]
    a, b = (_day(fk.parent_span[0]), _day(fk.parent_span[1])) if fk.parent_span else (F.lit(None), F.lit(None))
    spans = parent.select(*keys, F.coalesce(a, F.lit(_OPEN_PAST)).alias("a"), F.coalesce(b, F.lit(_OPEN_FUTURE)).alias("b"))
    names = [f"k{i}" for i in range(len(keys))]
    inverted = F.col("b") < F.col("a")
    ends = spans.dropna(subset=names).groupBy(*names, "a").agg(F.max(F.when(~inverted, F.col("b"))).alias("last"), F.min(F.when(inverted, F.col("b"))).alias("early"))
    both = F.explode(F.array_compact(F.array("last", "early")))
    return ends.select(*names, "a", both.alias("b")).groupBy(*names).agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def direct_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey, id_columns: Sequence[str], period: F.Column | None = None) -> DataFrame:
    """Rows of ``child`` with a complete key to which no parent row is valid, as (*id_columns, k0.., p0, p1, period, reason).

    reason: ``missing`` (no row of that key), ``deleted`` (all validity lies before), ``later`` (all after),
    ``between`` (some before, some after). The parents are reduced to one row per key before the join and
    broadcast only if counted to be few; a bigger master is joined by shuffle, where AQE may split a hot key,
    since the parent side has one row per key.

    Defined edge cases: a null in any part of the child key refers to nothing and is no orphan; a child whose
    own span has a null or inverted bound does not count; a parent row whose validity is inverted is valid on
    no day, but exists before or after like its bounds; an empty parent makes every reference ``missing``.
    """
    names = [f"k{i}" for i in range(len(fk.child_key))]
    a, b = (_day(fk.child_span[0]), _day(fk.child_span[1])) if fk.child_span else (F.lit(0), F.lit(0))
    rows = child.select(
        *[F.col(c).alias(f"id{i}") for i, c in enumerate(id_columns)],
        *[F.col(c).alias(n) for c, n in zip(fk.child_key, names)],
        a.alias("p0"),
        b.alias("p1"),
        (F.lit(None).cast("string") if period is None else period).alias("period"),
    ).dropna(subset=[*names, "p0", "p1"]).where("p1 >= p0")
    joined = rows.join(broadcast_if_small(_parent_spans(parent, fk)), names, "left")
    valid = F.exists("spans", lambda s: (s["a"] <= F.col("p1")) & (s["b"] >= F.col("p0")) & (s["a"] <= s["b"]))
    before = F.exists("spans", lambda s: (s["a"] < F.col("p0")) | (s["b"] < F.col("p0")))
    after = F.exists("spans", lambda s: s["a"] > F.col("p1"))
    reason = (
        F.when(F.col("spans").isNull(), "missing")
        .when(before & after, "between")
        .when(after, "later")
        .otherwise("deleted")
    )
    found = joined.where(F.col("spans").isNull() | ~valid)
    return found.select(*[F.col(f"id{i}").alias(c) for i, c in enumerate(id_columns)], *names, "p0", "p1", "period", reason.alias("reason"))


def _child_rows(child: DataFrame, fk: ForeignKey, row_id: str, period: F.Column | None) -> DataFrame:
    """(row_id, k0.., p0, p1, period) of the rows with a complete key and a span that exists."""
    names = [f"k{i}" for i in range(len(fk.child_key))]
    a, b = (_day(fk.child_span[0]), _day(fk.child_span[1])) if fk.child_span else (F.lit(0), F.lit(0))
    rows = child.select(
        F.col(row_id).cast("long").alias("row_id"), *[F.col(c).alias(k) for c, k in zip(fk.child_key, names)], a.alias("p0"), b.alias("p1"),
        (F.lit(None).cast("string") if period is None else period).alias("period"),
    )
    return rows.dropna(subset=[*names, "p0", "p1"]).where("p1 >= p0")


def _inherited(child: DataFrame, parent: DataFrame, orphaned: DataFrame, fk: ForeignKey, ids: Mapping[str, str], period: F.Column | None) -> DataFrame:
    """(row_id, period) of the children whose parents of their time are all orphans, by semi-joins.

    Parents are told apart by ``orphaned`` (rid); what is compared with a child are the spans of its key's
    orphaned and sound parents, reduced as in ``_parent_spans``.
    """
    names = [f"k{i}" for i in range(len(fk.child_key))]
    tagged = parent.select(F.col(ids[fk.parent]).cast("long").alias("__rid"), *dict.fromkeys([*fk.parent_key, *fk.parent_span]))
    dead = _parent_spans(tagged.join(orphaned, "__rid", "left_semi"), fk).withColumnRenamed("spans", "dead")
    keys = dead.select(*[F.col(k).alias(c) for k, c in zip(names, fk.parent_key)])
    sound = _parent_spans(tagged.join(keys, list(fk.parent_key), "left_semi").join(orphaned, "__rid", "left_anti"), fk).withColumnRenamed("spans", "sound")
    both = broadcast_if_small(dead.join(sound, names, "left"))
    meets = lambda spans: F.coalesce(F.exists(spans, lambda s: (s["a"] <= F.col("p1")) & (s["b"] >= F.col("p0")) & (s["a"] <= s["b"])), F.lit(False))
    return _child_rows(child, fk, ids[fk.child], period).join(both, names).where(meets("dead") & ~meets("sound")).select("row_id", "period")


def orphan_cascade(
    tables: Mapping[str, DataFrame],
    keys: Sequence[ForeignKey],
    ids: Mapping[str, str],
    periods: Mapping[str, F.Column] | None = None,
) -> DataFrame:
    """Orphans of every table, as (table_name, row_id, reference, period, reason, origin, round).

    Round 0 finds the rows whose own reference fails (origin ``direct``). Each later round walks down the
    foreign keys from the tables in which rows were orphaned in the round before: a child is one too (origin
    ``inherited``) if it has parents at its time and all of them are orphans, by semi-joins, until a round adds
    nothing (fixpoint). A row fails at most once per reference, so there is an end, cycles included; an acyclic
    graph ends after its depth.

    ``ids`` names the row id of each table, ``periods`` an optional column expression by which reports are
    grouped. A row already orphaned by a reference does not fail by it again.
    """
    periods = dict(periods or {})
    columns = ["table_name", "row_id", "reference", "period", "reason", "origin", "round"]
    parts = []
    for fk in keys:
        d = direct_orphans(tables[fk.child], tables[fk.parent], fk, [ids[fk.child]], periods.get(fk.child))
        parts.append(
            d.select(
                F.lit(fk.child).alias("table_name"), F.col(ids[fk.child]).cast("long").alias("row_id"), F.lit(fk.label).alias("reference"),
                "period", "reason", F.lit("direct").alias("origin"), F.lit(0).alias("round"),
            )
        )
    rounds = [cut(reduce(DataFrame.unionByName, parts))]
    while True:
        fresh = {r[0] for r in rounds[-1].select("table_name").distinct().collect()}  # names of tables
        edges = [fk for fk in keys if fk.parent in fresh]
        so_far = reduce(DataFrame.unionByName, rounds)
        if not edges:
            return so_far.select(columns)
        parts = []
        for fk in edges:
            orphaned = so_far.where(F.col("table_name") == fk.parent).select(F.col("row_id").alias("__rid")).distinct()
            hit = _inherited(tables[fk.child], tables[fk.parent], orphaned, fk, ids, periods.get(fk.child)).select(
                F.lit(fk.child).alias("table_name"), "row_id", F.lit(fk.label).alias("reference"), "period",
                F.lit("orphaned_parent").alias("reason"), F.lit("inherited").alias("origin"), F.lit(len(rounds)).alias("round"),
            )
            parts.append(hit.join(so_far.select("table_name", "row_id", "reference"), ["table_name", "row_id", "reference"], "left_anti").select(columns))
        rounds.append(cut(reduce(DataFrame.unionByName, parts)))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, reference, period, reason and origin."""
    return orphans.groupBy("table_name", "reference", "period", "reason", "origin").agg(F.count(F.lit(1)).alias("orphans"))
