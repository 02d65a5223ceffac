"""Problem 9: packing items into containers of fixed capacity, best fit decreasing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almazara.session import shared_path

#: Items packed together by one task. A bound on memory; what a group leaves half empty is packed again over all groups.
GROUP_ITEMS = 50_000
#: Trees with more leaves than this are kept sparse, so that memory follows the open containers, not the capacity.
_DENSE = 1 << 20


class _Counts(dict):
    """Counts by node; what is not there counts 0 and takes no room."""

    def __missing__(self, node: int) -> int:
        return 0


class OpenContainers:
    """A segment tree over remaining capacities: leaf r counts the open containers with r left."""

    def __init__(self, capacity: int):
        self.base = 1 << max(1, capacity).bit_length()
        self.sparse = self.base > _DENSE
        self.count = _Counts() if self.sparse else [0] * (2 * self.base)
        self.at: dict[int, list[int]] = {}

    def add(self, left: int, container: int) -> None:
        self.at.setdefault(left, []).append(container)
        node = self.base + left
        while node:
            self.count[node] += 1
            node >>= 1

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """The (remaining, container) with the least remaining capacity of at least ``size``, taken out; None if there is none."""
        count, node = self.count, self.base + size
        if not count[node]:
            while True:  # up to the first ancestor whose right sibling holds something
                if node == 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.base:  # down to its leftmost leaf in use
                node *= 2
                if not count[node]:
                    node += 1
        left = node - self.base
        container = self.at[left].pop()
        if not self.at[left]:
            del self.at[left]
        while node:
            count[node] -= 1
            if self.sparse and not count[node]:
                del count[node]
            node >>= 1
        return left, container


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece, tokens, container) of every piece; ``item`` is the position in ``sizes``.

    An item larger than the capacity, and only such, is split into full pieces, each its own container, and a
    rest. All other pieces go, largest first (ties by position), into the open container with the least
    remaining capacity that holds them, or open a new one.
    """
    full = np.where(sizes > capacity, sizes // capacity, 0).astype(np.int64)
    rest = sizes - full * capacity
    n_full = int(full.sum())
    item = np.repeat(np.arange(len(sizes)), full)
    piece = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
    out = [(item, piece, np.full(n_full, capacity, np.int64), np.arange(n_full))]
    loose = np.flatnonzero((rest > 0) | (full == 0))
    loose = loose[np.argsort(-rest[loose], kind="stable")]
    containers, opened, nxt = np.empty(len(loose), np.int64), OpenContainers(capacity), n_full
    for i, size in enumerate(rest[loose].tolist()):
        found = opened.take_tightest(size)
        if found is None:
            found = capacity, nxt
            nxt += 1
        containers[i] = found[1]
        opened.add(found[0] - size, found[1])
    out.append((loose, full[loose], rest[loose], containers))
    return tuple(np.concatenate(x) for x in zip(*out))


def pack(items: DataFrame, capacities: DataFrame, id_column: str = "doc_id", size_column: str = "tokens", group_items: int = GROUP_ITEMS, rows_known: int | None = None) -> DataFrame:
    """(capacity_id, container_id, id, piece, tokens): all items in containers of each capacity.

    ``capacities`` has capacity_id and capacity_tokens; it is a table of parameters, every row of which repeats
    the packing, and comes to the driver whole. The items are dealt round into groups of about ``group_items``
    rows, whatever their ids, so no key makes a group large; each group is packed whole by one task, for all
    capacities, with best fit decreasing on a segment tree. Best fit leaves at most one container of a group half
    empty or more (a second one's first item would have fitted into it); these, one a group, are packed again over
    all groups as if they were items. Container ids are unique per capacity: group number times 2^32 plus the
    container's number in the group; the groups' last containers that were put together bear the id of one of them.

    ``rows_known`` is the number of items where it is known more cheaply than by counting ``items`` (whose
    sizes would be computed twice); it only sets the number of groups.

    Defined edge cases: an item of size 0 (an empty text), or of null or negative size, takes no space and lies
    in the tightest container there is; repeated rows are items of their own; a capacity that is null or not
    positive has no containers; no items give no rows.
    """
    spark = items.sparkSession
    caps = [(r[0], int(r[1])) for r in capacities.where("capacity_tokens > 0").select("capacity_id", "capacity_tokens").distinct().orderBy("capacity_tokens", "capacity_id").collect()]
    rows = items.select(F.col(id_column).alias("id"), F.greatest(F.coalesce(F.col(size_column).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    if not caps:
        return rows.limit(0).select(F.lit(0).cast("long").alias("capacity_id"), F.lit(0).cast("long").alias("container_id"), F.col("id").alias(id_column), F.lit(0).alias("piece"), F.col("size").alias("tokens"))
    groups = max(1, math.ceil((rows.count() if rows_known is None else rows_known) / group_items))
    kind = items.schema[id_column].dataType.simpleString()
    schema = f"capacity_id bigint, container_id bigint, `{id_column}` {kind}, piece int, tokens bigint"
    packed = lambda group, sizes: ((c, n, group, best_fit_decreasing(sizes, n)) for c, n in caps)

    def whole(ids: pa.Array, sizes: np.ndarray, group: int, moved: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
        for capacity_id, _, _, (item, piece, tokens, container) in packed(group, sizes):
            container = container + (group << 32)
            if moved:
                there = np.fromiter((moved.get((capacity_id, c), c) for c in range(int(container.min()), int(container.max()) + 1)), np.int64)
                container = there[container - container.min()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(item), capacity_id, np.int64)), pa.array(container), ids.take(pa.array(item)), pa.array(piece.astype(np.int32)), pa.array(tokens)],
                names=["capacity_id", "container_id", id_column, "piece", "tokens"],
            )

    if groups == 1:

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if got:
                t = pa.Table.from_batches(got).combine_chunks()
                yield from whole(t.column(0).combine_chunks(), t.column(1).to_numpy(), 0, {})

        return rows.repartition(1).mapInArrow(once, schema)

    path = shared_path(spark, "sizes")  # sizes are computed once, for two passes over the same groups
    dealt = rows.repartition(groups).withColumn("group", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path).repartition(groups, "group")  # a number, so that small groups aren't put into one task

    def tails(t: pa.Table) -> pa.Table:
        out = []
        for capacity_id, capacity, group, (_, _, tokens, container) in packed(t.column("group")[0].as_py(), t.column("size").to_numpy()):
            used = np.bincount(container, tokens)
            out += [(capacity_id, (group << 32) + int(c), int(used[c])) for c in np.flatnonzero(2 * used <= capacity)]
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["capacity_id", "container_id", "used"])

    sizes_of = dict(caps)

    def together(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("container_id").to_numpy(), -t.column("used").to_numpy()))
        ids, used = t.column("container_id").to_numpy()[order], t.column("used").to_numpy()[order]
        item, _, _, container = best_fit_decreasing(used, sizes_of[t.column("capacity_id")[0].as_py()])
        first: dict[int, int] = {}
        new = [first.setdefault(int(c), int(ids[i])) for i, c in sorted(zip(item, container))]
        return pa.table([t.column("capacity_id").combine_chunks(), pa.array(ids[np.sort(item)]), pa.array(new, pa.int64())], names=["capacity_id", "container_id", "into"])

    last = dealt.groupBy("group").applyInArrow(tails, "capacity_id bigint, container_id bigint, used bigint")
    merged = last.groupBy("capacity_id").applyInArrow(together, "capacity_id bigint, container_id bigint, into bigint")  # a row a group at most
    shared = spark.sparkContext.broadcast({(r[0], r[1]): r[2] for r in merged.where("container_id <> into").collect()})  # a row a group and capacity at most

    def final(t: pa.Table) -> pa.Table:
        parts = list(whole(t.column("id").combine_chunks(), t.column("size").to_numpy(), t.column("group")[0].as_py(), shared.value))
        return pa.Table.from_batches(parts)

    return dealt.groupBy("group").applyInArrow(final, schema)


def packing_quality(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, capacity_tokens, containers, tokens, least_containers, unused_share) of a packing."""
    used = packed.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("tokens")).groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    out = used.join(capacities.select("capacity_id", "capacity_tokens"), "capacity_id")
    return out.select(
        "capacity_id", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(1 - F.try_divide(F.col("tokens"), F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )


def packing_faults(items: DataFrame, packed: DataFrame, capacities: DataFrame, id_column: str = "doc_id", size_column: str = "tokens") -> DataFrame:
    """(capacity_id, capacity_tokens, items, overfull, needless_splits, lost_tokens) of a packing of items with unique ids.

    Containers over their capacity, items in several pieces though they fit one container, and tokens that were
    lost or are there twice; all three are 0 in a sound packing.
    """
    caps = capacities.where("capacity_tokens > 0").select("capacity_id", "capacity_tokens")
    over = packed.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("used")).join(caps, "capacity_id").groupBy("capacity_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    found = packed.groupBy("capacity_id", id_column).agg(F.sum("tokens").alias("found"), F.count(F.lit(1)).alias("pieces"))
    wanted = items.select(id_column, F.col(size_column).alias("size"))
    per = found.join(wanted, id_column).join(caps, "capacity_id").groupBy("capacity_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("items"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("needless_splits"), F.sum(F.abs(F.col("found") - F.col("size"))).alias("lost_tokens"),
    )
    return per.join(over, "capacity_id").select("capacity_id", "capacity_tokens", "items", "overfull", "needless_splits", "lost_tokens")
