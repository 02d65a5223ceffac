"""A random forest whose trees grow side by side: each task grows its share of whole trees over rows binned once.

Spark's own forest passes all rows and a histogram of every open node through a shuffle once a level, and gathers the trees
on the driver; with trees as deep as their rows allow, that is hundreds of GB. Here the rows are put into bins once, equal
rows are counted, and the trees, which have more nodes than there are rows, are applied while they grow and never kept.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almazara.session import shared_path

#: Cells of histograms at once, random draws at once, and what counts as no gain, relative to a node's spread.
CELLS, DRAWS, NONE = 1 << 19, 1 << 20, 1e-9
_BLOCK = "query boolean, bins binary, runs binary, labels binary, times binary"


def thresholds(values: np.ndarray, times: np.ndarray, bins: int = 32) -> list[float]:
    """At most about ``bins`` - 1 bounds of ascending different values, chosen as Spark's trees do: all midpoints, else by strides."""
    middle = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return middle.tolist()
    upto, out, stride = np.cumsum(times), [], times.sum() / bins
    target = stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(float(middle[i - 1]))
            target += stride
    return out


def _best(x: np.ndarray, lens: np.ndarray, node: np.ndarray, c: np.ndarray, s: np.ndarray, count: np.ndarray, total: np.ndarray, tried: np.ndarray, bins: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: the best sum of squared sums over counts that a split reaches, its feature and the last bin of its left side."""
    n, wide, flat, starts = len(count), x.shape[1], x.reshape(-1), np.concatenate([[0], np.cumsum(lens)])
    score, feature, last = np.full(n, -np.inf), np.zeros(n, np.intp), np.zeros(n, np.intp)
    step = max(1, CELLS // bins)
    for a in range(0, n, step):
        b = min(n, a + step)
        i, j, k = starts[a], starts[b], b - a
        own, row, cc, ss = node[i:j] - a, np.arange(i * wide, j * wide, wide), c[i:j], s[i:j]
        base = own * bins
        for f in np.ascontiguousarray(tried[a:b].T):
            key = row + f.take(own)
            key = flat.take(key) + base
            left = np.bincount(key, cc, k * bins).reshape(k, bins).cumsum(1)[:, :-1]
            sums = np.bincount(key, ss, k * bins).reshape(k, bins).cumsum(1)[:, :-1]
            right, rest = count[a:b, None] - left, total[a:b, None] - sums
            with np.errstate(all="ignore"):
                got = sums * sums / left
                got += rest * rest / right
            got[(left < least) | (right < least)] = -np.inf
            at = got.argmax(1)
            reached = got[np.arange(k), at]
            better = reached > score[a:b]
            score[a:b][better], feature[a:b][better], last[a:b][better] = reached[better], f[better], at[better]
    return score, feature, last


def grow(x: np.ndarray, c: np.ndarray, s: np.ndarray, ss: np.ndarray, queries: np.ndarray, features: int, tries: int, bins: int, least: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """What one tree predicts for ``queries``, grown level by level over binned rows ``x``.

    ``c``, ``s`` and ``ss`` are the number, the sum and the squared sum of each row's drawn labels. Rows stay sorted by node, so
    that a node's histogram is written in one place. A node is tried on ``tries`` of its ``features``, and ends as Spark's trees
    do: at ``depth``, without spread, and if no tried split gains anything with ``least`` labels on both sides.
    """
    out, who, at = np.zeros(len(queries)), np.arange(len(queries)), np.zeros(len(queries), np.intp)
    order = np.flatnonzero(c > 0)
    lens, flat_queries, wide = np.array([len(order)]), queries.reshape(-1), x.shape[1]
    c, s, ss = c[order], s[order], ss[order]
    for level in range(depth + 1):
        starts = np.cumsum(lens) - lens
        count, total, squares = (np.add.reduceat(v, starts) for v in (c, s, ss))
        value = total / count
        spread = squares - total * value
        opened = (level < depth) & (count >= 2 * least) & (spread > NONE * squares) & (lens > 1)
        going = opened[at]
        out[who[~going]] = value[at[~going]]
        who, at = who[going], at[going]
        if not opened.all():
            rows = np.flatnonzero(np.repeat(opened, lens))
            order, c, s, ss = order[rows], c[rows], s[rows], ss[rows]
            at = (np.cumsum(opened) - 1)[at]
            lens, count, total, value, spread = (v[opened] for v in (lens, count, total, value, spread))
        if not len(lens) or not len(who):
            return out
        x = x.take(order, 0)
        node = np.repeat(np.arange(len(lens)), lens)
        tried = rng.random((len(lens), features), np.float32).argpartition(tries - 1, 1)[:, :tries] if tries < features else np.tile(np.arange(features), (len(lens), 1))
        score, feature, last = _best(x, lens, node, c, s, count, total, tried, bins, least)
        split = score - total * value > NONE * spread
        going = split[at]
        out[who[~going]] = value[at[~going]]
        who, at = who[going], at[going]
        if not len(who):
            return out
        at = 2 * (np.cumsum(split) - 1)[at] + (flat_queries.take(who * wide + feature[at]) > last[at])
        rows = np.arange(len(x)) if split.all() else np.flatnonzero(split[node])
        right = x.reshape(-1).take(rows * wide + feature[node[rows]]) > last[node[rows]]
        lens = lens[split]
        node, starts = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens) - lens
        before = np.concatenate([[0], np.cumsum(right)])
        to_right = before[starts + lens] - before[starts]
        rank, here = before[:-1] - before[starts][node], np.arange(len(rows))
        order = np.empty(len(rows), np.intp)
        order[np.where(right, (starts + lens - to_right)[node] + rank, here - rank)] = rows  # by child, else as before
        lens = np.stack([lens - to_right, to_right], 1).reshape(-1)
        c, s, ss = c[order], s[order], ss[order]
    return out


class _ForestParams(Params):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "splits above a leaf at most", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "drawn labels of a leaf at least", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features a node is tried on: sqrt or all", TypeConverters.toString)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether each tree draws its rows", TypeConverters.toBoolean)
    seed = Param(Params._dummy(), "seed", "of all draws", TypeConverters.toInt)


class Forest(Estimator, _ForestParams):
    """A forest of ``features`` for ``label``. Fitting bins the rows; the trees grow when the model is applied.

    A task holds the different binned rows and their labels: about 200 bytes a different row, 40 a different label of one.
    """

    def __init__(self, **params: object) -> None:
        super().__init__()
        self._setDefault(maxBins=32, featureSubsetStrategy="sqrt", bootstrap=True)
        self._set(**params)
        if not 2 <= self.getOrDefault("maxBins") <= 128 or self.getOrDefault("featureSubsetStrategy") not in ("sqrt", "all"):
            raise ValueError("maxBins is 2 to 128, featureSubsetStrategy sqrt or all")

    def _fit(self, dataset: DataFrame) -> ForestModel:
        spark, bins = dataset.sparkSession, self.getOrDefault("maxBins")
        rows = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                for j, column in enumerate(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T):
                    values, times = np.unique(column[~np.isnan(column)], return_counts=True)
                    if not len(values):
                        values, times = np.zeros(1), np.zeros(1, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), j, np.int32)), pa.array(values), pa.array(times.astype(np.int64))], names=["feature", "value", "times"])

        def bounds(t: pa.Table) -> pa.Table:
            values, times = t.column("value").to_numpy(), t.column("times").to_numpy()
            order = np.argsort(values)
            return pa.table({"feature": t.column("feature").slice(0, 1), "bounds": pa.array([thresholds(values[order], times[order], bins)], pa.list_(pa.float64()))})

        values = rows.select("x").mapInArrow(counted, "feature int, value double, times bigint").groupBy("feature", "value").agg(F.sum("times").alias("times"))
        cuts = [np.array(r["bounds"]) for r in values.groupBy("feature").applyInArrow(bounds, "feature int, bounds array<double>").orderBy("feature").collect()]  # a row a feature
        if not cuts:
            raise ValueError("no rows to fit")
        path = shared_path(spark, "forest")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        binned = rows.select(_bins(cuts)("x").alias("bins"), "label").repartition(parts, "bins")  # a number, so that the blocks stay the same
        _blocks(binned.groupBy("bins", "label").agg(F.count(F.lit(1)).alias("times")).sortWithinPartitions("bins", "label"), False).write.parquet(path)
        return self._copyValues(ForestModel(cuts, path))


class ForestModel(Model, _ForestParams):
    """Binned training rows at ``path`` and the bounds of the bins."""

    def __init__(self, cuts: Sequence[np.ndarray], path: str) -> None:
        super().__init__()
        self.cuts, self.path = cuts, path

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, cuts, trees = dataset.sparkSession, self.cuts, self.getOrDefault("numTrees")
        rows = dataset.withColumn("__bins", _bins(cuts)(vector_to_array("features")))
        queries = _blocks(rows.select(F.col("__bins").alias("bins")).distinct().select("bins", F.lit(0.0).alias("label"), F.lit(0).cast("long").alias("times")), True)
        groups = min(trees, 2 * spark.sparkContext.defaultParallelism)
        blocks = spark.read.schema(_BLOCK).parquet(self.path).unionByName(queries)
        dealt = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, "group")
        totals = dealt.mapInArrow(self._grower(trees, groups), "bins binary, total double").groupBy("bins").agg((F.sum("total") / trees).alias("prediction"))
        totals.write.parquet(path := shared_path(spark, "predicted"))  # the trees grow once
        known = spark.read.schema(totals.schema).parquet(path).withColumnRenamed("bins", "__bins")
        return rows.join(known, "__bins").drop("__bins")

    def _grower(self, trees: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        features, bins = len(self.cuts), max(2, *(len(c) + 1 for c in self.cuts))
        tries = math.ceil(math.sqrt(features)) if self.getOrDefault("featureSubsetStrategy") == "sqrt" else features
        bootstrap, seed, least, depth = (self.getOrDefault(p) for p in ("bootstrap", "seed", "minInstancesPerNode", "maxDepth"))
        wide = 1 << (features - 1).bit_length()  # numpy moves such rows fastest

        def matrix(parts: list[bytes]) -> np.ndarray:
            out = np.zeros((sum(map(len, parts)) // features, wide), np.uint8)
            out[:, :features] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, features)
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict[tuple[int, bool], list[dict]] = defaultdict(list)
            for b in batches:
                for r in b.to_pylist():
                    got[r["group"], r["query"]].append(r)
            for group in sorted({g for g, query in got if query}):
                train = sorted(got.pop((group, False)), key=lambda r: (r["bins"][:features], r["labels"][:8]))  # in whatever order they came
                x, queries = matrix([r["bins"] for r in train]), matrix([r["bins"] for r in got.pop((group, True))])
                runs, labels, times = (np.concatenate([np.frombuffer(r[k], kind) for r in train]) for k, kind in (("runs", np.int64), ("labels", np.float64), ("times", np.int64)))
                del train
                starts = np.cumsum(runs) - runs
                mean = (labels * times).sum() / times.sum()
                labels, lam, total = labels - mean, times.astype(float), np.zeros(len(queries))
                for tree in range(group, trees, groups):
                    rng = np.random.default_rng([seed, tree])
                    # a label that is there k times is drawn as often as k labels that are drawn once on average
                    drawn = np.concatenate([rng.poisson(lam[i : i + DRAWS]) for i in range(0, len(lam), DRAWS)]).astype(float) if bootstrap else lam
                    if not drawn.any():
                        continue  # the mean stays
                    sums = (drawn, drawn * labels, drawn * labels * labels)
                    total += grow(x, *(np.add.reduceat(v, starts) for v in sums), queries, features, tries, bins, least, depth, rng)
                total += mean * len(range(group, trees, groups))
                for i in range(0, len(queries), 100_000):
                    part = np.ascontiguousarray(queries[i : i + 100_000, :features])
                    yield pa.RecordBatch.from_arrays([_binary(part), pa.array(total[i : i + 100_000])], names=["bins", "total"])

        return run


def _binary(codes: np.ndarray) -> pa.Array:
    """A row of bytes each."""
    return pa.Array.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())


def _bins(cuts: Sequence[np.ndarray]) -> Callable[[Column | str], Column]:
    """An array of doubles as one byte a feature: how many bounds lie under the value; NaN lies over all."""

    def run(a: pa.Array) -> pa.Array:
        x = a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
        return _binary(np.stack([np.searchsorted(c, x[:, j]).astype(np.uint8) for j, c in enumerate(cuts)], 1))

    return F.arrow_udf(run, "binary")


def _blocks(rows: DataFrame, query: bool) -> DataFrame:
    """(bins, label, times) rows by the batch: different neighbours' bins, how many rows each has, labels and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = b.column(0).to_pylist()
                first = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
                runs = np.diff(np.array([*first, len(keys)], np.int64))
                block = {"query": query, "bins": b"".join(keys[i] for i in first), "runs": runs.tobytes(), "labels": b.column(1).to_numpy().tobytes(), "times": b.column(2).to_numpy().tobytes()}
                yield pa.RecordBatch.from_pylist([block], pa.schema([("query", pa.bool_()), *((k, pa.binary()) for k in ("bins", "runs", "labels", "times"))]))

    return rows.mapInArrow(run, _BLOCK)
