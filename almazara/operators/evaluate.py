"""Temporal splits, baselines, metrics and the choice of a model per regime from earlier folds only."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almazara.operators.quality import group_medians
from almazara.session import broadcast_if_small, cut


@dataclass(frozen=True)
class Fold:
    """A fold by places of development periods (0-based): validation from ``first`` to ``last``, training all before."""

    fold: int
    first: int
    last: int


def test_periods(periods: int, fraction: float = 0.15, least: int = 2, min_train: int = 8, min_validation: int = 1) -> int:
    """The size of the holdout: ceil(fraction) of the periods, capped so that a fold remains possible."""
    return min(max(math.ceil(fraction * periods), least), max(0, periods - min_train - min_validation))


def plan_folds(development: int, splits: int = 4, fraction: float = 0.1, min_validation: int = 1, min_train: int = 8) -> list[Fold]:
    """Up to ``splits`` contiguous validation blocks of ceil(fraction) periods at the end of the development periods."""
    size = max(min_validation, math.ceil(fraction * development))
    n = min(splits, max(0, (development - min_train) // size))
    start = development - n * size
    return [Fold(i + 1, start + i * size, start + (i + 1) * size - 1) for i in range(n)]


def _placed(periods: DataFrame, index: str) -> DataFrame:
    distinct = periods.select(index).where(F.col(index).isNotNull()).distinct()
    return distinct.withColumn("place", F.row_number().over(Window.orderBy(index)) - 1)  # one row a period


def holdout(periods: DataFrame, index: str = "period_index", **rules: float) -> DataFrame:
    """(index, split): the different periods, the last ones ``test``, the others ``development``."""
    placed = _placed(periods, index)
    n = placed.count()
    return placed.select(index, F.when(F.col("place") >= n - test_periods(n, **rules), "test").otherwise("development").alias("split"))


def folds(development: DataFrame, index: str = "period_index", **rules: float) -> DataFrame:
    """(fold, index, role): for each fold its training and validation periods, from the development periods."""
    placed = _placed(development, index)
    plan = plan_folds(placed.count(), **rules)
    spans = F.array(*[F.struct(F.lit(f.fold).alias("fold"), F.lit(f.first).alias("a"), F.lit(f.last).alias("b")) for f in plan]).cast("array<struct<fold:int,a:int,b:int>>")
    each = placed.select(index, "place", F.explode(spans).alias("s")).where(F.col("place") <= F.col("s.b"))
    return each.select(F.col("s.fold").alias("fold"), index, F.when(F.col("place") >= F.col("s.a"), "validation").otherwise("train").alias("role"))


def discover_baselines(columns: Sequence[str], target: str = "units") -> dict[str, str]:
    """Model name -> feature of the causal baselines a table has: lag 1, the shortest rolling mean, the expanding mean."""
    out = {"lag_1": f"{target}__lag_1"} if f"{target}__lag_1" in columns else {}
    rolling = sorted(int(m[1]) for c in columns if (m := re.fullmatch(re.escape(target) + r"__rolling_mean_(\d+)", c)))
    if rolling:
        out[f"rolling_mean_{rolling[0]}"] = f"{target}__rolling_mean_{rolling[0]}"
    if f"{target}__expanding_mean_prior" in columns:
        out["expanding_mean"] = f"{target}__expanding_mean_prior"
    if not out:
        raise ValueError("the table has no feature a baseline could use")
    return out


def baseline_predictions(features: DataFrame, fold_table: DataFrame, baselines: Mapping[str, str], keys: Sequence[str], target: str = "units", regime: str = "article_demand_regime_prior", index: str = "period_index") -> DataFrame:
    """(fold, model, *keys, index, regime, target, prediction, used_fallback) of every validation row and baseline.

    A prediction is the feature's value, or the median target of the fold's training rows; never negative.
    All folds and models are one plan; the fold table and medians are small.
    """
    known = features.where(F.col(target).isNotNull())
    small = broadcast_if_small(fold_table)
    medians = group_medians(known.join(small.where("role = 'train'"), index), ["fold"], target, "fallback")
    rows = known.join(small.where("role = 'validation'"), index).join(F.broadcast(medians), "fold", "left")  # a row a fold
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("value")) for m, c in baselines.items()]))
    return rows.select("fold", *keys, index, F.col(regime).alias("regime"), F.col(target).alias("target"), "fallback", models.alias("m")).select(
        "fold", F.col("m.model").alias("model"), *keys, index, "regime", "target",
        F.greatest(F.coalesce(F.col("m.value"), F.col("fallback")), F.lit(0.0)).alias("prediction"), F.col("m.value").isNull().alias("used_fallback"),
    )


def _measures(y: Column, p: Column) -> dict[str, Column]:
    both = y.isNotNull() & p.isNotNull()
    err = F.when(both, p - y)
    scale = F.sum(F.when(both, F.abs(y)))
    scale = F.when(scale != 0, scale)
    return {
        "rows": F.count(F.lit(1)), "mae": F.avg(F.abs(err)), "rmse": F.sqrt(F.avg(err * err)), "wape": F.try_divide(F.sum(F.abs(err)), scale), "bias": F.try_divide(F.sum(err), scale),
        "coverage": F.avg(F.when(p.isNotNull(), 1.0).otherwise(0.0)), "total_target": F.sum(y), "total_prediction": F.sum(p),
    }


def metrics(predictions: DataFrame, by: Sequence[str] = ("fold", "model"), target: str = "target", prediction: str = "prediction") -> DataFrame:
    """Errors per group: MAE, RMSE, WAPE and bias (over the sum of absolute targets; null if that is 0), coverage, totals."""
    return predictions.groupBy(*by).agg(*[c.alias(n) for n, c in _measures(F.col(target), F.col(prediction)).items()])


def metrics_at_levels(predictions: DataFrame, base: Sequence[str] = ("fold", "model"), extra: Sequence[str] = ("regime", "period_index")) -> DataFrame:
    """The metrics per fold and model, per regime within, and per period within, by one aggregate over grouping sets."""
    view = predictions.select(*base, *extra, "target", "prediction")
    sets = [list(base), *[[*base, e] for e in extra]]
    out = view.groupingSets([[F.col(c) for c in s] for s in sets], *base, *extra).agg(F.grouping_id().alias("gid"), *[c.alias(n) for n, c in _measures(F.col("target"), F.col("prediction")).items()])
    level = F.lit("model")
    for i, e in enumerate(extra):
        mask = sum(1 << (len(extra) - 1 - j) for j in range(len(extra)) if j != i)
        level = F.when(F.col("gid") == mask, e).otherwise(level)
    return out.withColumn("level", level).drop("gid")


def top_k_overlap(predictions: DataFrame, by: Sequence[str], period: str, entity: Sequence[str], k: int = 20) -> DataFrame:
    """Mean over periods of how many of the k largest targets are among the k largest predictions (ties by entity; nulls never)."""
    group = [*by, period]
    rows = predictions.where(F.col("target").isNotNull() & F.col("prediction").isNotNull())
    best = lambda c: F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(c), *entity)) <= k
    ranked = rows.select(*group, best("target").alias("__top_target"), best("prediction").alias("__top_prediction"))
    per = ranked.groupBy(*group).agg(F.try_divide(F.count_if(F.col("__top_target") & F.col("__top_prediction")), F.least(F.lit(k), F.count(F.lit(1)))).alias("overlap"))
    return per.groupBy(*by).agg(F.avg("overlap").alias("top_k_overlap"), F.count(F.lit(1)).alias("periods"))


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and deviation of the fold metrics per model, ranked by WAPE, then MAE, then name."""
    out = fold_metrics.groupBy("model").agg(F.count(F.lit(1)).alias("folds"), *[x for m in ("wape", "mae", "rmse", "bias") for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("wape_mean"), F.asc_nulls_last("mae_mean"), "model")))


def _pooled(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    good = rows.where(F.col("target").isNotNull() & F.col("prediction").isNotNull())
    return good.groupBy(*by).agg(F.sum(F.abs(F.col("prediction") - F.col("target"))).alias("err"), F.sum(F.abs("target")).alias("scale"), F.count(F.lit(1)).alias("n"))


def _ranked(scores: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    good = scores.where((F.col("n") >= least) & (F.col("scale") > 0)).withColumns({"wape": F.col("err") / F.col("scale"), "mae": F.col("err") / F.col("n")})
    best = F.min(F.struct("wape", "mae", "model")).alias("b")
    return good.groupBy(*by).agg(best).select(*by, F.col("b.model").alias("model"), F.col("b.wape").alias("wape"))


def adaptive_selection(predictions: DataFrame, default: str, min_regime_rows: int = 20, min_global_rows: int = 50) -> DataFrame:
    """(fold, regime, model, source): for each fold and regime that occurs the model that did best in earlier folds.

    Errors are summed once per (fold, regime, model), a few rows; each of them is carried to every later fold and
    added up there, so a model that misses a fold still counts by what came before. The models are ranked by
    the regime if it has enough rows, else over all regimes, else the default stands. No loop over folds.
    """
    sums = cut(_pooled(predictions, ["fold", "regime", "model"]))
    known = sums.withColumn("folds", F.collect_set("fold").over(Window.partitionBy()))  # a row a fold, regime and model
    carried = known.withColumn("later", F.explode(F.filter("folds", lambda f: f > F.col("fold")))).drop("fold", "folds").withColumnRenamed("later", "fold")
    added = [F.sum(c).alias(c) for c in ("err", "scale", "n")]
    own = _ranked(carried.groupBy("fold", "regime", "model").agg(*added), ["fold", "regime"], min_regime_rows).select("fold", "regime", F.col("model").alias("own"))
    overall = _ranked(carried.groupBy("fold", "model").agg(*added), ["fold"], min_global_rows).select("fold", F.col("model").alias("overall"))
    cells = sums.select("fold", "regime").distinct().join(own, ["fold", "regime"], "left").join(overall, "fold", "left")
    return cells.select("fold", "regime", F.coalesce("own", "overall", F.lit(default)).alias("model"), F.when(F.col("own").isNotNull(), "regime").when(F.col("overall").isNotNull(), "global").otherwise("default").alias("source"))


def global_model(predictions: DataFrame, min_rows: int = 50) -> str | None:
    """The best model over all regimes, if it has enough rows."""
    best = _ranked(_pooled(predictions, ["model"]).withColumn("all", F.lit(1)), ["all"], min_rows).first()
    return best["model"] if best else None


def frozen_mapping(predictions: DataFrame, default: str, min_regime_rows: int = 20, min_global_rows: int = 50) -> DataFrame:
    """(regime, model, source): the choice on all development predictions."""
    own = _ranked(_pooled(predictions, ["regime", "model"]), ["regime"], min_regime_rows).select("regime", F.col("model").alias("own"))
    overall = global_model(predictions, min_global_rows)
    cells = predictions.select("regime").where("regime is not null").distinct().join(own, "regime", "left")
    return cells.select("regime", F.coalesce("own", F.lit(overall), F.lit(default)).alias("model"), F.when(F.col("own").isNotNull(), "regime").otherwise("global" if overall else "default").alias("source"))


def apply_selection(predictions: DataFrame, selection: DataFrame, on: Sequence[str], keys: Sequence[str], default: str, name: str = "adaptive") -> DataFrame:
    """The prediction of the chosen model for each row, or of the default model where that has none."""
    chosen = predictions.join(broadcast_if_small(selection.withColumnRenamed("model", "chosen").drop("source")), list(on), "left").withColumn("chosen", F.coalesce("chosen", F.lit(default)))
    base = [c for c in (*on, *keys) if c != "model"]
    base = list(dict.fromkeys(base))
    pick = lambda cond: F.max(F.when(cond, F.col("prediction")))
    return chosen.groupBy(*base).agg(
        F.max("target").alias("target"), F.coalesce(pick(F.col("model") == F.col("chosen")), pick(F.col("model") == default)).alias("prediction"), F.max("chosen").alias("selected_model"),
    ).withColumn("model", F.lit(name))
