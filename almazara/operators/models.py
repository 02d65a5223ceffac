"""Model candidates with Spark ML: preprocessing, Poisson regression, random forest, boosted trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almazara.operators.forest import Forest

MISSING = "__MISSING__"
#: Candidates by name. Boosted trees with a Poisson loss have no counterpart in Spark ML; ``gbt_log1p`` is named for what it is.
CANDIDATES = ("poisson_glm", "random_forest", "gbt_log1p")


def matrix(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Categories as text with a word for missing, measures as doubles with NaN as null."""
    return df.withColumns({**{c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in categorical}, **{c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}})


def _preparation(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> list:
    known = train.agg(*[F.count(c).alias(c) for c in numeric]).first() if numeric else {}
    usable = [c for c in numeric if known[c]]  # a column without any value can't be imputed and says nothing
    stages = []
    if usable:
        stages.append(Imputer(inputCols=usable, outputCols=[f"{c}__in" for c in usable], strategy="median"))
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__ix" for c in categorical], handleInvalid="keep", stringOrderType="frequencyDesc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__ix" for c in categorical], outputCols=[f"{c}__hot" for c in categorical], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*[f"{c}__in" for c in usable], *[f"{c}__hot" for c in categorical]], outputCol="features", handleInvalid="keep"))
    return stages


def fit(train: DataFrame, name: str, categorical: Sequence[str], numeric: Sequence[str], target: str, seed: int = 42, trees: int = 300, iterations: int = 250, depth: int = 30) -> PipelineModel:
    """A candidate fitted on rows with a known target; ``depth`` bounds the forest's trees, 30 is the most Spark allows."""
    rows = matrix(train.where(F.col(target).isNotNull()), categorical, numeric).withColumn("label", F.col(target).cast("double"))
    if name == "poisson_glm":
        model = GeneralizedLinearRegression(family="poisson", link="log", regParam=1.0, maxIter=25)
    elif name == "random_forest":
        model = Forest(numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed)
    elif name == "gbt_log1p":
        rows = rows.withColumn("label", F.log1p("label"))
        model = GBTRegressor(maxIter=iterations, stepSize=0.05, maxDepth=5, minInstancesPerNode=20, seed=seed)
    else:
        raise ValueError(f"no candidate {name}")
    return Pipeline(stages=[*_preparation(rows, categorical, numeric), model]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, name: str, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """``rows`` with ``prediction``, never negative."""
    out = model.transform(matrix(rows, categorical, numeric))
    p = F.expm1("prediction") if name == "gbt_log1p" else F.col("prediction")
    return out.select(*rows.columns, F.greatest(p, F.lit(0.0)).alias("prediction"))


def poisson_allowed(train: DataFrame, target: str) -> bool:
    """Whether a Poisson loss makes sense: no negative target, and a positive sum."""
    r = train.agg(F.min(target).alias("lo"), F.sum(target).alias("sum")).first()
    return r["lo"] is not None and r["lo"] >= 0 and r["sum"] > 0


def cross_validate(features: DataFrame, fold_table: DataFrame, names: Sequence[str], categorical: Sequence[str], numeric: Sequence[str], keys: Sequence[str], target: str = "units", regime: str = "regime", index: str = "period_index", **sizes: int) -> DataFrame:
    """Out-of-fold predictions of every candidate, as (fold, model, *keys, index, regime, target, prediction, used_fallback).

    The driver loops over the few folds and candidates; each fit and prediction is distributed.
    """
    out = None
    for f in sorted(r[0] for r in fold_table.select("fold").distinct().collect()):
        part = F.broadcast(fold_table.where(F.col("fold") == f))  # one row a period
        rows = features.where(F.col(target).isNotNull()).join(part, index)
        train, valid = rows.where("role = 'train'"), rows.where("role = 'validation'")
        for n in names:
            if n == "poisson_glm" and not poisson_allowed(train, target):
                continue
            p = predict(fit(train, n, categorical, numeric, target, **sizes), valid, n, categorical, numeric)
            p = p.select(F.lit(f).alias("fold"), F.lit(n).alias("model"), *keys, index, F.col(regime).alias("regime"), F.col(target).alias("target"), "prediction", F.lit(False).alias("used_fallback"))
            out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no fold or no candidate")
    return out


def unseen_share(train: DataFrame, valid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share): of validation rows, how many have a category the training rows lack."""
    out = None
    for c in columns:
        known = train.select(F.col(c).cast("string").alias("v")).distinct().withColumn("known", F.lit(1))
        r = valid.select(F.col(c).cast("string").alias("v")).join(known, "v", "left").agg(F.lit(c).alias("column"), F.avg(F.when(F.col("v").isNotNull() & F.col("known").isNull(), 1.0).otherwise(0.0)).alias("share"))
        out = r if out is None else out.unionByName(r)
    return out
