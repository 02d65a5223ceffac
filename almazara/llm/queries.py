"""Queries of problems 8 to 10 over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almazara.llm.packing import pack, packing_faults, packing_quality
from almazara.llm.reading import DEMANDING, reading_levels
from almazara.llm.tokenize import token_counts, token_ids


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(_table(spark, d, "documents"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    documents = _table(spark, d, "documents")
    return pack(token_counts(documents), _table(spark, d, "capacidades"), rows_known=documents.count())


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    return packing_quality(p9_packing(spark, d), _table(spark, d, "capacidades"))


def p9_faults(spark: SparkSession, d: str) -> DataFrame:
    """What would be wrong with the packing of all documents: nothing, by its SQL."""
    counts = token_counts(_table(spark, d, "documents"))
    return packing_faults(counts, p9_packing(spark, d), _table(spark, d, "capacidades"))


P9_FAULTS_SQL = "select capacity_id, capacity_tokens, (select count(*) from documents) as items, 0 as overfull, 0 as needless_splits, 0 as lost_tokens from capacidades where capacity_tokens > 0"


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = reading_levels(_table(spark, d, "documents"), _table(spark, d, "niveles"))
    return rows.select("doc_id", F.round("level", 2).alias("level"), F.round("unfamiliar_share", 4).alias("unfamiliar_share"), F.round("sentence_words", 2).alias("sentence_words"), "language")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(_table(spark, d, "documents"), _table(spark, d, "niveles")).where(F.col("level") >= DEMANDING).select("doc_id")


QUERIES = {"p8_ids": p8_ids, "p9_packing": p9_packing, "p9_quality": p9_quality, "p9_faults": p9_faults, "p10_found": p10_found, "p10_levels": p10_levels}
#: The others can't be said in SQL; tests/llm checks them against brute force, round trips and held-out labels.
SQL: dict[str, str] = {"p9_faults": P9_FAULTS_SQL}
