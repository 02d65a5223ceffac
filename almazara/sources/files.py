"""Files by the session's file systems, so that folders may lie on any storage Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _place(spark, path)
    fs.mkdirs(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    fs, p = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def below(spark: SparkSession, path: str, recursive: bool = False) -> list[str]:
    """The files of a folder, and of the folders in it if ``recursive``, sorted."""
    fs, p = _place(spark, path)
    if not fs.exists(p):
        return []
    found, it = [], fs.listFiles(p, recursive)
    while it.hasNext():
        found.append(it.next().getPath().toString())
    return sorted(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _place(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
