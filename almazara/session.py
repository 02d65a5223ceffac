"""Sessions, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "almazara", **conf: str) -> SparkSession:
    """A session with ANSI mode, UTC and adaptive execution; a running session is reused as it is."""
    b = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, or (local masters only) a temporary one.

    A machine-local folder is chosen only where ``spark.checkpoint.dir`` is unset, nothing was set on the
    context before and all executors are threads of this machine; elsewhere that is an error. It is removed
    when the program ends.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="almazara-")
        atexit.register(shutil.rmtree, configured, True)
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, for tables that a query writes and reads again."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def value_bytes(name: str, kind: str) -> Column:
    """About how many bytes a value takes; arrays and maps are counted by 64 bytes an element."""
    c = F.col(name)
    if kind == "string":
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if kind.startswith(("array", "map")):
        return F.greatest(F.size(c), F.lit(0)) * 64 + 16
    return F.lit(16)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` cut from its lineage, with a broadcast hint only if it was measured to be small in rows and bytes.

    Larger sides are returned without a hint, so that the join shuffles and AQE may split skewed keys.
    """
    kept = cut(df)
    width = sum((value_bytes(c, t) for c, t in kept.dtypes), F.lit(0).cast("long"))
    n, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(kept) if n <= max_rows and size <= max_bytes else kept
