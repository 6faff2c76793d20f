"""Stages that must be cut from their lineage, kept as Parquet in the folder all executors share.

The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only in local mode, and only where that
setting is missing, a temporary folder is made. Tables live until :func:`discard`, or until the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, tuple[SparkSession, str]] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """Folder of this application's stages, below the shared checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="strataframe-")
        _ROOTS[app] = (spark, f"{base.rstrip('/')}/strataframe-{app}")
    return _ROOTS[app][1]


def _remove(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a finished action go at once instead of at the driver's next collection."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def store(df: DataFrame, label: str) -> DataFrame:
    """Runs the plan of ``df`` once and returns the written rows; a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    with lean_shuffles(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(*stored: DataFrame) -> None:
    """Deletes stages that no later plan reads."""
    for df in stored:
        _remove(df.sparkSession, df.stored_at)


@atexit.register
def _clear() -> None:
    for spark, root in _ROOTS.values():
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _remove(spark, root)
