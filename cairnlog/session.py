"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_settled: ContextVar[list[str] | None] = ContextVar("settled tables", default=None)


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the operators are written for; sizes stay the cluster's business."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # typed entries are stored with a column per frequent key, which a scan of that key reads alone
        .config("spark.sql.variant.writeShredding.enabled", "true")
        .config("spark.sql.variant.inferShreddingSchema", "true")
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only where it is unset.

    The fallback is for a single machine (tests).  A cluster without the
    setting is refused rather than given a folder its executors cannot see.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cairnlog-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (nothing is created yet)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, surviving the loss of executors.

    Used where a result is read more than once and must not change between the
    reads.  The rows go to the shared folder as Parquet, so later reads prune
    columns and know their size.
    """
    path = workspace(df.sparkSession, "settled")
    if (owned := _settled.get()) is not None:
        owned.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Drop the tables settled inside once it is left; results must have been written by then.

    For work that goes on for ever, such as the batches of a stream.
    """
    token = _settled.set([])
    try:
        yield
    finally:
        paths = _settled.get() or []
        _settled.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def pin_splits(spark: SparkSession) -> None:
    """Freeze how files are cut into splits, unless the session already does.

    The default derives from the number of cores registered at planning time.
    With executors joining between two scans the same line could get two
    different positions; a fixed minimum keeps the cut equal for all scans.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set(
            "spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism)
        )


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only where counted rows prove that ``df`` fits the limit."""
    return df.hint("broadcast") if rows * row_bytes <= limit else df


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="cairnlog-")) / "cairnlog.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for module in sorted(root.rglob("*.py")):
            bundle.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
