"""Tail: the new lines of a folder that keeps receiving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.project import normalise_entry
from ..operators.search import raw_prefilter
from ..sources.lines import stream_lines
from ..sources.parse import parse_auto


def lines_from_now(spark: SparkSession, path: str, checkpoint: str, **options: object) -> DataFrame:
    """The lines of files that arrive in a folder from the first start on; older files are not read.

    The start is kept beside the stream's ``checkpoint``, so that a stream that is
    started again goes on from where it was and misses nothing in between.  Files
    are told by their modification time.  Lines appended to a file that was read
    already, and files that take the name of such a one, are not followed.
    """
    return stream_lines(spark, path, _start(spark, f"{checkpoint.rstrip('/')}-start"), **options)


def _start(spark: SparkSession, path: str) -> int:
    """When the stream was first started (milliseconds of the epoch)."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        spark.range(1).select(F.unix_millis(F.current_timestamp()).alias("at")).write.mode("overwrite").parquet(path)
    return spark.read.schema("at long").parquet(path).first()["at"]


def tail_entries(lines: DataFrame, pattern: str = "", ignore_case: bool = True) -> DataFrame:
    """New lines, filtered while raw, as (ts, level, msg).

    A line that detects as a format but does not parse as it is passed on as it is.
    """
    if pattern:
        lines = raw_prefilter(lines, pattern, ignore_case)
    marked = normalise_entry(parse_auto(lines, mode="line", keep_failed=True))
    failed = F.coalesce(F.size("fields"), F.lit(0)) == 0
    return marked.select(
        "file",
        "block_start",
        "seq",
        F.when(~failed, F.col("ts")).alias("ts"),
        F.when(~failed, F.col("level")).alias("level"),
        F.when(failed, F.col("raw")).otherwise(F.col("msg")).alias("msg"),
    )
