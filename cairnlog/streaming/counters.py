"""Live counters over a stream of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import field, has_field
from ..sources.parse import parse_auto


def level_counts(frame: DataFrame) -> DataFrame:
    """Entries per upper-cased level (or severity); entries without one are left out.

    On a stream, write it in complete or update mode; the state is one row per level.
    """
    own = F.when(has_field(frame, "level"), field(frame, "level")).otherwise(field(frame, "severity", ""))
    return (
        frame.select(F.upper(own).alias("level"))
        .where("level != ''")
        .groupBy("level")
        .agg(F.count("*").alias("count"))
    )


def line_counters(lines: DataFrame) -> DataFrame:
    """Entries and lines that failed to parse, over all lines so far."""
    frame = parse_auto(lines, mode="line", keep_failed=True)
    return frame.agg(
        F.count("fields").alias("entries"), F.count_if(F.col("fields").isNull()).alias("failures")
    )


def counted_writer(sink: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands on the parsed entries and counts them on their way.

    The counts are observed while ``sink`` writes the batch, so they cost no
    second look at it; a sink that does not read the whole batch counts what it
    reads.  They are kept one row a batch below ``path``, where a batch that runs
    again replaces its own.  The stream's rows are lines; the sink gets the
    entries of those that parse.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = Observation(f"lines-{number}")
        frame = parse_auto(batch, mode="line", keep_failed=True)
        seen = frame.observe(
            counts, F.count("fields").alias("entries"), F.count_if(F.col("fields").isNull()).alias("failures")
        )
        sink(seen.where("fields IS NOT NULL"), number)
        row = [(counts.get["entries"], counts.get["failures"])]
        spark = batch.sparkSession
        spark.createDataFrame(row, "entries long, failures long").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def counted_totals(spark: SparkSession, path: str) -> DataFrame:
    """entries, failures and batches of all that a :func:`counted_writer` has written so far."""
    kept = spark.read.schema("entries long, failures long, batch long").parquet(path)
    return kept.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"),
        F.count(F.lit(1)).alias("batches"),
    )


def top_levels(frame: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent levels of a batch (or of a counters table kept by a stream)."""
    return level_counts(frame).orderBy(F.desc("count"), F.asc("level")).limit(n)
