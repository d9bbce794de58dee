"""Log lines derived from the ``events`` table, so that their expected parse is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import lines_from


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the level and the ``k`` of its properties."""
    return with_level(table(spark, sf_dir, "events"))


def with_level(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "signup", "DEBUG")
    ).otherwise("INFO")
    return df.withColumn("level", level).withColumn("k", F.get_json_object("props", "$.k"))


def _time(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def ndjson_line() -> Column:
    return F.format_string(
        '{"timestamp":"%s","level":"%s","message":"%s by user %d","latency_ms":%s,"k":%s}',
        _time("yyyy-MM-dd'T'HH:mm:ss"),
        F.col("level"),
        F.col("event_type"),
        F.col("user_id"),
        F.col("value").cast("string"),
        F.col("k"),
    )


def access_line() -> Column:
    kind = F.col("event_type")
    status = F.when(kind == "error", "500").when(kind == "purchase", "201").when(kind == "signup", "404")
    size = F.when(F.col("event_id") % 10 == 0, "-").otherwise(F.col("event_id").cast("string"))
    return F.format_string(
        '10.0.0.%d - - [%s +0000] "GET /%s/%d HTTP/1.1" %s %s',
        F.col("user_id") % 256,
        _time("dd/MMM/yyyy:HH:mm:ss"),
        kind,
        F.col("user_id"),
        status.otherwise("200"),
        size,
    )


def syslog_line() -> Column:
    return F.format_string(
        "<%d>%s host%d %s[%d]: value %s",
        F.lit(8) + F.col("event_id") % 8,
        _time("MMM dd HH:mm:ss"),
        F.col("user_id") % 5,
        F.col("event_type"),
        F.col("event_id"),
        F.col("value").cast("string"),
    )


def mixed_line() -> Column:
    turn = F.col("event_id") % 4
    note = F.concat(F.lit("note "), F.col("event_id").cast("string"))
    return F.when(turn == 0, ndjson_line()).when(turn == 1, access_line()).when(turn == 2, syslog_line()).otherwise(note)


# Streams of the mixed lines start differently per file, so that the files lock differently.
def mixed_file() -> Column:
    return F.concat(F.lit("part-"), (F.col("user_id") % 7).cast("string"))


def event_lines(df: DataFrame, line: Column, file: Column | None = None) -> DataFrame:
    """Lines (file, block_start, seq, raw) in event order."""
    return lines_from(df, line, F.col("event_id"), file)
