"""Text scan: files to ordered, stripped, non-blank lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, strip_line
from ..session import pin_splits, ship_package

_PLACE = ("_metadata.file_path AS file", "_metadata.file_block_start AS block_start")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files with the key that reproduces their order.

    ``(file, block_start, seq)`` sorts lines the way the files hold them: a
    split lies inside one task, where ``seq`` only grows.  The key is made in
    the scan stage, so no shuffle and no global counter is needed.
    """
    pin_splits(spark)
    scan = spark.read.text(paths)
    return _stripped(scan.selectExpr(*_PLACE, "monotonically_increasing_id() AS seq", "value"))


def stream_lines(spark: SparkSession, path: str, after_millis: int | None = None, **options: object) -> DataFrame:
    """The same rows from a folder that keeps receiving files.

    Options go to the file source; ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger`` bound a micro-batch.  The lines of files that were not
    modified after ``after_millis`` (of the epoch) are left out; the source itself
    takes no such option on a stream.  A stream has no built-in line number, so one
    passes over the Arrow batches.
    """
    ship_package(spark)
    scan = spark.readStream.options(**options).text(path)
    if after_millis is not None:
        scan = scan.where(F.col("_metadata.file_modification_time") > F.timestamp_millis(F.lit(after_millis)))
    scan = scan.selectExpr(*_PLACE, "value")
    numbered = scan.mapInArrow(_number_lines, "file string, block_start long, value string, seq long")
    return _stripped(numbered)


def _number_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = 0
    for batch in batches:
        seq = pa.array(range(done, done + batch.num_rows), pa.int64())
        done += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, seq], [*batch.schema.names, "seq"])


def lines_from(df: DataFrame, raw: Column, seq: Column, file: Column | None = None) -> DataFrame:
    """Lines held in a table column; ``seq`` orders them inside ``file``."""
    placed = df.select(
        (F.lit("table") if file is None else file).alias("file"),
        F.lit(0).cast("long").alias("block_start"),
        seq.cast("long").alias("seq"),
        raw.alias("value"),
    )
    return _stripped(placed)


def _stripped(lines: DataFrame) -> DataFrame:
    # Asked of the line as it is: a condition on the stripped text would strip it twice.
    visible = F.col("value").between("!", "~") | (strip(F.col("value")) != "")
    text = F.make_valid_utf8(strip_line(F.col("value")))
    return lines.where(visible).select("file", "block_start", "seq", text.alias("raw"))
