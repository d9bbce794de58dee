"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Beginning of the names of columns that the operators add for themselves.
HIDDEN = "__llm_"


def refuse_hidden(df: DataFrame) -> None:
    """Raise where a column has a name that the operators use for their own."""
    taken = [name for name in df.columns if name.lower().startswith(HIDDEN)]
    if taken:
        raise ValueError(f"columns may not begin with {HIDDEN}: {', '.join(taken)}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str) -> Column:
    """A text column whose nulls count as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def fresh_names(df: DataFrame, added: list[str]) -> list[str]:
    """The input's columns that an operator may keep: those whose names it does not add itself.

    An input column with the name of a result column is replaced by the result.
    """
    taken = {name.lower() for name in added}
    return [name for name in df.columns if name.lower() not in taken]


def with_fields(df: DataFrame, names: list[str], extra: str) -> T.StructType:
    """Schema of ``names`` of ``df`` followed by the DDL ``extra``."""
    kept = [T.StructField(n, df.schema[n].dataType, True) for n in names]
    return T.StructType(kept + list(T.StructType.fromDDL(extra).fields))


def arrow_map(
    df: DataFrame,
    names: list[str],
    column: str,
    extra: str,
    work: Callable[[list[str]], dict[str, pa.Array]],
    batch_chars: int = 4_000_000,
) -> DataFrame:
    """``names`` of ``df`` plus the columns ``extra`` that ``work`` makes from the texts of ``column``.

    Rows stay in their partition and in order.  Arrow batches are cut so that one
    call sees about ``batch_chars`` characters (or one longer text).
    """
    schema = with_fields(df, names, extra)
    added = [f.name for f in T.StructType.fromDDL(extra).fields]
    source = df.select(*[F.col(f"`{n}`") for n in names], text_or_empty(column).alias(HIDDEN + "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names))
            for start, end in slices(texts, batch_chars):
                part = batch.slice(start, end - start)
                made = work(texts.slice(start, end - start).to_pylist())
                columns = [part.column(i) for i in range(len(names))] + [made[n] for n in added]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return source.mapInArrow(lean(run), schema)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a partition, after which the worker gives back the memory that is free.

    Workers wait for their next task with what they hold, beside the others of
    their executor.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            pa.system_memory_pool().release_unused()

    return mapped


def slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chars`` bytes each, one row at least."""
    return ranges(pa.compute.binary_length(texts).to_pylist(), chars)


def ranges(sizes: list[int | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to ``most``, one at least; no size is 0."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        size = size or 0
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def least_hashes(df: DataFrame, column: str, tie: Column, n: int, rows: int) -> list:
    """The ``n`` rows of ``df`` (of ``rows``) with the least hashes in ``column``: a sample that no plan or size changes.

    Only hashes below a limit that some 2 n rows are expected to have are looked
    at, so what tasks send to the driver does not grow with their number.
    """
    if rows > 4 * n:
        limit = -(2**63) + 2**64 * 2 * n // rows
        df = df.where(F.col(column) < limit)
    return df.orderBy(column, tie).limit(n).collect()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
