"""Ordered blocks: how running values are computed without one task holding them all.

A running value over an order (a z-score against all earlier entries, a position
in a group) needs the past of each row.  A window over one big group would put
that group into a single task.  Instead the order is cut into blocks; totals per
block are summed over the earlier blocks (few rows), and only inside a block a
window runs.  This is the only way such values are computed, at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.fields import LINE_ORDER, row_hash
from ..session import settle

#: Lines of one split in a block; splits are bounded already, unless a file can't be split.
LINES_PER_BLOCK = 2_000_000


def with_block(df: DataFrame, order_by: Sequence[str], name: str = "_block") -> DataFrame:
    """Add a column that cuts the order into blocks and sorts like it.

    Lines come in file splits, and the block is a function of the line's place.
    Other orders, of any types and with NULLs first, are dealt in ranges of the
    order columns themselves, one block a shuffle partition.  The ranges are
    sampled, so the dealt rows are written once: every later read, also of a lost
    task, sees the same blocks.
    """
    if tuple(order_by) == LINE_ORDER:
        # Whole-number division, as ``seq`` outgrows a double.
        chunk = F.expr(f"seq div {LINES_PER_BLOCK}")
        return df.withColumn(name, F.struct("file", "block_start", chunk.alias("chunk")))
    return settle(df.repartitionByRange(*order_by).withColumn(name, F.spark_partition_id()))


def with_ties_broken(df: DataFrame, order_by: Sequence[str], name: str = "_tie") -> tuple[DataFrame, list[str]]:
    """The rows and an order in which those that tie follow a hash of all their columns.

    So a row's past does not depend on how the rows are partitioned, and an instant
    that holds most rows, or an order that is the same for all, is cut into blocks
    like any other.  Only rows equal in every column stay together; which of them
    comes first makes no difference.  Lines have an order without ties.
    """
    if tuple(order_by) == LINE_ORDER:
        return df, list(order_by)
    return df.withColumn(name, row_hash(df)), [*order_by, name]


def earlier_blocks(keys: Sequence[str], block: str = "_block") -> WindowSpec:
    """Window over per-block totals: all blocks before the current one."""
    return (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(block)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def earliest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, count: str | None = None
) -> DataFrame:
    """Per key, the first position (a struct of the order columns), and how many rows.

    A minimum over the last order column alone keeps its buffer fixed-size, so
    the heavy level is a hash aggregation; the composite minimum, which sorts,
    sees the remainder only.
    """
    *outer, last = order
    counted = [F.count("*").alias(count)] if count else []
    pieces = df.groupBy(*keys, *outer).agg(F.min(last).alias(last), *counted)
    if not outer:
        return pieces.select(*keys, F.struct(last).alias(name), *([count] if count else []))
    summed = [F.sum(count).alias(count)] if count else []
    return pieces.groupBy(*keys).agg(F.min(F.struct(*order)).alias(name), *summed)
