"""Counts, top lists and groups of entries by the text of one field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import field, order_columns
from .blocks import earlier_blocks, earliest, with_block, with_ties_broken


def count_by(df: DataFrame, name: str) -> DataFrame:
    """Entries per value (value, count); an entry without the field counts as unknown."""
    return df.groupBy(field(df, name).alias("value")).agg(F.count("*").alias("count"))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def top(df: DataFrame, name: str, n: int = 10, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """The n most frequent values with their rank; ties go to the value seen first."""
    order = order_columns(df, order_by)
    valued = df.select(field(df, name).alias("_value"), *order)
    seen = earliest(valued, ["_value"], order, "first", "count").withColumnRenamed("_value", "value")
    best = seen.orderBy(F.desc("count"), F.asc("first")).limit(max(n, 0))
    # At most n rows reach this window.
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), F.asc("first"))
    return best.select(F.row_number().over(ranked).cast("long").alias("rank"), "value", "count")


def distribution(
    df: DataFrame, name: str, n: int = 10, width: int = 40, order_by: Sequence[str] | str | None = None
) -> DataFrame:
    """The top list with each count against the largest: bar length and percent."""
    highest = F.max("count").over(Window.partitionBy(F.lit(0)))
    return (
        top(df, name, n, order_by)
        .withColumn("_highest", highest)
        .select(
            "rank",
            "value",
            "count",
            F.floor(F.col("count") / F.col("_highest") * width).cast("int").alias("bar_len"),
            (F.col("count") / F.col("_highest") * 100).alias("pct_of_max"),
        )
    )


def group_by(df: DataFrame, name: str, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """Every entry with its group and its position (from 1) inside it.

    Groups stay rows: a list per group would have to fit one task.  Positions are
    counted block by block.  Entries that tie in the order follow a hash of all
    their columns.  In an order other than that of lines the entries are written
    once with all columns, so select what is needed.
    """
    unique, order = with_ties_broken(df, order_columns(df, order_by))
    grouped = unique.withColumn("group", field(df, name))
    cut = with_block(grouped, order)
    before = (
        cut.groupBy("group", "_block")
        .agg(F.count("*").alias("_rows"))
        .select("group", "_block", F.sum("_rows").over(earlier_blocks(["group"])).alias("_before"))
    )
    inside = Window.partitionBy("group", "_block").orderBy(*order)
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(before, ["group", "_block"])
        .withColumn("position", F.coalesce("_before", F.lit(0)) + F.col("_inside"))
        .select(*[c for c in grouped.columns if c != "_tie"], "position")
    )


def group_items(df: DataFrame, name: str, key: str) -> DataFrame:
    """The entries of one group; none where the group does not exist."""
    return df.where(field(df, name) == key)


def group_keys(df: DataFrame, name: str) -> DataFrame:
    """The group names, ascending by code point."""
    return df.select(field(df, name).alias("group")).distinct().orderBy("group")


def group_counts(df: DataFrame, name: str) -> DataFrame:
    return count_by(df, name).select(F.col("value").alias("group"), "count")


def group_cardinality(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    """Number of groups; ``approximate`` trades exactness for a sketch per task."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(field(df, name)).alias("groups"))


def write_groups(df: DataFrame, name: str, path: str) -> None:
    """Write the entries into one folder per group, with no shuffle.

    Each task writes its own file per group, so a group of any size is spread.
    """
    df.withColumn("group", field(df, name)).write.partitionBy("group").parquet(path)
