"""Numeric summaries of one field: exact nearest-rank percentiles and moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.fields import numeric
from ..functions.text import pinned
from ..session import settle
from .blocks import earlier_blocks, with_block

DEFAULT_PERCENTILES = (50, 90, 95, 99)


def percentile_name(p: float) -> str:
    """Column name of a percentile: p95, p99_9."""
    return f"p{p:g}".replace(".", "_")


def percentile(df: DataFrame, name: str, p: float) -> DataFrame:
    """One exact nearest-rank percentile; 0.0 where the field has no numbers."""
    return summary(df, name, [p]).select(percentile_name(p))


def summary(df: DataFrame, name: str, percentiles: Sequence[float] = DEFAULT_PERCENTILES) -> DataFrame:
    """Percentiles, min, max, mean and count of the numbers in a field, one row."""
    counts = _counts(df, name)
    wanted = {percentile_name(p): _nearest_rank(p) for p in percentiles}
    facts = _facts(counts)
    return values_at_ranks(counts, wanted).select(
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in wanted],
        *[F.lit(facts[n]).cast("double").alias(n) for n in ("min", "max", "mean", "count")],
    )


def _counts(df: DataFrame, name: str) -> DataFrame:
    """(v, c): each number of the field and how often it occurs, from one pass over the entries."""
    values = df.select(pinned(numeric(df, name)).alias("v")).where("v IS NOT NULL")
    return settle(values.groupBy("v").agg(F.count("*").alias("c")))


def _facts(counts: DataFrame) -> Row:
    """min, max, mean and count of the numbers: one row, also where there are none."""
    return counts.agg(
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum("c")).alias("mean"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("count"),
    ).first()


def _nearest_rank(p: float) -> Column:
    """Rank (from 1) of a percentile among ``n`` sorted values."""
    rank = F.ceil(F.lit(p / 100) * F.col("n")).cast("long")
    return F.greatest(F.lit(1), F.least(rank, F.col("n")))


def values_at_ranks(counts: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """The values ``v`` at the given ranks (columns of ``n``), one row; NULL without values.

    Equal values are counted together before anything is ordered.  The value
    range is cut into blocks: a running total over the blocks tells which hold a
    wanted rank, and only those are ranked.
    """
    cut = with_block(counts, ["v"])
    sizes = cut.groupBy("_block").agg(F.sum("c").alias("rows"))
    spans = sizes.select(
        "_block",
        F.coalesce(F.sum("rows").over(earlier_blocks([])), F.lit(0)).alias("before"),
        "rows",
        F.sum("rows").over(Window.partitionBy(F.lit(0))).alias("n"),
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), rank.alias("rank")) for n, rank in ranks.items()])
    )
    # One row per wanted rank: as few as there are percentiles.
    targets = (
        spans.select("*", wanted.alias("w"))
        .where("w.rank > before AND w.rank <= before + rows")
        .select("_block", "before", "w.name", "w.rank")
    )
    held = cut.join(F.broadcast(targets.select("_block").distinct()), "_block", "left_semi")
    upto = Window.partitionBy("_block").orderBy("v")
    ranked = held.select("_block", "v", F.sum("c").over(upto).alias("upto"))
    hits = (
        ranked.join(F.broadcast(targets), "_block")
        .where("before + upto >= rank")
        .groupBy("name")
        .agg(F.min("v").alias("v"))
    )
    return hits.agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ranks])


def median(df: DataFrame, name: str) -> DataFrame:
    """Median (mean of the middle two) and count of a field's numbers, one row."""
    counts = _counts(df, name)
    n = F.col("n")
    middle = {"low": F.floor((n + 1) / 2).cast("long"), "high": F.floor((n + 2) / 2).cast("long")}
    count = _facts(counts)["count"]
    return values_at_ranks(counts, middle).select(
        ((F.col("low") + F.col("high")) / 2).alias("median"), F.lit(count).cast("long").alias("count")
    )


def skipped_count(df: DataFrame, name: str) -> DataFrame:
    """Entries whose field is absent or not a number."""
    return df.agg(F.count_if(numeric(df, name).isNull()).alias("skipped"))


def moments(df: DataFrame, name: str) -> DataFrame:
    """Count, mean, population variance and deviation; 0 for what no value defines."""
    v = numeric(df, name)
    zero = F.lit(0.0)
    return df.select(v.alias("v")).agg(
        F.count("v").alias("count"),
        F.coalesce(F.avg("v"), zero).alias("mean"),
        F.coalesce(F.var_pop("v"), zero).alias("variance"),
        F.coalesce(F.stddev_pop("v"), zero).alias("std"),
    )
