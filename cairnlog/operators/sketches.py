"""Sketches that are stored as rows, a day or a file at a time, and merged when they are asked for.

A year of percentiles or distinct values needs no second look at the entries: each
part leaves a sketch of fixed size, and any set of parts is answered from theirs.
The exact operators (``numeric.summary``, ``counting.group_cardinality``) stay the
default; these trade a stated error for that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field, numeric

#: Size of a quantile sketch: the greater, the smaller its error.
QUANTILE_SIZE = 400
#: Registers of a distinct sketch are 2 ** this.
DISTINCT_BITS = 14


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """How far, as a share of all values, the rank of an answer lies from the one asked for, in 99 of 100 cases."""
    return 2.296 / size**0.9723


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """The standard error of a distinct count, as a share of it; of merged sketches, too."""
    return 1.04 / 2 ** (bits / 2)


def quantile_sketches(df: DataFrame, name: str, by: Sequence[Column | str] = (), size: int = QUANTILE_SIZE) -> DataFrame:
    """A row per value of ``by``: n and the quantile sketch of the field's numbers; entries without one are left out."""
    value = numeric(df, name)
    return df.where(value.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch")
    )


def merge_quantiles(sketches: DataFrame, by: Sequence[Column | str] = (), size: int = QUANTILE_SIZE) -> DataFrame:
    """Sketches of the same ``by`` as one; the error is that of a sketch of all their values."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def quantiles(sketches: DataFrame, percents: Sequence[float]) -> DataFrame:
    """The sketches with a column per percent (p50, p99_9), NULL where there are no values."""
    some = F.col("n") > 0
    found = {
        "p" + f"{p:g}".replace(".", "_"): F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100).cast("double")))
        for p in percents
    }
    return sketches.withColumns(found)


def distinct_sketches(df: DataFrame, name: str, by: Sequence[Column | str] = (), bits: int = DISTINCT_BITS) -> DataFrame:
    """A row per value of ``by``: the sketch of the field's texts, absent ones counted as the group they fall in."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(field(df, name), bits).alias("sketch"))


def merge_distinct(sketches: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """Sketches of the same ``by`` as one: that of the union of their values."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """The sketches with ``groups``, the estimated number of distinct values."""
    return sketches.withColumn("groups", F.hll_sketch_estimate("sketch"))
