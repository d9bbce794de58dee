"""Anomaly scores: each value against the mean and deviation of all earlier ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.fields import numeric, order_columns
from .blocks import earlier_blocks, with_block, with_ties_broken

THRESHOLD = 3.0
MIN_SAMPLES = 30
RESULT_COLUMNS = ("value", "n", "mean", "std", "z_score", "is_anomaly", "skipped")


def score_anomalies(
    df: DataFrame,
    name: str,
    threshold: float = THRESHOLD,
    min_samples: int = MIN_SAMPLES,
    order_by: Sequence[str] | str | None = None,
    partition_by: Sequence[str] = (),
    reset_when: Column | None = None,
    prior: DataFrame | None = None,
) -> DataFrame:
    """Score a numeric field; adds value, n, mean, std, z_score, is_anomaly, skipped.

    Columns of these names are replaced.
    n, mean and std describe the numbers *before* the entry.  The score stays
    NULL until there are ``min_samples`` of them and while they are all equal;
    it is an anomaly when strictly above the threshold.  ``reset_when`` restarts
    the statistics at the entries where it is true.  ``prior`` holds what went
    before the first entry, as :func:`totals_of` gives it.  Entries that tie in
    the order follow a hash of all their columns.  In an order other than that of
    lines the entries are written once with all columns, so select what is needed.
    """
    order = order_columns(df, order_by)
    unique, order = with_ties_broken(df, order)
    scored, keys = _keyed(unique, partition_by)
    if reset_when is not None:
        scored = scored.withColumn("_reset", F.coalesce(reset_when, F.lit(False)).cast("long"))
    cut = with_block(scored.withColumn("value", numeric(df, name)), order)
    if reset_when is not None:
        cut, keys = _with_epoch(cut, keys, order), [*keys, "_epoch"]
    scored = _past_by_blocks(cut, keys, order, prior)
    kept = [c for c in df.columns if c not in RESULT_COLUMNS]
    return _judge(scored, threshold, min_samples).select(*kept, *RESULT_COLUMNS)


def anomalies(df: DataFrame, name: str, **options: object) -> DataFrame:
    """The entries that score as anomalies, for use in front of an alert rule."""
    return score_anomalies(df, name, **options).where("is_anomaly")


def totals_of(df: DataFrame, name: str, partition_by: Sequence[str] = (), prior: DataFrame | None = None) -> DataFrame:
    """Per key, what there is to know of all its numbers: n, mean, var, lo, hi.

    With ``prior`` (an earlier result) the two are taken together.
    """
    keyed, keys = _keyed(df, partition_by)
    totals = keyed.withColumn("value", numeric(df, name)).groupBy(*keys).agg(*_totals())
    if prior is None:
        return totals
    n, off = F.col("n"), F.col("mean") - F.col("centre")
    both = totals.unionByName(prior).withColumn("centre", _centre(keys))
    count = F.nullif(F.sum(n), F.lit(0))
    return both.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.max("centre").alias("mean"),
        (F.sum(n * (F.col("var") + off * off)) / count).alias("var"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )


def _keyed(df: DataFrame, partition_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Grouping keys as text of their own, never NULL, so that they join."""
    keys = [f"_key{i}" for i in range(len(partition_by))]
    texts = {k: F.coalesce(F.col(c).cast("string"), F.lit("\0")) for k, c in zip(keys, partition_by)}
    return (df.withColumns(texts) if texts else df), keys


def _totals() -> list[Column]:
    v = F.col("value")
    return [
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("var"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
    ]


def _centre(keys: list[str]) -> Column:
    """Overall mean of a group, from the totals of its parts."""
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    return F.sum(F.col("n") * F.col("mean")).over(group) / F.nullif(F.sum("n").over(group), F.lit(0))


def _past(window: WindowSpec) -> dict[str, Column]:
    """What is known of the values before the current row of the window."""
    v = F.col("value")
    return {
        "n": F.count(v).over(window),
        "mean": F.avg(v).over(window),
        "var": F.var_pop(v).over(window),
        "lo": F.min(v).over(window),
        "hi": F.max(v).over(window),
    }


def _past_by_blocks(cut: DataFrame, keys: list[str], order: list[str], prior: DataFrame | None) -> DataFrame:
    """The past of each row of ``cut`` (with its ``_block``): earlier blocks, and a window inside the block.

    Sums are taken around the group's overall mean, so they do not cancel.
    """
    totals = cut.groupBy(*keys, "_block").agg(*_totals())
    if prior is not None:
        # A NULL block sorts before all others, and joins none of them.
        first = F.lit(None).cast(totals.schema["_block"].dataType)
        totals = totals.unionByName(prior.withColumn("_block", first))
    shifted = totals.withColumn("centre", _centre(keys)).withColumn("off", F.col("mean") - F.col("centre"))
    before = earlier_blocks(keys)
    n, off = F.col("n"), F.col("off")
    sums = shifted.select(
        *keys,
        "_block",
        "centre",
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias("n0"),
        F.sum(n * off).over(before).alias("s0"),
        F.sum(n * (F.col("var") + off * off)).over(before).alias("q0"),
        F.min("lo").over(before).alias("lo0"),
        F.max("hi").over(before).alias("hi0"),
    )
    n0 = F.nullif(F.col("n0"), F.lit(0))
    prefix = sums.select(
        *keys,
        "_block",
        "n0",
        (F.col("centre") + F.col("s0") / n0).alias("mean0"),
        F.greatest(F.col("q0") - F.col("s0") * F.col("s0") / n0, F.lit(0.0)).alias("m0"),
        "lo0",
        "hi0",
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    here = cut.select("*", *[c.alias(f"{k}1") for k, c in _past(inside).items()])
    both = here.join(prefix, [*keys, "_block"])
    zero = F.lit(0.0)
    na, nb = F.col("n0").cast("double"), F.col("n1").cast("double")
    mean_a, mean_b = F.coalesce("mean0", zero), F.coalesce("mean1", zero)
    gap = F.when((na > 0) & (nb > 0), mean_b - mean_a).otherwise(zero)
    count = F.nullif(na + nb, zero)
    squares = (
        F.coalesce("m0", zero) + nb * F.coalesce("var1", zero) + gap * gap * na * nb / count
    )
    return both.select(
        *[c for c in cut.columns if c != "_block"],
        (F.col("n0") + F.col("n1")).alias("_n"),
        ((na * mean_a + nb * mean_b) / count).alias("_mean"),
        (squares / count).alias("_var"),
        F.least("lo0", "lo1").alias("_lo"),
        F.greatest("hi0", "hi1").alias("_hi"),
    )


def _with_epoch(cut: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number the stretches between resets: those of earlier blocks, and a running count inside the block."""
    totals = cut.groupBy(*keys, "_block").agg(F.sum("_reset").alias("resets"))
    prefix = totals.select(
        *keys, "_block", F.coalesce(F.sum("resets").over(earlier_blocks(keys)), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.withColumn("_inside", F.sum("_reset").over(inside))
        .join(prefix, [*keys, "_block"])
        .withColumn("_epoch", F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside", "_reset")
    )


def _judge(df: DataFrame, threshold: float, min_samples: int) -> DataFrame:
    """Score each value against its past.

    Equal values have no deviation; their computed variance may be a rounding
    remainder, so the test is on the smallest and the largest of them.
    """
    value = F.col("value")
    varied = F.col("_lo") < F.col("_hi")
    std = F.when(varied, F.sqrt("_var")).otherwise(F.lit(0.0))
    mean = F.coalesce("_mean", F.lit(0.0))
    z = F.when(
        (F.col("_n") >= min_samples) & (std > 0), F.try_divide(F.abs(value - mean), std)
    )
    return (
        df.withColumn("n", F.col("_n"))
        .withColumn("mean", mean)
        .withColumn("std", std)
        .withColumn("z_score", z)
        .withColumn("is_anomaly", F.coalesce(F.col("z_score") > threshold, F.lit(False)))
        .withColumn("skipped", value.isNull())
    )
