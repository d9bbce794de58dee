"""The statistics report: total, top values and, if asked, the numeric summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field, order_columns
from ..functions.fields import numeric as number_of
from ..functions.text import pinned
from ..session import settle
from .counting import top as top_values
from .counting import total
from .numeric import skipped_count, summary


def stats(
    df: DataFrame,
    by: str = "level",
    top: int = 10,
    numeric: bool = False,
    order_by: Sequence[str] | str | None = None,
) -> DataFrame:
    """Long report (section, rank, label, value) over one field.

    The field's value, its number and the order columns are settled in one pass
    over the entries; every section reads those.
    """
    order = order_columns(df, order_by)
    shown = field(df, by)
    df = settle(df.select(shown.alias("_shown"), pinned(number_of(df, by)).alias("_number"), *order))
    empty = F.lit(None).cast("long").alias("rank")
    sections = total(df).select(
        F.lit("total").alias("section"), empty, F.lit("entries").alias("label"), F.col("total").cast("double").alias("value")
    )
    ranked = top_values(df, "_shown", top, order).select(
        F.lit("top").alias("section"), "rank", F.col("value").alias("label"), F.col("count").cast("double").alias("value")
    )
    report = sections.unionByName(ranked)
    if numeric:
        facts = summary(df, "_number")
        pairs = [F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in facts.columns]
        numbers = facts.select(F.inline(F.array(*pairs))).where("value IS NOT NULL")
        skipped = skipped_count(df, "_number").select(
            F.lit("skipped").alias("label"), F.col("skipped").cast("double").alias("value")
        )
        extra = numbers.unionByName(skipped)
        report = report.unionByName(extra.select(F.lit("numeric").alias("section"), empty, "label", "value"))
    return report
