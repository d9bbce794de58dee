"""Writers: NDJSON, CSV and HTML table rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import as_text, field, is_log_frame
from ..functions.text import escape_html
from ..operators.search import first_n

# Fields of the access-log and syslog formats that hold numbers.
NUMBER_FIELDS = ("status", "bytes", "priority")


def entry_json(df: DataFrame, names: Sequence[str] = ()) -> Column:
    """The entry (or its named fields) as a JSON object with its own value types."""
    if not is_log_frame(df):
        return F.to_json(F.struct(*(names or df.columns)))

    def typed(key: Column, value: Column) -> Column:
        return (
            F.when(key.isin(*NUMBER_FIELDS), value.try_cast("bigint").cast("variant"))
            .when((key == "raw") & (value == "True"), F.lit(True).cast("variant"))
            .otherwise(value.cast("variant"))
        )

    from_line = F.map_filter(
        F.from_json("raw", "map<string,variant>"), lambda key, _: F.map_contains_key("fields", key)
    )
    entry = F.when(F.col("format") == "json", from_line).otherwise(F.transform_values("fields", typed))
    return F.to_json(F.map_filter(entry, lambda key, _: key.isin(*names)) if names else entry)


def write_ndjson(
    df: DataFrame,
    path: str,
    names: Sequence[str] = (),
    limit: int = 0,
    order_by: Sequence[str] | str | None = None,
) -> None:
    """One JSON object per line; with ``limit``, the first entries only."""
    first_n(df, limit, order_by).select(entry_json(df, names).alias("value")).write.text(path)


def first_keys(df: DataFrame, order_by: Sequence[str] | str | None = None) -> list[str]:
    """The keys of the first entry, in its order."""
    if not is_log_frame(df):
        return df.columns
    first = first_n(df, 1, order_by).select(F.map_keys("fields").alias("keys")).first()
    return [] if first is None else list(first["keys"])


def write_csv(df: DataFrame, path: str, order_by: Sequence[str] | str | None = None) -> None:
    """CSV whose header is the keys of the first entry.

    Other keys are ignored, absent and null values are empty.  Without entries
    there is no header either.
    """
    names = first_keys(df, order_by)
    if not names:
        df.select(F.lit("").alias("value")).where(F.lit(False)).write.text(path)
        return
    cells = [F.coalesce(as_text(df, n), F.lit("")).alias(n) for n in names]
    (
        df.select(*cells)
        .write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def html_row(df: DataFrame) -> Column:
    """The entry as an HTML table row, all values escaped."""
    level = escape_html(field(df, "level", ""))
    return F.format_string(
        '<tr class="level-%s">\n  <td>%s</td>\n  <td class="level">%s</td>\n  <td>%s</td>\n</tr>',
        F.lower(level),
        escape_html(field(df, "timestamp", "")),
        level,
        escape_html(field(df, "message", "")),
    )
