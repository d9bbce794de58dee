"""Projections: chosen fields, default columns, the (ts, level, msg) view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field, filled, has_field, is_log_frame
from .search import first_n

# Columns an access-log table leaves out by default.  The first
# is spelled with a double r and so never meets the field ``referer``.
ACCESS_HIDDEN = ("referrer", "user_agent", "protocol")


def select_fields(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the listed keys of every entry; absent ones stay absent."""
    return frame.withColumn("fields", F.map_filter("fields", lambda key, _: key.isin(*names)))


def field_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One text column per listed field, empty where the entry lacks it."""
    return df.select(*[field(df, name, "").alias(name) for name in names])


def default_columns(df: DataFrame, order_by: Sequence[str] | str | None = None) -> list[str]:
    """Column names for a table of entries: the keys of the first one.

    For access logs the keys that are null in it, and the hidden ones, are left out.
    """
    if not is_log_frame(df):
        return df.columns
    first = first_n(df, 1, order_by).select(F.map_entries("fields").alias("pairs")).first()
    if first is None:
        return []
    pairs = [(pair.key, pair.value) for pair in first.pairs]
    if {"method", "path", "status"} <= {key for key, _ in pairs}:
        return [key for key, value in pairs if value is not None and key not in ACCESS_HIDDEN]
    return [key for key, _ in pairs]


def default_table(df: DataFrame, order_by: Sequence[str] | str | None = None) -> DataFrame:
    return field_columns(df, default_columns(df, order_by))


def normalise_entry(df: DataFrame) -> DataFrame:
    """Add ts, level and msg, whatever the format of the entry.

    Empty and zero values count as missing and the next name is tried.
    """
    return df.select(
        *[c for c in df.columns if c not in ("ts", "level", "msg")],
        filled(df, "timestamp", "time", "@timestamp").alias("ts"),
        entry_level(df).alias("level"),
        _message(df).alias("msg"),
    )


def entry_level(df: DataFrame) -> Column:
    return F.upper(filled(df, "level", "severity", "lvl", default="INFO"))


def _message(df: DataFrame) -> Column:
    request = F.format_string(
        "%s %s → %s (%s B)",
        field(df, "method"),
        field(df, "path"),
        field(df, "status"),
        field(df, "bytes", "-"),
    )
    tagged = F.format_string("[%s] %s", field(df, "tag"), field(df, "message", ""))
    is_request = has_field(df, "method") & has_field(df, "path") & has_field(df, "status")
    is_tagged = has_field(df, "tag") & has_field(df, "hostname")
    return (
        F.when(is_request, request)
        .when(is_tagged, tagged)
        .otherwise(filled(df, "message", "msg", "body"))
    )
