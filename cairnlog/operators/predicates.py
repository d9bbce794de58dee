"""Predicates: functions of a DataFrame giving a boolean Column, and how they combine.

A plain Column is a predicate too.  NULL counts as false, as in any filter; it
is left as it is, because a filter wrapped against NULL would not reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import NULL_TEXT, as_text, has_field, is_log_frame
from ..functions.text import first_of, java_regex
from ..functions.timestamps import event_time, time_bound
from ..session import ship_package

Predicate = Column | Callable[[DataFrame], Column]


def condition(df: DataFrame, predicate: Predicate) -> Column:
    """The predicate as a Column of ``df``."""
    return predicate if isinstance(predicate, Column) else predicate(df)


def regex_search(pattern: str, fields: Sequence[str] = (), ignore_case: bool = True, flags: int = 0) -> Predicate:
    """True where a value (of any field, or of the named ones) contains a match; ``flags`` are those of ``re``."""
    regex = java_regex(pattern, ignore_case, flags)

    def matches(df: DataFrame) -> Column:
        if fields:
            hits = [has_field(df, f) & _shown(as_text(df, f)).rlike(regex) for f in fields]
        elif is_log_frame(df):
            return F.exists(F.map_values("fields"), lambda value: _shown(value).rlike(regex))
        else:
            hits = [as_text(df, c).rlike(regex) for c in df.columns]
        return reduce(or_, hits, F.lit(False))

    return matches


def _shown(value: Column) -> Column:
    return F.coalesce(value, F.lit(NULL_TEXT))


def time_range(
    start: datetime | str | Column | None = None,
    end: datetime | str | Column | None = None,
    timestamp: str = "timestamp",
    default_year: int = 1900,
) -> Predicate:
    """True where the entry's time lies in [start, end]; a missing time never does.

    On a timestamp column the bounds compare with the bare column, so a scan
    of Parquet can skip row groups by them.
    """

    def inside(stamp: Column) -> Column:
        bounds = [stamp.isNotNull()]
        if start is not None:
            bounds.append(stamp >= time_bound(start))
        if end is not None:
            bounds.append(stamp <= time_bound(end))
        return reduce(and_, bounds)

    def within(df: DataFrame) -> Column:
        if not is_log_frame(df) and isinstance(_kind(df, timestamp), T.TimestampNTZType):
            return inside(F.col(timestamp))
        return first_of(entry_time(df, timestamp, default_year), inside)

    return within


def entry_time(df: DataFrame, name: str = "timestamp", default_year: int = 1900) -> Column:
    """The entry's time as a zone-less timestamp; NULL where there is none."""
    if is_log_frame(df):
        return event_time(as_text(df, name), True, default_year)
    kind = _kind(df, name)
    if kind is None:
        return F.lit(None).cast("timestamp_ntz")
    return event_time(F.col(name), isinstance(kind, T.StringType), default_year)


def _kind(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[name].dataType if name in df.columns else None


def contains_like(name: str, pattern: str) -> Predicate:
    """SQL LIKE with the pattern anywhere; ``%`` and ``_`` in it are wildcards."""
    return lambda df: as_text(df, name).like(f"%{pattern}%")


def field_equals(name: str, value: str) -> Predicate:
    return lambda df: as_text(df, name) == value


def python_predicate(test: Callable[[dict], bool]) -> Predicate:
    """A Python test of one entry, run in Arrow batches.  Prefer a Column."""

    def matches(df: DataFrame) -> Column:
        ship_package(SparkSession.active())

        @F.pandas_udf("boolean")
        def run(entries: pd.Series) -> pd.Series:
            return pd.Series([bool(test(dict(e))) for e in entries], dtype="bool")

        @F.pandas_udf("boolean")
        def run_rows(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([bool(test(r)) for r in rows.to_dict("records")], dtype="bool")

        return run(F.col("fields")) if is_log_frame(df) else run_rows(F.struct(*df.columns))

    return matches


def all_of(*predicates: Predicate) -> Predicate:
    """True where every predicate is; with none, everywhere."""
    return lambda df: reduce(and_, [condition(df, p) for p in predicates], F.lit(True))


def any_of(*predicates: Predicate) -> Predicate:
    """True where at least one predicate is; with none, nowhere."""
    return lambda df: reduce(or_, [condition(df, p) for p in predicates], F.lit(False))


@dataclass(frozen=True)
class Chain:
    """Predicates that must all hold; grows by ``add``, joins another by ``&``."""

    predicates: tuple[Predicate, ...] = ()

    def add(self, predicate: Predicate) -> Chain:
        return Chain((*self.predicates, predicate))

    def __and__(self, other: Chain) -> Chain:
        return Chain(self.predicates + other.predicates)

    def __len__(self) -> int:
        return len(self.predicates)

    def __call__(self, df: DataFrame) -> Column:
        return all_of(*self.predicates)(df)

    def apply(self, df: DataFrame) -> DataFrame:
        return where(df, self)


def where(df: DataFrame, predicate: Predicate) -> DataFrame:
    return df.where(condition(df, predicate))
