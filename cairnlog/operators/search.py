"""Search: pre-filter of raw lines, filters over entries, first n in order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import order_columns
from ..functions.text import java_regex
from .predicates import Chain, contains_like, regex_search, time_range, where


def raw_prefilter(lines: DataFrame, pattern: str, ignore_case: bool = True, flags: int = 0) -> DataFrame:
    """Keep the lines that match, before they are parsed."""
    return lines.where(F.col("raw").rlike(java_regex(pattern, ignore_case, flags)))


def search(
    df: DataFrame,
    pattern: str,
    field: str | None = None,
    case_sensitive: bool = False,
    since: datetime | str | Column | None = None,
    until: datetime | str | Column | None = None,
    timestamp: str = "timestamp",
    limit: int = 0,
    order_by: Sequence[str] | str | None = None,
    flags: int = 0,
) -> DataFrame:
    """Entries that match the pattern inside the time range; the first ``limit`` if given."""
    chain = Chain().add(regex_search(pattern, [field] if field else [], not case_sensitive, flags))
    if since is not None or until is not None:
        chain = chain.add(time_range(since, until, timestamp))
    found = chain.apply(df)
    return first_n(found, limit, order_by) if limit else found


def match_count(df: DataFrame, pattern: str, **options: object) -> DataFrame:
    """How many entries a search finds (``matches``), whatever part of them is shown.

    ``options`` are those of :func:`search`; a ``limit`` among them is left aside.
    """
    return search(df, pattern, **{**options, "limit": 0}).agg(F.count(F.lit(1)).alias("matches"))


def substring_search(
    df: DataFrame, field: str, pattern: str, limit: int = 0, order_by: Sequence[str] | str | None = None
) -> DataFrame:
    """Rows whose field holds the text (SQL LIKE, case-sensitive); at most ``limit`` if given.

    With a limit and without ``order_by`` any such rows will do, and the scan stops early.
    """
    found = where(df, contains_like(field, pattern))
    if limit <= 0:
        return found
    return found.limit(limit) if order_by is None else first_n(found, limit, order_by)


def substring_sql(
    spark: SparkSession, table: str, field: str, pattern: str, limit: int = 0, order_by: str | None = None
) -> DataFrame:
    """:func:`substring_search` as SQL over a table of the catalog.

    Names and texts are bound as parameters and never become part of the statement.
    ``table`` and ``field`` are identifiers: quote a part that holds more than
    letters, digits and underscores in backticks.
    """
    statement = "SELECT * FROM IDENTIFIER(:table) WHERE IDENTIFIER(:field) LIKE concat('%', replace(:pattern, '\\\\', '\\\\\\\\'), '%')"
    bound: dict[str, object] = {"table": table, "field": field, "pattern": pattern}
    if order_by is not None:
        statement += " ORDER BY IDENTIFIER(:order_by)"
        bound["order_by"] = order_by
    if limit > 0:
        statement += " LIMIT :limit"
        bound["limit"] = limit
    return spark.sql(statement, args=bound)


def first_n(df: DataFrame, n: int, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """The first n entries in order; 0 means all of them.

    Sort and limit together plan as a top-n per task and one merge, not a sort.
    """
    return df if n <= 0 else df.orderBy(*order_columns(df, order_by)).limit(n)
