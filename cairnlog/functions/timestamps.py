"""Log timestamps: text to a zone-less timestamp, and bounds for time ranges."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_of, strip

# Month names in order, three letters each.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MONTH = "|".join(MONTHS)
_CLOCK = r"(\d\d?):(\d\d?):(\d\d?)"
_DAY = r"( ?\d|\d\d)"
# Three families; only one of them matches, so the groups of the same part can
# sit side by side in the replacement.
_SHAPE = (
    r"(?i)^(?:"
    rf"(\d{{4}})-(\d\d?)-{_DAY}(?:t{_CLOCK}z?|\s+{_CLOCK})?"
    rf"|{_DAY}/({_MONTH})/(\d{{4}}):{_CLOCK}\s+(?:[+-]\d\d:?[0-5]\d(?::?[0-5]\d(?:\.\d{{1,6}})?)?|z)"
    rf"|({_MONTH})\s+{_DAY}\s+{_CLOCK}"
    r")$"
)
# Six lines: year, month, day, hour, minute, second; the last marks the family.
_PARTS = "$1$12\n$2$11$16\n$3$10$17\n$4$7$13$18\n$5$8$14$19\n$6$9$15$20\n$16"

_RELATIVE = re.compile(r"^(\d+)([smhdw])$")
_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK"}
_BOUND_FORMATS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d")


def parse_timestamp(text: Column, default_year: int = 1900) -> Column:
    """Timestamp (no zone) of ISO, ISO-with-Z, spaced, access-log, syslog or date text.

    A zone offset is dropped, not applied.  Year-less syslog times take
    ``default_year``.  Anything else is NULL.
    """
    text = strip(text)
    packed = F.split(F.regexp_replace(text, _SHAPE, _PARTS), "\n")
    # Text of several lines could pass for the listed parts of another.
    fits = ~text.contains("\n") | text.rlike(_SHAPE)

    def build(part: Column) -> Column:
        name = F.lower(part[1])
        month = F.when(
            name.rlike("^[a-z]"), F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
        ).otherwise(name.try_cast("int"))
        year = F.when(part[6] != "", F.lit(default_year)).otherwise(part[0].try_cast("int"))
        clock = [F.coalesce(F.nullif(part[i], F.lit("")).try_cast("int"), F.lit(0)) for i in (3, 4, 5)]
        stamp = F.try_make_timestamp_ntz(
            year, month, F.trim(part[2]).try_cast("int"), clock[0], clock[1], clock[2]
        )
        return F.when((F.size(part) == 7) & fits & (year >= 1) & (clock[2] <= 59), stamp)

    return first_of(packed, build)


def event_time(column: Column, is_text: bool, default_year: int = 1900) -> Column:
    """``column`` as a zone-less timestamp, parsing it when it is text."""
    return parse_timestamp(column, default_year) if is_text else column.cast("timestamp_ntz")


def time_bound(bound: datetime | str | Column) -> Column:
    """A range bound: a datetime, ISO text to the second, minute or day, or ``30m`` ago."""
    if isinstance(bound, Column):
        return bound.cast("timestamp_ntz")
    if isinstance(bound, str):
        ago = _RELATIVE.match(bound.strip())
        if ago:
            return F.localtimestamp() - F.expr(f"INTERVAL {int(ago[1])} {_UNITS[ago[2]]}")
        bound = _read_bound(bound)
    return F.lit(bound.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def _read_bound(text: str) -> datetime:
    for layout in _BOUND_FORMATS:
        try:
            return datetime.strptime(text, layout)
        except ValueError:
            continue
    raise ValueError(f"not a date, a time or an age such as 30m: {text!r}")


def micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    seconds = (
        (F.unix_date(F.to_date(stamp)).cast("long") * 24 + F.hour(stamp)) * 60 + F.minute(stamp)
    ) * F.lit(60)
    fraction = F.extract(F.lit("SECONDS"), stamp) * F.lit(1_000_000)
    return seconds * F.lit(1_000_000) + fraction.cast("long")
