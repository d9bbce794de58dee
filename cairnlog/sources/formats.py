"""Line formats as column expressions: raw text to a map of fields.

A parser gives NULL where the line is to be dropped.  A line regex runs once per
line: one replacement lists all its groups, one per row of text (lines hold no
newline), and a split takes them apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import NON_WS, WS, first_of, strip

FIELDS_TYPE = "map<string,string>"
FORMATS = ("json", "apache", "syslog", "raw")

# The first rule that fits names the format of a line.
ACCESS_HINT = r"(?Ud)^[^\s\x1c-\x1f]+ [^\s\x1c-\x1f]+ [^\s\x1c-\x1f]+ \["
SYSLOG_HINT = (
    r"(?Ud)^(?:<\d+>)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[\s\x1c-\x1f]"
)

# The access-log line (common or combined) and the RFC 3164 line.
ACCESS_LINE = (
    rf"(?Ud)^({NON_WS}+){WS}+{NON_WS}+{WS}+{NON_WS}+{WS}+"
    rf'\[([^\]]+)\]{WS}+"([^"]+)"{WS}+(\d+){WS}+({NON_WS}+)'
    rf'(?:{WS}+("[^"]*"))?(?:{WS}+("[^"]*"))?(?s:.*)$'
)
SYSLOG_LINE = (
    rf"(?Ud)^(?:<(\d+)>)?(\w{{3}}{WS}+\d+{WS}+\d{{2}}:\d{{2}}:\d{{2}}){WS}+"
    rf"({NON_WS}+){WS}+([^:\[]+)(?:\[(\d+)\])?:{WS}*(.*)$"
)

# Severity names, in the order of priority modulo 8.
SEVERITIES = ("EMERG", "ALERT", "CRIT", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG")

# How non-finite JSON numbers come out of the JSON reader, and as text.
NON_FINITE = {'"NaN"': "nan", '"Infinity"': "inf", '"-Infinity"': "-inf"}

_JSON_OPTIONS = {"allowSingleQuotes": "false"}


def detect_format(raw: Column) -> Column:
    """Name of the format a stripped line looks like."""
    return (
        F.when(raw.startswith("{"), "json")
        .when(raw.rlike(ACCESS_HINT), "apache")
        .when(raw.rlike(SYSLOG_HINT), "syslog")
        .otherwise("raw")
    )


def _json_scan(raw: Column) -> Column:
    """Keys of a JSON object; NULL for malformed text and for other JSON values."""
    return _whole_line(
        raw,
        F.from_json(raw, FIELDS_TYPE, _JSON_OPTIONS),
        F.from_json(_in_array(raw), f"array<{FIELDS_TYPE}>", _JSON_OPTIONS),
        lambda found: F.when(F.size(found) == 1, found[0]),
    )


def _in_array(raw: Column) -> Column:
    return F.concat(F.lit("["), raw, F.lit("]"))


def _whole_line(raw: Column, alone: Column, listed: Column, single: Callable[[Column], Column]) -> Column:
    """What the line is read as, if nothing follows the first value; each read happens where it is needed only.

    A reader stops at the end of the first value and ignores what follows.  Where
    the first closing brace ends the line nothing can follow, and the line is read
    as it is.  Otherwise it is read inside an array, in which trailing text is an
    error and a second value an element.
    """
    flat = raw.startswith("{") & (F.instr(raw, "}") == F.length(raw))
    return F.when(flat, alone).when(_closes_once(raw), first_of(listed, single))


def _json_build(raw: Column, found: Column) -> Column:
    """The keys, with booleans and non-finite numbers spelled as the log model does."""

    def told(fields: Column) -> Column:
        ambiguous = F.exists(F.map_values(fields), lambda v: v.isin("true", "false", *NON_FINITE))
        return F.when(ambiguous, _typed_text(raw, fields)).otherwise(fields)

    # Values are looked at only where the line has one of the words at all.
    words = reduce(or_, [raw.contains(word) for word in ("true", "false", "NaN", "Infinity")])
    return F.when(words, first_of(found, told)).otherwise(found)


def json_variant(raw: Column) -> Column:
    """The JSON object as a VARIANT, whose values keep their types; NULL for anything else.

    VARIANT takes no key twice and no NaN or Infinity; an object with those keeps
    its values as texts, of a repeated key the last.
    """
    typed = _whole_line(
        raw,
        F.try_parse_json(raw),
        F.try_parse_json(_in_array(raw)),
        lambda found: F.when(F.try_variant_get(found, "$[1]", "variant").isNull(), F.try_variant_get(found, "$[0]", "variant")),
    )

    def last_values(fields: Column) -> Column:
        entries, names = F.map_entries(fields), F.array_distinct(F.map_keys(fields))
        values = F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
        return F.to_variant_object(F.map_from_arrays(names, values))

    return F.when(raw.startswith("{"), F.coalesce(typed, first_of(_json_build(raw, _json_scan(raw)), last_values)))


def _closes_once(raw: Column) -> Column:
    """False where the line itself closes the wrapping array early."""
    nested = f"map<string,{FIELDS_TYPE}>"
    as_member = F.from_json(F.concat(F.lit('{"":'), raw, F.lit("}")), nested, _JSON_OPTIONS)
    return (
        F.when(~raw.contains("]"), True)
        .when(~raw.rlike(r"\}\s*\]"), True)
        .otherwise(as_member.isNotNull())
    )


def _typed_text(raw: Column, fields: Column) -> Column:
    """Tell booleans and non-finite numbers from strings that spell the same."""
    typed = F.from_json(raw, "map<string,variant>", _JSON_OPTIONS)

    def retell(variants: Column) -> Column:
        def text(key: Column, value: Column) -> Column:
            kind = F.schema_of_variant(variants[key])
            told = F.when(value.isin("true", "false") & (kind == "BOOLEAN"), F.initcap(value))
            for spelled, name in NON_FINITE.items():
                told = told.when((value == spelled) & (kind == "DOUBLE"), name)
            return told.otherwise(value)

        return F.transform_values(fields, text)

    return first_of(typed, retell)


def _access_scan(raw: Column) -> Column:
    return _groups(raw, ACCESS_LINE, 7)


def _access_build(raw: Column, part: Column) -> Column:
    """Fields of an access-log line, common or combined; NULL where it is neither."""
    request = F.split(part[2], " ", 3)
    status, size = part[3], part[4]
    failed = F.coalesce(status.try_cast("bigint"), F.lit(500)) >= 500
    fields = F.create_map(
        *_pairs(
            host=part[0],
            timestamp=part[1],
            method=F.get(request, F.lit(0)),
            path=F.get(request, F.lit(1)),
            protocol=F.get(request, F.lit(2)),
            status=_whole_number(status),
            bytes=F.when(size == "-", "0").otherwise(_whole_number(size)),
            referer=_quoted(part[5]),
            user_agent=_quoted(part[6]),
            level=F.when(failed, "ERROR").otherwise("INFO"),
        )
    )
    return F.when(F.size(part) == 7, fields)


def _syslog_scan(raw: Column) -> Column:
    return _groups(raw, SYSLOG_LINE, 6)


def _syslog_build(raw: Column, part: Column) -> Column:
    """Fields of an RFC 3164 line; a line of another shape is kept as raw text."""
    priority = F.nullif(part[0], F.lit(""))
    fields = F.create_map(
        *_pairs(
            timestamp=part[1],
            hostname=part[2],
            tag=strip(part[3]),
            pid=F.nullif(part[4], F.lit("")),
            message=part[5],
            level=severity_from_priority(priority),
            priority=_whole_number(priority),
        )
    )
    return F.when(F.size(part) == 6, fields).otherwise(raw_fields(raw))


def severity_from_priority(priority: Column) -> Column:
    """Severity name of a priority in digits; INFO where there is none."""
    # 8 divides 1000, so the last three digits decide however long the number is.
    rank = F.right(priority, F.lit(3)).try_cast("int") % 8
    names = F.array(*[F.lit(name) for name in SEVERITIES])
    return F.coalesce(F.get(names, rank), F.lit("INFO"))


def raw_fields(raw: Column) -> Column:
    return F.create_map(F.lit("message"), raw, F.lit("raw"), F.lit("True"))


class LineParser(NamedTuple):
    """A parse in two steps, so that the costly first one runs once per line.

    ``scan`` takes the raw line apart; ``build`` makes the map of fields from
    the raw line and the scanned value, and may mention both any number of times.
    ``once``: it looks at the scanned value once a line, so no column has to hold it.
    """

    scan: Callable[[Column], Column]
    build: Callable[[Column, Column], Column]
    once: bool = False


PARSERS = {
    "json": LineParser(_json_scan, _json_build, once=True),
    "apache": LineParser(_access_scan, _access_build),
    "syslog": LineParser(_syslog_scan, _syslog_build),
}


def _groups(raw: Column, pattern: str, count: int) -> Column:
    """The groups of the line's match; another number of parts if it does not match.

    Text of several lines is no line, and must not pass for listed groups.
    """
    listing = "\n".join(f"${i}" for i in range(1, count + 1))
    groups = F.split(F.regexp_replace(raw, pattern, listing), "\n")
    return F.when(raw.contains("\n"), F.array(raw)).otherwise(groups)


def _pairs(**fields: Column) -> list[Column]:
    return [item for name, value in fields.items() for item in (F.lit(name), value)]


def _whole_number(digits: Column) -> Column:
    """Integer text without leading zeros or plus sign, of any length; else NULL."""
    long_number = F.when(
        digits.rlike(r"^[+-]?\d+$"), F.regexp_replace(digits, r"^(?:\+|(-))?0*(?=\d)", "$1")
    )
    return F.coalesce(digits.try_cast("bigint").cast("string"), long_number)


def _quoted(text: Column) -> Column:
    """Content between the quotes; NULL where the optional part was absent."""
    return F.when(text != "", F.substr(text, F.lit(2), F.length(text) - F.lit(2)))
