"""Parse jobs: lines to a log frame (file, block_start, seq, raw, format, fields)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.fields import LINE_ORDER, kind_of, variant_path
from ..functions.text import pinned
from ..session import broadcast_if_small, settle, ship_package
from .formats import FIELDS_TYPE, FORMATS, PARSERS, LineParser, detect_format, json_variant, raw_fields

ParseLine = Callable[[str], Mapping[str, object] | None]


def parse_json(lines: DataFrame, exact: bool = False) -> DataFrame:
    """NDJSON.  ``exact`` reads with Python's own JSON module, in Arrow batches.

    The default stays in the JVM; it differs in the text of nested values (JSON
    instead of Python's) and of floats beyond 1e16.
    """
    return _frame(lines, "json", python_fields(_json_object) if exact else PARSERS["json"])


def parse_json_typed(lines: DataFrame) -> DataFrame:
    """NDJSON with ``fields`` as a VARIANT: numbers, booleans, lists and objects keep their types.

    One parse a line.  Operators that take a field name work on it as on any log
    frame; :func:`typed_view` and :func:`field_kinds` read the types.
    """
    return _frame(lines, "json", json_variant)


def typed_view(frame: DataFrame, schema: str) -> DataFrame:
    """Columns of a typed frame next to their position, as in the DDL ``schema``; NULL where a value is of no such type."""
    wanted = T.StructType.fromDDL(schema)
    kinds = {f.name: f.dataType.simpleString() for f in wanted}
    return frame.select(*LINE_ORDER, *[F.try_variant_get("fields", variant_path(n), k).alias(n) for n, k in kinds.items()])


def field_kinds(frame: DataFrame) -> DataFrame:
    """(name, kind, count) of a typed frame: how often each key has a value of each kind.

    Kinds are int, float, bool, str, null, list and dict.
    """
    source = frame.sparkSession.tvf.variant_explode(F.col("fields").outer())
    pairs = frame.select("fields").lateralJoin(source).select(F.col("key").alias("name"), kind_of(F.col("value")).alias("kind"))
    return pairs.groupBy("name", "kind").agg(F.count("*").alias("count"))


def parse_access_log(lines: DataFrame) -> DataFrame:
    return _frame(lines, "apache", PARSERS["apache"])


def parse_syslog(lines: DataFrame) -> DataFrame:
    return _frame(lines, "syslog", PARSERS["syslog"])


def parse_as(lines: DataFrame, fmt: str = "auto", mode: str = "file") -> DataFrame:
    """Parse with the named format, or detect it."""
    if fmt == "auto":
        return parse_auto(lines, mode)
    if fmt not in PARSERS:
        raise ValueError(f"unknown format {fmt!r}; one of auto, {', '.join(PARSERS)}")
    return _frame(lines, fmt, PARSERS[fmt])


def parse_custom(lines: DataFrame, name: str, parser: Callable[[Column], Column]) -> DataFrame:
    """Parse with the caller's own parser.

    ``parser`` is a function of the raw column giving a map of strings (NULL
    drops the line), or :func:`python_fields` around a function of one line.
    """
    return _frame(lines, name, parser)


def parse_auto(
    lines: DataFrame, mode: str = "file", locks: DataFrame | None = None, keep_failed: bool = False
) -> DataFrame:
    """Detect the format: of every line (``line``), or once per file (``file``).

    A file takes the format of its first line that is not raw; the lines before
    that one stay raw, misfits after it are dropped (json, access log) or kept
    raw (syslog).  ``locks`` reuses the result of :func:`file_locks`;
    ``keep_failed`` keeps dropped lines too, with NULL fields.
    """
    if mode == "line":
        return _frame(lines, detect_format(F.col("raw")), None, keep_failed)
    if mode != "file":
        raise ValueError(f"mode is 'line' or 'file', not {mode!r}")
    if lines.isStreaming:
        raise ValueError("a stream has no whole file to look at: use mode='line'")
    locks = settle(file_locks(lines)) if locks is None else locks
    # One row per file, about its path's length; the count is read, not guessed.
    locks = broadcast_if_small(locks, locks.count(), row_bytes=512)
    at_or_after = F.struct("block_start", "seq") >= F.struct("lock_block", "lock_seq")
    fmt = F.when(at_or_after, F.col("lock_format")).otherwise("raw")
    return _frame(lines.join(locks, "file", "left"), F.coalesce(fmt, F.lit("raw")), None, keep_failed)


def file_locks(lines: DataFrame) -> DataFrame:
    """Per file, position and format of its first line that is not raw.

    The format's number rides in the low bits of ``seq``, so the first level is
    a hash aggregation of longs inside each split and only splits are shuffled.
    """
    code = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), detect_format(F.col("raw"))) - 1
    raw_code = len(FORMATS) - 1
    first_in_split = (
        lines.select("file", "block_start", (F.col("seq") * 4 + code).alias("packed"), code.alias("code"))
        .where(F.col("code") < raw_code)
        .groupBy("file", "block_start")
        .agg(F.min("packed").alias("packed"))
    )
    first = first_in_split.groupBy("file").agg(F.min(F.struct("block_start", "packed")).alias("lock"))
    names = F.array(*[F.lit(f) for f in FORMATS])
    return first.select(
        "file",
        F.col("lock.block_start").alias("lock_block"),
        F.shiftright("lock.packed", 2).alias("lock_seq"),
        F.get(names, F.col("lock.packed").bitwiseAND(3).cast("int")).alias("lock_format"),
    )


def python_fields(parse_line: ParseLine) -> Callable[[Column], Column]:
    """A column function around a Python parser of one line, run in Arrow batches."""
    ship_package(SparkSession.active())

    @F.pandas_udf(FIELDS_TYPE)
    def fields(raw: pd.Series) -> pd.Series:
        entries = (parse_line(line) for line in raw)
        return pd.Series([None if e is None else _texts(e) for e in entries], dtype="object")

    return fields


def parse_rows(lines: DataFrame, parse_line: Callable[[str], Iterable[Mapping[str, object]]], schema: str) -> DataFrame:
    """Parse with a Python function that yields any number of entries a line, with typed values.

    A table function applied to every line: the lines' columns, ``entry_no`` (from
    0, in the order the entries are yielded) and the columns of the DDL
    ``schema``, NULL where an entry lacks them.  A line without entries is
    dropped; so is, from there on, one whose parser raises ValueError.
    """
    ship_package(lines.sparkSession)
    columns = T.StructType.fromDDL(schema)
    whole = T.StructType([T.StructField("entry_no", T.LongType()), *columns])

    class Entries:
        @staticmethod
        def analyze(raw: AnalyzeArgument) -> AnalyzeResult:
            if raw.dataType != T.StringType():
                raise ValueError(f"lines are texts, not {raw.dataType.simpleString()}")
            return AnalyzeResult(whole)

        def eval(self, raw: str) -> Iterator[tuple]:
            try:
                for number, entry in enumerate(parse_line(raw)):
                    yield (number, *[entry.get(name) for name in columns.names])
            except ValueError:
                return

    return lines.lateralJoin(udtf(Entries)(F.col("raw").outer()))


def _texts(entry: Mapping[str, object]) -> dict[str, str | None]:
    return {str(k): None if v is None else str(v) for k, v in entry.items()}


def _json_object(line: str) -> dict[str, object] | None:
    try:
        value = json.loads(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _frame(
    lines: DataFrame,
    fmt: str | Column,
    parser: LineParser | Callable[[Column], Column] | None,
    keep_failed: bool = False,
) -> DataFrame:
    """Attach format and fields, dropping the lines whose parse is NULL.

    The fields are pinned: no filter on them may repeat the parse.
    ``parser`` None means: each line by the parser its format names.
    """
    raw = F.col("raw")
    kept = [*LINE_ORDER, "raw", "format"]
    named = lines.select(*LINE_ORDER, "raw", (F.lit(fmt) if isinstance(fmt, str) else fmt).alias("format"))
    if parser is None:
        scans = [F.when(F.col("format") == n, p.scan(raw)).alias(f"_{n}") for n, p in PARSERS.items()]
        fields = raw_fields(raw)
        for name, p in PARSERS.items():
            fields = F.when(F.col("format") == name, p.build(raw, F.col(f"_{name}"))).otherwise(fields)
    elif isinstance(parser, LineParser) and parser.once:
        scans, fields = [], parser.build(raw, parser.scan(raw))
    elif isinstance(parser, LineParser):
        scans = [parser.scan(raw).alias("_scan")]
        fields = parser.build(raw, F.col("_scan"))
    else:
        scans = [parser(raw).alias("_scan")]
        fields = F.col("_scan")
    parsed = named.select(*kept, *scans).select(*kept, pinned(fields).alias("fields"))
    return parsed if keep_failed else parsed.where("fields IS NOT NULL")


def access_view(frame: DataFrame) -> DataFrame:
    """Typed columns of access-log entries next to their position."""
    longs = {"status", "bytes"}
    names = ("host", "timestamp", "method", "path", "protocol", "status", "bytes", "referer", "user_agent", "level")
    return _view(frame, names, longs)


def syslog_view(frame: DataFrame) -> DataFrame:
    """Typed columns of syslog entries next to their position."""
    names = ("timestamp", "hostname", "tag", "pid", "message", "level", "priority")
    return _view(frame, names, {"priority"})


def _view(frame: DataFrame, names: tuple[str, ...], longs: set[str]) -> DataFrame:
    value = F.col("fields").getItem
    return frame.select(
        *LINE_ORDER,
        *[(value(n).try_cast("bigint") if n in longs else value(n)).alias(n) for n in names],
    )
