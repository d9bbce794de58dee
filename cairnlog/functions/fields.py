"""Field access that works on a log frame and on an ordinary table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import finite, to_number

LINE_ORDER = ("file", "block_start", "seq")
MISSING = "unknown"
NULL_TEXT = "None"


def is_log_frame(df: DataFrame) -> bool:
    return "fields" in df.columns and isinstance(df.schema["fields"].dataType, (T.MapType, T.VariantType))


def is_typed(df: DataFrame) -> bool:
    """A log frame whose fields keep their types."""
    return "fields" in df.columns and isinstance(df.schema["fields"].dataType, T.VariantType)


def variant_path(name: str) -> str:
    """The path of a top-level key, whatever it is called."""
    for quote in ('"', "'"):
        if quote not in name:
            return f"$[{quote}{name}{quote}]"
    raise ValueError(f"a key with both kinds of quotes can't be read from a VARIANT: {name!r}")


def kind_of(value: Column) -> Column:
    """int, float, bool, str, null, list or dict: what a VARIANT value is.

    Numbers with a point are decimals there, of no scale if they are whole; whole
    numbers are decimals only where they have more digits than a bigint.
    """
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "dict")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind == "BIGINT", "int")
        .when(kind.rlike(r"^DECIMAL\((19|[2-9]\d),0\)$"), "int")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "VOID", "null")
        .otherwise("str")
    )


def order_columns(df: DataFrame, order_by: Sequence[str] | str | None = None) -> list[str]:
    """The columns that give the entries their order; a log frame knows its own."""
    if order_by is None:
        if not set(LINE_ORDER) <= set(df.columns):
            raise ValueError("order_by is needed: the table has no line order of its own")
        return list(LINE_ORDER)
    return [order_by] if isinstance(order_by, str) else list(order_by)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns: maps as their entries, VARIANT values as their JSON."""
    hashable = {T.MapType: F.map_entries, T.VariantType: F.to_json}
    columns = [(F.col(f"`{f.name}`"), hashable.get(type(f.dataType))) for f in df.schema.fields]
    return F.xxhash64(*[plain(c) if plain else c for c, plain in columns])


def has_field(df: DataFrame, name: str) -> Column:
    """Is the key there?  In an ordinary table a NULL counts as absent."""
    if is_typed(df):
        return F.try_variant_get("fields", variant_path(name), "variant").isNotNull()
    if is_log_frame(df):
        return F.map_contains_key("fields", name)
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def as_text(df: DataFrame, name: str) -> Column:
    """The value as text, NULL where absent or null."""
    if is_typed(df):
        text = F.try_variant_get("fields", variant_path(name), "string")
        kind = kind_of(F.try_variant_get("fields", variant_path(name), "variant"))
        told = F.when(text.isin("true", "false") & (kind == "bool"), F.initcap(text))
        return told.when(text.rlike(r"^-?\d{1,18}$") & (kind == "float"), F.concat(text, F.lit(".0"))).otherwise(text)
    if is_log_frame(df):
        return F.col("fields")[name]
    if name not in df.columns:
        return F.lit(None).cast("string")
    text = F.col(name).cast("string")
    return F.initcap(text) if isinstance(df.schema[name].dataType, T.BooleanType) else text


def field(df: DataFrame, name: str, default: str = MISSING) -> Column:
    """The value as text; absent -> ``default``, present but null -> ``None``."""
    return F.when(has_field(df, name), F.coalesce(as_text(df, name), F.lit(NULL_TEXT))).otherwise(
        F.lit(default)
    )


def filled(df: DataFrame, *names: str, default: str = "") -> Column:
    """First of the named values that is neither absent, null, empty nor zero."""
    texts = [as_text(df, name) for name in names]
    usable = [F.when(~t.isin("", "0", "0.0", "False", "[]", "{}"), t) for t in texts]
    return F.coalesce(*usable, F.lit(default))


def numeric(df: DataFrame, name: str) -> Column:
    """The value as a double; NULL where it is absent, null or not a number."""
    if not is_log_frame(df) and name in df.columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.NumericType):
            number = F.col(name).cast("double")
            return finite(number) if isinstance(kind, (T.FloatType, T.DoubleType)) else number
        if isinstance(kind, T.BooleanType):
            return F.col(name).cast("int").cast("double")
    text = as_text(df, name)
    truth = F.when(text == "True", F.lit(1.0)).when(text == "False", F.lit(0.0))
    return F.coalesce(to_number(text), truth) if is_log_frame(df) else to_number(text)
