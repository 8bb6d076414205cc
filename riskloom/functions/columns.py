"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that means "missing", and the text form of a number.
NA_TOKENS = (
    "", "?", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A",
    "#NA", "#N/A N/A", "-NaN", "-nan", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)
NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; the table has {', '.join(df.columns)}")


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes NULL in float columns, so that every aggregate skips it."""
    names = [c for c in (cols or df.columns) if is_fractional(df, c)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names}) if names else df


def text_or_null(c: Column, na_tokens: Sequence[str] = NA_TOKENS) -> Column:
    trimmed = F.trim(c)
    return F.when(~trimmed.isin(list(na_tokens)), trimmed)


def number_or_null(c: Column, dtype: T.DataType) -> Column:
    """Double from a number or a number's text; anything else is NULL instead of an error."""
    if isinstance(dtype, T.StringType):
        trimmed = F.trim(c)
        return F.when(trimmed.rlike(NUMBER_TEXT), trimmed.try_cast("double"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def lookup(c: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Value of `mapping` at `c`; a key it lacks gives `default` (NULL if none)."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def title_case(c: Column) -> Column:
    """Capital after every non-letter, as in 'st_slope' -> 'St_Slope'."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, F.initcap), "")


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL when b is 0, without the ANSI error."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rows_of(df: DataFrame, structs: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """One output row per struct: turns a wide one-pass aggregate into a long table."""
    return df.select(*keep, F.inline(F.array(*structs)))


def fixed(c: Column, places: int, signed: bool = False) -> Column:
    """Decimal text of a number, rounded from its exact binary value."""
    text = F.regexp_replace(F.format_number(c, places), ",", "")
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text)) if signed else text


def plain_number(col: str) -> Column:
    """Shortest decimal text of a double, without an exponent from 0.0001 up to 10**16."""
    value = F.col(col).cast("double")
    text = value.cast("string")
    size = F.abs(value)
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    written = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when((size >= 1e-4) & (size < 1e16), written).otherwise(text)
