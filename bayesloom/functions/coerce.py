"""Total conversions of payload values: a default instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(x: Column, default: int = 0) -> Column:
    """Integers, whole parts of numbers, and strings of either; else the default."""
    d = x.cast("string").try_cast("double")
    return F.coalesce(x.cast("string").try_cast("bigint"), F.when(~F.isnan(d) & (F.abs(d) < 9.2e18), d.cast("bigint")), F.lit(default).cast("bigint"))


def to_float(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(default))


def to_string(x: Column, default: str = "") -> Column:
    return F.coalesce(x.cast("string"), F.lit(default))


def to_bool(x: Column, default: bool = False) -> Column:
    """The default for null; strings are false if empty or "0", numbers if zero, booleans as they are."""
    s = x.cast("string")
    text = s.isin("", "0")
    number = s.try_cast("double") == 0
    return F.when(x.isNull(), F.lit(default)).otherwise(~F.when(F.typeof(x) == "string", text).when(F.typeof(x) == "boolean", s == "false").otherwise(F.coalesce(number, F.lit(False))))


def format_float(x: Column) -> Column:
    """A number as text that keeps a zero fraction."""
    return F.when(x == F.floor(x), F.concat(F.format_string("%.0f", x), F.lit(".0"))).otherwise(x.cast("string"))


def string_list(x: Column) -> Column:
    return F.transform(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull()), lambda v: v.cast("string"))


def count_map(x: Column) -> Column:
    """A map of names to counts without negative ones."""
    return F.transform_values(F.coalesce(x, F.create_map().cast("map<string,bigint>")), lambda _, v: F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)).cast("bigint"))
