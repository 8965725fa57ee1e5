"""Scalar and string functions with the engine's own rules for zero, null and whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_int(kind: T.DataType) -> bool:
    return isinstance(kind, _INTS)


def div(a: Column, b: Column, ints: bool) -> Column:
    """Whole numbers truncate and give null by zero; floats follow IEEE."""
    if ints:
        q = F.when(b != 0, F.call_function("div", a, b))
        return q
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def try_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


def trim(s: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def length(s: Column) -> Column:
    """Characters, not bytes."""
    return F.char_length(s)


def concat_text(*parts: Column) -> Column:
    """The parts that are there, one after another; none is null."""
    return F.concat_ws("", *parts)


def substr(s: Column, start: Column, n: Column | None = None) -> Column:
    """From the 1-based character on; 0 counts as 1, before that the result is empty."""
    at = F.when(start == 0, 1).otherwise(start).cast("int")
    got = F.substring(s, at, n.cast("int") if n is not None else F.lit(2**31 - 1))
    return F.when(start < 0, F.when(s.isNotNull(), F.lit(""))).otherwise(got)


def cast_int(c: Column, kind: T.DataType) -> Column:
    """Whole part of a float, or of text that spells a number; null if there is none."""
    if isinstance(kind, T.StringType):
        return c.try_cast("bigint")
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        return F.when(F.isnan(c.cast("double")), None).otherwise(c.try_cast("bigint"))
    return c.try_cast("bigint")


def cast_bool(c: Column, kind: T.DataType) -> Column:
    """Numbers: not zero; text: not empty; floats have no truth value."""
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.StringType):
        return c != ""
    if is_int(kind):
        return c != 0
    return F.lit(None).cast("boolean")
