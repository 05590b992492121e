"""Arithmetic and conversions whose meaning differs from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Truncating; null for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def shift_left(a: Column, n: int) -> Column:
    """Shifts of 64 and more give 0, negative ones go the other way."""
    if abs(n) >= 64:
        return F.when(a.isNotNull(), F.lit(0).cast("bigint"))
    return F.shiftleft(a.cast("bigint"), n) if n >= 0 else F.shiftright(a.cast("bigint"), -n)


def shift_right(a: Column, n: int) -> Column:
    return shift_left(a, -n)


def round_half_away(x: Column, digits: int = 0) -> Column:
    """Half away from zero on the scaled double."""
    scaled = F.abs(x.cast("double")) * F.lit(10.0**digits)
    return F.signum(x.cast("double")) * F.floor(scaled + 0.5) / F.lit(10.0**digits)


def trunc(x: Column, digits: int = 0) -> Column:
    scale = F.lit(10.0**digits)
    return F.signum(x.cast("double")) * F.floor(F.abs(x.cast("double")) * scale) / scale


def sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("bigint")


def log(x: Column, base: Column | None = None) -> Column:
    """One argument: base 10."""
    return F.log10(x) if base is None else F.ln(x) / F.ln(base)


def to_number(s: Column) -> Column:
    return s.try_cast("double")


def to_int(s: Column) -> Column:
    """CAST of text or reals to an integer truncates."""
    x = s.cast("double")
    return (F.signum(x) * F.floor(F.abs(x))).cast("bigint")


def text_equals_number(s: Column, n: Column) -> Column:
    """Text that reads as a number compares as one, other text never equals."""
    return s.try_cast("double") == n


def total(x: Column) -> Column:
    """Sum as a real, 0 over nothing."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def random_int() -> Column:
    return F.xxhash64(F.uuid())
