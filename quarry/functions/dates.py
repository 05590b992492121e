"""Dates and times as text, unix seconds or timestamps without zone; modifiers with months that spill over."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
TEXT = "yyyy-MM-dd HH:mm:ss"


def stamp(t: Column) -> Column:
    """TIMESTAMP_NTZ of ISO text or a timestamp; null for what can't be read."""
    return t.try_cast("timestamp_ntz")


def from_unix(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def add_months(t: Column, n: int) -> Column:
    """The same day of a later month; days past that month's end spill into the next one (01-31 + 1 month = 03-02 or 03-03)."""
    first = F.add_months(F.trunc(t.cast("date"), "month"), n)
    day = F.date_add(first, F.dayofmonth(t) - 1)
    return day.cast("timestamp_ntz") + (t - F.date_trunc("day", t).cast("timestamp_ntz"))


def modify(t: Column, *modifiers: str) -> Column:
    """``+N second .. year``, ``start of day | month | year``, ``weekday N`` (the next such day, today included; 0 is Sunday)."""
    for m in modifiers:
        m = m.strip().lower()
        if x := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) *(second|minute|hour|day|week|month|year)s?", m):
            n, unit = float(x[1]), x[2]
            t = t + _seconds(F.lit(n * SECONDS[unit])) if unit in SECONDS else add_months(t, int(n) * (12 if unit == "year" else 1))
        elif x := re.fullmatch(r"start of (day|month|year)", m):
            t = F.date_trunc(x[1], t).cast("timestamp_ntz")
        elif x := re.fullmatch(r"weekday ([0-6])", m):
            t = t + F.make_dt_interval(days=F.pmod(F.lit(int(x[1])) - weekday(t), F.lit(7)).cast("int"))
        else:
            raise ValueError(f"unknown modifier {m!r}")
    return t


def datetime(t: Column, *modifiers: str) -> Column:
    return F.date_format(modify(t, *modifiers), TEXT)


def date(t: Column, *modifiers: str) -> Column:
    return F.date_format(modify(t, *modifiers), "yyyy-MM-dd")


def time(t: Column, *modifiers: str) -> Column:
    return F.date_format(modify(t, *modifiers), "HH:mm:ss")


def weekday(t: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(t) - 1


def unixepoch(t: Column) -> Column:
    return F.unix_timestamp(t.cast("timestamp"))


def julianday(t: Column) -> Column:
    return unixepoch(t) / F.lit(86400.0) + F.lit(2440587.5)


def strftime(pattern: str, t: Column, *modifiers: str) -> Column:
    """``%Y %m %d %e %H %M %S %f %s %j %w %u %F %T %%``."""
    t = modify(t, *modifiers)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = {
        "Y": lambda: F.date_format(t, "yyyy"), "m": lambda: F.date_format(t, "MM"), "d": lambda: F.date_format(t, "dd"),
        "e": lambda: F.lpad(F.dayofmonth(t).cast("string"), 2, " "), "H": lambda: F.date_format(t, "HH"), "M": lambda: F.date_format(t, "mm"),
        "S": lambda: two(F.second(t)), "f": lambda: F.date_format(t, "ss.SSS"), "s": lambda: unixepoch(t).cast("string"),
        "j": lambda: F.lpad(F.dayofyear(t).cast("string"), 3, "0"), "w": lambda: weekday(t).cast("string"),
        "u": lambda: (F.weekday(t) + 1).cast("string"), "F": lambda: date(t), "T": lambda: time(t), "%": lambda: F.lit("%"),
    }
    out = [parts[x[1]]() if len(x) == 2 and x[0] == "%" and x[1] in parts else F.lit(x) for x in re.findall(r"%.|[^%]+|%", pattern)]
    return F.concat(*out) if out else F.lit("")


def diff(a: Column, b: Column, unit: str = "day") -> Column:
    """(a - b) in whole units, truncated."""
    return F.timestamp_diff(unit.upper(), b, a)
