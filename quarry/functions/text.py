"""Text functions whose meaning differs from Spark's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"


def concat(*cols: Column) -> Column:
    """Skips nulls."""
    return F.concat_ws("", *cols)


def initcap(s: Column) -> Column:
    """Upper-cases the first character of every alphanumeric run and lower-cases the others."""
    runs = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def trim(s: Column, chars: str = BLANKS) -> Column:
    return F.btrim(s, F.lit(chars))


def ltrim(s: Column, chars: str = BLANKS) -> Column:
    return F.ltrim(s, F.lit(chars))


def rtrim(s: Column, chars: str = BLANKS) -> Column:
    return F.rtrim(s, F.lit(chars))


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """1-based; a negative start counts from the end, a start of 0 takes one place of the length."""
    if start == 0:
        return F.lit("") if length is not None and length <= 1 else F.substr(s, F.lit(1), F.lit(length - 1)) if length is not None else s
    if start > 0:
        return F.substr(s, F.lit(start)) if length is None else F.substr(s, F.lit(start), F.lit(max(0, length)))
    begin = F.char_length(s) + start + 1
    if length is None:
        return F.substr(s, F.greatest(begin, F.lit(1)))
    # what lies before the first character counts towards the length
    return F.substr(s, F.greatest(begin, F.lit(1)), F.greatest(F.least(F.lit(length), begin + length - 1), F.lit(0)))


def split_part(s: Column, sep: str, n: int) -> Column:
    """1-based, negative from the end; before the first part it is the first, past the last it is empty; no separator: all."""
    if n == 0:
        raise ValueError("split_part counts from 1")
    if sep == "":
        return F.when(s.isNotNull(), s if abs(n) == 1 else F.lit(""))
    parts = F.split(s, re.escape(sep), -1)
    at = F.lit(n - 1) if n > 0 else F.greatest(F.size(parts) + n, F.lit(0))
    return F.when(s.isNotNull(), F.coalesce(F.get(parts, at), F.lit("")))


def unicode(s: Column) -> Column:
    """Code point of the first character, null for an empty string."""
    return F.when(s != "", F.ascii(s))


def char(*points: Column) -> Column:
    """String of code points, also above 255."""
    one = lambda p: F.decode(F.unhex(F.lpad(F.hex(p.cast("bigint")), 8, "0")), "UTF-32")
    return F.concat(*[one(p) for p in points])


def quote_literal(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_ident(s: Column) -> Column:
    return F.when(s.rlike("^[a-z_][a-z0-9_]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def like(s: Column, pattern: str) -> Column:
    """LIKE without regard to case; a backslash is an ordinary character."""
    return s.ilike(pattern.replace("\\", "\\\\"))


def glob_regex(pattern: str) -> str:
    """The regular expression of a GLOB pattern: ``* ? [a-z] [^x] [!x]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end]
            neg = body[0] in "^!"
            out += "[" + "^" * neg + re.sub(r"([\\\[\]&^])", r"\\\1", body[neg:]) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def glob(s: Column, pattern: str) -> Column:
    return s.rlike(glob_regex(pattern))
