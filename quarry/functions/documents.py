"""JSON, regular expressions, arrays and conditionals whose meaning differs from Spark's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_extract(doc: Column, path: str, kind: str = "string") -> Column:
    """The value at ``$.a.b[0]``; null where the text is no JSON or has no such place."""
    return F.try_variant_get(F.try_parse_json(doc), path, kind)


def json_valid(doc: Column) -> Column:
    return F.when(doc.isNotNull(), F.try_parse_json(doc).isNotNull())


def json_array_length(doc: Column) -> Column:
    """0 for what is no array."""
    return F.when(doc.isNotNull(), F.coalesce(F.json_array_length(doc), F.lit(0)))


def json_type(doc: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(doc))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "text")
        .when(kind == "VOID", "null").when(kind == "BIGINT", "integer").otherwise(F.when(kind.isNotNull(), "real"))
    )


def json_normal(doc: Column) -> Column:
    """Compact text with sorted keys."""
    return F.to_json(F.try_parse_json(doc))


def regexp_replace_first(s: Column, pattern: str, to: str, flags: str = "") -> Column:
    """Only the first match unless ``g``; groups as ``\\1`` or ``$1``; ``i`` ignores case."""
    case = "(?i)" if "i" in flags else ""
    to = re.sub(r"\\(\d)", r"$\1", to)
    if "g" in flags:
        return F.regexp_replace(s, case + pattern, to)
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}" if m[1] != "0" else "$0", to)
    return F.regexp_replace(s, f"{case}(?s)\\A(.*?)(?-s){pattern}", "$1" + shifted)


def regexp_substr(s: Column, pattern: str, group: int = 0) -> Column:
    """Null without a match."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def regexp_matches(s: Column, pattern: str) -> Column:
    return F.to_json(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))


def regexp_split(s: Column, pattern: str) -> Column:
    return F.to_json(F.split(s, pattern, -1))


def array_from_text(s: Column) -> Column:
    """Elements of ``[..]`` JSON or ``{a,b}`` text."""
    braces = F.split(F.regexp_extract(s, r"^\{(.*)\}$", 1), ",", -1)
    return F.when(s.startswith("{"), F.when(s == "{}", F.array().cast("array<string>")).otherwise(braces)).otherwise(F.from_json(s, "array<string>"))


def typeof(c: Column) -> Column:
    kind = F.typeof(c)
    name = F.when(kind.isin("tinyint", "smallint", "int", "bigint"), "integer").when(kind.isin("float", "double") | kind.startswith("decimal"), "real").when(kind == "boolean", "boolean").otherwise("text")
    return F.when(c.isNull(), "null").otherwise(name)


def truthy(text: Column) -> Column:
    """Text is true unless it is empty."""
    return text != ""
