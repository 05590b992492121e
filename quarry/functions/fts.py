"""Text search: tokens with accent folding and a light stemmer, queries, highlighting."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCENTS = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xE0, 0x180)) if c.isalpha() and c == c.lower() and unicodedata.normalize("NFD", c) != c}
#: (suffix, replacement, least length of what stays)
SUFFIXES = (("coes", "cao", 2), ("oes", "ao", 2), ("aes", "ao", 2), ("mente", "", 3), ("ing", "", 3), ("ness", "", 3), ("ies", "y", 3), ("ed", "", 3), ("es", "e", 3), ("s", "", 3))


def fold(s: str) -> str:
    return "".join(ACCENTS.get(c, c) for c in s.lower())


def stem(word: str) -> str:
    """The first suffix that fits; words of up to three letters stay."""
    if len(word) > 3:
        for suffix, to, least in SUFFIXES:
            if word.endswith(suffix) and len(word) - len(suffix) >= least:
                return word[: -len(suffix)] + to
    return word


def words(s: str) -> list[str]:
    return [stem(w) for w in re.findall(r"[^\W_]+", fold(s))]


def _stem(w: Column) -> Column:
    n, out = F.length(w), None
    for suffix, to, least in SUFFIXES:
        fits = w.endswith(suffix) & (n >= len(suffix) + least)
        cut = F.concat(F.substr(w, F.lit(1), n - len(suffix)), F.lit(to)) if to else F.substr(w, F.lit(1), n - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return F.when(n <= 3, w).otherwise(out.otherwise(w))


def _fold(text: Column) -> Column:
    return F.translate(text, "".join(ACCENTS), "".join(ACCENTS.values()))


def _split(text: Column) -> Column:
    return F.split(text, r"[^\p{L}\p{N}]+")


def unstemmed(text: Column) -> Column:
    return F.filter(_split(_fold(F.lower(text))), lambda w: w != "")


def counted(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, term, n``: how often each token occurs in the rows of a key.

    A key's different words are counted first and only they are folded (letters stay letters, so words stay whole) and stemmed.
    """
    words_ = df.select(key, F.explode(_split(F.lower(text))).alias("word")).filter("word <> ''").groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    folded = words_.select(key, _fold(F.col("word")).alias("word"), "n")
    return folded.select(key, _stem(F.col("word")).alias("term"), "n").groupBy(key, "term").agg(F.sum("n").alias("n"))


def tokens(text: Column) -> Column:
    """Array of a text's tokens, in Catalyst alone."""
    return F.transform(unstemmed(text), _stem)


def count(words_: Column, word: str, prefix: bool) -> Column:
    """How many unstemmed words have this token (or, by ``prefix``, one that starts so); only words that can are _stem."""
    start = word[:-3] if prefix or word.endswith("cao") else word[:-2] if word.endswith("ao") else word[:-1] if word.endswith("y") else word
    near = F.transform(F.filter(words_, lambda w: w.startswith(start)), _stem)
    return F.size(F.filter(near, lambda w: w.startswith(word) if prefix else w == word))


def tokens_json(text: Column) -> Column:
    return F.to_json(tokens(text))


@dataclass(frozen=True)
class Term:
    """Words in a row; ``prefix``: the only word is the start of one."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Query:
    """Groups are all needed, of a group's terms one; none of ``without`` may occur."""

    groups: tuple[tuple[Term, ...], ...]
    without: tuple[Term, ...] = ()


def parse(text: str) -> Query:
    """AND between words, ``OR``, ``-word`` or ``NOT word``, ``"a phrase"``, ``prefix*``."""
    groups: list[list[Term]] = []
    without: list[Term] = []
    either = negative = False
    for raw in re.findall(r'-?"[^"]*"|\S+', text):
        if raw in ("AND", "OR", "NOT"):
            either, negative = raw == "OR" or (either and raw == "NOT"), raw == "NOT"
            continue
        minus = negative or (raw.startswith("-") and len(raw) > 1)
        body = raw.lstrip("-").strip('"')
        if raw.endswith("*") and re.fullmatch(r"[^\W_]+", body[:-1]):
            term = Term((fold(body[:-1]),), True)
        else:
            term = Term(tuple(words(body)))
        if term.words:
            if minus:
                without.append(term)
            elif either and groups:
                groups[-1].append(term)
            else:
                groups.append([term])
        either = negative = False
    return Query(tuple(map(tuple, groups)), tuple(without))


def _has(tokens_: Column, term: Term) -> Column:
    if term.prefix:
        return F.exists(tokens_, lambda w: w.startswith(term.words[0]))
    if len(term.words) == 1:
        return F.array_contains(tokens_, term.words[0])
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" ")), F.lit(f" {' '.join(term.words)} "))


def matches(tokens_: Column, query: Query) -> Column:
    """Whether a token array matches; a query with no positive term matches nothing."""
    if not query.groups:
        return F.lit(False)

    def test(t: Column) -> Column:
        out = F.lit(True)
        for group in query.groups:
            one = F.lit(False)
            for term in group:
                one = one | _has(t, term)
            out = out & one
        for term in query.without:
            out = out & ~_has(t, term)
        return out

    return F.exists(F.array(tokens_), test)  # the lambda's variable holds the tokens, so they are computed once


@lru_cache(1)
def _spellings() -> dict[str, str]:
    """The characters that fold to a character, itself left out."""
    out: dict[str, str] = {}
    for c in map(chr, range(0x110000)):
        if c.isalnum() and (f := fold(c)) != c and len(f) == 1:
            out[f] = out.get(f, "") + c
    return out


def spelled(term: str) -> str | None:
    """A pattern of the whole words whose token is ``term``; none where a character folds by its place (final sigma)."""
    found = {term} | {term[: len(term) - len(to)] + suffix for suffix, to, _ in SUFFIXES if term.endswith(to)}
    found = sorted(w for w in found if stem(w) == term)
    if set("".join(found)) & set("\u03c3\u03c2"):
        return None
    one = lambda w: "".join(f"[{c}{_spellings().get(c, '')}]" for c in w)
    # the dot that I with a dot leaves when it is lowered ends a token
    return "|".join([*map(one, found), *[one(w[:-1]) + r"\u0130[\p{L}\p{N}]*" for w in found if w.endswith("i")]]) or "(?!)"


def highlight(text: Column, query: Query, open_: str = "[", close: str = "]") -> Column:
    """The text with the query's words between marks."""
    single = sorted({w for g in query.groups for t in g for w in t.words if not t.prefix})
    starts = sorted({t.words[0] for g in query.groups for t in g if t.prefix})
    whole = [spelled(w) for w in single]
    if not starts and None not in whole:
        if not whole:
            return text
        marks = [re.sub(r"([\\$])", r"\\\1", m) for m in (open_, close)]
        # one pass over the text; what is before a word is part of the match, for Java looks behind by half characters
        return F.regexp_replace(text, rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(whole)})(?![\p{{L}}\p{{N}}])", f"$1{marks[0]}$2{marks[1]}")
    parts = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))

    def mark(p):
        t = F.get(tokens(p), F.lit(0))
        hit = F.array_contains(F.array(*map(F.lit, single)).cast("array<string>"), t) if single else F.lit(False)
        for s in starts:
            hit = hit | t.startswith(s)
        return F.when(F.coalesce(hit, F.lit(False)), F.concat(F.lit(open_), p, F.lit(close))).otherwise(p)

    return F.array_join(F.transform(parts, mark), "")
