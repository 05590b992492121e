"""Quality rules by suffix-array repetition (operator 2).

The suffix array of a batch of documents' words is built by prefix doubling, of which every round sorts only suffixes
that still tie; each document's words are numbers of their own, so no suffix ties with another document's.  The longest
common prefix of neighbours follows from the rounds' ranks by binary lifting.  Runs of the array whose common prefix is
at least so long are its LCP intervals, formed with a stack: an interval is a repeated substring that can't be extended to
the right, and one whose suffixes don't all follow the same word can't be extended to the left either.  The spans of
these maximal repeats are united; the covered fraction and the longest repeat are limited.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

WINDOW, MIN_WORDS, BASE_PERCENT = 5, 10, 20
#: A document fails if maximal repeats of at least SPAN words cover over COVERED percent of its words, or one has over LONGEST words.
#: Chosen on labelled rows with crc32(doc_id as text) mod 5 not 0; README has the figures on the others.
SPAN, COVERED, LONGEST = 3, 8, 12
BATCH_WORDS = 400_000


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the next) of the suffixes whose first symbol occurs twice.

    ``symbols``: non-negative integers; documents are told apart by symbols of their own and end with a unique one.
    Memory: 4 bytes a symbol for each doubling, of which there are log2(longest repeat).
    """
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], np.diff(symbols[order]) != 0])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [], 1
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    live = order[np.repeat(sizes, sizes) > 1]
    first = live  # only these have a repeat at all
    kind = np.int32 if n < 2**31 else np.int64
    while len(live):
        levels.append(rank.astype(kind))
        key = rank[live] * n + rank[np.minimum(live + width, n - 1)]
        s = np.argsort(key, kind="stable")
        live, key = live[s], key[s]
        old = rank[live]
        at = np.arange(len(live))
        starts = np.concatenate([[True], np.diff(key) != 0])
        groups = np.concatenate([[True], np.diff(old) != 0])
        rank[live] = old + np.maximum.accumulate(np.where(starts, at, 0)) - np.maximum.accumulate(np.where(groups, at, 0))
        sizes = np.diff(np.append(np.flatnonzero(starts), len(live)))
        live = live[np.repeat(sizes, sizes) > 1]
        width *= 2
    if not levels:
        return none, none
    suffixes = first[np.argsort(rank[first], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        same = levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]
        lcp += np.where(same & (i < n) & (j < n), 1 << k, 0)
    return suffixes, lcp


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first, last) of every LCP interval of at least ``least`` symbols, inner ones before those around them.

    ``first`` and ``last`` are places in the suffix array, whose suffixes between them share ``length`` symbols.
    """
    length, lo, hi = [], [], []
    high = np.flatnonzero(lcp >= least)
    if len(high):
        ends = np.append(np.flatnonzero(np.diff(high) > 1), len(high) - 1)
        begins = np.append(0, ends[:-1] + 1)
        for a, b in zip(high[begins].tolist(), high[ends].tolist(), strict=True):
            stack: list[tuple[int, int]] = []  # (length, first)
            for k, n in enumerate([*lcp[a : b + 1].tolist(), 0], a):
                left = k
                while stack and stack[-1][0] > n:
                    m, left = stack.pop()
                    length.append(m)
                    lo.append(left)
                    hi.append(k)
                if n and (not stack or stack[-1][0] < n):
                    stack.append((n, left))
    return np.array(length, np.int64), np.array(lo, np.int64), np.array(hi, np.int64)


def maximal_repeats(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest maximal repeat of at least ``least`` symbols that starts there, else 0.

    And for each position the length of its longest repeat of any length, maximal or not.
    """
    out, any_length = np.zeros((2, len(symbols)), np.int64)
    suffixes, lcp = suffix_array(symbols)
    np.maximum.at(any_length, suffixes[:-1], lcp)
    np.maximum.at(any_length, suffixes[1:], lcp)
    length, lo, hi = intervals(lcp, least)
    if not len(length):
        return out, any_length
    before = symbols[suffixes - 1]
    before[suffixes == 0] = -1
    changes = np.concatenate([[0], np.cumsum(np.diff(before) != 0)])
    maximal = changes[hi] > changes[lo]  # else the same symbol precedes all: a longer repeat begins there
    length, lo, hi = length[maximal], lo[maximal], hi[maximal]
    free = list(range(len(suffixes) + 1))  # the next place without a length, by path halving
    for n, a, b in zip(length.tolist(), lo.tolist(), hi.tolist(), strict=True):
        k = a
        while True:
            while free[k] != k:
                free[k] = free[free[k]]
                k = free[k]
            if k > b:
                break
            out[suffixes[k]] = n
            free[k] = k + 1
    return out, any_length


def _covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """0 or 1 for each position: in some repeat of at least ``least`` words."""
    at = np.flatnonzero(repeat >= least)
    step = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + repeat[at], -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[str | None], window: int = WINDOW, span: int = SPAN) -> list[tuple[int, int, int, int, int, int, int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words covered by spans, longest repeat) of each text."""
    head, counts, ids, number = [], [], [], 0
    for text in texts:
        text = text or ""
        raw = text.encode()
        words = raw.split()
        full = [x for x in raw.split(b"\n") if x.strip()]
        head.append((len(words), len(text) - len(raw) + sum(map(len, words)), len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(full) - len(set(full))))
        seen: dict[bytes, int] = {}
        ids += [seen.setdefault(w, number + len(seen)) for w in words]
        number += len(seen)
        ids.append(number)
        number += 1
        counts.append(len(words) + 1)
    if not texts:
        return []
    repeat, any_length = maximal_repeats(np.array(ids, np.int64), min(window, span))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sums = [np.add.reduceat(_covered(repeat, k).astype(np.int64), starts).tolist() for k in (window, span)]
    return [(*h, a, b, c) for h, a, b, c in zip(head, *sums, np.maximum.reduceat(any_length, starts).tolist(), strict=True)]


def quality_rules(docs: DataFrame, span: int = SPAN, covered: int = COVERED, longest: int = LONGEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_span_words, longest_repeat, base_failed, kept``.

    One row per row of ``docs``, whatever repeats; null and empty texts have no words and fail the base rules.  A suffix
    array is as large as its document, so memory follows the longest one: about 90 bytes a word, and 4 more for each
    doubling of the longest repeat.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_span_words", "longest_repeat"]

    def run(batches):
        import pyarrow as pa

        def batch(keys, texts):
            cols = list(zip(*measure(texts, WINDOW, span), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=names)

        for b in batches:
            keys, texts, held = [], [], 0
            for k, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                keys.append(k)
                texts.append(t)
                held += len(t or "") // 5 + 1
                if held > BATCH_WORDS:
                    yield batch(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield batch(keys, texts)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    good = (100 * F.col("n_span_words") <= covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents")).drop("longest_repeat")


def _grams(width: int) -> str:
    """Positions in some window of ``width`` words found twice."""
    return f"""SELECT DISTINCT doc_id, unnest(range(pos, pos + {width})) AS pos FROM (
      SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
        SELECT doc_id, pos, array_to_string(words[pos : pos + {width - 1}], ' ') AS g FROM (
          SELECT doc_id, words, unnest(range(1, greatest(len(words) - {width - 2}, 1))) AS pos FROM w))) WHERE n > 1"""


OP2_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
a AS (SELECT doc_id, count(*) AS n FROM ({_grams(WINDOW)}) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n FROM ({_grams(SPAN)}) GROUP BY doc_id),
z AS (SELECT DISTINCT doc_id FROM ({_grams(LONGEST + 1)})),
f AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(f.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words,
        coalesce(b.n, 0) AS n_span_words, z.doc_id IS NOT NULL AS too_long
      FROM w LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN f USING (doc_id)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_span_words, base_failed,
       NOT base_failed AND 100 * n_span_words <= {COVERED} * n_words AND NOT too_long AS kept
FROM r
"""
