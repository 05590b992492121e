"""Language ID by string kernels (operator 7).

The kernel counts the n-grams of 1 to 4 bytes that two whole texts share (presence; letters only, lower case), normalised
by their numbers.  An n-gram is its bytes, not a hash, so none collide.  Landmarks of every language span a Nyström
approximation, in which ridge regression learns one language against the rest.  A text's kernel values with the landmarks
are linear in its presence of the landmarks' n-grams, so the regression folds into one matrix, and a block of documents is
scored by one product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sampling, tokens

#: Documents of a language to learn from, of all together, landmarks likewise (each language has one at least).
EACH, TOTAL, LANDMARKS, MOST, SPECTRUM, RIDGE = 300, 6000, 60, 1500, 4, 1e-3
UND = "und"
#: A text whose best language scores less is rejected by filters.
SURE = 0.4

_LETTER = np.full(256, 32, np.uint32)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)
_PART = 1 << 20


def grams(text: str | None) -> np.ndarray:
    """The distinct n-grams of the whole text, sorted; one of up to four bytes, none of them zero, is one integer."""
    b = _LETTER[np.frombuffer(b" " + (text or "").lower().encode() + b" ", np.uint8)]
    parts = []
    for at in range(0, max(1, len(b) - SPECTRUM + 1), _PART):
        g = piece = b[at : at + _PART + SPECTRUM - 1]
        for n in range(1, min(SPECTRUM, len(piece))):
            g = (g[:-1] << np.uint32(8)) | piece[n:]
        parts.append(_distinct(g.copy()))
    longest = parts[0] if len(parts) == 1 else _distinct(np.concatenate(parts))
    out = [longest]
    for n in range(min(SPECTRUM, len(b)) - 1, 0, -1):  # the shorter ones begin a longer one, but for the text's last
        last = sum(int(x) << 8 * (n - 1 - k) for k, x in enumerate(b[len(b) - n :]))
        out.append(_distinct(np.append(out[-1] >> np.uint32(8), np.uint32(last))))
    return np.concatenate(out[::-1])


def _distinct(g: np.ndarray) -> np.ndarray:
    g.sort()
    return g[np.concatenate([[True], g[1:] != g[:-1]])]


def has_letter(text: str | None) -> bool:
    """Whether some character is of Unicode's category L."""
    import regex

    return bool(text) and regex.search(r"\p{L}", text) is not None


class Kernel:
    """One-versus-rest kernel ridge regression on Nyström features; without a sample everything is ``und``."""

    def __init__(self, sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        own = np.array(langs, object)
        each = max(1, min(landmarks, MOST // len(self.langs)))
        marks = np.concatenate([np.flatnonzero(own == g)[:each] for g in self.langs])
        self.grams = np.unique(np.concatenate([sets[i] for i in marks]))
        base = self.block([sets[i] for i in marks])
        values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
        half = vectors / np.sqrt(np.maximum(values, 1e-6))
        count = {g: langs.count(g) for g in self.langs}
        left, right = np.zeros((len(marks) + 1,) * 2), np.zeros((len(marks) + 1, len(self.langs)))
        for at in range(0, len(sets), 256):  # the normal equations, a block of documents at a time
            z = np.hstack([(self.block(sets[at : at + 256]) @ base.T) @ half, np.ones((len(sets[at : at + 256]), 1))])
            y = np.where(own[at : at + 256, None] == np.array(self.langs, object), 1.0, -1.0)
            w = np.array([[len(sets) / count[g]] for g in langs[at : at + 256]])  # every language weighs the same
            left += z.T @ (w * z)
            right += z.T @ (w * y)
        coef = np.linalg.solve(left + ridge * len(sets) * np.eye(len(left)), right)
        self.matrix = (base.T @ (half @ coef[:-1])).astype(np.float32)
        self.bias = coef[-1]

    def block(self, sets: list[np.ndarray]) -> np.ndarray:
        """Normalised presence of the landmarks' n-grams; those of no landmark count in the norm alone."""
        out = np.zeros((len(sets), len(self.grams)), np.float32)
        for row, s in zip(out, sets, strict=True):
            at = np.minimum(np.searchsorted(self.grams, s), len(self.grams) - 1)
            row[at[self.grams[at] == s]] = 1 / np.sqrt(max(1, len(s)))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return [UND] * len(texts), np.zeros(len(texts))
        s = self.block([grams(t) for t in texts]) @ self.matrix + self.bias
        p = np.exp(4 * (s - s.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = s.argmax(1)
        letters = [has_letter(t) for t in texts]
        return [self.langs[k] if a else UND for k, a in zip(best, letters, strict=True)], np.where(letters, p[np.arange(len(p)), best], 0.0)


def fit(docs: DataFrame, each: int = EACH, total: int = TOTAL) -> Kernel:
    """Learns from at most ``each`` documents of every language whose crc32(doc_id as text) mod 4 isn't 2, about ``total`` in all.

    Every non-null value of ``lang`` can be predicted.  Rows without an id aren't learned from.
    """
    rows = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    chosen = sampling.texts(docs, sampling.per_class(rows, "lang", each, total=total))

    def run(batches):
        import pyarrow as pa

        for b in common.releasing(batches):
            for s in tokens.slices(b, 256):
                yield pa.RecordBatch.from_arrays([s["doc_id"], s["key"], pa.array([grams(t).tobytes() for t in s["text"].to_pylist()], pa.binary())], names=["doc_id", "lang", "x"])

    got = chosen.mapInArrow(run, "doc_id long, lang string, x binary").toArrow()
    langs, sets = got["lang"].to_pylist(), got["x"].to_pylist()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    return Kernel([np.frombuffer(sets[i], np.uint32) for i in order], [langs[i] for i in order])


def identify(docs: DataFrame, kernel: Kernel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (replacing columns of those names); one row per row.

    Null texts and texts without a letter (category L) are ``und`` with score 0; other columns stay, whatever their names.
    """

    @F.pandas_udf("lang string, score double")
    def run(s):
        import pandas as pd

        t, langs, scores = s.tolist(), [], []
        for k in range(0, len(t), 256):
            a, b = kernel.predict(t[k : k + 256])
            langs += a
            scores += b.tolist()
        common.release()
        return pd.DataFrame({"lang": langs, "score": scores}, columns=["lang", "score"]).astype({"lang": object, "score": float})

    both = common.fresh("_language", docs)
    # else a filter on the result is moved below it with a copy of the model's run, and each run holds workers of its own
    out = docs.withColumn(both, run.asNondeterministic()(F.col(text)))
    return out.withColumns({"lang_pred": F.col(both)["lang"], "lang_score": F.col(both)["score"]}).drop(both)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id has no remainder and isn't held out."""
    docs = common.table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
