"""Quality classifier by nearest-neighbour voting in a latent-semantic space (operator 4).

A text's terms are trigrams of character classes (case, digits, single marks, line ends, ...) and a few terms for
repeated words and lines, all counted over the whole text.  A bounded balanced sample of labelled documents gives the
inverse document frequencies and a truncated singular value decomposition; its vectors go to every task, whose exact
cosine products with blocks of documents find each document's nearest labelled neighbours.  They vote with their
similarity as weight.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sampling, tokens

EACH, DIMS, NEIGHBOURS, POWER, THRESHOLD = 1500, 48, 31, 6, 0.3
BITS = 4
EXTRA = 4
TERMS = (1 << 3 * BITS) + EXTRA

_CLASS = np.full(256, 11, np.int32)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 32]] = 3
_CLASS[[10, 13]] = 4
_CLASS[ord(".")] = 5
_CLASS[ord(",")] = 6
_CLASS[ord("!")] = 7
_CLASS[[ord(c) for c in "#$%&*"]] = 8
_CLASS[ord("|")] = 9
_CLASS[[ord(c) for c in "@/:-_="]] = 10
_CLASS[128:192] = 12
_CLASS[192:224] = 13
_CLASS[224:] = 14


def terms(text: str | None) -> np.ndarray:
    """Term weights of a whole text: square roots of frequencies; empty and null texts have none."""
    raw = (text or "").encode()
    out = np.zeros(TERMS, np.float32)
    if not raw.strip():
        return out
    c = _CLASS[np.frombuffer(b"\n" + raw + b"\n", np.uint8)]
    out[: TERMS - EXTRA] = np.bincount((c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:], minlength=TERMS - EXTRA)
    out /= len(c) - 2
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[-4] = sum(map(eq, words, words[1:])) / len(words)
    out[-3] = 1 - len(set(words)) / len(words)
    out[-2] = 1 - len(set(lines)) / max(1, len(lines))
    out[-1] = 0.05
    return np.sqrt(out)


def right_vectors(x: np.ndarray, scale: np.ndarray, dims: int, rounds: int = 12) -> np.ndarray:
    """The leading right singular vectors of ``x * scale``, at most ``dims``, by subspace iteration from a fixed start."""
    rank = min(*x.shape, dims + 16)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((x.shape[1], rank)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(scale[:, None] * (x.T @ (x @ (scale[:, None] * q))))[0]
    turn = np.linalg.svd(x @ (scale[:, None] * q), full_matrices=False)[2]
    return np.ascontiguousarray((q @ turn.T)[:, :dims])


class Voter:
    """``score(texts)`` of a fitted sample ``x``, which is scaled in place; without one every score is 0.5, with one class its label."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int = DIMS, k: int = NEIGHBOURS):
        self.k, self.y = min(k, len(y)), y.astype(np.float32)
        self.prior = float(y.mean()) if len(y) else 0.5
        if not len(y):
            return
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        self.idf[-EXTRA:] = 3
        norm = np.sqrt(sum(((x[:, k : k + 512] * self.idf[k : k + 512]) ** 2).sum(1) for k in range(0, TERMS, 512)))
        x *= (1 / np.maximum(norm, 1e-12))[:, None]  # in place: the sample is held once
        self.basis = right_vectors(x, self.idf, dims) * self.idf[:, None]
        self.vectors = self.embed(x)

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.y) or not texts:
            return np.full(len(texts), self.prior)
        near = self.embed(np.stack([terms(t) for t in texts])) @ self.vectors.T
        top = np.argpartition(near, near.shape[1] - self.k, axis=1)[:, -self.k :]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** POWER
        total = weight.sum(1)
        return np.where(total > 0, np.clip((weight * self.y[top]).sum(1) / np.maximum(total, 1e-30), 0, 1), self.prior).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH, label: str = "quality") -> Voter:
    """Learns from at most ``each`` documents of either label whose crc32(doc_id as text) mod 5 isn't 0.

    Rows without an id, of labels other than 0 and 1, and documents that have both labels aren't learned from.
    """
    rows = labels.filter((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col(label).isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("other")).filter(F.col(label) == F.col("other"))
    chosen = sampling.texts(docs, sampling.per_class(rows, label, each))

    def run(batches):
        import pyarrow as pa

        for b in common.releasing(batches):
            for s in tokens.slices(b, 256):
                rows = [terms(t) for t in s["text"].to_pylist()]
                used = [np.flatnonzero(r).astype(np.uint16) for r in rows]  # few of the terms are in a text
                yield pa.RecordBatch.from_arrays([s["doc_id"], s["key"].cast(pa.int32()), pa.array([u.tobytes() for u in used], pa.binary()), pa.array([r[u].tobytes() for r, u in zip(rows, used, strict=True)], pa.binary())], names=["doc_id", "y", "at", "x"])

    got = chosen.mapInArrow(run, "doc_id long, y int, at binary, x binary").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    x, at, value = np.zeros((len(order), TERMS), np.float32), got["at"], got["x"]
    for row, i in zip(x, order.tolist(), strict=True):
        row[np.frombuffer(at[i].as_py(), np.uint16)] = np.frombuffer(value[i].as_py(), np.float32)
    return Voter(x, got["y"].to_numpy()[order])


def classify(docs: DataFrame, voter: Voter, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (replacing columns of those names); one row per row, nulls and repeats included.

    Texts without words have no vector and take the sample's share of label 1.
    """

    @F.pandas_udf("double")
    def score(s):
        import pandas as pd

        t = s.tolist()
        scores = [voter.score(t[k : k + 256]) for k in range(0, len(t), 256)]
        common.release()
        return pd.Series(np.concatenate(scores or [np.zeros(0)]))

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id has no remainder and isn't held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
