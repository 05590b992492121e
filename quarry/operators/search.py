"""Ranked text search (BM25), nearest neighbours and boxes."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fts, spatial, vectors
from . import recursive

K1, B = 1.2, 0.75


def match(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows that match a query over the columns' tokens, positions running on from one column to the next."""
    return df.filter(fts.matches(fts.tokens(F.concat_ws(" ", *columns)), fts.parse(query)))


def spread(df: DataFrame) -> DataFrame:
    """Few large files leave cores idle in work that is all computation: their rows are dealt out; otherwise nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bm25(df: DataFrame, key: str, columns: list[str], query: str, local: bool = False) -> DataFrame:
    """``key, score`` of the rows that match, with the corpus' statistics (``local``: each row as a corpus of its own).

    One pass counts documents, lengths and each query term's documents in a partial aggregate of one row; the second
    scores.  The query has a few terms, so no postings are shuffled.
    """
    parsed = fts.parse(query)
    terms = sorted({t for g in parsed.groups for t in g}, key=str)
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).filter(F.lit(False))
    parts = sorted({(w, t.prefix) for t in terms for w in t.words})
    simple = all(len(t.words) == 1 for t in {*terms, *parsed.without})

    def hit(words: Column) -> Column:
        """From counts where no term is a phrase."""
        if not simple:
            return fts.matches(F.transform(words, fts._stem), parsed)
        some = lambda t: fts.count(words, t.words[0], t.prefix) > 0
        out = F.lit(True)
        for g in parsed.groups:
            one = F.lit(False)
            for t in g:
                one = one | some(t)
            out = out & one
        for t in parsed.without:
            out = out & ~some(t)
        return out

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).alias("_n"), *[fts.count(words, w, p).alias(f"_f{k}") for k, (w, p) in enumerate(parts)], hit(words).alias("_hit"))

    # through a lambda's variable, so that a row's words are computed once
    counted = spread(df.select(key, *columns)).select(key, F.get(F.transform(F.array(fts.unstemmed(F.concat_ws(" ", *columns))), counts), F.lit(0)).alias("_c")).select(key, "_c.*")
    stats = counted.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *[F.count(F.when(F.col(f"_f{k}") > 0, 1)).alias(f"_d{k}") for k in range(len(parts))])
    both = counted.filter("_hit").crossJoin(F.broadcast(stats))  # one row
    docs, mean = (F.lit(1), F.col("_n")) if local else (F.col("_docs"), F.col("_mean"))
    score = F.lit(0.0)
    for k in range(len(parts)):
        f, d = F.col(f"_f{k}"), F.lit(0) if local else F.col(f"_d{k}")
        idf = F.ln((docs - d + 0.5) / (d + 0.5) + 1)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / mean))
    return both.select(key, F.greatest(score, F.lit(1e-9)).alias("score"))


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``term, key, positions`` of every token."""
    rows = df.select(key, F.posexplode(fts.tokens(F.concat_ws(" ", *columns))).alias("pos", "term"))
    return rows.groupBy("term", key).agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def frequencies(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, term, n``: the postings' lengths, without their positions.

    Texts are dealt by key, so that a key's words meet where they are split and no word is shuffled.
    """
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return fts.counted(df.select(key, *columns).repartition(tasks, key), key, F.concat_ws(" ", *columns))


def knn(df: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest rows, exactly; a condition is applied first.  Ties go by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = df if where is None else df.filter(where)
    return rows.select(key, vectors.distance(F.col(vector), q, metric).alias("distance")).filter("distance IS NOT NULL").orderBy("distance", key).limit(k)


def knn_batch(df: DataFrame, key: str, vector: str, queries: DataFrame, qkey: str, k: int, metric: str = "cosine", block: int = 512) -> DataFrame:
    """``qkey, key, distance, rank`` of the k nearest rows of each query, exactly.

    Each task keeps the k nearest of its rows for every query (blocked matrix products); only those meet.  The driver
    holds ``block * 64`` queries at a time; of more, each such block is a pass over the rows and is checkpointed.
    """
    rows = queries.select(F.col(qkey).alias("q"), F.col(vector).alias("v")).filter("v IS NOT NULL").toLocalIterator()
    w = Window.partitionBy(qkey).orderBy("distance", key)
    out, part = None, list(islice(rows, block * 64))
    while True:
        following = list(islice(rows, block * 64))
        top = _knn_pass(df, key, vector, part, queries.schema[qkey].dataType.simpleString(), qkey, k, metric, block)
        top = top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if out is None and not following:
            return top
        top = recursive.checkpoint(top)
        out = top if out is None else out.unionByName(top)
        if not following:
            return out
        part = following


def _knn_pass(df: DataFrame, key: str, vector: str, queries: list, qkind: str, qkey: str, k: int, metric: str, block: int) -> DataFrame:
    """Each task's k nearest rows of every query.

    Products only choose candidates, with some slack; their distances are computed from the vectors themselves, so that
    equal vectors tie.
    """
    import numpy as np

    ids, q = [r.q for r in queries], np.array([r.v for r in queries], np.float64)
    kind = df.schema[key].dataType.simpleString()

    def rough(a, x):
        if metric == "dot":
            return -(a @ x.T)
        if metric == "l2":
            return (a * a).sum(1)[:, None] + (x * x).sum(1) - 2 * a @ x.T
        n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        return np.where(n == 0, 1.0, 1 - (a @ x.T) / np.where(n == 0, 1, n))

    def exact(a, x):
        if metric == "dot":
            return -(a * x).sum(1)
        if metric == "l2":
            return np.sqrt(((a - x) ** 2).sum(1))
        n = np.linalg.norm(a, axis=1) * np.linalg.norm(x, axis=1)
        return np.where(n == 0, 1.0, 1 - (a * x).sum(1) / np.where(n == 0, 1, n))

    def run(batches):
        import pandas as pd

        step = 1024
        best = [None] * -(-len(q) // step)  # for each step of queries: query, distance, key of its nearest so far
        bound = np.full(len(q), np.inf)
        for pdf in batches:
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at : at + block].dropna()
                if not len(part):
                    continue
                keys, x = part[key].to_numpy(), np.stack(part[vector].to_list()).astype(np.float64)
                for j in range(len(best)):
                    a = q[j * step : (j + 1) * step]
                    limit = bound[j * step : (j + 1) * step]
                    d = rough(a, x)
                    if len(keys) >= k:
                        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                    slack = 1e-8 * (1 + (a * a).sum(1).max() + (x * x).sum(1).max())
                    i, m = np.nonzero(d <= limit[:, None] + slack)
                    new = [i, np.concatenate([np.round(exact(a[i[s : s + 65536]], x[m[s : s + 65536]]), 9) for s in range(0, len(i), 65536)] or [np.zeros(0)]), keys[m]]
                    if best[j] is not None:
                        new = [np.concatenate(c) for c in zip(best[j], new, strict=True)]
                    s = np.lexsort((new[2], new[1], new[0]))
                    new = [c[s] for c in new]
                    place = np.arange(len(s)) - np.searchsorted(new[0], new[0])
                    best[j] = [c[place < k] for c in new]
                    last = (place == k - 1).nonzero()[0]
                    far = new[1][last] ** 2 if metric == "l2" else new[1][last]
                    bound[j * step + new[0][last]] = far
        for j, b in enumerate(best):
            if b is not None:
                yield pd.DataFrame({qkey: [ids[j * step + i] for i in b[0]], key: b[2], "distance": b[1]})

    return df.select(key, vector).mapInPandas(run, f"`{qkey}` {qkind}, `{key}` {kind}, distance double")


def box(df: DataFrame, axes: list[str], low: list[float], high: list[float], code: str | None = None) -> DataFrame:
    """Rows in a closed box; with a Morton column its ranges come before, for files sorted by it."""
    cond = F.lit(True)
    for c, a, b in zip(axes, low, high, strict=True):
        cond = cond & F.col(c).between(a, b)
    if code:
        cond = spatial.in_ranges(F.col(code), spatial.ranges(low, high)) & cond
    return df.filter(cond)
