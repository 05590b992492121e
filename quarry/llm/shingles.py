"""Near-duplicates by exact Jaccard similarity of word shingles (the pipeline's near-duplicate stage).

Two texts are linked if the sets of their shingles of ``WIDTH`` words have a similarity of ``NUMERATOR / DENOMINATOR`` or
more; components of links are groups.  The first candidates are operator 3's: its fingerprints within two bits, found by its
pivot tables.  They hold the closest copies only, since texts at 0.8 differ in about 10 bits, where pivots tell nothing
apart.  So further candidates share one of ``BANDS`` buckets of ``ROWS`` minhashes each, which misses a pair at 0.8 with a
chance of (1 - 0.8 ** 4) ** 30, about 1e-7; every candidate of either kind is verified on its whole shingle sets.

In a bucket of up to ``CROWD`` members all pairs are candidates.  Members of larger ones, such as texts that share a passage
or a family of copies, meet by prefixes instead, which misses no pair: with each set's shingles in one order, rare ones
first, two similar sets share one of their first n - ceil(0.8 n) + 1.  Where a shingle stands in both sets bounds what they
can have in common, and pairs below the threshold are no candidates.  Of a shingle with many sets, those in which it stands
first, the middle of a family, meet all others and leave; then eight times as many, and so on, as long as the shingle has
more than one component and sets that can still match.  Pairs within a component can add nothing, so no link is left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash, tokens

WIDTH, NUMERATOR, DENOMINATOR = 5, 4, 5
BANDS, ROWS = 30, 4
CENTRES, CROWD, COUNTERS = 4, 32, 1 << 18
_random = np.random.default_rng(20240611)
_FACTORS = (_random.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_MASKS = _random.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) << np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than ``width`` are one shingle, none give none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six spaces only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - width]])
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64))


def buckets(hashes: np.ndarray) -> list[int]:
    """The bucket of each band, as signed integers; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[at : at + 512, None] ^ _MASKS) * _FACTORS).min(0))
    return [xxhash.xxh64_intdigest(least[ROWS * b : ROWS * (b + 1)].tobytes(), b) - 2**63 for b in range(BANDS)]


def _signed(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) - 2**63


def _rows(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, row, node, fp, buckets`` of every row; node stands for the shingle set, row for the text, fp is operator 3's."""

    def code(batches):
        import pyarrow as pa

        for whole in common.releasing(batches):
            for b in tokens.slices(whole):
                texts = b["text"].to_pylist()
                sets = [shingles(t, width) for t in texts]
                fps = pa.array(map(simhash.fingerprint, texts), pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array(map(_signed, sets), pa.int64()), fps, pa.array(map(buckets, sets), pa.list_(pa.int64()))], names=["doc_id", "row", "node", "fp", "buckets"])

    return docs.mapInArrow(code, "doc_id long, row long, node long, fp long, buckets array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``node, items`` of every row."""

    def code(batches):
        import pyarrow as pa

        for whole in common.releasing(batches):
            for b in tokens.slices(whole, 256):
                sets = [shingles(t, width) for t in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(_signed, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "items"])

    return docs.select("text").mapInArrow(code, "node long, items array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b, a_root, b_root`` whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    n = F.size("x") + F.size("y")
    # neither set may be under the least share of the other; only then are they compared
    near = (DENOMINATOR * F.least(F.size("x"), F.size("y")) >= NUMERATOR * F.greatest(F.size("x"), F.size("y"))) & ((DENOMINATOR + NUMERATOR) * F.size(F.array_intersect("x", "y")) >= NUMERATOR * n)
    return both.filter(near).select("a", "b", "a_root", "b_root")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (node, root)`` after links between roots; a node without a label is its own root."""
    moved = simhash.components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    held = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    moved = common.materialize(moved.join(held, "root", "left"), "moved")
    if moved.isEmpty():
        return labels
    old = common.join_counted(labels, moved.filter("n IS NOT NULL"), ["root"], ["node"], how="left", few=simhash.FEW)
    new = moved.filter("n IS NULL").select(F.col("root").alias("node"), F.col("to").alias("root"))
    return common.materialize(old.select("node", F.coalesce("to", "root").alias("root")).unionByName(new), "roots")


def _close(rows: DataFrame) -> DataFrame:
    """Written table ``node, c`` of the sets whose texts' fingerprints are equal or within operator 3's two bits.

    Of the sets of one fingerprint the least meets the others, and those of fingerprints that are linked to it.
    """
    of = common.materialize(rows.select("node", "fp").distinct(), "fingerprints")
    least = common.materialize(of.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "least")
    equal = common.join_counted(of, least.filter("n > 1"), ["fp"], ["node"]).select("node", F.col("first").alias("c"))
    a, b = (least.select(F.col("fp").alias(x), F.col("first").alias(y)) for x, y in (("a", "node"), ("b", "c")))
    linked = simhash.links(least.select("fp")).join(a, "a").join(b, "b").select("node", "c")
    return common.materialize(equal.unionByName(linked).filter("node <> c").distinct(), "close")


def _prefixes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Written table ``bucket, node, n, pos, size``: the shingles of the prefixes of ``nodes``' sets of ``n``, and their places.

    Any order that all sets share finds all pairs; rare shingles first finds few others.  How rare is counted by classes of
    shingles, ``COUNTERS`` numbers whatever the corpus.
    """
    some = common.materialize(sets.join(nodes, "node", "left_semi"), "crowded-sets")

    def count(batches):
        import pyarrow as pa

        seen = np.zeros(COUNTERS, np.int64)
        for b in common.releasing(batches):
            seen += np.bincount(b["items"].flatten().to_numpy() % COUNTERS, minlength=COUNTERS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["class", "n"])

    counts = some.select("items").mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[counts["class"].to_numpy()] = counts["n"].to_numpy()

    def cut(batches):
        import pyarrow as pa

        for b in common.releasing(batches):
            for node, items in zip(b["node"].to_pylist(), b["items"], strict=True):
                x = items.values.to_numpy()
                n = len(x)
                first = x[np.lexsort((x, often[x % COUNTERS]))[: n + 1 + -NUMERATOR * n // DENOMINATOR]]
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array([node] * len(first), pa.int64()), pa.array([n] * len(first), pa.int32()), pa.array(range(len(first)), pa.int32())], names=["bucket", "node", "n", "pos"])

    at = common.materialize(some.select("node", "items").mapInArrow(cut, "bucket long, node long, n int, pos int"), "prefix")
    shared = common.materialize(at.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
    return common.materialize(common.join_counted(at, shared, ["bucket"], ["node"], n="size"), "prefixes")


def _through_prefixes(members: DataFrame, labels: DataFrame, sets: DataFrame, centres: int) -> DataFrame:
    """``labels`` with the links between sets that share a shingle of their prefixes."""
    # the most that a set can hold in common with another, from a shingle on, is enough for partners of up to so many shingles
    members = members.withColumn("reach", F.floor((NUMERATOR + DENOMINATOR) * (F.col("n") - F.col("pos")) / NUMERATOR) - F.col("n"))
    while True:
        now = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parted = now.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("open"), F.count(F.lit(1)).alias("all"), F.min("n").alias("least")).filter("open").drop("open")
        now = common.join_counted(now, common.materialize(parted, "open"), ["bucket"], ["node"], n="all", few=simhash.FEW).filter("reach >= least").drop("least")
        now = common.materialize(now, "members")
        total, largest = now.agg(F.count(F.lit(1)), F.max("all")).first()
        if not total:
            return labels
        first = now.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy("pos", "node"))).filter(F.col("_n") <= centres)
        first = first.select("bucket", F.col("node").alias("c"), F.col("root").alias("c_root"), F.col("n").alias("c_size"), F.col("reach").alias("c_reach"), F.col("pos").alias("c_pos"), "all")
        can = (F.col("root") != F.col("c_root")) & (F.col("reach") >= F.col("c_size")) & (F.col("c_reach") >= F.col("n")) & (DENOMINATOR * F.least("n", "c_size") >= NUMERATOR * F.greatest("n", "c_size"))
        pairs = common.join_counted(now.drop("all"), first.drop("c_pos"), ["bucket"], ["node"], total, n="all", few=simhash.FEW).filter(can)
        labels = _linked(pairs, labels, sets)
        if largest <= centres:
            return labels
        # centres have met all others of their shingle, so they are no members of it any more: each row is a centre once
        last = first.groupBy("bucket", "all").agg(F.max(F.struct("c_pos", "c")).alias("last")).filter(F.col("all") > centres)
        left = common.join_counted(now.drop("all"), common.materialize(last, "last"), ["bucket"], ["node"], total, n="all", few=simhash.FEW)
        members = left.filter(F.struct("pos", "node") > F.col("last")).select("bucket", "node", "n", "pos", "reach")
        centres *= 8


def _linked(pairs: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """``labels`` with the links among pairs ``node, root, c, c_root``."""
    lower = F.col("node") < F.col("c")
    pairs = pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"), F.when(lower, F.col("root")).otherwise(F.col("c_root")).alias("a_root"), F.when(lower, F.col("c_root")).otherwise(F.col("root")).alias("b_root"))
    found = common.materialize(_similar(pairs.distinct(), sets), "similar")
    return _relabel(labels, found.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, centres: int = CENTRES, crowd: int = CROWD) -> DataFrame:
    """``doc_id, row, root`` of every row; rows of a near-duplicate group have one root.

    Rows without words are copies of each other.  An empty table gives no rows; other columns are not read.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    rows = common.materialize(_rows(plain, width), "shingled")
    nodes = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "buckets")).alias("one"))
    nodes = common.materialize(nodes.select("node", F.col("one.doc_id").alias("_id"), F.col("one.row").alias("_row"), "one.buckets"), "sets-of")
    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = common.materialize(shared, "shared")
    members = common.materialize(common.join_counted(members, shared, ["bucket"], ["node"], n="size"), "buckets")
    close = _close(rows)
    some = members.select("node").union(close.select("node")).union(close.select("c")).distinct().join(nodes.drop("buckets"), "node")
    some = common.materialize(some.drop("node"), "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("row").eqNullSafe(F.col("_row"))
    sets = common.materialize(_sets(plain.join(some, same, "left_semi"), width).dropDuplicates(["node"]), "sets")

    labels = rows.sparkSession.createDataFrame([], "node long, root long")
    labels = _linked(close.select("node", F.col("node").alias("root"), "c", F.col("c").alias("c_root")), labels, sets)
    few = members.filter(F.col("size") <= crowd).join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    other = few.select("bucket", F.col("node").alias("c"), F.col("root").alias("c_root"))
    labels = _linked(few.join(other, "bucket").filter("node < c AND root <> c_root").select("node", "root", "c", "c_root"), labels, sets)
    crowded = common.materialize(members.filter(F.col("size") > crowd).select("node").distinct(), "crowded")
    if not crowded.isEmpty():
        labels = _through_prefixes(_prefixes(sets, crowded), labels, sets, centres)
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    labels = common.materialize(labels.join(counts, "node"), "named")
    return common.join_counted(rows, labels, ["node"], ["doc_id", "row"], how="left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))
