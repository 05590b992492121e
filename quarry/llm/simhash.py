"""SimHash near-dedup with pivot distance tables (operator 3).

Fingerprints within ``MAX_BITS`` differing bits are linked; components of links are near-duplicate groups.

A written table holds every distinct fingerprint's Hamming distances to reference fingerprints, the pivots.  Two
fingerprints that differ in r bits have distances to any pivot that differ by at most r.  The pivots are one random
fingerprint, its copies with one nibble inverted, and further random ones.  The distances to the first and to its copy with
nibble j inverted give how many bits of that nibble differ from the first, a coordinate from 0 to 4; and since a nibble is
a part of its own, the coordinates of fingerprints within two bits differ by two in sum.  So such a pair shares a cell, a
vector of all sixteen coordinates that is at most one step from either's.  Each fingerprint is put into its own cell and
the at most 32 around it; in each cell pairs whose distances to a further pivot differ by more than ``MAX_BITS`` are
discarded, and the others are verified.

Sixteen coordinates split random fingerprints into some 10^9 cells' worth, but many near copies can share a cell.  A
cell of over ``CELL`` fingerprints is split by the remaining pivots, the first one's copies with a single bit inverted:
these distances tell every bit, so a cell of that level holds at most 65 fingerprints, all within two bits of each other,
and a link from each to the least is enough.  Nothing is dropped or capped at either level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MAX_BITS = 2
SHINGLE = 3
CELL = 64
#: So few links, 16 bytes each, are joined without looking for hot nodes: one task may hold them all.
FEW = 1 << 20
NIBBLES, FAR = 16, 8
_random = np.random.default_rng(20240607)
_signed = lambda x: x - (1 << 64) if x >> 63 else x
_first, *_far = (int(x) for x in _random.integers(0, 2**63, 1 + FAR))
#: Reference fingerprints as signed integers: the first, its copies with a nibble inverted, and random ones far from it.
PIVOTS = [_signed(x) for x in (_first, *(_first ^ (15 << 4 * j) for j in range(NIBBLES)), *_far)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed integer; no words: zero."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six spaces only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        h = np.array([digest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[: len(words) - width]])
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id, row, fp`` of every row; row is a hash of the text, null and empty texts have fingerprint zero."""

    def code(batches):
        import pyarrow as pa

        for whole in batches:
            for b in tokens.slices(whole):
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array([fingerprint(t, width) for t in b["text"].to_pylist()], pa.int64())], names=["doc_id", "row", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text")).mapInArrow(code, "doc_id long, row long, fp long")


def distances(nodes: DataFrame) -> DataFrame:
    """Written table ``fp, to``: the Hamming distances of every distinct fingerprint to all ``PIVOTS``."""
    to = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in PIVOTS])
    return common.materialize(nodes.select("fp", to.alias("to")), "pivots")


def cells(table: DataFrame) -> DataFrame:
    """``cell, fp, far``: the cells of every fingerprint; far holds the distances to the further pivots, a byte each."""
    part = [((F.col("to")[0] - F.col("to")[j + 1] + 4) / 2).cast("long") for j in range(NIBBLES)]
    step = [F.lit(1 << 3 * j) for j in range(NIBBLES)]
    own = sum((F.shiftleft(x, 3 * j) for j, x in enumerate(part)), F.lit(0).cast("long"))
    far = sum((F.shiftleft(F.col("to")[1 + NIBBLES + k].cast("long"), 8 * k) for k in range(FAR)), F.lit(0).cast("long"))
    at = table.select("fp", own.alias("own"), far.alias("far"), *[x.cast("byte").alias(f"c{j}") for j, x in enumerate(part)])
    around = [F.lit(0).cast("long"), *(F.when(F.col(f"c{j}") < 4, s) for j, s in enumerate(step)), *(F.when(F.col(f"c{j}") > 0, -s) for j, s in enumerate(step))]
    return at.select("fp", "far", "own", F.explode(F.array_compact(F.array(*around))).alias("by")).select((F.col("own") + F.col("by")).alias("cell"), "fp", "far")


def links(nodes: DataFrame, crowd: int = CELL) -> DataFrame:
    """Links ``a, b`` (a < b) between distinct fingerprints, of column ``fp``, that connect all that differ in at most two bits."""
    at = cells(distances(nodes))
    sizes = common.materialize(at.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "cells")
    met = common.materialize(common.join_counted(at, sizes, ["cell"], ["fp"]), "met")
    few = met.filter(F.col("n") <= crowd)
    near = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    for k in range(FAR):
        here, there = (F.shiftright(f"{s}.far", 8 * k).bitwiseAND(F.lit(255)) for s in "ab")
        near &= F.abs(here - there) <= MAX_BITS
    near &= F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS
    pairs = few.alias("a").join(few.alias("b"), near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowded = met.filter(F.col("n") > crowd).select("fp").distinct()
    # the cell of a vector of distances to single-bit pivots is named by the fingerprint that has it
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    fine = crowded.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("cell"))
    star = fine.groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("all")).filter(F.size("all") > 1)
    star = star.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 65)).alias("b"))
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges (a, b)``; root is the least node reachable.

    Alternating large-star and small-star contraction; every round is written to the shared folder, and rounds go on
    until none changes an edge.  Per node only a minimum is formed, so a node of any degree is aggregated in parts.
    """
    edges = common.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    state = edges.agg(*sums).first()
    while state.n:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = common.join_counted(both, least, ["a"], ["b"], 2 * state.n, few=FEW).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = common.join_counted(large, low, ["a"], ["b"], state.n, few=FEW).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges, before = common.materialize(small, "edges"), state
        if (state := edges.agg(*sums).first()) == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, crowd: int = CELL) -> DataFrame:
    """``doc_id, row, fp, component_id, root`` of every row; root is the component's least fingerprint.

    component_id is the smallest non-null doc_id of the component (null if it has none).  Equal fingerprints are one node,
    so copies of any number cost a partial aggregate; rows of repeated ids are kept, each with its own fingerprint.
    An empty table gives no rows; other columns are not read.
    """
    rows = common.materialize(fingerprints(docs, doc_id, text, width), "fingerprints")
    nodes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), crowd))
    group = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    group = common.materialize(group, "groups")
    named = group.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    named = common.join_counted(group, common.materialize(named, "named"), ["root"], ["fp"], n="nodes")
    label = common.materialize(named.select("fp", "component_id", "root", "n"), "labels")
    return common.join_counted(rows, label, ["fp"], ["doc_id", "row"]).select("doc_id", "row", "fp", "component_id", "root")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: of the smallest id (nulls last), then the least hash of the text.

    Rows that repeat both stay once.
    """
    return firsts(docs, near_dedup(docs, doc_id, text, **how), doc_id, text)


def firsts(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``representatives`` of groups that are given as ``doc_id, row, root``."""
    copies = groups.groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    best = copies.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("best")).select("best.doc_id", "best.row", "best.n")
    key, row, many = (common.fresh(k, docs) for k in ("_id", "_row", "_n"))
    best = common.materialize(best, "best").toDF(key, row, many)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(key)) & F.xxhash64(F.col(text)).eqNullSafe(F.col(row))
    twice = common.materialize(best.filter(F.col(many) > 1), "twice")
    once = docs.join(best.filter(F.col(many) == 1), same, "left_semi")
    return once.unionByName(docs.join(twice, same, "left_semi").dropDuplicates([doc_id, text]))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
