"""Best-fit packing of documents into fixed-length sequences (operator 5).

A packing depends only on how many pieces there are of each length, so the whole instance is a histogram of at most
``capacity`` counts, whatever the corpus' size.  The driver solves the histogram: Martello-Toth dominance fixes the sets
that dominate every other set with the same largest piece (alone, with one partner, with two), in bulk for all pieces of
that length; best fit decreasing places the rest, again a run of equal sequences at a time.  The result is a short list
of runs.  A piece finds its place from its rank among the pieces of its length; ranks come from counts of each input
partition, so no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens


@dataclass
class Plan:
    """Runs of pieces of one length: ranks rank0.. lie ``per`` to a sequence from sequence ``bin0`` on, at ``off0``."""

    capacity: int
    bins: int = 0
    ranks: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def put(self, size: int, count: int, per: int, bin0: int, off0: int) -> None:
        self.runs.append((size, self.ranks[size], per, bin0, off0))
        self.ranks[size] += count


def _dominant(size: int, count: list[int], capacity: int) -> tuple[int, ...] | None:
    """Partners in a set that dominates all feasible sets with one piece of ``size``; None if none is known.

    ``count`` has the other pieces.  With at most two partners possible these are Martello and Toth's criteria; a partner
    that fills the sequence dominates in any case.
    """
    room = capacity - size
    fit = [s for s in range(1, room + 1) if count[s]]
    if not fit:
        return ()
    best = fit[-1]
    if best == room:
        return (best,)
    small = [s for s in fit[:4] for _ in range(min(4, count[s]))][:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return (best,)
    if len(small) == 3 and sum(small) <= room:
        return None
    pair, j = (0, 0), 0
    for i in range(len(fit) - 1, -1, -1):
        while j < len(fit) and fit[j] + fit[i] <= room:
            j += 1
        for k in (j - 1, j - 2):
            if 0 <= k <= i and (k < i or count[fit[i]] > 1) and fit[i] + fit[k] <= room and fit[i] + fit[k] > sum(pair):
                pair = (fit[i], fit[k])
    if best >= sum(pair):
        return (best,)
    if best == pair[0]:
        between = [s for s in fit if pair[1] < s <= best for _ in range(min(3, count[s] - (s == best)))]
        if len(between) < 2 or between[0] + between[1] > room:
            return pair
    return None


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """Plan for ``{length: pieces}``."""
    plan, count = Plan(capacity), [0] * (capacity + 1)
    for s, n in histogram.items():
        count[s] = n
    for size in range(capacity, 0, -1):
        while count[size]:
            count[size] -= 1
            found = _dominant(size, count, capacity)
            count[size] += 1
            if found is None:
                break
            whole = (size, *found)
            n = min(count[s] // whole.count(s) for s in whole)
            off = 0
            for s in dict.fromkeys(whole):
                plan.put(s, n * whole.count(s), whole.count(s), plan.bins, off)
                off += s * whole.count(s)
                count[s] -= n * whole.count(s)
            plan.bins += n
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs of sequences (first, number)
    for size in range(capacity, 0, -1):
        while left := count[size]:
            room = next((r for r in range(size, capacity) if free[r]), capacity)
            first, n = free[room].pop() if room < capacity else (plan.bins, -(-left // (capacity // size)))
            plan.bins += n if room == capacity else 0
            per = room // size
            full = min(n, left // per)
            if full:
                plan.put(size, full * per, per, first, capacity - room)
                free[room - per * size].append((first, full))
                left -= full * per
            if full < n:
                if left:
                    plan.put(size, left, left, first + full, capacity - room)
                    free[room - left * size].append((first + full, 1))
                    full, left = full + 1, 0
                if full < n:
                    free[room].append((first + full, n - full))
            count[size] = left
    return plan


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, what is left over goes first."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))] if length else []


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids`` digest columns.

    * null and empty texts: one piece of the end id alone; null ids and repeated rows are packed like any other row;
    * a document over ``capacity`` tokens: pieces of ``capacity``, the first one the remainder;
    * ties between equal lengths go by the rows' place in the input files; an empty table gives no rows;
    * other columns of ``docs`` are not read, so their names can't clash.
    """
    spark = docs.sparkSession

    def pieces(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end, part = tokens.encoder(path), tokens.little([end_id]), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for whole in common.releasing(batches):
            for batch in tokens.slices(whole):
                rows = []
                for key, ids in zip(batch["doc_id"].to_pylist(), encode([t or "" for t in batch["text"].to_pylist()]), strict=True):
                    ids += end
                    for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((key, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types(pa), strict=True)], schema=pa.schema(list(zip(names, types(pa), strict=True))))

    names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
    types = lambda pa: (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    cuts = common.materialize(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"),
        "pieces",
    )
    counts = cuts.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    plan = solve({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # at most ``capacity`` rows
    return _place(spark, cuts.join(base, ["part", "length"]), plan)


def _place(spark: SparkSession, ranked: DataFrame, plan: Plan) -> DataFrame:
    """The plan's runs are bounded by the capacity, not by the corpus, so every task carries them."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for size, *run in sorted(plan.runs):
        runs[size].append(tuple(run))
    starts = {s: [r[0] for r in x] for s, x in runs.items()}

    def place(batches):
        import pyarrow as pa

        for b in common.releasing(batches):
            seq, off = [], []
            for size, rank in zip(b["length"].to_pylist(), b["rank"].to_pylist(), strict=True):
                rank0, per, bin0, off0 = runs[size][bisect_right(starts[size], rank) - 1]
                q, r = divmod(rank - rank0, per)
                seq.append(bin0 + q)
                off.append(off0 + r * size)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
