"""Recursive UNION to a fixpoint."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 100_000


class RoundLimit(RuntimeError):
    """The recursion went on for more rounds than allowed."""


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's folder (a temporary one only where none is set)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint()


def union_fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``base UNION step(...)``: every round applies ``step`` to the rows that the last one found new, nulls comparing equal.

    Each round's rows are checkpointed, so neither lineage nor recomputation grows.  ``limit`` stops once so many rows
    are found (and returns that many).
    """
    frontier = checkpoint(base.distinct())
    seen, total = frontier, frontier.count()
    for _ in range(max_rounds):
        if limit is not None and total >= limit:
            return seen.limit(limit)
        found = step(frontier).toDF(*base.columns).distinct()
        old = seen.toDF(*[f"_seen_{c}" for c in base.columns])
        on = None
        for c in base.columns:
            same = F.col(c).eqNullSafe(F.col(f"_seen_{c}"))
            on = same if on is None else on & same
        frontier = checkpoint(found.join(old, on, "left_anti"))
        n = frontier.count()
        if n == 0:
            return seen
        seen, total = checkpoint(seen.unionByName(frontier)), total + n
    raise RoundLimit(f"more than {max_rounds} rounds")
