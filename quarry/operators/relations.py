"""Joins and windows whose meaning differs from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_using(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """JOIN USING: the right side's key columns are hidden and the left side's aren't merged with them."""
    r = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        one = left[k] == r[f"_right_{k}"]
        on = one if on is None else on & one
    return left.join(r, on, how).drop(*[f"_right_{k}" for k in keys])


def lag_by(df: DataFrame, partition: list[str], order: list[str], value: str, offset: Column, name: str) -> DataFrame:
    """LAG with an offset that differs by row (negative ones look ahead): a self join on the row's number."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).withColumn("_at", F.col("_n") - offset)
    other = rows.select(*[F.col(c).alias(f"_p{k}") for k, c in enumerate(partition)], F.col("_n").alias("_m"), F.col(value).alias(name))
    on = F.col("_at") == F.col("_m")
    for k, c in enumerate(partition):
        on &= F.col(c).eqNullSafe(F.col(f"_p{k}"))
    return rows.join(other, on, "left").select(*df.columns, name)


def band(left: DataFrame, right: DataFrame, x: str, y: str, width: float, tasks: int = 16) -> DataFrame:
    """``left`` joined with ``right`` on ``x < y <= x + width``.

    Values are numbered by steps of an eighth of the width, and a left row meets the rows of its steps alone.  The pairs may be
    far more than the rows, so the left rows are dealt to ``tasks`` tasks a core, whatever their size, and meet a copy of the
    right side, which is held whole by each executor; pairs only stream through.
    """
    step = lambda c: F.floor(c / F.lit(width / 8)).cast("long")
    n = tasks * left.sparkSession.sparkContext.defaultParallelism
    # by the sum itself, whose rounding counts
    steps = F.sequence(step(F.col(x)), step(F.col(x) + F.lit(width)))
    rows = left.filter(F.col(x) < float("inf")).repartition(n).withColumn("_step", F.explode(steps))
    other = right.filter(F.col(y).isNotNull()).withColumn("_step", step(F.col(y)))
    near = (F.col(y) > F.col(x)) & (F.col(y) <= F.col(x) + F.lit(width))
    return rows.join(F.broadcast(other), "_step").filter(near).drop("_step")
