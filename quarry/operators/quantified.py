"""``x op ANY | ALL (SELECT y ...)`` with three-valued results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}


def quantified(outer: DataFrame, inner: DataFrame, keys: dict[str, str], x: Column, op: str, y: Column, kind: str, name: str) -> DataFrame:
    """``outer`` with the boolean ``name``: whether ``x op y`` holds for any or all rows of ``inner`` with equal ``keys``.

    ANY over no rows is false, ALL is true; a null leaves the result open unless another row decides it.  The inner side
    becomes one row per key (its least and greatest value, rows and values), by partial aggregates, before it is joined, so
    no outer row meets more than one.  ``keys``: outer column by inner column; none for an uncorrelated subquery.
    """
    seen = inner.groupBy(*[F.col(i).alias(f"_k{n}") for n, i in enumerate(keys.values())]).agg(F.count(F.lit(1)).alias("_n"), F.count(y).alias("_k"), F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    link = [outer[o] == seen[f"_k{n}"] for n, o in enumerate(keys)]
    both = outer.join(seen, link, "left") if link else outer.crossJoin(F.broadcast(seen))  # one row
    test, every = OPS[op], kind == "all"
    lo, hi = test(x, F.col("_lo")), test(x, F.col("_hi"))
    holds = (lo & hi) if every else (lo | hi)  # of an order or an equality the extremes decide
    if op == "=" and not every or op == "<>" and every:
        raise ValueError("that is IN and NOT IN: a semi or an anti join")
    none = F.coalesce("_n", F.lit(0)) == 0
    decided = F.when(F.col("_k") > 0, ~holds if every else holds)
    out = F.when(none, F.lit(every)).when(decided, F.lit(not every)).when(F.col("_k") < F.col("_n"), None).otherwise(holds)
    return both.select(*[outer[c] for c in outer.columns], out.alias(name))
