"""Versioned tables: constraints, upserts, updates, deletes, a change feed, snapshots and materialized views.

A version is a folder of Parquet files; a commit publishes it by creating ``_log/N.json``, which the file system does for
one writer only, so concurrent commits conflict and readers never see half a version.  Every commit also writes its
changed rows to ``_changes`` (one folder per commit), which a stream can tail.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another commit came first."""


class ConstraintError(ValueError):
    """Rows that a constraint forbids."""


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str = "restrict"  # restrict, cascade, set null


@dataclass
class Constraints:
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    foreign: tuple[ForeignKey, ...] = ()


class Files:
    """Hadoop's file system, for small log files."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def create(self, p: str, text: str) -> bool:
        """False if the file exists."""
        try:
            out = self.fs.create(self.path(p), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def names(self, p: str) -> list[str]:
        if not self.fs.exists(self.path(p)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(p))]

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Table:
    """One versioned table under ``root/name``."""

    def __init__(self, spark: SparkSession, root: str, name: str, constraints: Constraints | None = None):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.path = f"{self.root}/{name}"
        self.files = Files(spark, self.path)
        self.constraints = constraints or Constraints()
        self.after: list = []  # what runs after a commit, with its kind and changed rows

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/_log") if n.endswith(".json"))

    def version(self) -> int:
        """The newest version, -1 if there is none."""
        return (self.versions() or [-1])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        info = json.loads(self.files.read(f"{self.path}/_log/{v:09d}.json"))
        return self.spark.read.parquet(f"{self.path}/{info['folder']}")

    def create(self, df: DataFrame) -> Table:
        self._publish(df, -1, df.withColumn("_kind", F.lit("insert")))
        return self

    def _publish(self, df: DataFrame, base: int, changes: DataFrame | None = None, parents: dict[str, Table] | None = None) -> int:
        import uuid

        folder = f"v{base + 1:09d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        stored = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        if bad := violations(stored, self.constraints, parents or {}):
            raise ConstraintError(f"{self.name}: {bad}")
        feed = None
        if changes is not None:
            feed = f"_changes/lsn={base + 1:09d}-{uuid.uuid4().hex}"
            changes.write.parquet(f"{self.path}/{feed}")
        if not self.files.create(f"{self.path}/_log/{base + 1:09d}.json", json.dumps({"folder": folder, "changes": feed})):
            raise Conflict(self.name)
        if feed and self.after:
            rows = self.spark.read.parquet(f"{self.path}/{feed}")
            kind = rows.select("_kind").first()
            for action in self.after:
                if kind:
                    action(kind["_kind"], rows.drop("_kind"))
        return base + 1

    def insert(self, rows: DataFrame, conflict: str = "error", update: dict[str, Column] | None = None, parents: dict[str, Table] | None = None) -> DataFrame:
        """INSERT; ``conflict``: ``error``, ``nothing``, ``update`` (``update`` maps columns to expressions over ``old.c`` and
        ``excluded.c``, by default the new values) or ``replace`` (of rows that meet any unique key).

        New rows of one key count once: the last one given by ``rows``' own order column is not known to a set, so
        duplicates within the input are an error unless ``conflict`` is ``nothing``, where any one stays.
        Returns the rows as they are now (RETURNING).
        """
        base, key = self.version(), list(self.constraints.key)
        old = self.read(base)
        rows = rows.select(*old.columns)
        same = lambda a, b, cols: _all([F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in cols])
        if conflict == "error":
            new, touched = old.unionByName(rows), rows
        elif conflict == "nothing":
            touched = rows.dropDuplicates(key).alias("n").join(old.alias("o"), same("n", "o", key), "left_anti")
            new = old.unionByName(touched)
        elif conflict == "replace":
            kept = old.alias("o")
            for cols in [key, *map(list, self.constraints.unique)]:
                kept = kept.join(rows.alias("n"), same("o", "n", cols), "left_anti").alias("o")
            new, touched = kept.select(*old.columns).unionByName(rows), rows
        else:
            o = old.select(*[F.col(c).alias(f"old_{c}") for c in old.columns], F.lit(True).alias("_old"))
            n = rows.select(*[F.col(c).alias(f"excluded_{c}") for c in old.columns], F.lit(True).alias("_new"))
            joined = o.join(n, _all([F.col(f"old_{c}") == F.col(f"excluded_{c}") for c in key]), "full")
            value = lambda c: (update or {}).get(c, F.col(f"excluded_{c}") if update is None else F.col(f"old_{c}"))
            out = [F.when(F.col("_new").isNull(), F.col(f"old_{c}")).when(F.col("_old").isNull(), F.col(f"excluded_{c}")).otherwise(value(c)).cast(old.schema[c].dataType).alias(c) for c in old.columns]
            merged = joined.select(*out, F.col("_new"))
            new, touched = merged.drop("_new"), merged.filter("_new").drop("_new")
        self._publish(new, base, touched.withColumn("_kind", F.lit("insert" if conflict in ("error", "nothing") else "upsert")), parents)
        return touched

    def update(self, where: str | Column, values: dict[str, Column], parents: dict[str, Table] | None = None) -> DataFrame:
        """UPDATE; new values are of the old row.  Returns the changed rows."""
        base = self.version()
        old = self.read(base)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        flagged = old.withColumn("_hit", hit)
        out = [(F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).cast(old.schema[c].dataType) if c in values else F.col(c)).alias(c) for c in old.columns]
        new = flagged.select(*out, "_hit")
        touched = new.filter("_hit").drop("_hit")
        self._publish(new.drop("_hit"), base, touched.withColumn("_kind", F.lit("update")), parents)
        return touched

    def delete(self, where: str | Column, children: list[Table] | None = None) -> DataFrame:
        """DELETE; ``children`` are tables whose foreign keys refer to this one, treated by their ON DELETE action."""
        base = self.version()
        old = self.read(base)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        gone = old.filter(hit)
        for child in children or []:
            for fk in child.constraints.foreign:
                if fk.parent != self.name:
                    continue
                keys = gone.select(F.col(fk.parent_column).alias("_k")).distinct()
                refers = child.read().join(keys, F.col(fk.column) == F.col("_k"), "left_semi")
                if refers.isEmpty():
                    continue
                if fk.on_delete == "restrict":
                    raise ConstraintError(f"{child.name}.{fk.column} refers to rows of {self.name}")
                marked = child.read().join(keys, F.col(fk.column) == F.col("_k"), "left")
                rows = child.read()
                if fk.on_delete == "cascade":
                    child._publish(rows.join(keys, F.col(fk.column) == F.col("_k"), "left_anti"), child.version(), refers.withColumn("_kind", F.lit("delete")))
                else:
                    null = F.when(F.col("_k").isNull(), F.col(fk.column))
                    child._publish(marked.select(*[(null if c == fk.column else F.col(c)).alias(c) for c in rows.columns]), child.version(), refers.withColumn("_kind", F.lit("update")))
        self._publish(old.filter(~hit), base, gone.withColumn("_kind", F.lit("delete")))
        return gone

    def add_column(self, name: str, kind: str, default=None) -> None:
        self._publish(self.read().withColumn(name, F.lit(default).cast(kind)), self.version())

    def drop_column(self, name: str) -> None:
        self._publish(self.read().drop(name), self.version())

    def rename_column(self, old: str, new: str) -> None:
        self._publish(self.read().withColumnRenamed(old, new), self.version())

    def truncate(self) -> None:
        self._publish(self.read().filter(F.lit(False)), self.version())

    def restore(self, version: int) -> int:
        """Publishes an earlier version as the newest one."""
        return self._publish(self.read(version), self.version())

    def changes(self, since: int = -1) -> DataFrame:
        """Rows of all commits after ``since``, with ``_kind`` and ``_lsn``."""
        out = None
        for v in self.versions():
            info = json.loads(self.files.read(f"{self.path}/_log/{v:09d}.json"))
            if v > since and info["changes"]:
                one = self.spark.read.parquet(f"{self.path}/{info['changes']}").withColumn("_lsn", F.lit(v).cast("bigint"))
                out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            return self.read().withColumn("_kind", F.lit("")).withColumn("_lsn", F.lit(0).cast("bigint")).filter(F.lit(False))
        return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def violations(df: DataFrame, c: Constraints, parents: dict[str, Table]) -> dict[str, int]:
    """Numbers of rows against each constraint; checks pass on null, unique keys ignore nulls."""
    needed = dict.fromkeys([*c.key, *c.not_null])
    aggs = [F.count_if(F.col(n).isNull()).alias(f"not null {n}") for n in needed] + [F.count_if(~F.expr(e)).alias(f"check {n}") for n, e in c.checks.items()]
    found = df.agg(*aggs).first().asDict() if aggs else {}
    for cols in [c.key, *c.unique]:
        if cols:
            found[f"unique {', '.join(cols)}"] = df.dropna(subset=list(cols)).groupBy(*cols).count().filter("count > 1").count()
    for fk in c.foreign:
        if fk.parent in parents:
            p = parents[fk.parent].read().select(F.col(fk.parent_column).alias("_k"))
            found[f"foreign {fk.column}"] = df.filter(F.col(fk.column).isNotNull()).join(p, F.col(fk.column) == F.col("_k"), "left_anti").count()
    return {k: n for k, n in found.items() if n}


class MaterializedView:
    """The rows of a query, stored; ``refresh`` recomputes them, and so does a commit of a table in ``sources`` (auto refresh)."""

    def __init__(self, spark: SparkSession, root: str, name: str, query, sources: tuple[Table, ...] = ()):
        self.table, self.query = Table(spark, root, name), query
        self.table.create(query())
        for t in sources:
            t.after.append(lambda kind, rows: self.refresh())

    def read(self) -> DataFrame:
        return self.table.read()

    def refresh(self) -> None:
        self.table._publish(self.query(), self.table.version())


def analyze(df: DataFrame) -> DataFrame:
    """``column_name, n_rows, n_distinct, n_null, min, max`` of every column that can be ordered, in one pass."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant", "binary")]
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(cols):
        aggs += [F.count_distinct(c).alias(f"d{k}"), F.count_if(F.col(c).isNull()).alias(f"u{k}"), F.min(c).cast("string").alias(f"a{k}"), F.max(c).cast("string").alias(f"z{k}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"d{k}").alias("n_distinct"), F.col(f"u{k}").alias("n_null"), F.col(f"a{k}").alias("min"), F.col(f"z{k}").alias("max")) for k, c in enumerate(cols)])
    return one.select(F.inline(rows))
