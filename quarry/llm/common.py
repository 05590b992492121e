"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace of the word contracts: space and U+0009 to U+000D, what ``bytes.split`` and ``bytes.strip`` take.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = os.path.join(tempfile.gettempdir(), "quarry-shared")
        os.makedirs(base, exist_ok=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``cleanup`` removes it."""
    _made.append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cleanup(spark: SparkSession) -> None:
    """Removes what this driver's operators wrote to the shared folder, once their results are no longer read."""
    while _made:
        remove(spark, _made.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts the lineage with files that outlive any executor, and gives the planner true sizes, so that later joins
    broadcast by the configured threshold and not by a guess.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives the memory that this process has freed back to the system, which allocators else keep for as long as a worker lives.

    An idle worker counts with its executor as much as a busy one.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def releasing(batches):
    """The batches one by one; after each, ``release``."""
    for b in batches:
        yield b
        del b
        release()


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames has it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with over 1/HOT of the rows is hot, so there are at most HOT of them; its rows are dealt in parts of about 1/HOT, at most SALTS.
HOT, SALTS = 1000, 64


def join_counted(rows: DataFrame, one: DataFrame, keys: list[str], spread: list[str], total: int | None = None, n: str = "n", how: str = "inner", few: int = 0) -> DataFrame:
    """``rows`` joined on ``keys`` with ``one``, which has one row (or few) per key and in ``n`` how many of ``rows`` share it.

    The keys that hold over a thousandth of the rows are at most a thousand, whatever the data, and are broadcast to mark
    their rows; those rows are dealt by a hash of ``spread`` to several tasks, each with a copy of the key's one row.  A key
    has as many copies as thousandths, so all hot keys together have at most 2000 for each row that ``one`` has of a key.
    Rows with a null key, which match nothing, are dealt likewise.
    ``total``: the sum of ``n``, counted here if not given (``one`` should then be a written table).  Up to ``few`` rows in
    all are joined plainly, with the same result.
    """
    if total is None:
        total = one.agg(F.sum(n)).first()[0] or 0
    if total <= few:
        return rows.join(one, keys, how)
    parts, salt = fresh("_parts", rows, one), fresh("_salt", rows, one)
    share = F.when(F.col(n) * HOT > total, F.least(F.lit(SALTS), F.ceil(F.col(n) * HOT / total)).cast("long"))
    marked = rows.join(F.broadcast(one.select(*keys, share.alias(parts)).filter(F.col(parts).isNotNull()).distinct()), keys, "left")
    place, no_key = F.xxhash64(*spread), reduce(or_, (F.col(k).isNull() for k in keys))
    marked = marked.withColumn(salt, F.when(no_key, place).when(F.col(parts).isNotNull(), F.pmod(place, F.col(parts))).otherwise(0).cast("long")).drop(parts)
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(share, F.lit(1).cast("long")) - 1)
    return marked.join(one.withColumn(salt, F.explode(copies)), [*keys, salt], how).drop(salt)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does the same where all characters are ASCII, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def open_fs(uri: str):
    """(file system, path) of a URI or local path, for the few operators whose output is a file format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else os.path.abspath(uri))
