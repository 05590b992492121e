"""Token-id files: independent zstandard frames, each with a checksum, and a trailing seek table (operator 6).

A file is a run of zstandard frames of whole documents' ids (little-endian unsigned 32-bit), then a skippable frame with
the documents' index, then the public seekable format's seek table with a checksum of each frame.  Any zstandard reader
can decompress the file; a reader that wants some documents reads the table and the index and decompresses their frames.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

SKIP, SEEK_SKIP, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME = 1 << 18


class Corrupt(ValueError):
    """A file whose structure or checksums don't hold."""


def _sum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


def write(out, docs: Iterable[tuple[int | None, bytes]], frame: int = FRAME, level: int = 3) -> tuple[int, int]:
    """Write one file of documents (id, ids' bytes) to a binary stream; the numbers of documents and ids.

    A frame holds whole documents of at least ``frame`` bytes together.  Only one frame is in memory.
    """
    import zstandard

    press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    table, ids, known, sizes, held, n = [], [], [], [], [], 0

    def flush() -> None:
        if raw := b"".join(held):
            out.write(z := press.compress(raw))
            table.append((len(z), len(raw), _sum(raw)))
        held.clear()

    for key, raw in docs:
        ids.append(key or 0)
        known.append(key is not None)
        sizes.append(len(raw) // 4)
        held.append(raw)
        n += len(raw)
        if n >= frame:
            flush()
            n = 0
    flush()
    index = press.compress(np.array(ids, "<i8").tobytes() + np.array(known, "u1").tobytes() + np.array(sizes, "<u4").tobytes())
    out.write(struct.pack("<IIQ", SKIP, 8 + len(index), len(ids)) + index)
    table.append((16 + len(index), 0, 0))
    out.write(struct.pack("<II", SEEK_SKIP, 12 * len(table) + 9) + b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC))
    return len(ids), sum(sizes)


class Reader:
    """Random access to one file: ``source`` needs ``seek`` and ``read``."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unpress = source, zstandard.ZstdDecompressor()
        self.frames_read = 0
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise Corrupt("no seek table")
        raw = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(raw[:, 0])])
        self.at, self.table, self.raw_at = at, raw, np.concatenate([[0], np.cumsum(raw[:, 1])])
        head = self._at(int(at[-2]), int(raw[-1, 0]))
        magic, length, n = struct.unpack("<IIQ", head[:16])
        if magic != SKIP or length != len(head) - 8:
            raise Corrupt("no document index")
        index = self.unpress.decompress(head[16:])
        self.ids, self.known = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        self.sizes = np.frombuffer(index, "<u4", n, 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes.astype(np.int64))])

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _frame(self, k: int) -> bytes:
        self.frames_read += 1
        raw = self.unpress.decompress(self._at(int(self.at[k]), int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or _sum(raw) != self.table[k, 2]:
            raise Corrupt(f"frame {k}")
        return raw

    def documents(self, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, ids before it in this file, its ids' bytes) in the file's order, of ``wanted`` ids or all.

        Only the frames of those documents are decompressed, one at a time.
        """
        have, raw = -1, b""
        for i in range(len(self.ids)):
            key = int(self.ids[i]) if self.known[i] else None
            if wanted is not None and key not in wanted:
                continue
            a, b = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
            if a == b:
                yield key, a // 4, b""
                continue
            k = int(np.searchsorted(self.raw_at, a, "right")) - 1
            if k != have:
                have, raw = k, self._frame(k)
            yield key, a // 4, raw[a - int(self.raw_at[k]) : b - int(self.raw_at[k])]


def _encoded(batches, encode, end: bytes) -> Iterator[tuple[int | None, bytes]]:
    """(id, ids' bytes) of every row of record batches, which are taken one at a time."""
    for whole in common.releasing(batches):
        for b in tokens.slices(whole):
            yield from zip(b["id"].to_pylist(), (x + end for x in encode([t or "" for t in b["text"].to_pylist()])), strict=True)
        whole = b = None


def write_files(docs: DataFrame, path: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write ``docs`` to files in ``folder`` in ascending order of ids: one row per file, ``shard, file, n_docs, n_tokens``.

    Rows are dealt by ranges of (id, hash of the text) and sorted by (id, text), so repeated ids have a defined order and
    a common one doesn't meet in one task.  Null ids come first; null and empty texts hold the end id alone.  Every
    attempt of a task writes a file of its own name, so a lost executor's half-written files are never read.
    """

    def shard(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = tokens.encoder(path), tokens.little([end_id])
        fs, where = common.open_fs(folder)
        fs.create_dir(where)

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            part = TaskContext.get().partitionId()
            name = f"{where}/{part:08d}-{uuid.uuid4().hex}.ids.zst"
            with fs.open_output_stream(name, compression=None) as out:
                n, total = write(out, _encoded(itertools.chain([first], batches), encode, end))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "file": [name.rsplit("/", 1)[-1]], "n_docs": [n], "n_tokens": [total]})

    dealt = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    return common.materialize(dealt.mapInArrow(shard, "shard int, file string, n_docs long, n_tokens long"), "shards")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; ``start`` counts over all files.

    ``files`` has one row per file (not per document), so its running total is a small window.
    """

    def read(batches):
        import pyarrow as pa

        fs, where = common.open_fs(folder)
        for b in common.releasing(batches):
            for name, base in zip(b["file"].to_pylist(), b["base"].to_pylist(), strict=True):
                with fs.open_input_file(f"{where}/{name}") as f:
                    rows = []
                    for key, start, raw in Reader(f, f.size()).documents():
                        rows.append((key, base + start, len(raw) // 4, zlib.crc32(raw)))
                        if len(rows) == 10_000:
                            yield batch(pa, rows)
                            rows = []
                    if rows:
                        yield batch(pa, rows)

    def batch(pa, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    based = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, files.count())
    ranked = based.withColumn("nth", F.row_number().over(Window.orderBy("shard")) - 1)
    return ranked.repartitionById(n, F.col("nth")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_seekable_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch(spark, "ids")
    return read_files(write_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, folder), folder)
