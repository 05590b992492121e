"""AVI motion-JPEG columns: write, index, decode and cut into shots (operator 9).

A frame is a baseline JPEG in grey, whose blocks hold a DC coefficient and nothing else: a block of 8x8 equal pixels
stands for one 8-bit sample, so the picture at an eighth of its scale is the samples, without loss.  The Huffman tables
give every difference 15 bits (code and magnitude together) and the end of block one, so that a block is two bytes and
numpy codes and decodes whole frames with one table look-up.  Any JPEG decoder can show the frames.

The container is a RIFF file: hdrl with avih, strh and strf, a LIST INFO with the payload's length, movi with one
00dc chunk per frame, and the idx1 index, from which the reader finds the frames.  The reader takes other files as well:
the frame rate comes from their headers, index offsets count from the movi list or from the file's start, files without an
index are walked, and frames of other profiles are decoded from their own tables (:mod:`.jpeg`).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jpeg, tokens

SIDE = 32  # samples in a frame's row and column
FRAME = SIDE * SIDE
FPS = 25


def _tables():
    """Code word of each difference (-255..255) and, inversely, the difference of each 16-bit word."""
    word = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        bits = d if d >= 0 else d + (1 << size) - 1
        # canonical codes of lengths 15 - size for sizes 8, 7, ... 0: code k has length 7 + k
        code = sum(1 << (15 - (7 + k)) for k in range(8 - size)) >> size if size < 8 else 0
        word[d + 255] = ((code << size) | bits) << 1
    back = np.full(65536, 999, np.int16)
    back[word] = np.arange(-255, 256)
    return word, back


WORD, BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DC = bytes([0] * 6 + [1] * 9 + [0]) + bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])
_AC = bytes([1] + [0] * 15) + bytes([0])
HEAD = (
    b"\xff\xd8" + _segment(0xE0, b"AVI1" + bytes(12)) + _segment(0xDB, b"\x00" + b"\x08" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * SIDE, 8 * SIDE, 1) + b"\x01\x11\x00")
    + _segment(0xC4, b"\x00" + _DC) + _segment(0xC4, b"\x10" + _AC) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of a uint8 array of shape (n, FRAME)."""
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128))
    coded = WORD[diff + 255].astype(">u2")
    return [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in coded]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples of JPEG frames as written by :func:`encode_frames`, by one table look-up."""
    scans = []
    for f in frames:
        if not own_profile(f):
            raise ValueError("not a frame of this writer's profile")
        scans.append(f[len(HEAD) : -2].replace(b"\xff\x00", b"\xff"))
    if any(len(s) != 2 * FRAME for s in scans):
        raise ValueError("truncated scan")
    diff = BACK[np.frombuffer(b"".join(scans), ">u2").astype(np.uint16)].reshape(len(frames), FRAME)
    if (diff == 999).any():
        raise ValueError("bad code word")
    return (np.cumsum(diff, axis=1, dtype=np.int32) + 128).astype(np.uint8)


def own_profile(frame: bytes) -> bool:
    return frame.startswith(HEAD) and frame.endswith(b"\xff\xd9")


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """The payload as an AVI file; the last frame is filled up with zeros, the INFO list has the true length."""
    n = max(1, -(-len(payload) // FRAME))
    frames = encode_frames(np.frombuffer(payload.ljust(n * FRAME, b"\0"), np.uint8).reshape(n, FRAME))
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, 8 * SIDE, 8 * SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0, 0, 0, 0, 8 * SIDE, 8 * SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * SIDE, 8 * SIDE, 1, 8, b"MJPG", 64 * FRAME, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"payload-bytes=%d\0" % len(payload))
    index, movi, at = [], [b"movi"], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c := _chunk(b"00dc", f))
        at += len(c)
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Index:
    """Where a file's frames are, and what its headers say: frames a second as a fraction, payload bytes if it names them."""

    frames: list[bytes]
    rate: int
    scale: int
    size: int | None

    def ms(self, frame: int) -> int:
        return 1000 * self.scale * frame // self.rate


def _walk(media: bytes, at: int, end: int):
    """(name, first byte, length) of the chunks from ``at`` on; a list has its kind for a name."""
    while at + 8 <= end:
        name, n = struct.unpack_from("<4sI", media, at)
        if at + 8 + n > end:
            raise ValueError("truncated chunk")
        if name in (b"LIST", b"RIFF"):
            yield media[at + 8 : at + 12], at + 12, n - 4
        else:
            yield name, at + 8, n
        at += 8 + n + (n & 1)


def _video(name: bytes) -> bool:
    return name[2:] in (b"dc", b"db") and name[:2].isdigit()


def _movi_frames(media: bytes, at: int, end: int):
    for name, a, n in _walk(media, at, end):
        if name == b"rec ":
            yield from _movi_frames(media, a, a + n)
        elif _video(name):
            yield media[a : a + n]


def index_avi(media: bytes) -> Index:
    """Walks the RIFF chunks and finds the frames of the video stream by idx1, or in the movi lists where there is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found, movi, size, rate, scale = {}, [], None, 0, 0
    try:
        for kind, a, n in _walk(media, 0, len(media)):
            if kind not in (b"AVI ", b"AVIX"):
                continue
            for name, b, m in _walk(media, a, a + n):
                if name == b"movi":
                    movi.append((b, b + m))
                elif name == b"INFO" and b"payload-bytes=" in (text := media[b : b + m]):
                    size = int(text[text.index(b"payload-bytes=") + 14 :].split(b"\0")[0])
                elif name == b"hdrl":
                    for x, c, k in _walk(media, b, b + m):
                        if x == b"avih":
                            found["step"] = struct.unpack_from("<I", media, c)[0]
                        elif x == b"strl":
                            for z, d, _ in _walk(media, c, c + k):
                                if z == b"strh" and media[d : d + 4] == b"vids":
                                    scale, rate = struct.unpack_from("<II", media, d + 20)
                elif name == b"idx1":
                    found[name] = media[b : b + m]
        if not rate or not scale:
            rate, scale = 1_000_000, found.get("step") or 1_000_000 // FPS
        if not movi:
            raise ValueError("no frames")
        if b"idx1" not in found or len(movi) > 1:
            frames = [f for a, b in movi for f in _movi_frames(media, a, b)]
        else:
            frames, base = [], None
            for name, _, off, n in struct.iter_unpack("<4sIII", found[b"idx1"]):
                if not _video(name):
                    continue
                if base is None:  # offsets count from the list's kind or from the file's start
                    base = next((x for x in (movi[0][0] - 4, 0) if media[x + off : x + off + 8] == name + struct.pack("<I", n)), None)
                if base is None or media[base + off : base + off + 8] != name + struct.pack("<I", n):
                    raise ValueError("the index doesn't fit the frames")
                frames.append(media[base + off + 8 : base + off + 8 + n])
    except struct.error as e:
        raise ValueError(f"broken header: {e}") from e
    return Index(frames, rate, scale, size)


def read_avi(media: bytes) -> tuple[bytes, np.ndarray]:
    """(payload, frames' samples) of a file that :func:`write_avi` wrote."""
    found = index_avi(media)
    samples = decode_frames(found.frames)
    return samples.tobytes()[: found.size], samples


def pictures(found: Index) -> list[np.ndarray]:
    """A file's frames as grey values: this writer's samples, of others all pixels (an empty frame repeats the last one)."""
    if found.frames and all(map(own_profile, found.frames)):
        return list(decode_frames(found.frames))
    out: list[np.ndarray] = []
    for f in found.frames:
        if not f and out:
            out.append(out[-1])
            continue
        p = jpeg.decode(f)
        out.append((p if p.ndim == 2 else np.rint(p @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)).ravel())
    return out


def shots(samples: np.ndarray | list[np.ndarray], window: int = 8, factor: float = 2.0, least: float = 0.25) -> list[tuple[int, int]]:
    """(first frame, end) of each shot.

    A cut lies where the histogram difference of two neighbouring frames (half the L1 distance of 16 bins, 0 to 1) is at
    least ``least`` and over ``factor`` times the mean of up to ``window`` differences since the last cut or before it.
    """
    n = len(samples)
    if n == 0:
        return []
    if isinstance(samples, np.ndarray):
        bins = np.bincount(((samples >> 4) + 16 * np.arange(n)[:, None]).ravel(), minlength=16 * n).reshape(n, 16) / samples.shape[1]
    else:
        bins = np.array([np.bincount(f >> 4, minlength=16) / f.size for f in samples]).reshape(n, 16)
    diff = np.abs(np.diff(bins, axis=0)).sum(1) / 2
    if n < 2 or diff.max() < least:
        return [(0, n)]
    total, cuts, last = np.concatenate([[0], np.cumsum(diff)]), [0], 0
    for k in np.flatnonzero(diff >= least).tolist():
        a = max(last, k - window)
        if k == a or diff[k] > factor * (total[k] - total[a]) / (k - a):
            cuts.append(k + 1)
            last = k + 1
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], n], strict=True) if a < b]


def encode_column(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Adds the AVI file of a binary column; null stays null.  One value is limited by Spark's 2 GB a cell (900 MB of payload)."""

    @F.pandas_udf("binary")
    def code(s):
        return s.map(lambda x: None if x is None else write_avi(x))

    return df.withColumn(media, code(payload))


CLIP = "clip int, start_ms long, end_ms long, frames long, mean double"


def cut(found: Index, samples) -> list[tuple[int, int, int, int, float]]:
    """The timed clips of a file, fields as in ``CLIP``; times follow the headers' frame rate."""
    return [(i, found.ms(a), found.ms(b), b - a, float(np.mean([f.mean() for f in samples[a:b]]))) for i, (a, b) in enumerate(shots(samples))]


def clips(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per shot of each AVI file: ``key, clip, start_ms, end_ms, frames, mean`` (of the grey values), and ``error``.

    Null media gives no row; a file that can't be read, or without frames, gives one row that has only the key and what is wrong.
    """
    kind = df.schema[key].dataType.simpleString()
    value, file = "key", "media"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, m in zip(pdf[value], pdf[file], strict=True):
                if m is None:
                    continue
                try:
                    found = index_avi(bytes(m))
                    some = [(k, *c, None) for c in cut(found, pictures(found))]
                    rows += some or [(k, *[None] * 5, "no frames")]
                except ValueError as e:
                    rows.append((k, *[None] * 5, str(e)))
            out = pd.DataFrame(rows, columns=[value, "clip", "start_ms", "end_ms", "frames", "mean", "error"])
            yield out.astype({"clip": "Int32", "start_ms": "Int64", "end_ms": "Int64", "frames": "Int64", "mean": "Float64"})

    rows = df.select(F.col(key).alias(value), F.col(media).alias(file)).mapInPandas(run, f"{value} {kind}, {CLIP}, error string")
    return rows.withColumnRenamed(value, key)


def digest(doc_id, media: bytes, size: int) -> tuple:
    found = index_avi(media)
    samples = decode_frames(found.frames)
    payload = samples.tobytes()[: found.size]
    parts = cut(found, samples)
    feature = f"frames={len(samples)};shots={len(parts)};longest={max(c[3] for c in parts)};mean={int(samples.sum(dtype=np.int64)) // samples.size}"
    named = [dict(zip(("clip", "start_ms", "end_ms", "frames", "mean"), c, strict=True)) for c in parts]
    return doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, named


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table ``doc_id, n_bytes, media``: each text's UTF-8 bytes and zeros up to a positive multiple of 64, as AVI.

    Null and empty texts are 64 zeros; rows are not merged, so repeated ones stay.
    """

    def code(batches):
        import pyarrow as pa

        for whole in batches:
            for b in tokens.slices(whole, 512):
                raw = [(t or "").encode() for t in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_avi(x + bytes(-len(x) % 64 or 64 * (not x))) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return common.materialize(rows.mapInArrow(code, "doc_id long, n_bytes long, media binary"), "media")


def op9_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(batches):
        import pyarrow as pa

        clip = pa.struct([("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int64()), ("mean", pa.float64())])
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip)]
        for whole in batches:
            for b in tokens.slices(whole, 512):
                rows = [digest(k, m, n) for k, n, m in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)

    NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    stored = store_texts(common.table(spark, sf_dir, "documents"))
    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,start_ms:long,end_ms:long,frames:long,mean:double>>")
