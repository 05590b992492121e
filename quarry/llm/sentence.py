"""SentencePiece encoding and decoding with a max-plus parallel scan over giant documents (operator 8).

The ids are those of the sentencepiece library for the given BPE model file.  A sequence of pieces is the BPE encoding of
its text exactly if every two neighbours are the encoding of their own concatenation, so encoding is a best path in a
lattice of pieces whose steps weigh 0 (neighbours that agree) or minus infinity.  That makes it a max-plus product:

* a document of over ``chunk`` characters is cut into chunks; a boundary's states are the pieces that can cover the
  character before the cut (a few dozen, found from 16 characters on either side);
* each chunk yields the transfer matrix between the states of its two boundaries, on its own; no piece holds a space
  after another character, so a chunk with a word start in it has a matrix of rank one and only its edges are searched;
* the matrices of a document are combined associatively, which fixes the state at each boundary;
* each chunk is then traced back on its own between its two states, its inner words by the library.

Entries are kept as booleans (true: 0, false: minus infinity), products are max-plus products of such matrices.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CHUNK = 32_768
SPACE = "▁"


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message."""

    def varint(i):
        r = s = 0
        while True:
            r |= (raw[i] & 127) << s
            s += 7
            i += 1
            if raw[i - 1] < 128:
                return r, i

    i = 0
    while i < len(raw):
        k, i = varint(i)
        if k & 7 == 0:
            v, i = varint(i)
        elif k & 7 == 2:
            n, i = varint(i)
            v, i = raw[i : i + n], i + n
        else:
            n = 4 if k & 7 == 5 else 8
            v, i = raw[i : i + n], i + n
        yield k >> 3, v


class Model:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix, as the library reads it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    d = dict(_fields(value))
                    piece, kind, n = d[1].decode(), d.get(3, 1), len(self.bytes)
                    self.bytes.append(bytes([int(piece[3:5], 16)]) if kind == 6 else piece.encode() if kind == 1 else b"")
                    if kind == 1:
                        self.score[piece], self.id[piece] = struct.unpack("<f", d[2])[0], n
                    elif kind == 6:
                        self.byte_id[int(piece[3:5], 16)] = n
        self.longest = max(map(len, self.id))
        self._agree: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def merge(self, s: str) -> list[str]:
        """The encoding of a short string by its definition: the best-scored neighbours merge first, leftmost of equals."""
        parts = list(s)
        while True:
            best = max(((self.score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def whole(self, s: str) -> bool:
        """Whether ``s`` is a piece that its own encoding gives; any single character is one."""
        if len(s) == 1:
            return True
        if s not in self.score:
            return False
        if s not in self._whole:
            self._whole[s] = self.merge(s) == [s]
        return self._whole[s]

    def agree(self, x: str, y: str) -> bool:
        """Whether ``x y`` is the encoding of ``xy``."""
        if y[0] == SPACE != x[-1]:
            return True
        if (x, y) not in self._agree:
            if len(self._agree) > 200_000:
                self._agree.clear()
            self._agree[x, y] = self.merge(x + y) == [x, y]
        return self._agree[x, y]

    def ids(self, piece: str) -> list[int]:
        return [self.id[piece]] if piece in self.id else [self.byte_id[b] for b in piece.encode()]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1) if texts else []

    def words(self, s: str) -> list[int]:
        """Ids of inner text that starts with a word's space sign: the library adds that sign itself."""
        return self.library.encode(s[1:].replace(SPACE, " "), num_threads=1) if len(s) > 1 else self.ids(s)

    def decode(self, ids, first: bool = True) -> str:
        """Text of ids; ``first``: they begin a document, whose leading space was added."""
        s = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return s[1:] if first and s[:1] == " " else s


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def signs(text: str) -> str:
    """The text as the model's pieces see it."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Chunk:
    """Characters [at, end) of ``s``, the signs of a document from ``at - longest`` to ``end + longest`` (where it has them)."""

    def __init__(self, m: Model, s: str, at: int, end: int, first: bool, last: bool):
        self.m, self.s, self.at, self.end, self.first, self.last = m, s, at, end, first, last
        starts = [x.start() + 1 for x in re.finditer(f"[^{SPACE}]{SPACE}", s[at + m.longest : max(at + m.longest, end - m.longest)])]
        self.inner = (at + m.longest + starts[0], at + m.longest + starts[-1]) if starts and not (first and last) else None

    def states(self, at: int, edge: bool) -> list[tuple[int, int]]:
        """Pieces that can cover the character before ``at``; at a document's start none, at its end only those that end there."""
        if edge and at == self.at:
            return [(at, at)]
        n, s = self.m.longest, self.s
        return [(a, b) for a in range(max(0, at - n), at) for b in range(at, min(len(s), a + n) + 1) if (not edge or b == at) and self.m.whole(s[a:b])]

    def entry(self) -> list[tuple[int, int]]:
        return self.states(self.at, self.first)

    def leave(self) -> list[tuple[int, int]]:
        return self.states(self.end, self.last)

    def paths(self, sources: dict[tuple[int, int], int], goals: list[tuple[int, int]]) -> tuple[dict, dict]:
        """Which sources reach which pieces up to the goals: bit sets by piece, and a predecessor of each."""
        s, m = self.s, self.m
        reach, back, ending = dict(sources), {}, {}
        for x in sources:
            ending.setdefault(x[1], []).append(x)
        top = max((g[1] for g in goals), default=0)
        last = max((g[0] for g in goals), default=0)
        for at in range(min(ending, default=top), last + 1):
            for x in ending.pop(at, ()):
                left = s[x[0] : x[1]]
                for b in range(at + 1, min(top, at + m.longest) + 1):
                    right = s[at:b]
                    if m.whole(right) and (not left or m.agree(left, right)):
                        y = (at, b)
                        if y not in reach:
                            ending.setdefault(b, []).append(y)
                            back[y] = x
                        reach[y] = reach.get(y, 0) | reach[x]
        return reach, back

    def transfer(self) -> np.ndarray:
        """The matrix: [i, j] true if some path leads from entry state i to leaving state j."""
        entry, leave = self.entry(), self.leave()
        out = np.zeros((len(entry), len(leave)), bool)
        sources = {x: 1 << i for i, x in enumerate(entry)}
        if self.inner:
            a, b = self.inner
            ends = [(x, a) for x in range(a - self.m.longest, a) if self.m.whole(self.s[x:a])]
            reach, _ = self.paths(sources, ends)
            bits = 0
            for e in ends:
                bits |= reach.get(e, 0)
            after, _ = self.paths({(b, b): 1}, leave)
            for j, y in enumerate(leave):
                if after.get(y):
                    out[:, j] = [bool(bits >> i & 1) for i in range(len(entry))]
            return out
        reach, _ = self.paths(sources, leave)
        for j, y in enumerate(leave):
            if y in sources:  # a piece that covers the whole chunk
                out[entry.index(y), j] = True
            elif bits := reach.get(y, 0):
                out[:, j] = [bool(bits >> i & 1) for i in range(len(entry))]
        return out

    def trace(self, i: int, j: int) -> list[int]:
        """Ids of the pieces after entry state i up to and with leaving state j."""
        source, goal = self.entry()[i], self.leave()[j]
        if source == goal:
            return []
        if not self.inner:
            return self._walk(source, goal)
        a, b = self.inner
        reach, back = self.paths({source: 1}, ends := [(x, a) for x in range(a - self.m.longest, a)])
        end = next(e for e in ends if e in reach)
        return self._walk(source, end, back) + (self.m.words(self.s[a:b]) if b > a else []) + self._walk((b, b), goal)

    def _walk(self, source, goal, back=None) -> list[int]:
        if back is None:
            _, back = self.paths({source: 1}, [goal])
        path = []
        while goal != source:
            path.append(self.s[goal[0] : goal[1]])
            goal = back[goal]
        return [x for p in reversed(path) for x in self.m.ids(p)]


def combine(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary of the path through a document: a tree of associative products, then a descent.

    The descent picks a state for the middle boundary of every node from the two halves' matrices.
    """
    tree = [matrices]
    while len(tree[-1]) > 1:
        low = tree[-1]
        tree.append([(low[k].astype(np.uint8) @ low[k + 1].astype(np.uint8)) > 0 if k + 1 < len(low) else low[k] for k in range(0, len(low), 2)])
    ends = [(int(i), int(j)) for i, j in np.argwhere(tree[-1][0])[:1]]
    if not ends:
        raise ValueError("no path")
    for low in reversed(tree[:-1]):
        out = []
        for k, (i, j) in enumerate(ends):
            if 2 * k + 1 < len(low):
                mid = int(np.flatnonzero(low[2 * k][i] & low[2 * k + 1][:, j])[0])
                out += [(i, mid), (mid, j)]
            else:
                out.append((i, j))
        ends = out
    return [ends[0][0], *(j for _, j in ends)]


def split(text: str, chunk: int, context: int) -> list[tuple[int, str, int, int]]:
    """(number, signs with context, at, end within them) of a document's chunks."""
    s = signs(text)
    cuts = list(range(0, len(s), chunk)) or [0]
    out = []
    for k, a in enumerate(cuts):
        b = min(len(s), a + chunk)
        low = max(0, a - context)
        out.append((k, s[low : b + context], a - low, b - low))
    return out


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row, chunk, chunks, ids``: the ids of every document, giant ones in several rows in the order of ``chunk``.

    ``row`` tells rows of equal or null doc_id apart.  Null and empty texts have one row with no ids.  Columns other than
    the two are not read.  A document's text itself is one cell, so under 2 GB; its chunks spread over all tasks.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk

    def short(batches):
        import pyarrow as pa

        m = model(path)
        for whole in batches:
            for b in tokens.slices(whole, 128):
                lists = m.encode(b["text"].to_pylist())
                n, ends = b.num_rows, np.cumsum([0, *map(len, lists)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))))
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), ids], names=["doc_id", "row", "chunk", "chunks", "ids"])

    def cut(batches):
        import pyarrow as pa

        m = model(path)
        for whole in batches:
            for b in tokens.slices(whole, 16):
                out = []
                for d, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    parts = split(t, chunk, m.longest)
                    out += [(d, r, k, len(parts), s, a, e) for k, s, a, e in parts]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "row", "chunk", "chunks", "signs", "at", "end"])

    def piece(s, k, n, a, e):
        return Chunk(model(path), s, a, e, k == 0, k == n - 1)

    @F.pandas_udf("binary")
    def transfer(s, k, n, a, e):
        import pandas as pd

        out = []
        for x in zip(s, k, n, a, e, strict=True):
            t = piece(*x).transfer()
            out.append(struct.pack("<II", *t.shape) + np.packbits(t).tobytes())
        return pd.Series(out)

    def fix(pdf):
        import pandas as pd

        pdf = pdf.sort_values("chunk")
        mats = []
        for raw in pdf["transfer"]:
            a, b = struct.unpack_from("<II", raw)
            mats.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=a * b).reshape(a, b).astype(bool))
        at = combine(mats)
        return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "enter": at[:-1], "leave": at[1:]})

    @F.pandas_udf("array<int>")
    def trace(s, k, n, a, e, i, j):
        import pandas as pd

        return pd.Series([piece(*x[:5]).trace(*x[5:]) for x in zip(s, k, n, a, e, i, j, strict=True)])

    parts = common.materialize(rows.filter(is_long).mapInArrow(cut, "doc_id long, row long, chunk int, chunks int, signs string, at int, end int"), "chunks")
    args = ["signs", "chunk", "chunks", "at", "end"]
    mats = common.materialize(parts.repartition("row", "chunk").select("row", "chunk", transfer(*args).alias("transfer")), "transfers")
    states = mats.groupBy("row").applyInPandas(fix, "row long, chunk int, enter int, leave int")
    giant = parts.join(states, ["row", "chunk"]).select("doc_id", "row", "chunk", "chunks", trace(*args, "enter", "leave").alias("ids"))
    return rows.filter(~is_long).mapInArrow(short, "doc_id long, row long, chunk int, chunks int, ids array<int>").unionByName(giant)


def _times(matrix: tuple[int, ...], vector: int) -> int:
    """A product over GF(2)."""
    out = 0
    for row in matrix:
        if not vector:
            break
        out ^= row * (vector & 1)
        vector >>= 1
    return out


@cache
def _zeros(power: int) -> tuple[int, ...]:
    """The matrix that takes a CRC register through 2**power zero bits."""
    if power == 0:
        return (0xEDB88320, *(1 << i for i in range(31)))
    half = _zeros(power - 1)
    return tuple(_times(half, r) for r in half)


def _crc_shift(crc: int, length: int) -> int:
    """The CRC register after ``length`` zero bytes."""
    power = 3
    while length:
        if length & 1:
            crc = _times(_zeros(power), crc)
        length >>= 1
        power += 1
    return crc


def crc_join(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of a concatenation from its parts' (crc, length)."""
    out = 0
    for crc, n in parts:
        out = _crc_shift(out, n) ^ crc
    return out


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_crc32, decoded_chars, decoded_crc32`` (of the text decoded from the ids, in UTF-8).

    The document's figures are combined from its chunks'; ids and texts aren't gathered.
    """
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def measure(batches):
        import pyarrow as pa

        m = model(path)
        for whole in batches:
            for b in tokens.slices(whole):
                out = []
                lists = b["ids"]
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                for d, r, k, n, at, end in zip(*(c.to_pylist() for c in b.columns[:4]), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    ids = flat[at:end]
                    text = m.decode(ids.tolist(), k == 0)
                    back = text.encode()
                    out.append((d, r, k, n, len(ids), zlib.crc32(ids.astype("<i4").tobytes()), len(text), len(back), zlib.crc32(back)))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def join(pdf):
        import pandas as pd

        p = pdf.sort_values("chunk")
        crc = crc_join([(c, 4 * n) for c, n in zip(p["crc"].tolist(), p["n"].tolist(), strict=True)])
        text = crc_join(list(zip(p["text_crc"].tolist(), p["n_bytes"].tolist(), strict=True)))
        return pd.DataFrame([(p["doc_id"].iloc[0], p["n"].sum(), crc, p["n_chars"].sum(), text)], columns=["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "decoded_crc32"])

    names = ["doc_id", "row", "chunk", "chunks", "n", "crc", "n_chars", "n_bytes", "text_crc"]
    out = common.materialize(encode(common.table(spark, sf_dir, "documents"), path).mapInArrow(measure, "doc_id long, row long, chunk int, chunks int, n long, crc long, n_chars long, n_bytes long, text_crc long"), "measured")
    one = out.filter("chunks = 1").select("doc_id", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), F.col("n_chars").alias("decoded_chars"), F.col("text_crc").alias("decoded_crc32"))
    many = out.filter("chunks > 1").groupBy("row").applyInPandas(join, "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, decoded_crc32 long")
    return one.unionByName(many)
