"""A decoder of baseline JPEG frames, as motion-JPEG streams hold them.

Tables are read from the frame itself; a frame without Huffman tables (as AVI's motion JPEG allows) takes the standard's
own.  Huffman decoding goes symbol by symbol; dequantising, the inverse transform and the change of colour are done for
all blocks at once.
"""

from __future__ import annotations

import struct

import numpy as np

ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
_U = np.arange(8)
#: Row u: the u-th basis function of the transform at the eight pixels.
BASIS = np.where(_U[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16)

#: The standard's example tables (annex K.3), by (0 DC, 1 AC; 0 luminance, 1 chrominance): codes of each length, symbols.
STANDARD = {
    (0, 0): ("00010501010101010100000000000000", "000102030405060708090a0b"),
    (0, 1): ("00030101010101010101010000000000", "000102030405060708090a0b"),
    (1, 0): (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    (1, 1): (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


class Bad(ValueError):
    """A frame that isn't a whole baseline JPEG."""


def huffman(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For each 16-bit prefix (code length, symbol); length 0 where no code begins so."""
    out, code, at = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            low = code << (16 - length)
            if low >= 65536:
                raise Bad("too many codes")
            out[low : low + (1 << (16 - length))] = [(length, symbol)] * (1 << (16 - length))
            code += 1
        at += n
        code <<= 1
    return out


_tables: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}


def _table(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """Tables are the same in all frames of a stream, so a few are kept."""
    key = (counts, symbols)
    if key not in _tables:
        if len(_tables) >= 16:
            _tables.clear()
        _tables[key] = huffman(counts, symbols)
    return _tables[key]


class _Bits:
    """Bits of one entropy-coded segment, without its stuffed bytes; some zeros follow its end."""

    def __init__(self, raw: bytes):
        raw = raw.replace(b"\xff\x00", b"\xff")
        self.raw, self.at, self.end = raw + bytes(8), 0, 8 * len(raw)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.raw[byte : byte + 4], "big") >> (32 - (self.at & 7) - n)) & ((1 << n) - 1)


def _symbol(bits: _Bits, table) -> int:
    length, symbol = table[bits.peek(16)]
    if not length or bits.at + length > bits.end:
        raise Bad("bad code word or truncated scan")
    bits.at += length
    return symbol


def _receive(bits: _Bits, n: int) -> int:
    if not n:
        return 0
    if bits.at + n > bits.end:
        raise Bad("truncated scan")
    v = bits.peek(n)
    bits.at += n
    return v if v >> (n - 1) else v - (1 << n) + 1


def _block(bits: _Bits, dc, ac, before: int, out: np.ndarray) -> int:
    """Reads one block's coefficients, in zigzag order, into ``out``; its DC value."""
    out[0] = before = before + _receive(bits, _symbol(bits, dc))
    k = 1
    while k < 64:
        s = _symbol(bits, ac)
        run, n = s >> 4, s & 15
        if not n:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise Bad("run beyond the block")
        out[k] = _receive(bits, n)
        k += 1
    return before


def decode(frame: bytes) -> np.ndarray:
    """The picture of a baseline frame: uint8 of shape (height, width), or (height, width, 3) in RGB for three components."""
    if frame[:2] != b"\xff\xd8":
        raise Bad("no start of image")
    quant, tables, restart, parts, size, at = {}, {k: (bytes.fromhex(a), bytes.fromhex(b)) for k, (a, b) in STANDARD.items()}, 0, [], None, 2
    try:
        while True:
            while frame[at] == 0xFF and frame[at + 1] == 0xFF:
                at += 1
            if frame[at] != 0xFF:
                raise Bad("no marker where one is due")
            marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body = frame[at + 4 : at + 2 + n]
            if len(body) != n - 2:
                raise Bad("truncated segment")
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    k = sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + k]
                    body = body[17 + k :]
            elif marker in (0xC0, 0xC1):
                bits, height, width, k = struct.unpack_from(">BHHB", body)
                if bits != 8 or not height or not width or k not in (1, 3):
                    raise Bad("not a picture of 8 bits and one or three components")
                size = (height, width)
                parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise Bad("not a baseline frame")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if size is None or body[0] != len(parts):
                    raise Bad("a scan of all components was expected")
                chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(len(parts))}
                return _scan(frame[at:], size, parts, chosen, quant, tables, restart)
    except (IndexError, KeyError, struct.error) as e:
        raise Bad(f"broken frame: {e!r}") from e


def _segments(data: bytes) -> list[bytes]:
    """The entropy-coded segments between restart markers, up to the end of the image."""
    out, start, at = [], 0, data.find(b"\xff")
    while at >= 0:
        marker = data[at + 1] if at + 1 < len(data) else 0xD9
        if 0xD0 <= marker <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        elif marker not in (0, 0xFF):
            return [*out, data[start:at]]
        at = data.find(b"\xff", at + (1 if marker == 0xFF else 2))
    raise Bad("no end of image")


def _scan(data: bytes, size, parts, chosen, quant, tables, restart: int) -> np.ndarray:
    height, width = size
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    rows, cols = -(-height // (8 * most_v)), -(-width // (8 * most_h))
    coef = [np.zeros((rows * v, cols * h, 64), np.int32) for _, h, v, _ in parts]
    codes = [(_table(*tables[0, chosen[p[0]][0]]), _table(*tables[1, chosen[p[0]][1]])) for p in parts]
    segments = _segments(data)
    units, each = rows * cols, restart or rows * cols
    if len(segments) < -(-units // each):
        raise Bad("truncated scan")
    for k, raw in zip(range(0, units, each), segments, strict=False):
        bits, before = _Bits(raw), [0] * len(parts)
        for unit in range(k, min(units, k + each)):
            y, x = divmod(unit, cols)
            for i, (_, h, v, _) in enumerate(parts):
                for j in range(h * v):
                    before[i] = _block(bits, *codes[i], before[i], coef[i][y * v + j // h, x * h + j % h])
    planes = []
    for (_, h, v, q), c in zip(parts, coef, strict=True):
        flat = np.zeros((*c.shape[:2], 64))
        flat[..., ZIGZAG] = c * quant[q]
        pixels = np.einsum("ux,abuv,vy->axby", BASIS, flat.reshape(*c.shape[:2], 8, 8), BASIS, optimize=True)
        plane = np.clip(np.rint(pixels + 128), 0, 255).reshape(8 * c.shape[0], 8 * c.shape[1])
        planes.append(plane.repeat(most_v // v, 0).repeat(most_h // h, 1)[:height, :width])
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
