"""Points in the plane, in space and on the sphere; the Morton curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_008.8
LIMIT = 1_000_000.0


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def within(a: list[Column], b: list[Column], radius: float) -> Column:
    """Within the radius; the box around it comes first, which scans can use."""
    box = F.lit(True)
    for x, y in zip(a, b, strict=True):
        box = box & x.between(y - radius, y + radius)
    return box & (distance(a, b) <= radius)


def sphere(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), F.lit(2)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def cell(x: Column, bits: int, wrap: bool = False) -> Column:
    """Outside the limits the cell at the edge, so that ranges of the curve cover boxes; with ``wrap`` the low bits of the cell's number."""
    top = (1 << bits) - 1
    at = F.floor((x + LIMIT) / (2 * LIMIT) * top)
    return at.bitwiseAND(F.lit(top)) if wrap else F.least(F.greatest(at, F.lit(0)), F.lit(top)).cast("bigint")


def cell_of(x: float, bits: int) -> int:
    import math

    top = (1 << bits) - 1
    return min(max(math.floor((x + LIMIT) / (2 * LIMIT) * top), 0), top)


def spread(v: int, dims: int, bits: int) -> int:
    return sum((v >> i & 1) << dims * i for i in range(bits))


def morton(*axes: Column, wrap: bool = False) -> Column:
    """Bits of the axes' cells in turn: 31 of two axes, 21 of three."""
    dims = len(axes)
    steps = {2: ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)), 3: ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))}[dims]
    out = F.lit(0).cast("bigint")
    for k, x in enumerate(axes):
        v = cell(x, 31 if dims == 2 else 21, wrap)
        for shift, mask in steps:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(v, k))
    return out


def ranges(low: list[float], high: list[float], most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges of the curve that cover a box: quadrants are split, largest first, while there is room."""
    dims = len(low)
    bits = 31 if dims == 2 else 21
    a, b = [cell_of(x, bits) for x in low], [cell_of(x, bits) for x in high]
    todo, done = [(bits, tuple([0] * dims))], []
    while todo:
        todo.sort()
        level, at = todo.pop()
        size = 1 << level
        if any(x + size - 1 < p or x > q for x, p, q in zip(at, a, b, strict=True)):
            continue
        inside = all(p <= x and x + size - 1 <= q for x, p, q in zip(at, a, b, strict=True))
        if inside or level == 0 or len(todo) + len(done) + (1 << dims) > most:
            start = sum(spread(x, dims, bits) << k for k, x in enumerate(at))
            done.append((start, start + (1 << dims * level) - 1))
            continue
        half = size >> 1
        todo += [(level - 1, tuple(x + half * (c >> k & 1) for k, x in enumerate(at))) for c in range(1 << dims)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(done):
        if out and s == out[-1][1] + 1:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def in_ranges(code: Column, found: list[tuple[int, int]]) -> Column:
    def test(c: Column) -> Column:
        out = F.lit(False)
        for s, e in found:
            out = out | c.between(s, e)
        return out

    return code.between(found[0][0], found[-1][1]) & F.exists(F.array(code), test) if found else F.lit(False)
