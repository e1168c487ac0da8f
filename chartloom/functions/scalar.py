"""Scalar Column functions: finite tests, transforms, Morton codes, frustum planes, cosine.

NULL plays the part of NaN on input.  Transforms keep the row and give NaN where a
value is not finite; aggregates elsewhere drop such values first.
"""

from __future__ import annotations

from functools import lru_cache, reduce
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def col(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def finite(*columns: str | Column) -> Column:
    """All columns are numbers other than NaN and the infinities."""
    out = F.lit(True)
    for c in map(col, columns):
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)
    return out


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, to the microsecond."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / F.lit(1e6)


def normalize(v: str | Column, lo: Column, hi: Column) -> Column:
    """(v - lo) / (hi - lo) held within [0, 1]; 0 where hi is not above lo; NaN where v is not finite."""
    v = col(v)
    inside = F.when(hi > lo, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(v - lo, hi - lo)))).otherwise(0.0)
    return F.when(finite(v), inside).otherwise(NAN)


def log_transform(v: str | Column, base: float = math.e) -> Column:
    """Logarithm to a base; NaN for values that are not finite and above 0."""
    v = col(v)
    return F.when(finite(v) & (v > 0), F.ln(v) / F.lit(math.log(base))).otherwise(NAN)


def ln_transform(v: str | Column) -> Column:
    v = col(v)
    return F.when(finite(v) & (v > 0), F.ln(v)).otherwise(NAN)


def log10_transform(v: str | Column) -> Column:
    v = col(v)
    return F.when(finite(v) & (v > 0), F.log10(v)).otherwise(NAN)


def power_transform(v: str | Column, exponent: float) -> Column:
    """v to a power; NaN for values that are not finite, and for negative bases with fractional exponents."""
    v = col(v)
    return F.when(finite(v), F.pow(v, F.lit(float(exponent)))).otherwise(NAN)


def half_up(v: Column, places: int) -> Column:
    """Rounds halves toward plus infinity, as display rounding does."""
    scale = float(10**places)
    return F.floor(v * scale + 0.5) / scale


def _spread_byte(value: int, dims: int) -> int:
    """The bits of a byte, ``dims`` places apart."""
    return sum((value >> i & 1) << (i * dims) for i in range(8))


@lru_cache(maxsize=None)
def _table(dims: int, back: bool) -> str:
    """SQL of the array of spread bytes, or of the byte nibbles that spread bits came from."""
    if not back:
        return "array(" + ",".join(f"{_spread_byte(v, dims)}L" for v in range(256)) + ")"
    # Of so many spread bits as hold whole source bits: 8 for two axes, 9 for three.
    width = 8 if dims == 2 else 9
    return "array(" + ",".join(f"{sum((v >> (i * dims) & 1) << i for i in range(width // dims))}L" for v in range(1 << width)) + ")"


def _spread(x: Column, dims: int, bits: int) -> Column:
    """The bits of a whole number, ``dims`` places apart, by bytes: the number is used once for each."""
    parts = []
    for k in range(0, bits, 8):
        byte = F.get(F.expr(_table(dims, False)), F.shiftrightunsigned(x, k).bitwiseAND(F.lit(255)).cast("int"))
        parts.append(F.shiftleft(byte, k * dims) if k else byte)
    return reduce(Column.bitwiseOR, parts)


def _compact(x: Column, dims: int, bits: int) -> Column:
    width, parts = (8 if dims == 2 else 9), []
    for k in range(0, bits, width // dims):
        some = F.get(F.expr(_table(dims, True)), F.shiftrightunsigned(x, k * dims).bitwiseAND(F.lit((1 << width) - 1)).cast("int"))
        parts.append(F.shiftleft(some, k) if k else some)
    return reduce(Column.bitwiseOR, parts)


AXIS_BITS = 21
AXIS_MAX = (1 << AXIS_BITS) - 1


def morton2(x: Column, y: Column) -> Column:
    """Interleaves two whole numbers of up to 32 bits; x takes the even bits."""
    return _spread(x.cast("long"), 2, 32).bitwiseOR(F.shiftleft(_spread(y.cast("long"), 2, 32), 1))


def morton3(x: Column, y: Column, z: Column) -> Column:
    """Interleaves the low 21 bits of three whole numbers."""
    a, b, c = (_spread(v.cast("long").bitwiseAND(F.lit(AXIS_MAX)), 3, AXIS_BITS) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def unmorton2(code: Column) -> tuple[Column, Column]:
    return tuple(_compact(F.shiftrightunsigned(code, k), 2, 32) for k in (0, 1))


def unmorton3(code: Column) -> tuple[Column, Column, Column]:
    return tuple(_compact(F.shiftrightunsigned(code, k), 3, AXIS_BITS) for k in (0, 1, 2))


def axis_code(v: Column, lo: Column, hi: Column) -> Column:
    """A coordinate as a whole number of 21 bits over its range; a range of no width counts as 1."""
    width = F.when(hi > lo, hi - lo).otherwise(1.0)
    return F.floor((v - lo) / width * float(AXIS_MAX)).cast("long")


def frustum_planes(mvp: list[float]) -> list[tuple[float, float, float, float]]:
    """Left, right, bottom, top, near and far planes of a column-major 4 x 4 matrix, of unit normals."""
    if len(mvp) != 16:
        raise ValueError("a matrix of 16 values is needed")
    row = [[mvp[4 * c + r] for c in range(4)] for r in range(4)]
    out = []
    for axis in range(3):
        for sign in (1.0, -1.0):
            plane = [row[3][k] + sign * row[axis][k] for k in range(4)]
            size = math.sqrt(sum(v * v for v in plane[:3]))
            out.append(tuple(v / size for v in plane) if size > 1e-12 else tuple(plane))
    return out


def in_frustum(x: str | Column, y: str | Column, z: str | Column, planes: list[tuple[float, float, float, float]]) -> Column:
    """On the inner side of every plane, or on it; false for points that are not finite."""
    x, y, z = col(x), col(y), col(z)
    out = finite(x, y, z)
    for a, b, c, d in planes:
        out = out & (x * float(a) + y * float(b) + z * float(c) + float(d) >= 0)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles within [0, 1]; 0 for unlike lengths, empty or zero arrays."""
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)) for v in (a, b)]
    value = F.try_divide(dot, size[0] * size[1])
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))).otherwise(0.0)
