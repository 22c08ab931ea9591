"""Scalar column functions: quantization, octahedral normals, residual coding and bit counts.

Single precision is kept step by step: Spark's float division gives a double, so each result is cast back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(c: Column) -> Column:
    return c.cast("float")


def quantize(x: Column, low: Column, span: Column, bits: int) -> Column:
    """floor((x - low) * (max / span) + 0.5) in single precision."""
    check_bits(bits, 1, 31)
    scale = f32(F.lit(float((1 << bits) - 1)) / span)
    return F.floor(f32(f32(f32(x - low) * scale) + F.lit(0.5).cast("float"))).cast("int")


def dequantize(q: Column, low: Column, span: Column, bits: int) -> Column:
    check_bits(bits, 1, 31)
    step = f32(span / F.lit(float((1 << bits) - 1)))
    return f32(f32(f32(q) * step) + low)


def check_bits(bits: int, low: int, high: int) -> None:
    if not low <= bits <= high:
        raise ValueError(f"bits must be {low} to {high}, not {bits}")


def octahedral(x: Column, y: Column, z: Column, bits: int) -> tuple[Column, Column]:
    """Unit vector to octahedral (s, t), before corners and edges are made canonical. A vector of no length maps as (1, 0, 0)."""
    check_bits(bits, 2, 30)
    center = (1 << (bits - 1)) - 1
    x, y, z = (v.cast("double") for v in (x, y, z))
    norm = F.abs(x) + F.abs(y) + F.abs(z)
    small = norm <= 1e-6
    a = F.when(small, F.lit(center)).otherwise(F.floor(x / norm * center + 0.5).cast("int"))
    b = F.when(small, F.lit(0)).otherwise(F.floor(y / norm * center + 0.5).cast("int"))
    over = center - F.abs(a) - F.abs(b)
    b2 = F.when(over < 0, F.when(b > 0, b + over).otherwise(b - over)).otherwise(b)
    c = F.greatest(over, F.lit(0)) * F.when(z < 0, F.lit(-1)).otherwise(F.lit(1))
    front = a >= 0
    s = F.when(front, b2 + center).otherwise(F.when(b2 < 0, F.abs(c)).otherwise(2 * center - F.abs(c)))
    t = F.when(front, c + center).otherwise(F.when(c < 0, F.abs(b2)).otherwise(2 * center - F.abs(b2)))
    return s, t


def canonical_octahedral(s: Column, t: Column, bits: int) -> tuple[Column, Column]:
    """One name for each point of the square's border, which the folding leaves with two (four for the corners)."""
    center = (1 << (bits - 1)) - 1
    top = 2 * center
    corner = ((s == 0) & (t == 0)) | ((s == 0) & (t == top)) | ((s == top) & (t == 0))
    s2 = F.when(corner, F.lit(top)).when((t == top) & (s < center), top - s).when((t == 0) & (s > center), top - s).otherwise(s)
    t2 = F.when(corner, F.lit(top)).when((s == 0) & (t > center), top - t).when((s == top) & (t < center), top - t).otherwise(t)
    return s2, t2


def octahedral_vector(s: Column, t: Column, bits: int) -> tuple[Column, Column, Column]:
    """Octahedral (s, t) to a unit vector, in double precision."""
    top = float((1 << bits) - 2)
    y, z = s.cast("double") * (2 / top) - 1, t.cast("double") * (2 / top) - 1
    x = 1 - F.abs(y) - F.abs(z)
    fold = F.greatest(F.lit(0.0), -x)
    y = y + F.when(y < 0, fold).otherwise(-fold)
    z = z + F.when(z < 0, fold).otherwise(-fold)
    norm = x * x + y * y + z * z
    inverse = F.when(norm < 1e-6, F.lit(0.0)).otherwise(1 / F.sqrt(norm))
    return x * inverse, y * inverse, z * inverse


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, u / 2).otherwise(-(u + 1) / 2).cast("long")


def wrapped(residual: Column, low: Column, high: Column) -> Column:
    """A residual brought into the half-open range of the values' width around zero."""
    width = 1 + high - low
    top = F.floor(width / 2) - F.when(width % 2 == 0, 1).otherwise(0)
    least = -F.floor(width / 2)
    return F.when(residual < least, residual + width).when(residual > top, residual - width).otherwise(residual)


def bit_length(v: Column) -> Column:
    """Significant bits of a non-negative integer, 0 for 0."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v)))


def varint_length(v: Column) -> Column:
    """Bytes of a base-128 varint."""
    return F.greatest(F.lit(1), F.ceil(bit_length(v) / 7)).cast("int")


def table_precision(bits: Column) -> Column:
    """Precision of an entropy coder's probability table for symbols of so many bits."""
    return F.least(F.lit(20), F.greatest(F.lit(12), F.floor(3 * bits / 2))).cast("int")


def table_bits(largest: Column, unique: Column) -> Column:
    """Estimated size of such a table: eight bits a symbol used, and as much for each and for every run of 64 unused."""
    return 8 * unique + 8 * (unique + F.floor(F.greatest(F.lit(0), largest - unique) / 64))


def reverse_bits32(v: Column) -> Column:
    """The 32 bits of a natural number in the other order."""
    return F.conv(F.reverse(F.lpad(F.bin(v), 32, "0")), 2, 10).cast("long")


def increment_mod(v: Column, n: int) -> Column:
    return F.pmod(v + 1, F.lit(n))


def int_sqrt(v: Column) -> Column:
    """The greatest integer whose square is at most v, also where the root of a double is rounded up or down."""
    r = F.floor(F.sqrt(v.cast("double"))).cast("long")
    return F.when(r * r > v, r - 1).when((r + 1) * (r + 1) <= v, r + 1).otherwise(r)


def narrowed(v: Column, bits: int, signed: bool = True) -> Column:
    """The lowest bits of an integer as a number of so many bits: values wrap."""
    low = F.pmod(v, F.lit(1 << bits))
    return F.when(low >= (1 << (bits - 1)), low - (1 << bits)).otherwise(low) if signed else low


def binary_entropy(ones: Column, total: Column) -> Column:
    """Bits of so many ones among total bits, for one of them; 0 where all are alike."""
    p = ones.cast("double") / total
    return F.when((ones == 0) | (ones == total), F.lit(0.0)).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def in_diamond(s: Column, t: Column, center: int) -> Column:
    return F.abs(s) + F.abs(t) <= center


def in_bottom_left(s: Column, t: Column) -> Column:
    return ((s == 0) & (t == 0)) | ((s < 0) & (t <= 0))


def inverted_diamond(s: Column, t: Column, center: int) -> tuple[Column, Column]:
    """The point on the other side of the diamond's edge in the same quarter; applied twice it gives the point back."""
    both, none = (s >= 0) & (t >= 0), (s <= 0) & (t <= 0)
    a = F.when(both, 1).when(none, -1).otherwise(F.when(s > 0, 1).otherwise(-1))
    b = F.when(both, 1).when(none, -1).otherwise(F.when(t > 0, 1).otherwise(-1))
    x, y = 2 * s - a * center, 2 * t - b * center
    alike = a * b > 0
    x, y = F.when(alike, -y).otherwise(y), F.when(alike, -x).otherwise(x)
    half = lambda v: F.when(v < 0, -F.floor(-v / 2)).otherwise(F.floor(v / 2))
    return half(x + a * center), half(y + b * center)


def canonical_vector(x: Column, y: Column, z: Column, center: int) -> tuple[Column, Column, Column]:
    """An integer vector scaled so that its absolute values add up to center, divisions toward zero; one of no length becomes (center, 0, 0)."""
    total = F.abs(x) + F.abs(y) + F.abs(z)
    part = lambda v: F.when(v < 0, -F.floor(-v * center / total)).otherwise(F.floor(v * center / total))
    a, b = part(x), part(y)
    c = center - F.abs(a) - F.abs(b)
    none = total == 0
    return F.when(none, center).otherwise(a), F.when(none, 0).otherwise(b), F.when(none, 0).when(z < 0, -c).otherwise(c)
