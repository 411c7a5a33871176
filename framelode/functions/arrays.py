"""Array columns as vectors: norms, gates, rotations, quantised products. All stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda's variable, where an expression would be computed at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    """x over the root of its mean square."""
    scale = lambda u: F.sqrt(dot(u, u) / F.size(u) + eps)
    return let(x, lambda u: let(scale(u), lambda s: F.transform(u, lambda v: v / s)))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """x less its mean, over the root of its variance."""
    scale = lambda u, m: F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(u) + eps)
    return let(x, lambda u: let(total(u) / F.size(u), lambda m: let(scale(u, m), lambda s: F.transform(u, lambda v: (v - m) / s))))


def gated(residual: Column, x: Column, gate: Column) -> Column:
    """residual + gate * x."""
    return F.zip_with(residual, F.transform(x, lambda v: v * gate), lambda r, v: r + v)


def scaled_shifted(x: Column, scale: Column, shift: Column) -> Column:
    """x * (1 + scale) + shift."""
    return F.transform(x, lambda v: v * (1 + scale) + shift)


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def gelu(v: Column) -> Column:
    """The tanh form."""
    return 0.5 * v * (1 + F.tanh(F.lit(0.7978845608028654) * (v + 0.044715 * v * v * v)))


def halves_gated(x: Column, act) -> Column:
    """act(first half) * second half."""
    n = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda a, b: act(a) * b)


def rotary(x: Column, position: Column, base: float = 10000.0) -> Column:
    """Neighbouring pairs of x turned by position * base**(-2i / n)."""

    def turned(u: Column, v: Column, i: Column) -> Column:
        pair = F.floor(i / 2) * 2
        angle = position * F.pow(F.lit(base), -pair / F.size(u))
        other = F.get(u, F.when(i % 2 == 0, i + 1).otherwise(i - 1).cast("int"))
        return F.when(i % 2 == 0, v * F.cos(angle) - other * F.sin(angle)).otherwise(v * F.cos(angle) + other * F.sin(angle))

    return let(x, lambda u: F.transform(u, lambda v, i: turned(u, v, i)))


def int8_scale(x: Column) -> Column:
    """Largest absolute value over 127; 1 for a zero row."""
    top = F.array_max(F.transform(x, F.abs))
    return F.when(top == 0, F.lit(1.0)).otherwise(top / 127)


def int8(x: Column, scale: Column) -> Column:
    """x in steps of scale, rounded half to even, within -127..127."""
    return F.transform(x, lambda v: F.greatest(F.least(F.rint(v / scale), F.lit(127.0)), F.lit(-127.0)).cast("int"))


def relative_l1(now: Column, before: Column) -> Column:
    """Sum of changes over the sum of absolute earlier values."""
    changes = total(F.zip_with(now, before, lambda a, b: F.abs(a - b)))
    return changes / F.greatest(total(F.transform(before, F.abs)), F.lit(1e-12))


def polynomial(coefficients: list[float], x: Column) -> Column:
    """Horner's value of a polynomial, highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out


def shifted_norm(x: Column, scale: Column, shift: Column, norm=layer_norm, eps: float = 1e-6) -> Column:
    """norm(x) * (1 + scale) + shift."""
    return scaled_shifted(norm(x, eps), scale, shift)


def tanh_norm(x: Column, scale: Column, shift: Column, norm=layer_norm, eps: float = 1e-6) -> Column:
    """norm(x) * tanh(scale) + shift."""
    return F.transform(norm(x, eps), lambda v: v * F.tanh(scale) + shift)


def per_head(x: Column, heads: int, f) -> Column:
    """f of each of heads equal parts of x, put together again."""
    size = lambda u: (F.size(u) / heads).cast("int")
    return let(x, lambda u: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: f(F.slice(u, h * size(u) + 1, size(u))))))


def rotary_halves(x: Column, position: Column, base: float = 10000.0) -> Column:
    """The pair of place i is place i + n / 2 of x; both turned by position * base**(-2i / n)."""

    def turned(u: Column, v: Column, i: Column) -> Column:
        half = (F.size(u) / 2).cast("int")
        angle = position * F.pow(F.lit(base), -2 * (i % half) / F.size(u))
        other = F.get(u, F.when(i < half, i + half).otherwise(i - half).cast("int"))
        return v * F.cos(angle) + F.when(i < half, -other).otherwise(other) * F.sin(angle)

    return let(x, lambda u: F.transform(u, lambda v, i: turned(u, v, i)))


def rotary_angles(position: Column, size: int, theta: float = 10000.0, rescale: float = 1.0, interpolation: float = 1.0) -> Column:
    """The angles of one axis of size places: position * interpolation over rising powers of theta."""
    base = theta * rescale ** (size / (size - 2)) if rescale != 1.0 else theta
    return F.transform(F.sequence(F.lit(0), F.lit(size // 2 - 1)), lambda i: position * interpolation / F.pow(F.lit(base), 2 * i / F.lit(float(size))))


def quick_gelu(v: Column) -> Column:
    return v * sigmoid(1.702 * v)


def mul_add(a: Column, b: Column, c: Column, k: float = 0.0) -> Column:
    """c + a * (k + b), place by place."""
    return F.zip_with(c, F.zip_with(a, b, lambda p, q: p * (k + q)), lambda r, t: r + t)


def fp8_scale(top: Column) -> Column:
    """The largest absolute value over 448; 1 where it is 0."""
    return F.when(top == 0, F.lit(1.0)).otherwise(top / 448)


def bytes_of(values: Column) -> Column:
    """An array of longs as binary, 8 bytes each, low ones first."""
    pairs = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(h, 15 - 2 * i, F.lit(2))), "")
    return F.unhex(F.array_join(F.transform(values, lambda v: pairs(F.lpad(F.hex(v), 16, "0"))), ""))
