"""Number formats as columns: the bits of a double as a long, and rounding to bfloat16 and to E4M3.

Spark has no function that looks at a number's bits. Its exponent is found by a logarithm and put right by one where
that missed a power of two; all scaling is by powers of two and so exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelode.functions.arrays import let


def _inf() -> Column:
    return F.lit(float("inf"))


def _nan() -> Column:
    return F.lit(float("nan"))


def _two(e: Column) -> Column:
    """2**e for a whole e from -1074 to 1023, in two factors that are powers of two themselves."""
    half = F.floor(e / 2)
    return F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - half)


def exponent(x: Column, least: int) -> Column:
    """The whole e with 2**e <= |x| < 2**(e + 1), at least least; for finite numbers. 0 has least."""

    def corrected(a: Column, e: Column) -> Column:
        lower = F.when((_two(e) > a) & (e > least), e - 1).otherwise(e)
        # 2**1024 isn't a number: nothing finite reaches it
        return let(lower, lambda f: F.when((f < 1023) & (_two(F.least(f + 1, F.lit(1023))) <= a), f + 1).otherwise(f))

    guess = lambda a: F.least(F.greatest(F.floor(F.log2(F.greatest(a, F.lit(5e-324)))), F.lit(least)), F.lit(1023))
    return let(F.abs(x), lambda a: let(guess(a), lambda e: corrected(a, e)))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < _inf())


def _negative(x: Column) -> Column:
    """Whether the sign bit is set, that of zero too."""
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def to_bits(x: Column) -> Column:
    """The 64 bits of a double as a long. Every NaN is the one with only the quiet bit."""

    def size(a: Column, e: Column) -> Column:
        # below 2**-1022 there is no leading one and the exponent's field is 0
        whole = F.shiftleft(e + 1023, 52).bitwiseOR(((a / _two(e) - 1) * F.lit(2.0**52)).cast("long"))
        return F.when(a < F.lit(2.2250738585072014e-308), ((a * F.lit(2.0**537)) * F.lit(2.0**537)).cast("long")).otherwise(whole)

    def signed(v: Column) -> Column:
        finite = let(F.when(_finite(v), F.abs(v)).otherwise(F.lit(1.0)), lambda a: let(exponent(a, -1022), lambda e: size(a, e)))
        out = F.when(F.isnan(v), F.lit(0x7FF8 << 48)).when(F.abs(v) == _inf(), F.lit(0x7FF0 << 48)).otherwise(finite)
        return F.when(_negative(v) & ~F.isnan(v), out.bitwiseOR(F.lit(-(1 << 63)))).otherwise(out)

    return F.when(x.isNull(), F.lit(None).cast("long")).otherwise(let(x.cast("double"), signed))


def from_bits(bits: Column) -> Column:
    """The double that a long's bits are."""
    field = F.shiftright(bits, 52).bitwiseAND(0x7FF)
    mantissa = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    small = (mantissa * F.lit(2.0**-537)) * F.lit(2.0**-537)
    plain = (F.lit(1.0) + mantissa * F.lit(2.0**-52)) * _two(F.greatest(F.least(field, F.lit(2046)), F.lit(1)) - 1023)
    size = F.when(field == 0x7FF, F.when(mantissa == 0, _inf()).otherwise(_nan())).when(field == 0, small).otherwise(plain)
    return F.when(bits < 0, -size).otherwise(size)


def _rounded(x: Column, places: int, least: int) -> Column:
    """Finite numbers rounded half to even to places binary digits behind the leading one, 2**(least - places) at least
    between neighbours."""
    return let(_two(exponent(x, least) - places), lambda step: F.rint(x / step) * step)


def bf16(x: Column) -> Column:
    """A number as bfloat16 holds it: first a float, then rounded half to even to 7 places; too large ones are infinite."""

    def near(v: Column) -> Column:
        sign = lambda n: F.when(n < 0, -_inf()).otherwise(_inf())
        return let(_rounded(v, 7, -126), lambda n: F.when(F.abs(n) >= F.lit(2.0**128), sign(n)).otherwise(n))

    return let(x.cast("float").cast("double"), lambda v: F.when(_finite(v), let(F.when(_finite(v), v).otherwise(F.lit(0.0)), near)).otherwise(v))


def e4m3(x: Column) -> Column:
    """A number as 8 bits with 4 of exponent hold it: cut to [-448, 448], rounded half to even; NaN stays."""
    cut = lambda v: F.greatest(F.least(F.when(F.isnan(v), F.lit(0.0)).otherwise(v), F.lit(448.0)), F.lit(-448.0))
    return let(x.cast("double"), lambda v: F.when(F.isnan(v), _nan()).otherwise(let(cut(v), lambda c: _rounded(c, 3, -6))))
