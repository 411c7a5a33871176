"""Colour spaces as columns: a pixel is three columns, a change of space three expressions over them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Pixel = tuple[Column, Column, Column]

# fixed values: the matrices, white point and knees of the spaces
YUV = ((0.299, 0.587, 0.114), (-0.147, -0.289, 0.436), (0.615, -0.515, -0.100))
FROM_YUV = ((1.0, 0.0, 1.14), (1.0, -0.396, -0.581), (1.0, 2.029, 0.0))
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FROM_XYZ = ((3.2404813432005266, -1.5371515162713185, -0.4985363261688878), (-0.9692549499965682, 1.8759900014898907, 0.0415559265582928), (0.0556466391351772, -0.2040413383665112, 1.0573110696453443))
WHITE = (0.95047, 1.0, 1.08883)
EPS = 1e-8


def mixed(matrix, p: Pixel) -> Pixel:
    """A matrix times a pixel."""
    return tuple(a * p[0] + b * p[1] + c * p[2] for a, b, c in matrix)


def _linear(v: Column) -> Column:
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def _curved(v: Column) -> Column:
    return F.when(v > 0.0031308, 1.055 * F.pow(F.greatest(v, F.lit(0.0031308)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)


def to_lab(p: Pixel) -> Pixel:
    f = lambda t: F.when(t > 0.008856, F.pow(F.greatest(t, F.lit(0.008856)), F.lit(1 / 3))).otherwise(7.787 * t + 4 / 29)
    x, y, z = (f(v / w) for v, w in zip(mixed(XYZ, tuple(map(_linear, p))), WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def from_lab(p: Pixel) -> Pixel:
    y = (p[0] + 16) / 116
    back = lambda t, w: F.when(t > 0.2068966, t * t * t).otherwise((t - 4 / 29) / 7.787) * w
    xyz = tuple(back(t, w) for t, w in zip((p[1] / 500 + y, y, F.greatest(y - p[2] / 200, F.lit(0.0))), WHITE, strict=True))
    return tuple(F.least(F.greatest(_curved(v), F.lit(0.0)), F.lit(1.0)) for v in mixed(FROM_XYZ, xyz))


def _hue(p: Pixel, top: Column, span: Column) -> Column:
    """The hue in radians: the first of the largest channels says which sixth it is in; 0 for grey."""
    r, g, b = p
    width = F.when(span == 0, F.lit(1.0)).otherwise(span)
    sixths = F.when(r == top, (g - b) / width).when(g == top, 2 + (b - r) / width).otherwise(4 + (r - g) / width)
    return F.pmod(sixths / 6, F.lit(1.0)) * (2 * math.pi)


def _turned(h: Column, at: int) -> Column:
    """How far the hue is from a channel's own, in sixths, as the ramps of both cylinders use it."""
    return F.pmod(at + h * (6 / (2 * math.pi)), F.lit(6.0))


def to_hsv(p: Pixel) -> Pixel:
    top, low = F.greatest(*p), F.least(*p)
    return _hue(p, top, top - low), (top - low) / (top + EPS), top


def from_hsv(p: Pixel) -> Pixel:
    h, s, v = p
    ramp = lambda k: F.greatest(F.least(k, 4 - k, F.lit(1.0)), F.lit(0.0))
    return tuple(v - v * s * ramp(_turned(h, n)) for n in (5, 3, 1))


def to_hls(p: Pixel) -> Pixel:
    top, low = F.greatest(*p), F.least(*p)
    light = (top + low) / 2
    room = F.when(light < 0.5, top + low).otherwise(2 - (top + low))
    return _hue(p, top, top - low), light, F.when(top == low, F.lit(0.0)).otherwise((top - low) / F.when(room == 0, F.lit(1.0)).otherwise(room))


def from_hls(p: Pixel) -> Pixel:
    h, light, s = p
    reach = s * F.least(light, 1 - light)
    twelfth = lambda n: F.pmod(n + h * (12 / (2 * math.pi)), F.lit(12.0))
    bend = lambda k: F.greatest(F.least(k - 3, 9 - k, F.lit(1.0)), F.lit(-1.0))
    return tuple(light - reach * bend(twelfth(n)) for n in (0, 8, 4))


#: From red, green and blue in [0, 1] to a space, and back.
SPACES = {
    "RGB": (lambda p: p, lambda p: p),
    "YUV": (lambda p: mixed(YUV, p), lambda p: mixed(FROM_YUV, p)),
    "HSV": (to_hsv, from_hsv),
    "HLS": (to_hls, from_hls),
    "LAB": (to_lab, from_lab),
}
