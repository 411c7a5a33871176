"""Scalar columns: rounding, alignment, ramps and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def align_up(value: Column, step: int) -> Column:
    """The next multiple of step, for values of at least 0."""
    return F.floor((value + step - 1) / step) * step


def to_byte(x: Column) -> Column:
    """A value in [0, 1] as 0..255: clamped, rounded half to even."""
    return F.rint(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def truncated(x: Column) -> Column:
    """A value in [0, 1] on the grid of 255 steps, cut and not rounded."""
    return (x * 255).cast("int") / F.lit(255.0)


def ramp(i: Column, n: Column, mode: str) -> Column:
    """How much the earlier of two overlapping sequences counts at place i of n (both ends included).

    mode: before, after, linear, cosine, sigmoid or value:r. One place counts for the later sequence.
    """
    t = i / (n - 1)
    name, _, share = mode.strip().lower().partition(":")
    if name == "before":
        return F.lit(1.0)
    if name == "after":
        return F.lit(0.0)
    if name == "value":
        if not 0 <= float(share) <= 1:
            raise ValueError("value:r needs r in [0, 1]")
        weight = F.lit(float(share))
    elif name in ("linear", "cosine", "sigmoid"):
        weight = {"linear": 1 - t, "cosine": F.cos(t * F.lit(1.5707963267948966)), "sigmoid": 1 / (1 + F.exp(t * 12 - 6))}[name]
    else:
        raise ValueError(f"unknown overlap mode {mode!r}")
    return F.when(n <= 1, F.lit(0.0)).otherwise(weight)


def linear_quadratic(i: Column, n: int | Column, threshold: float = 0.025, linear: int | None = None) -> Column:
    """Noise level of step i of n: linear down to 1 - threshold in half of the steps (or in linear of them), then quadratic;
    1.0 where n < 2."""
    n = F.lit(n) if isinstance(n, int) else n
    k = F.greatest(F.floor(n / 2), F.lit(1)) if linear is None else F.lit(linear)
    gap, rest = k - threshold * n, F.greatest(n - k, F.lit(1))
    square = gap / (k * rest * rest)
    slope = threshold / k - 2 * gap / (rest * rest)
    curve = F.when(i < k, 1 - i * threshold / k).otherwise(1 - (square * i * i + slope * i + square * k * k))
    return F.when(n < 2, F.lit(1.0)).otherwise(curve)


def from_byte(x: Column) -> Column:
    """0..255 as a value in [0, 1]."""
    return x / F.lit(255.0)


def signed(x: Column) -> Column:
    """A value in [0, 1] as one in [-1, 1]."""
    return x * 2 - 1


def unsigned(x: Column) -> Column:
    """A value in [-1, 1] as one in [0, 1]; others are cut."""
    return F.least(F.greatest(x / 2 + 0.5, F.lit(0.0)), F.lit(1.0))


def safe_fraction(text: Column) -> Column:
    """"24000/1001" as a number; anything else is 0."""
    parts = F.split(text, "/")
    top, bottom = (F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2))
    return F.coalesce(F.try_divide(top, F.when(F.size(parts) == 1, F.lit(1.0)).otherwise(bottom)), F.lit(0.0))


def shortened(text: Column, limit: int = 200) -> Column:
    """Text for a log: longer than limit is cut and ends in three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def optional_string(text: Column) -> Column:
    """null for null, empty and "N/A"."""
    return F.nullif(F.nullif(text, F.lit("")), F.lit("N/A"))


def distance(num: Column, den: Column) -> Column:
    """num / den with the denominator kept from zero."""
    return num / F.greatest(den, F.lit(1e-12))


def latent_frames(frames: Column, ratio: int) -> Column:
    return F.floor((frames - 1) / ratio) + 1


def window_frames(current: Column, expected: int, sample: int, shift: int, dynamic: bool = False) -> Column:
    """Frames that a window infers: expected, or with dynamic the next size of the grid shift + k * sample below it."""
    if not dynamic:
        return F.lit(expected)
    return F.least(F.lit(expected), F.floor((current - shift + sample - 1) / sample) * sample + shift)


def skipped_steps(steps: Column, strength: float) -> Column:
    """How many of a schedule's first steps a strength below 1 leaves out."""
    return F.greatest(steps - F.least(steps * strength, steps), F.lit(0.0)).cast("long")


def guidance_scale(step: Column, top: float, steps: int = 15, least: float = 1.0, dynamic: bool = True) -> Column:
    """The guidance of a step: decays from top to least within steps, or stays at top."""
    if not dynamic:
        return F.lit(float(top))
    decay = (top - least) ** (1.0 / steps)
    return least + F.when(step < steps, F.greatest((top - least) / F.pow(F.lit(decay), step), F.lit(0.0))).otherwise(0.0)


def flow_sigma(i: Column, n: Column, train: int = 1000, shift: float = 1.0) -> Column:
    """Noise level i of n: evenly from 1 to 1 / train, shifted; 0 behind the last."""
    s = F.when(n > 1, 1 - i * (1 - 1 / train) / (n - 1)).otherwise(F.lit(1.0))
    return F.when(i >= n, F.lit(0.0)).otherwise(shift * s / (1 + (shift - 1) * s))


def spatial_alignment(degree: Column) -> Column:
    """(align_w, align_h) for 1, 2 or 4 ranks; others raise."""
    sizes = F.when(degree == 1, F.struct(F.lit(32).alias("align_w"), F.lit(32).alias("align_h"))).when(degree == 2, F.struct(F.lit(64).alias("align_w"), F.lit(32).alias("align_h"))).when(degree == 4, F.struct(F.lit(64).alias("align_w"), F.lit(64).alias("align_h")))
    return F.coalesce(sizes, F.raise_error(F.concat(F.lit("unsupported degree "), degree)).cast("struct<align_w:int,align_h:int>"))


def picked(values: Column, index: Column) -> Column:
    """The value at index, or the last one beyond the end; null of an empty array."""
    return F.get(values, F.least(index, F.size(values) - 1).cast("int"))


def window_fraction(completed: Column, fraction: Column, total: Column) -> Column:
    """Progress inside a window: nine tenths of it, the rest is kept for decoding."""
    done = completed + 0.9 * F.greatest(F.lit(0.0), F.least(fraction, F.lit(1.0)))
    return F.least(F.lit(94), 5 + F.floor(89 * done / total))


def object_url(key: Column, bucket: str, region: str | None = None, base: str | None = None) -> Column:
    """Where an object is read: under base, else in its bucket; every part of the key percent-encoded, not its slashes."""
    encoded = F.replace(F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    host = base or (f"https://{bucket}.s3.{region}.amazonaws.com" if region and region != "us-east-1" else f"https://{bucket}.s3.amazonaws.com")
    return F.concat(F.lit(f"{host}/"), encoded)


def numbered_name(name: Column, outputs: Column, index: Column) -> Column:
    """name with _index before its extension if there are several outputs."""
    return F.when((outputs > 1) & (name != "") & index.isNotNull(), F.regexp_replace(name, r"^(.*?[^/])(\.[^./]*)?$", F.concat(F.lit("$1_"), index, F.lit("$2")))).otherwise(name)
