"""Two-dimensional work on frames of bytes: blur, dilation, structural similarity, crops, pads, masks that are filled.

A row is a frame (height, width, pixels as raw bytes). A task stacks the frames of one size that a batch brings, a few
million pixels at a time, and works on the stack; no frame needs another, so nothing is shuffled but where a measure
looks at the frame before. What can be said on rows of pixels is in masks.py.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pixels that are worked on at once.
STACK = 1 << 21
IMAGES = ("pixels", "candidate", "mask", "before", "candidate_before")
KINDS = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


# --- on stacks of n x height x width ------------------------------------------------------------------------------


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def smoothing(n: int, size: int, sigma: float) -> np.ndarray:
    """The n x n matrix of a Gaussian over n places with mirrored ends, the end itself not repeated."""
    out = np.zeros((n, n))
    at = np.arange(n)[:, None] + np.arange(size) - size // 2
    at = np.abs(at) % max(2 * n - 2, 1)
    np.add.at(out, (np.arange(n)[:, None], np.minimum(at, 2 * n - 2 - at)), gaussian_kernel(size, sigma))
    return out


def blurred(stack: np.ndarray, size: int = 11, sigma: float = 1.5) -> np.ndarray:
    """A separable Gaussian with mirrored borders: one matrix product for each axis."""
    return smoothing(stack.shape[-2], size, sigma) @ stack @ smoothing(stack.shape[-1], size, sigma).T


def moved(stack: np.ndarray, step: int, axis: int) -> np.ndarray:
    """The stack shifted by step along an axis, False where nothing comes in."""
    out = np.zeros_like(stack)
    n = stack.shape[axis]
    to, of = [slice(None)] * stack.ndim, [slice(None)] * stack.ndim
    to[axis], of[axis] = slice(max(step, 0), n + min(step, 0)), slice(max(-step, 0), n - max(step, 0))
    if abs(step) < n:
        out[tuple(to)] = stack[tuple(of)]
    return out


def dilated(mask: np.ndarray, times: int = 1, height: int = 3, width: int = 3) -> np.ndarray:
    """Masks grown by a cross of height x width, times times."""
    steps = [(axis, s) for axis, size in ((-2, height), (-1, width)) for s in range(-(size // 2), size // 2 + 1) if s]
    for _ in range(times):
        mask = np.logical_or.reduce([mask, *(moved(mask, s, axis) for axis, s in steps)])
    return mask


def cross_counts(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """The sum of each place's cross of height x width."""
    steps = [(-2, s) for s in range(-(height // 2), height // 2 + 1) if s] + [(-1, s) for s in range(-(width // 2), width // 2 + 1) if s]
    return mask + sum(moved(mask, s, axis) for axis, s in steps)


def thickened(mask: np.ndarray, times: int, height: int, width: int, share: float, limit: int = 64_000) -> np.ndarray:
    """0/1 masks after times sums over a cross: on where more than share of what a sum could be is reached.

    Sums are only turned back into 0 and 1 before one could pass limit, and at the end, so several steps count how often a
    place is reached, and a single far place needn't be enough.
    """
    span, most = height + width - 1, 1
    out = mask.astype(np.int64)
    for i in range(times):
        out, most = cross_counts(out, height, width), most * span
        if i == times - 1 or most * span > limit:
            out, most = (out > most * share).astype(np.int64), 1
    return out.astype(bool)


def any_near(mask: np.ndarray, reach: int) -> np.ndarray:
    """Where any pixel within reach rows and columns is set."""
    for axis in (-2, -1):
        mask = np.logical_or.reduce([moved(mask, s, axis) for s in range(-reach, reach + 1)])
    return mask


def similarity(a: np.ndarray, b: np.ndarray, peak: float = 255.0) -> np.ndarray:
    """The structural similarity of each pixel's 11 x 11 surroundings: alike in brightness, times alike in structure."""
    small = (peak * np.array([0.01, 0.03])) ** 2
    moments = blurred(np.stack([a, b, a**2, b**2, a * b]))
    mean = moments[:2]
    spread = moments[2:4] - mean**2
    together = moments[4] - mean.prod(0)
    bright = (2 * mean.prod(0) + small[0]) / ((mean**2).sum(0) + small[0])
    return bright * (2 * together + small[1]) / (spread.sum(0) + small[1])


def filling_steps(mask: np.ndarray) -> np.ndarray:
    """How many 3 x 3 blurs of 1 - mask leave nothing at 0, for each mask of a stack; -1 where none is enough.

    A blur reaches one pixel further in each direction, so it is the largest distance of a full pixel to one that isn't,
    and less than the longer side.
    """
    reached = mask < 1
    steps = np.where(reached.any((-2, -1)), 0, -1)
    while (open_ := ~reached.all((-2, -1)) & (steps >= 0)).any():
        reached[open_] = any_near(reached[open_], 1)
        steps[open_] += 1
    return steps


# --- on frames ----------------------------------------------------------------------------------------------------


def _stack(column: pa.Array, height: int, width: int) -> np.ndarray:
    """A column of frames of one size as n x height x width; a frame of another size raises."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
    if column.null_count or (np.diff(offsets) != height * width).any():
        raise ValueError(f"frames of {height} x {width} bytes are expected")
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, height, width)


def _binary(stack: np.ndarray) -> pa.Array:
    """A stack of bytes as a column of frames."""
    flat = np.ascontiguousarray(stack, np.uint8)
    size = flat[0].size if len(flat) else 0
    return pa.BinaryArray.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer((np.arange(len(flat) + 1) * size).astype(np.int32)), pa.py_buffer(flat)])


def _doubles(stack: np.ndarray) -> pa.Array:
    flat = stack.reshape(len(stack), -1)
    return pa.ListArray.from_arrays((np.arange(len(flat) + 1) * flat.shape[1]).astype(np.int32), pa.array(flat.ravel()))


def _mapped(frames: DataFrame, work: Callable, out: dict[str, str], by: tuple[str, ...] = ("height", "width")) -> DataFrame:
    """frames without their images, with the columns out (name: type) that work(rows, height, width) returns in order.

    rows is a record batch of frames that agree in the columns by; what it returns may be Arrow or numpy arrays.
    """
    held = [f for f in frames.schema if f.name not in IMAGES]

    def run(batches):
        for batch in batches:
            sizes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by], 1)
            for size in np.unique(sizes, axis=0):
                mine = np.flatnonzero((sizes == size).all(1))
                per = max(1, STACK // max(int(size[0]) * int(size[1]), 1))
                for at in range(0, len(mine), per):
                    rows = batch.take(pa.array(mine[at : at + per]))
                    made = [x if isinstance(x, pa.Array) else pa.array(x, KINDS[k], from_pandas=True) for x, k in zip(work(rows, *map(int, size[:2])), out.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in held), *made], [*(f.name for f in held), *out])

    return frames.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held), *(f"{n} {k}" for n, k in out.items())]))


def dilated_masks(frames: DataFrame, times: int, size: int, threshold: float) -> DataFrame:
    """Gray frames (..., height, width, pixels) binarised above threshold, dilated by a cross, as 0/255 bytes."""
    return _mapped(frames, lambda r, h, w: [_binary(dilated(_stack(r.column("pixels"), h, w) > threshold, times, size, size) * np.uint8(255))], {"pixels": "binary"})


def soft_masks(frames: DataFrame, size: int, sigma: float) -> DataFrame:
    """Gray frames blurred, rounded half to even."""
    return _mapped(frames, lambda r, h, w: [_binary(np.rint(blurred(_stack(r.column("pixels"), h, w), size, sigma)))], {"pixels": "binary"})


def grown_masks(frames: DataFrame, times: int, size: int, sigma: float, remain: int) -> DataFrame:
    """Masks of bytes v / 255 with soft borders, as soft (array<double>): the mask itself where it is on, and around it
    its dilation by a cross (size, times times), blurred times + remain times."""

    def grow(r, h, w):
        mask = _stack(r.column("pixels"), h, w)
        wide = dilated(mask > 0, times, size, size).astype(float)
        for _ in range(max(times + remain, 1)):
            wide = blurred(wide, size, sigma).clip(0, 1)
        own = mask / 255
        return [_doubles((own + (1 - own) * wide).clip(0, 1))]

    return _mapped(frames, grow, {"soft": "array<double>"})


def filled_masks(frames: DataFrame, sigma: float = 0.8, key: str = "clip") -> DataFrame:
    """Masks of bytes v / 255 as filled (array<double>): 1 - mask is blurred (3 x 3) until nothing in the clip is at 0,
    and turned back. All frames of a clip take as many steps as the one that needs most.

    The number of steps is found first, from what is full and what isn't; it is less than the longer side of a frame. A
    frame that is full everywhere would never end, and raises.
    """
    steps = _mapped(frames.select(key, "frame", "height", "width", "pixels"), lambda r, h, w: [filling_steps(_stack(r.column("pixels"), h, w) / 255)], {"steps": "long"})
    never = F.raise_error(F.concat_ws(" ", F.lit("the mask is full in frame"), "frame", F.lit("of clip"), key)).cast("long")
    most = steps.withColumn("steps", F.when(F.col("steps") < 0, never).otherwise(F.col("steps"))).groupBy(key).agg(F.max("steps").alias("steps"))

    def fill(r, h, w):
        left = 1 - _stack(r.column("pixels"), h, w) / 255
        n = r.column("steps").to_numpy()
        for s in range(int(n.max(initial=0))):
            left[n > s] = blurred(left[n > s], 3, sigma)
        return [_doubles(1 - left)]

    return _mapped(frames.join(most, key), fill, {"filled": "array<double>"}).drop("steps")


def masked_frames(frames: DataFrame, times: int, size: int, share: float) -> DataFrame:
    """Gray frames (..., pixels, mask: bytes) as values (array<double>, in [0, 1]) that are 0 in the thickened mask, and
    that mask as on (bytes 0 and 1). A mask's byte is on above 255 / 2 * share."""

    def cover(r, h, w):
        on = thickened(_stack(r.column("mask"), h, w) > 255 / 2 * share, times, size, size, share)
        return [_doubles(_stack(r.column("pixels"), h, w) / 255 * ~on), _binary(on)]

    return _mapped(frames, cover, {"values": "array<double>", "on": "binary"})


REGIONS = ("mask", "edge", "outside")
FRAME = ("ssim", "mae", "mse", "temporal_delta")
MEASURES = (*FRAME, *(f"{r}_{k}" for r in REGIONS for k in ("ssim", "mae")))
COUNTS = ("mask_pixels", "edge_pixels")


def with_before(frames: DataFrame) -> DataFrame:
    """frames (clip, frame, pixels, candidate, ...) with before and candidate_before, those of the clip's frame before;
    null for its first. The window numbers frames alone; images come by an equi-join."""
    order = Window.partitionBy("clip").orderBy("frame")
    links = frames.select("clip", "frame", F.lag("frame").over(order).alias("_before"))
    earlier = frames.select("clip", F.col("frame").alias("_before"), F.col("pixels").alias("before"), F.col("candidate").alias("candidate_before"))
    return frames.join(links, ["clip", "frame"]).join(earlier, ["clip", "_before"], "left").drop("_before")


def compared(frames: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Quality of frames (..., height, width, pixels, candidate, mask): the measures of names (default: all that can be
    told), null where a region has no pixel.

    ssim, mae and mse of the whole frame; mask_pixels and edge_pixels; ssim and mae inside the mask, along its edge
    (11 x 11 around it) and outside; with before and candidate_before (see with_before) temporal_delta, the mean change
    of the error. Only what names asks for is computed.
    """
    timed = "before" in frames.columns
    known = [n for n in ("ssim", "mae", "mse", *COUNTS, *MEASURES[3:]) if timed or n != "temporal_delta"]
    wanted = [n for n in known if names is None or n in names]
    alike_too = any("ssim" in n for n in wanted)

    def measure(r, h, w):
        a, b = (_stack(r.column(c), h, w).astype(float) for c in ("pixels", "candidate"))
        gap = np.abs(b - a)
        alike = similarity(a, b) if alike_too else gap
        on = _stack(r.column("mask"), h, w) > 0
        rim = any_near(on, 5) & any_near(~on, 5) if any("edge" in n for n in wanted) else on
        regions = dict(zip(REGIONS, (on, rim, ~on), strict=True))
        whole = {"ssim": alike.mean((1, 2)), "mae": gap.mean((1, 2)), "mse": (gap**2).mean((1, 2)), "mask_pixels": on.sum((1, 2)), "edge_pixels": rim.sum((1, 2))}
        if timed:
            there = r.column("before").is_valid().to_numpy(zero_copy_only=False)
            whole["temporal_delta"] = np.full(len(a), np.nan)
            kept = r.filter(pa.array(there))
            p, q = (_stack(kept.column(c), h, w).astype(float) for c in ("before", "candidate_before"))
            whole["temporal_delta"][there] = np.abs((b - a)[there] - (q - p)).mean((1, 2))
        out = []
        for name in wanted:
            if name in whole:
                out.append(whole[name])
                continue
            region, kind = name.split("_")
            area = regions[region]
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(np.einsum("nhw,nhw->n", area, alike if kind == "ssim" else gap) / area.sum((1, 2)))
        return out

    return _mapped(frames, measure, {n: "long" if n in COUNTS else "double" for n in wanted})


def spliced(frames: DataFrame, x: int, y: int) -> DataFrame:
    """Gray frames with a patch (candidate: patch_height x patch_width) laid over them at column x and row y.

    A patch that doesn't lie inside the frame raises; a null patch leaves the frame as it is.
    """

    def lay(r, height, width):
        out = _stack(r.column("pixels"), height, width).copy()
        there = r.column("candidate").is_valid().to_numpy(zero_copy_only=False)
        if there.any():
            h, w = (int(r.column(c)[0].as_py()) for c in ("patch_height", "patch_width"))
            if x < 0 or y < 0 or x + w > width or y + h > height:
                raise ValueError(f"patch {x, y, w, h} exceeds frame {width} x {height}")
            out[there, y : y + h, x : x + w] = _stack(r.column("candidate").filter(pa.array(there)), h, w)
        return [_binary(out)]

    return _mapped(frames, lay, {"pixels": "binary"}, ("height", "width", "patch_height", "patch_width"))


def cropped(frames: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """A box of each gray frame; a box outside the frame raises."""

    def cut(r, height, width):
        if x < 0 or y < 0 or x + w > width or y + h > height:
            raise ValueError(f"box {x, y, w, h} exceeds frame {width} x {height}")
        return [_binary(_stack(r.column("pixels"), height, width)[:, y : y + h, x : x + w])]

    return _mapped(frames, cut, {"pixels": "binary"})


def padded(frames: DataFrame, align: int, names: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """Gray frames (and others of names) padded to the right and below with their last pixels, to multiples of align.
    height and width stay those of the frame as it was."""

    def pad(r, h, w):
        return [_binary(np.pad(_stack(r.column(n), h, w), ((0, 0), (0, -h % align), (0, -w % align)), mode="edge")) for n in names]

    return _mapped(frames, pad, dict.fromkeys(names, "binary"))
