"""The E8 lattice: nearest points, and the cells next to them."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np

from . import textarrays as ta


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    pairs = [[(a, s), (b, t)] for a, b in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    whole = np.zeros((len(pairs), 8))
    for row, entries in zip(whole, pairs, strict=True):
        for k, v in entries:
            row[k] = v
    halves = np.array([x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0])
    return np.vstack([whole, halves])


NEIGHBOURS = shortest()


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    p = np.rint(y)
    odd = np.flatnonzero(p.sum(1) % 2)
    gap = (y - p)[odd]
    k = np.abs(gap).argmax(1)
    p[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return p


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row of y (n x 8)."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def cells(y: np.ndarray, probes: int) -> np.ndarray:
    """64-bit names of each row's cell and of the probes nearest cells around it: n x (1 + probes)."""
    home = nearest(y)
    points = np.empty((len(y), 1 + probes, 8))
    points[:, 0] = home
    if probes:
        toward = (y - home) @ NEIGHBOURS.T
        near = np.argpartition(-toward, probes - 1, axis=1)[:, :probes]
        points[:, 1:] = home[:, None] + NEIGHBOURS[near]
    name = np.zeros(points.shape[:2], np.uint64)
    for k in range(8):
        name = ta.mix(name * np.uint64(0x9E3779B97F4A7C15) + np.rint(2 * points[:, :, k]).astype(np.int64).view(np.uint64) + np.uint64(1))
    return name


def found_rate(scale: float, cosine: float, probes: int, pairs: int = 20_000) -> float:
    """How often two unit vectors of this cosine meet in one table: a simulation of Gaussian projections."""
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, pairs, 8))
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    x, y = cells(scale * a, probes), cells(scale * b, probes)
    return float(((x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)).mean())
