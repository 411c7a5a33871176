"""Small numpy helpers that the text operators share: words, hashes and packed columns.

Everything here works on one Arrow batch inside a Spark task. Spark deals the rows, shuffles the packed
columns and joins the answers back; nothing here holds more than one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
ZSTD = pa.Codec("zstd", compression_level=1)
_PRIME = 0x9E3779B97F4A7C15 | 1


def byte_class(members) -> np.ndarray:
    """A 256-entry table that is True for the given bytes."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


IS_WHITE = byte_class(WHITE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: One random-looking 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_PRIME))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n; base is odd, so it has an inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        m = max(n + 1, 1 << 16)
        up, down = np.full(m, base, U64), np.full(m, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The mixed polynomial hash of values[starts:ends], wherever the span stands."""
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_WHITE):
    """Starts and ends of the words in bytes, and for each text the number of words before it (n + 1 values).

    gap: a 256-entry table of the bytes that part words. Words never cross texts.
    """
    word = ~gap[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    at, end = offsets[:-1][full], offsets[1:][full] - 1
    first[at] = word[at]
    last[end] = word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pieces(batches, size: int, text: str = "text", rows: int = 1 << 40) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about size bytes, of rows rows at most; one longer text is a slice of its own."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def gathered(batches, size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Like pieces(), but small batches are joined first."""
    held, n = [], 0
    for piece in pieces(batches, size, text):
        held.append(piece)
        n += piece.column(text).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held and (whole := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield whole[0]


def planes(values: np.ndarray) -> bytes:
    """The values' bytes, all first bytes first, compressed: the high ones are mostly zero or nearly so."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return b"\0" + raw if len(raw) < 256 else b"\1" + len(raw).to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)


def unplanes(raw: bytes, dtype) -> np.ndarray:
    """The values that planes() packed."""
    raw = raw[1:] if raw[:1] != b"\1" else ZSTD.decompress(raw[9:], int.from_bytes(raw[1:9], "little"), asbytes=True)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def joined(cells, dtype) -> np.ndarray:
    """All values of several packed cells."""
    return np.concatenate([np.zeros(0, dtype), *(unplanes(x, dtype) for x in cells if x)])


def runs(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (key, at) pairs as (key, first, last + 1) runs of consecutive values."""
    if not len(at):
        return keys[:0], at[:0], at[:0]
    cut = np.flatnonzero((np.diff(keys) != 0) | (np.diff(at) != 1)) + 1
    i, j = np.r_[0, cut], np.r_[cut, len(at)] - 1
    return keys[i], at[i], at[j] + 1


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, and so on."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def covered(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """A mask of size values, True inside any of the spans [first, last)."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return np.cumsum(change[:-1]) > 0


def sorted_groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal values start in a sorted array, and their sizes."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1]
    return at, np.diff(np.r_[at, len(values)])


class Spans:
    """Hashes of any spans of one byte array, by prefix sums of two independent polynomials."""

    def __init__(self, data: np.ndarray, bases: tuple[int, ...]):
        values = BYTE_VALUES[data]
        self.parts = []
        for base in bases:
            up, down = powers(base, len(values))
            total = np.zeros(len(values) + 1, U64)
            np.cumsum(values * up[: len(values)], out=total[1:])
            self.parts.append((total, down))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, part: int = 0) -> np.ndarray:
        total, down = self.parts[part]
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
