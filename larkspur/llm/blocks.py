"""Fingerprints of byte and word sequences, and blocks of windows that share an anchor.

Everything is a function of content alone, so equal windows of different documents, on different
executors, get equal anchors. Arithmetic is modulo 2**64, vectorised over a buffer of many documents.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Odd multipliers of the two polynomial fingerprints and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Windows that get their anchors together; places of anchors must fit 24 bits.
PIECE = 1 << 22
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
        k += m
    return out[:n]


class Prefix:
    """Fingerprints of any part of a sequence, from sums of its prefixes."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values) + 1
        held = Prefix._powers.get(which)
        if held is None or len(held[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            held = Prefix._powers[which] = powers(BASES[which], size), powers(INVERSES[which], size)
        self.back = held[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * held[0][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        """Of every part of that size."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbouring keys, by minima from both ends of chunks of that width."""
    n = len(keys) - width + 1
    size = -(-len(keys) // width) * width
    padded = np.full(size, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def buffers(batch, column: str, most: int = 1 << 21):
    """Rows of an Arrow batch as (first row, bytes, starts, ends), joined up to about `most` bytes, one blank between texts."""
    import pyarrow as pa

    col = batch.column(column)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    large = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and len(col.buffers()[2]) else np.zeros(0, np.uint8)
    first = 0
    while first < len(col):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first:last] - offsets[first], offsets[first + 1 : last + 1] - offsets[first]
        first = last


def hashed(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxh3 of each part of values."""
    raw, size = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((start * size).tolist(), (end * size).tolist())), np.uint64, len(start))


def runs(values: np.ndarray) -> np.ndarray:
    """First places of runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Blocks:
    """Blocks of one buffer: document row, first window (in the document), number of windows, anchor, hash of the whole, place of the anchor in the first window."""

    def __init__(self, row, start, count, anchor, body, rel):
        self.row, self.start, self.count, self.anchor, self.body, self.rel = row, start, count, anchor, body, rel


def joined(parts: list[Blocks]) -> Blocks:
    return Blocks(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("row", "start", "count", "anchor", "body", "rel")))


def byte_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> Blocks:
    """Windows of `window` bytes, anchored at the leftmost of their least `gram`-byte strings."""
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return Blocks(*[empty] * 6)
    if len(data) - window + 1 > PIECE:
        # Pieces overlap by a window less one byte, so each window lies in one piece; blocks may be cut, which repeats allows.
        parts = []
        for lo in range(0, len(data) - window + 1, PIECE):
            hi = min(lo + PIECE + window - 1, len(data))
            own = np.flatnonzero((ends > lo) & (starts < hi))
            part = byte_blocks(data[lo:hi], np.maximum(starts[own], lo) - lo, np.minimum(ends[own], hi) - lo, window, gram)
            part.row = own[part.row]
            part.start = part.start + np.maximum(lo - starts[part.row], 0)
            parts.append(part)
        return joined(parts)
    one = Prefix(data.astype(np.uint64) + U(1), 0)
    grams = one.all(gram)
    # Order by 40 bits of the fingerprint, then by place; so the least key also tells where it stands.
    keys = ((grams >> U(24)) << U(24)) | np.arange(len(grams), dtype=np.uint64)
    low = least(keys, window - gram + 1)
    at = (low & U(0xFFFFFF)).astype(np.int64)
    # Windows that run over the end of their text do not count.
    long = ends - starts >= window
    rows, s, e = np.flatnonzero(long), starts[long], ends[long] - window + 1
    if not len(rows):
        return Blocks(*[empty] * 6)
    inside = np.zeros(len(at) + 1, np.int32)
    np.add.at(inside, s, 1)
    np.add.at(inside, e, -1)
    tagged = np.where(np.cumsum(inside[:-1]) > 0, at, -1)
    # A new text starts a new block even if the anchor stays (it cannot: anchors lie inside their text).
    first = runs(tagged)
    last = np.concatenate((first[1:], [len(tagged)]))
    real = tagged[first] >= 0
    first, last = first[real], last[real]
    row = rows[np.searchsorted(s, first, "right") - 1]
    anchor = grams[tagged[first]]
    rel = tagged[first] - first
    body = hashed(data, first, last - 1 + window) ^ mix((rel + 1).astype(np.uint64))
    return Blocks(row, first - starts[row], last - first, signed(anchor), signed(body), rel)
