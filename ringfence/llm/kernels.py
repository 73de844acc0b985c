"""NumPy kernels over the UTF-8 bytes of many texts at once.

A *piece* is a run of whole documents of an Arrow batch, about ``PIECE`` bytes of text (a longer
document is a piece of its own). Every array below is per byte or per word of one piece, so that the
memory of a task is bounded by its longest document.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_MUL = np.uint64(0x9E3779B97F4A7C15)
_FNV = np.uint64(0x100000001B3)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h + np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(column, size: int = PIECE):
    """(first row, end row, bytes, offsets) of a string column; a null text is empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, end, raw[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


def words(buf: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE):
    """Starts and ends of the words (runs without a separator, within a document), and each document's first word.

    The last array has one more entry than there are documents.
    """
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~apart[buf]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    size = ends - starts
    if not len(size):
        return np.empty(0, np.uint64)
    order = np.argsort(size, kind="stable")[::-1]
    s, down = starts[order], size[order]
    longer = np.searchsorted(-down, -np.arange(int(down[0])), "left")  # words of more than k bytes
    h = np.full(len(size), 0xCBF29CE484222325, np.uint64)
    for k, m in enumerate(longer):
        h[:m] = (h[:m] ^ buf[s[:m] + k]) * _FNV
    out = np.empty_like(h)
    out[order] = mix(h ^ (down.astype(np.uint64) << np.uint64(48)))
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive entries; the caller leaves out those that cross documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc, covered, power, base, shift = None, 0, h, _MUL, 1
    while True:  # the binary digits of k, each a block of doubled length
        if k & shift:
            part = power[covered:covered + n]
            if acc is None:
                acc = part.copy()
            else:
                acc *= base
                acc += part
            covered += shift
        if shift * 2 > k:
            return mix(acc, k)
        power = power[:-shift] * base + power[shift:]
        base = np.uint64(int(base) * int(base) % 2**64)
        shift *= 2


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of all runs of ``k`` entries that lie in one document, ``first`` as from :func:`words`."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    last = first[1:] - k + 1
    some = last > first[:-1]
    np.add.at(ok, first[:-1][some], 1)
    np.add.at(ok, last[some], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true entries."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
