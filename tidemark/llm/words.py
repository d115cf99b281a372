"""Vectorised words and word-window hashes over Arrow text columns.

A word is a run of bytes other than space and the controls 9 to 13, so UTF-8 text is handled
as bytes. Work goes in chunks of 1 MB; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (public splitmix constants)."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    x = a * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x += b
    return mix(x)


BYTE_CODES = mix(np.arange(256, dtype=U) * U(0xA24BAED4963EE407))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, b, U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for ascending, disjoint spans; memory stays bounded."""
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(BYTE_CODES[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U)
        i = j
    return mix(out)


class Words:
    """Words of consecutive texts: data[offs[d]:offs[d+1]] is text d, its words are at[d]:at[d+1]."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @cached_property
    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    @cached_property
    def end_of_doc(self) -> np.ndarray:
        return np.repeat(self.at[1:], self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n items, by doubling (windows may cross texts; callers mask)."""
    if len(h) < n:
        return np.empty(0, U)
    size = 1
    while 2 * size <= n:
        h = pair(h[: len(h) - size], h[size:])
        size *= 2
    return h if size == n else pair(h[: len(h) - (n - size)], h[n - size :])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) of consecutive rows of at most limit bytes, a row at least."""
    data, offs = texts(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by a key; only a group that a batch cuts is held."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not len(t):
            continue
        k = t.column(key).to_numpy()
        new = int(np.searchsorted(k, k[-1], "left"))
        if new:
            held.append(t.slice(0, new))
            yield pa.concat_tables(held).combine_chunks()
            held = [t.slice(new)]
        elif held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.concat_tables(held).combine_chunks()
            held = [t]
        else:
            held.append(t)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def each_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each key of batches sorted by it."""
    for t in whole_groups(batches, key):
        k = t.column(key).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        for a, b in zip(first, np.append(first[1:], len(k)), strict=True):
            yield t.slice(a, b - a)
