"""Words of many documents at once, as numpy arrays over the bytes of an Arrow column.

Python objects for each word would cost most of an operator's time; here a slice of some megabytes of text becomes arrays
of word starts, ends and 64-bit hashes with a fixed number of vector operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MULTIPLIER = U64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


def inverse(odd: int) -> int:
    """Of an odd number, modulo 2^64."""
    return pow(odd, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(inverse(self.base), m, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters and digits: what separates them among ASCII once A-Z are lower case.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text; a longer text comes alone."""
    values = batch.column(column)
    sizes = np.zeros(len(values), np.int64)
    if len(values):
        sizes = values.cast(pa.large_binary()).fill_null(b"")
        sizes = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(values):
        yield batch.slice(at)


class Words:
    """starts, ends: byte positions of the words in `data`; offsets: of each document's words (n + 1 numbers); hashes."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.raw = data
        self.data = LOWER[data] if lower else data
        self.at = at - at[0]
        inside = ~separators[self.data]
        before = np.empty(len(data), bool)
        before[1:] = inside[:-1]
        after = np.empty(len(data), bool)
        after[:-1] = inside[1:]
        edges = self.at[:-1][self.at[:-1] < self.at[1:]]  # of documents that are not empty
        before[edges] = False
        after[self.at[1:][self.at[:-1] < self.at[1:]] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.offsets = np.searchsorted(self.starts, self.at)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def document(self) -> np.ndarray:
        """The row of each word's document."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def last(self) -> np.ndarray:
        """For each word, one past the last word of its document."""
        return np.repeat(self.offsets[1:], self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            up, down = _POWERS.get(len(self.data) + 1)
            total = np.empty(len(self.data) + 1, U64)
            total[0] = 0
            np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=total[1:])
            own = (total[self.ends] - total[self.starts]) * down[self.starts]
            self._hashes = mix(own + (self.ends - self.starts).astype(U64) * MULTIPLIER)
        return self._hashes

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(hashes: np.ndarray, length: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """A hash of each run of `length` elements, by doubling; the caller drops runs that cross documents."""
    if len(hashes) < length:
        return np.zeros(0, U64)
    have, n, out, done = hashes, 1, None, 0  # have: of runs of n; out: of the first `done`
    while True:
        if length & n:
            if out is None:
                out, done = have, n
            else:
                m = min(len(out), len(have) - done)
                out, done = out[:m] * U64(pow(base, n, 1 << 64)) + have[done : done + m], done + n
        if 2 * n > length:
            return mix(out[: len(hashes) - length + 1])
        have = have[:-n] * U64(pow(base, n, 1 << 64)) + have[n:]
        n *= 2


def sliding(op: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum, np.maximum) over each run of `width`."""
    if len(x) < width:
        return x[:0]
    n = 1
    while 2 * n <= width:
        x, n = op(x[:-n], x[n:]), 2 * n
    return op(x[: len(x) - (width - n)], x[width - n :]) if n < width else x
