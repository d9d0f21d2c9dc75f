"""Words of many texts at once, as numpy arrays; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = (1 << 64) - 1


class Powers:
    """Powers of an odd multiplier and of its inverse, modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(self.n, x, np.uint64))]) for x in (self.base, self.inverse))
        return self.up, self.down


BYTES, WINDOWS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of values[start:end] for each pair, from one running sum."""
    up, down = powers.upto(len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return mixed((sums[ends] - sums[starts]) * down[starts])


class Words:
    """Words of a list of texts (UTF-8 bytes), each text's words joined by one space.

    buffer: all words, each followed by one space; start, end: of each word in it; first: index of the first word of
    each text, with the number of words at the end. `between` tells for each byte whether it parts words; a space does.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, between: np.ndarray = _SPACE):
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = between[raw]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        keep = ~space
        begins = np.flatnonzero(keep & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, np.int64)
        keep[1:] |= ~space[:-1]
        flat, gap = raw[keep], space[keep]
        flat[gap] = 32
        self.buffer = _LOWER[flat] if lower else flat
        self.end = np.flatnonzero(gap)
        self.start = np.concatenate([np.zeros(min(1, len(self.end)), np.int64), self.end[:-1] + 1])
        self.first = np.searchsorted(begins, at)
        self.n = np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def spelled(self, some: np.ndarray) -> pa.Array:
        """The words with these numbers, as strings."""
        begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.end[some] - self.start[some])])
        at = np.arange(begins[-1]) + np.repeat(self.start[some] - begins[:-1], np.diff(begins))
        return pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(begins), pa.py_buffer(self.buffer[at])])

    def hashes(self, step: int = 1 << 14) -> np.ndarray:
        """A hash of each word; computed for `step` words at a time, as eight bytes are needed for each byte of text."""
        out = np.empty(len(self.start), np.uint64)
        for i in range(0, len(out), step):
            start, end = self.start[i : i + step], self.end[i : i + step]
            out[i : i + step] = rolled(self.buffer[start[0] : end[-1]].astype(np.uint64), start - start[0], end - start[0], BYTES)
        return out


def chunks(rows: Iterator, size_of, most: int = 2 << 20) -> Iterator[list]:
    """Lists of rows of about `most` bytes together; a longer row is a list of its own."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
