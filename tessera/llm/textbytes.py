"""Vectorised work on the UTF-8 bytes of whole texts: blocks of texts, words and polynomial hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, but for a single longer text.
BLOCK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of the multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULT, _INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any byte ranges of one buffer, each in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


class Block:
    """Texts side by side in one buffer, each followed by a line feed that belongs to none."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.begin = np.zeros(len(texts), np.int64)
        np.cumsum(sizes[:-1] + 1, out=self.begin[1:])
        self.end = self.begin + sizes

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each run of bytes without white space begins and ends, and the number of its text."""
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = ~IS_SPACE[self.data]
        step = np.diff(inside)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return begin, end, np.searchsorted(self.begin, begin, "right") - 1


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, Block]]:
    """Whole texts of an Arrow column, null as empty: the first one's number and a block of about size bytes."""
    part: list[bytes] = []
    held = first = 0
    for i, value in enumerate(texts):
        raw = value.as_buffer().to_pybytes() if value.is_valid else b""
        if part and held + len(raw) > size:
            yield first, Block(part)
            part, held, first = [], 0, i
        part.append(raw)
        held += len(raw)
    if part:
        yield first, Block(part)
