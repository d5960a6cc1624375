"""Hashes of word shingles of whole texts, for many texts at a time in NumPy."""

from __future__ import annotations

import numpy as np

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = bytes([0x20, *range(0x09, 0x0E)])
BLOCK_BYTES = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base & ((1 << 64) - 1), np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def prefix_sums(data: np.ndarray, table: np.ndarray, powers: Powers) -> np.ndarray:
    """s with s[e] - s[b] = sum of table[data[i]] * BASE^i over b <= i < e, modulo 2^64."""
    up, _ = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:], dtype=np.uint64)
    return sums


def byte_table(fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold`` A-Z have the values of a-z."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if fold:
        table[65:91] = table[97:123]
    return table


class Shingler:
    """Distinct hashed shingles of ``width`` words, A-Z lower-cased; a text of fewer words has its whole sequence as one.

    Words are runs of other bytes than ASCII white space. Two different shingles have the same 64-bit hash with a
    chance of about 2^-60.
    """

    def __init__(self, width: int):
        self.width, self.powers, self.table = width, Powers(), byte_table(True)
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True

    def sets(self, texts: list[bytes]):
        """Yields the sorted distinct hashes of each text; blocks of about BLOCK_BYTES are hashed together."""
        first = size = 0
        for i, text in enumerate(texts):
            size += len(text) + 1
            if size >= BLOCK_BYTES or i == len(texts) - 1:
                yield from self._block(texts[first : i + 1])
                first, size = i + 1, 0

    def _block(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = self.space[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        begin = edges if space[0] else np.concatenate([[0], edges])
        begin, end = begin[0::2], begin[1::2]
        sums = prefix_sums(data, self.table, self.powers)
        _, down = self.powers.upto(len(data) + 1)
        words = mixed((sums[end] - sums[begin[: len(end)]]) * down[begin[: len(end)]] + (end - begin[: len(end)]).astype(np.uint64))
        limits = np.cumsum([len(text) + 1 for text in texts])
        last = np.searchsorted(begin, limits)
        start = 0
        n = len(words) - self.width + 1
        if n > 0:
            joined = words[:n].copy()
            for k in range(1, self.width):
                joined = mixed(joined * MIX[0] + words[k : n + k])
        for stop in last.tolist():
            count = stop - start
            if count >= self.width:
                yield np.unique(joined[start : stop - self.width + 1])
            elif count:
                whole = np.array([count], np.uint64)
                for word in words[start:stop]:
                    whole = mixed(whole * MIX[1] + word)
                yield whole
            else:
                yield np.zeros(0, np.uint64)
            start = stop
