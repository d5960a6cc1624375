"""Counts of word sequences in a HAT-trie: a shallow trie over word ids with burstable hash containers below it."""

from __future__ import annotations

import numpy as np

from sensorflow.llm.shingles import mixed

BURST = 1 << 16


class Container:
    """Open-addressing hash table from packed sequences to counts; the keys of one call, all different, are placed together."""

    def __init__(self, capacity: int = 1 << 10):
        self.keys, self.counts, self.used = np.zeros(capacity, np.int64), np.zeros(capacity, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        need = 2 * (self.used + len(keys))
        if need > len(self.keys):
            old = self.entries()
            self.__init__(1 << need.bit_length())
            self._place(*old)
        self._place(keys, counts)

    def _place(self, keys, counts):
        mask = np.uint64(len(self.keys) - 1)
        slot = (mixed(keys.view(np.uint64)) & mask).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # one of those that want a slot gets it
            mine = self.keys[slot] == keys
            self.counts[slot[mine]] += counts[mine]
            self.used += int((free & mine).sum())
            keys, counts, slot = keys[~mine], counts[~mine], (slot[~mine] + 1) & int(mask)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys, in no order, and their counts."""
        full = np.flatnonzero(self.keys)
        return self.keys[full], self.counts[full]

    def in_order(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = self.entries()
        order = np.argsort(keys)
        return keys[order], counts[order]


class HatTrie:
    """Counts sequences of 1 to ``longest`` word ids; ids are from 1 to ``max_id``.

    A sequence is packed into one number, its first word highest and 0 for no word, so that a subtree is a range of numbers. The trie is kept as the first
    number of each container's range. A container holds sibling subtrees; when it has more than ``burst`` sequences it is cut in two
    between siblings, at the first depth where its sequences differ.
    """

    def __init__(self, longest: int, burst: int = BURST):
        self.longest, self.burst = longest, burst
        self.bits = 63 // longest
        self.max_id = (1 << self.bits) - 1
        self.lows, self.containers = np.zeros(1, np.int64), [Container()]

    def __len__(self) -> int:
        return sum(container.used for container in self.containers)

    def shift(self, depth: int) -> int:
        return self.bits * (self.longest - 1 - depth)

    def columns(self, keys: np.ndarray) -> list[np.ndarray]:
        return [keys >> self.shift(depth) & self.max_id for depth in range(self.longest)]

    def add(self, ids: np.ndarray) -> None:
        """Count the sequences that start at all ids but the last ``longest`` - 1; a 0 ends sequences."""
        starts = len(ids) - self.longest + 1
        if starts < 1:
            return
        key, whole, found = np.zeros(starts, np.int64), np.ones(starts, bool), []
        for depth in range(self.longest):
            word = ids[depth : starts + depth]
            whole &= word > 0
            key = key | word << self.shift(depth)
            found.append(key[whole])
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        limits = np.append(np.searchsorted(keys, self.lows), len(keys)).tolist()
        for i in reversed(range(len(self.containers))):
            if limits[i] < limits[i + 1]:
                self.containers[i].add(keys[limits[i] : limits[i + 1]], counts[limits[i] : limits[i + 1]])
                self._burst(i)

    def _burst(self, i: int) -> None:
        if self.containers[i].used <= self.burst:
            return
        keys, counts = self.containers[i].in_order()
        depth = next(d for d in range(self.longest) if keys[0] >> self.shift(d) != keys[-1] >> self.shift(d))
        subtrees = keys >> self.shift(depth)
        middle = subtrees[len(keys) // 2]
        at = int(np.searchsorted(subtrees, middle)) or int(np.searchsorted(subtrees, middle, "right"))
        halves = [Container(), Container()]
        halves[0].add(keys[:at], counts[:at])
        halves[1].add(keys[at:], counts[at:])
        self.containers[i : i + 1] = halves
        self.lows = np.insert(self.lows, i + 1, subtrees[at] << self.shift(depth))
        self._burst(i + 1)
        self._burst(i)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Remove the subtrees of whole containers, fullest first, until at most ``keep`` sequences are left; their sequences, in no order, and counts."""
        left, gone = len(self), []
        for i in sorted(range(len(self.containers)), key=lambda i: -self.containers[i].used):
            if left <= keep:
                break
            left -= self.containers[i].used
            gone.append(i)
        out = [self.containers[i].entries() for i in sorted(gone)]
        for i in gone:
            self.containers[i] = Container()
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([keys for keys, _ in out]), np.concatenate([counts for _, counts in out])
