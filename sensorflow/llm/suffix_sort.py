"""Deep-shallow sorting of suffixes that are compared up to a given depth."""

from __future__ import annotations

import numpy as np

WORD = 8


def _words(data: np.ndarray, starts: np.ndarray, depth: int, length: int) -> np.ndarray:
    """The eight bytes of each suffix from ``depth`` on as one big-endian number, zero beyond ``length``.

    data has WORD bytes after the last suffix."""
    view = np.ndarray((len(data) - WORD + 1,), ">u8", data, 0, (1,))
    found = view[starts + depth].astype(np.uint64)
    beyond = depth + WORD - length
    return found >> np.uint64(8 * beyond) << np.uint64(8 * beyond) if beyond > 0 else found


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    changed = np.ones(len(keys[0]), bool)
    changed[1:] = False
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def _sizes(begins: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begins, n))


def _multikey(data, starts, length, shallow):
    """Multikey quicksort on characters of eight bytes down to ``shallow``: order, and group of each place in it."""
    order = np.argsort(_words(data, starts, 0, length))
    group = np.zeros(len(order), np.int64)
    begins = _runs(_words(data, starts[order], 0, length))
    group[begins[1:]] = 1
    group = np.cumsum(group)
    for depth in range(WORD, min(shallow, length), WORD):
        sizes = _sizes(_runs(group), len(group))
        todo = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        if not len(todo):
            break
        key, own = _words(data, starts[order[todo]], depth, length), group[todo]
        turned = np.lexsort((key, own))
        order[todo] = order[todo[turned]]
        key, own = key[turned], own[turned]
        split = np.zeros(len(group), np.int64)
        split[todo[_runs(own, key)]] = 1
        split[_runs(group)] = 1
        group = np.cumsum(split) - 1
    return order, group


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``length`` bytes, and for each place in that order the number of its group
    of equal ones. data has WORD bytes after the last suffix; every start has ``length`` bytes before those.

    Groups that agree down to ``shallow`` are ordered by blind tries, built level by level for all groups at once: a
    trie node knows only the depth at which its suffixes first differ, found against one of them, and
    its children are the bytes there; the bytes in between are not compared again.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, group = _multikey(data, starts, length, shallow)
    begins = _runs(group)
    sizes = _sizes(begins, len(group))
    todo = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    split = np.zeros(len(group), bool)
    split[begins] = True
    own = group[todo]
    while len(todo):
        begins = _runs(own)
        sizes = _sizes(begins, len(own))
        at = starts[order[todo]]
        leader = np.repeat(at[begins], sizes)
        common = np.full(len(todo), length, np.int64)
        open_ = np.arange(len(todo))
        for depth in range(0, length, WORD):
            differs = _words(data, at[open_], depth, length) ^ _words(data, leader[open_], depth, length)
            hit = differs != 0
            # the position of the highest set bit, by the exponent of the number as a float of its upper or lower half
            found = differs[hit]
            upper = found >> np.uint64(32)
            half = np.where(upper > 0, upper, found).astype(np.float64)
            bits = np.frexp(half)[1] + np.where(upper > 0, 32, 0)
            common[open_[hit]] = depth + (64 - bits) // 8
            open_ = open_[~hit]
            if not len(open_):
                break
        node = np.minimum.reduceat(common, begins)
        more = np.repeat(node < length, sizes)
        if not more.any():
            break
        todo, own, at = todo[more], own[more], at[more]
        branch = data[at + np.repeat(node, sizes)[more]]
        turned = np.lexsort((branch, own))
        order[todo] = order[todo[turned]]
        branch, own = branch[turned], own[turned]
        begins = _runs(own, branch)
        split[todo[begins]] = True
        sizes = _sizes(begins, len(own))
        own = np.repeat(np.arange(len(begins)), sizes)
        several = np.repeat(sizes, sizes) > 1
        todo, own = todo[several], own[several]
    return order, np.cumsum(split) - 1
