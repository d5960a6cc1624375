"""Adaptive radix tree over byte keys: nodes of four layouts that grow and shrink with their children, and compressed paths."""

from __future__ import annotations

# Children that the layouts hold.
LAYOUTS = (4, 16, 48, 256)


class Children:
    """Children by their first byte, in ascending order.

    Up to 16 children are two parallel sorted lists; up to 48 have an index of 256 bytes into a list of children; more have
    one place for each byte.
    """

    __slots__ = ("layout", "bytes", "nodes", "n")

    def __init__(self):
        self.layout, self.bytes, self.nodes, self.n = LAYOUTS[0], bytearray(), [], 0

    def get(self, byte: int):
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.nodes[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.nodes[at - 1] if at else None
        return self.nodes[byte]

    def put(self, byte: int, node) -> None:
        """Add a child or replace the one that has this byte."""
        if self.get(byte) is None and self.n == self.layout:
            self._relaid(LAYOUTS[LAYOUTS.index(self.layout) + 1])
        if self.layout <= 16:
            at = next((i for i, known in enumerate(self.bytes) if known >= byte), self.n)
            if at < self.n and self.bytes[at] == byte:
                self.nodes[at] = node
                return
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
        elif self.layout == 48:
            if self.bytes[byte]:
                self.nodes[self.bytes[byte] - 1] = node
                return
            self.nodes.append(node)
            self.bytes[byte] = len(self.nodes)
        else:
            if self.nodes[byte] is not None:
                self.nodes[byte] = node
                return
            self.nodes[byte] = node
        self.n += 1

    def _relaid(self, layout: int) -> None:
        known = list(self.items())
        self.layout = layout
        if layout <= 16:
            self.bytes, self.nodes = bytearray(byte for byte, _ in known), [node for _, node in known]
        elif layout == 48:
            self.bytes, self.nodes = bytearray(256), [node for _, node in known]
            for i, (byte, _) in enumerate(known, 1):
                self.bytes[byte] = i
        else:
            self.bytes, self.nodes = bytearray(), [None] * 256
            for byte, node in known:
                self.nodes[byte] = node

    def items(self):
        if self.layout <= 16:
            yield from zip(self.bytes, self.nodes)
        elif self.layout == 48:
            yield from ((byte, self.nodes[at - 1]) for byte, at in enumerate(self.bytes) if at)
        else:
            yield from ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """``path``: the bytes from the parent to here, the byte that leads here included; ``values``: of keys that end here;
    ``n`` and ``least``: number and smallest of the values here and below."""

    __slots__ = ("path", "children", "values", "n", "least")

    def __init__(self, path: bytes, n: int = 0, least=None):
        self.path, self.children, self.values, self.n, self.least = path, Children(), [], n, least

    def passed(self, value) -> None:
        self.least = value if self.n == 0 else min(self.least, value)
        self.n += 1


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        half = (low + n) // 2
        low, n = (half, n) if a[low:half] == b[low:half] else (low, half)
    return low


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, value) -> None:
        node, at = self.root, 0
        node.passed(value)
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.children.put(key[at], child)
                at = len(key)
            else:
                same = _common(child.path, key[at : at + len(child.path)])
                if same < len(child.path):  # the compressed path forks or ends within
                    upper = Node(child.path[:same], child.n, child.least)
                    child.path = child.path[same:]
                    upper.children.put(child.path[0], child)
                    node.children.put(key[at], upper)
                    child = upper
                at += same
            node = child
            node.passed(value)
        node.values.append(value)

    def walk(self):
        """(node, key length at its parent, leaving) for all nodes: each before its children and once more, leaving, after them."""
        stack = [(self.root, 0, False)]
        while stack:
            node, above, leaving = stack.pop()
            yield node, above, leaving
            if not leaving:
                stack.append((node, above, True))
                below = above + len(node.path)
                stack.extend((child, below, False) for _, child in reversed(list(node.children.items())))
