"""Adaptive radix tree over byte keys: nodes of 4, 16, 48 and 256 places, with path compression."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any


class _Sorted:
    """Up to `room` children, found by their bytes in order (layouts of 4 and 16 places)."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        i = bisect_left(self.bytes, byte)
        return self.nodes[i] if i < len(self.bytes) and self.bytes[i] == byte else None

    def put(self, byte: int, node: Node) -> None:
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.nodes[i] = node
        else:
            self.bytes.insert(i, byte), self.nodes.insert(i, node)

    def full(self) -> bool:
        return len(self.nodes) == self.room

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes)


class _Indexed:
    """Up to 48 children; a table of 256 bytes says which place a byte has."""

    __slots__ = ("index", "nodes")

    def __init__(self):
        self.index, self.nodes = bytearray(b"\xff" * 256), []

    def get(self, byte: int):
        return self.nodes[self.index[byte]] if self.index[byte] != 255 else None

    def put(self, byte: int, node: Node) -> None:
        if self.index[byte] == 255:
            self.index[byte] = len(self.nodes)
            self.nodes.append(node)
        else:
            self.nodes[self.index[byte]] = node

    def full(self) -> bool:
        return len(self.nodes) == 48

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.nodes[i]) for byte, i in enumerate(self.index) if i != 255)


class _Direct:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> None:
        self.nodes[byte] = node

    def full(self) -> bool:
        return False

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """path: the bytes from the parent, its own byte included. value: of the key that ends here. total: what a caller sums up."""

    __slots__ = ("path", "value", "children", "total")

    def __init__(self, path: bytes, value: Any = None):
        self.path, self.value, self.children, self.total = path, value, None, None

    def child(self, byte: int):
        return self.children.get(byte) if self.children is not None else None

    def put(self, node: Node) -> None:
        if self.children is None:
            self.children = _Sorted(4)
        elif self.children.full() and self.children.get(node.path[0]) is None:
            old = self.children
            self.children = _Direct() if isinstance(old, _Indexed) else _Indexed() if old.room == 16 else _Sorted(16)
            for byte, kept in old.items():
                self.children.put(byte, kept)
        self.children.put(node.path[0], node)

    def kids(self) -> list[Node]:
        """Children in the order of their bytes."""
        return [node for _, node in self.children.items()] if self.children is not None else []


class RadixTree:
    """Keys with values. A key that another one begins with ends at an inner node."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: Any) -> None:
        """value must not be None; of equal keys the last value stays."""
        node, at = self.root, 0
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                node.put(Node(key[at:], value))
                return
            path = below.path
            same = len(path) if key.startswith(path, at) else _common(path, key, at)
            if same < len(path):  # the path is cut in two
                middle = Node(path[:same])
                below.path = path[same:]
                middle.put(below)
                node.put(middle)
                below = middle
            node, at = below, at + same
        node.value = value

    def get(self, key: bytes) -> Any:
        node, at = self.root, 0
        while at < len(key):
            node = node.child(key[at])
            if node is None or not key.startswith(node.path, at):
                return None
            at += len(node.path)
        return node.value

    def upwards(self) -> Iterator[Node]:
        """All nodes, children before their parent; no recursion, so paths may be long."""
        stack, order = [self.root], []
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.kids())
        return reversed(order)


def _common(path: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of path and key[at:], by halving."""
    lo, hi = 0, min(len(path), len(key) - at)
    while lo < hi:
        middle = (lo + hi + 1) // 2
        if path[:middle] == key[at : at + middle]:
            lo = middle
        else:
            hi = middle - 1
    return lo
