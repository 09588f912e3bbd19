"""A compressed radix trie over byte strings."""

from __future__ import annotations

from collections.abc import Iterator

#: What a node costs besides the bytes of its label.
NODE_BYTES = 250


class Node:
    __slots__ = ("children", "label", "terminal")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.children: dict[int, Node] = {}
        self.terminal: object = None


def shared(a: bytes, at: int, b: bytes) -> int:
    """How many leading bytes ``a[at:]`` and ``b`` share, by halving."""
    low, high = 0, min(len(a) - at, len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[at + low : at + middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """Full byte strings in a Patricia trie; a terminal node holds what is known of its string."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = 0
        self.branch_bytes: dict[int, int] = {}

    def terminal(self, key: bytes, new) -> object:
        """The terminal of ``key``; made by ``new()`` if the string was not there."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self._grew(key, len(key) - at)
                node, at = child, len(key)
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = shared(key, at, child.label)
            middle = Node(child.label[:n])
            node.children[key[at]] = middle
            child.label = child.label[n:]
            middle.children[child.label[0]] = child
            self._grew(key, 0)
            node, at = middle, at + n
        if node.terminal is None:
            node.terminal = new()
        return node.terminal

    def _grew(self, key: bytes, n: int) -> None:
        self.bytes += n + NODE_BYTES
        self.branch_bytes[key[0]] = self.branch_bytes.get(key[0], 0) + n + NODE_BYTES

    def spill(self, most: int) -> Iterator[tuple[bytes, object]]:
        """Take out the heaviest subtrees below the root until at most ``most`` bytes are held."""
        while self.bytes > most and self.branch_bytes:
            first = max(self.branch_bytes, key=self.branch_bytes.__getitem__)
            yield from _strings(self.root.children.pop(first), b"")
            self.bytes -= self.branch_bytes.pop(first)

    def drain(self) -> Iterator[tuple[bytes, object]]:
        """Take out everything, the empty string too."""
        yield from self.spill(-1)
        if self.root.terminal is not None:
            yield b"", self.root.terminal
            self.root.terminal = None
        self.bytes = 0


def _strings(top: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
    stack = [(top, prefix)]
    while stack:
        node, before = stack.pop()
        text = before + node.label
        if node.terminal is not None:
            yield text, node.terminal
        stack.extend((child, text) for child in node.children.values())
