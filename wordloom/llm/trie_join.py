"""Prefix-tree join of n-gram sets under a Jaccard threshold, within one block of documents."""

from __future__ import annotations

from collections import Counter


#: Token ranks up to which an edge is kept as the bits of a whole number.
_BITS = 1 << 16


def bits_of(tokens: tuple[int, ...]) -> int:
    """The bits of ascending token ranks."""
    if not tokens:
        return 0
    held = bytearray(tokens[-1] // 8 + 1)
    for t in tokens:
        held[t >> 3] |= 1 << (t & 7)
    return int.from_bytes(held, "little")


class Node:
    """An edge's tokens and what stands below it."""

    __slots__ = ("tokens", "held", "children", "docs", "least", "most", "rest", "group")

    def __init__(self, tokens: tuple[int, ...], held: int | frozenset[int]):
        self.tokens, self.held = tokens, held
        self.children: dict[int, Node] = {}
        self.docs: list[int] = []
        self.least, self.most = 1 << 62, 0  # set sizes below
        self.rest = 0  # most tokens behind this edge on a way down
        self.group = -2  # a document of the one group below, -1 for several, -2 for none


class TrieJoin:
    """Links sets with intersection / union >= ``num`` / ``den``.

    Tokens are ordered by frequency, most frequent first, and each set is a
    way down the tree, so sets share the overlap counted on common edges.  A
    subtree is left when the overlap so far and what can still follow (tokens
    left in the set, tokens left below) cannot reach the overlap that the
    smallest set below needs, when sizes rule it out, or when everything below
    is linked with the set already.  So every link between different groups is
    found, and groups of mutually similar sets cost one link each.
    """

    def __init__(self, num: int = 75, den: int = 100, ranks: int = _BITS):
        self.num, self.den = num, den
        self.hold = bits_of if ranks <= _BITS else frozenset  # overlaps are counted in one step either way
        self.root = Node((), self.hold(()))
        self.parent: list[int] = []
        self.sizes: list[int] = []

    def find(self, d: int) -> int:
        """The root of a document's group."""
        while self.parent[d] != d:
            self.parent[d] = self.parent[self.parent[d]]
            d = self.parent[d]
        return d

    def need(self, a: int, b: int) -> int:
        """The overlap that sets of a and b tokens need."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def add(self, tokens: tuple[int, ...], size: int, probe: bool = True, insert: bool = True) -> int:
        """Adds a set (its shared tokens' ranks, ascending; ``size`` counts all its tokens) after linking it with the sets in the tree."""
        d = len(self.parent)
        self.parent.append(d)
        self.sizes.append(size)
        if probe and self.root.most and size:
            self.probe(d, tokens)
        if insert:
            self.insert(d, tokens)
        return d

    def probe(self, d: int, tokens: tuple[int, ...]) -> None:
        """Links set d with every group that holds a set similar to it."""
        mine, size, num, den = self.hold(tokens), self.sizes[d], self.num, self.den
        position = {t: k for k, t in enumerate(tokens)}
        bits, own, n = isinstance(mine, int), self.find(d), len(tokens)
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, passed = stack.pop()
            group = node.group
            if group >= 0 and self.find(group) == own:
                continue
            if node.least * num > size * den or node.most * den < size * num:
                continue
            common = mine & node.held
            if common:
                overlap += common.bit_count() if bits else len(common)
                passed = 1 + position[common.bit_length() - 1 if bits else max(common)]
            if overlap + min(node.rest, n - passed) < self.need(size, max(node.least, -(-size * num // den))):
                continue
            for other in node.docs:
                if overlap >= self.need(size, self.sizes[other]):
                    group = self.find(other)
                    if group != own:
                        self.parent[own] = group
                        own = group
            if node.children:
                stack.extend((child, overlap, passed) for first, child in node.children.items() if first not in position)
                stack.extend((child, overlap, passed) for first, child in node.children.items() if first in position)

    def insert(self, d: int, tokens: tuple[int, ...]) -> None:
        """Puts set d into the tree."""
        node, at, size = self.root, 0, self.sizes[d]
        own = self.find(d)
        while True:
            node.least, node.most, node.rest = min(node.least, size), max(node.most, size), max(node.rest, len(tokens) - at)
            node.group = own if node.group == -2 or node.group >= 0 and self.find(node.group) == own else -1
            if at == len(tokens):
                node.docs.append(d)
                return
            child = node.children.get(tokens[at])
            if child is None:
                child = node.children[tokens[at]] = Node(tokens[at:], self.hold(tokens[at:]))
                child.least = child.most = size
                child.group = own
                child.docs.append(d)
                return
            edge, k = child.tokens, 1
            end = min(len(edge), len(tokens) - at)
            while k < end and edge[k] == tokens[at + k]:
                k += 1
            if k < len(edge):
                upper = Node(edge[:k], self.hold(edge[:k]))
                upper.least, upper.most, upper.group = child.least, child.most, child.group
                upper.rest = child.rest + len(edge) - k
                child.tokens, child.held = edge[k:], self.hold(edge[k:])
                upper.children[edge[k]] = child
                node.children[edge[0]] = upper
                child = upper
            node, at = child, at + k


def link_block(sets: list[tuple[int, list[int]]], num: int = 75, den: int = 100, second: list[bool] | None = None) -> list[int]:
    """For each (size, tokens) the index of its group's first member, over all links between the block's sets.

    With ``second`` only the sets marked there are compared with those not marked, none with another of its side.
    """
    seen = Counter(t for _, tokens in sets for t in tokens)
    order = {t: k for k, (t, _) in enumerate(sorted(((t, n) for t, n in seen.items() if n > 1), key=lambda x: (-x[1], x[0])))}
    join = TrieJoin(num, den, len(order))
    by_size = sorted(range(len(sets)), key=lambda i: (second is not None and second[i], sets[i][0]))
    for i in by_size:
        size, tokens = sets[i]
        probe = second is None or second[i]
        join.add(tuple(sorted(order[t] for t in tokens if t in order)), size, probe, second is None or not probe)
    first: dict[int, int] = {}
    out = [0] * len(sets)
    for k, i in enumerate(by_size):
        root = join.find(k)
        first[root] = min(first.get(root, i), i)
    for k, i in enumerate(by_size):
        out[i] = first[join.find(k)]
    return out
