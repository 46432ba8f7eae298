"""Deep-shallow sorting of strings with long common prefixes."""

from __future__ import annotations

import numpy as np

SHALLOW = 40


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return n if not x else ((x & -x).bit_length() - 1) >> 3


class BlindTrie:
    """Orders strings that share a long prefix.

    Inner nodes hold a depth and children by the byte at that depth (-1 for a
    string that ends there), nothing else.  A string goes down blindly to any
    leaf, is compared with that one string, and is put in where they part.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None

    def add(self, k: int) -> None:
        """Puts in string k."""
        s = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            byte = s[depth] if depth < len(s) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = self.strings[node[0]]
        common = lcp(s, other)
        mine = s[common] if common < len(s) else -1
        theirs = other[common] if common < len(other) else -1
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            byte = s[node[0]] if node[0] < len(s) else -1
            above, node = (node[1], byte), node[1][byte]
        if mine == theirs:
            while isinstance(node, tuple):
                node = node[1][s[node[0]] if node[0] < len(s) else -1]
            node.append(k)
            return
        if isinstance(node, tuple) and node[0] == common:
            node[1][mine] = [k]
            return
        made = (common, {theirs: node, mine: [k]})
        if above is None:
            self.root = made
        else:
            above[0][above[1]] = made

    def order(self) -> list[int]:
        """The strings in order, equal ones side by side."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][byte] for byte in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, LCP of each string with the one before it in the order; 0 for the first).

    A multikey sort by levels, a word of eight bytes at a time and all groups
    at once: at each depth the groups that are still equal are sorted by their
    next word.  (numpy sorts a level; it stands in for the three-way partition
    of multikey quicksort, which orders the same groups by the same keys.)
    Groups equal to the shallow depth go to a blind trie each.
    """
    n = len(strings)
    if not n:
        return [], []
    head = np.frombuffer(b"".join([s[:shallow].ljust(shallow, b"\0") for s in strings]), ">u8").reshape(n, shallow // 8).astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)  # positions in the order whose group is larger than one
    for depth in range(shallow // 8):
        at = order[live]
        by = np.lexsort((head[at, depth], group[live]))
        order[live] = at = at[by]
        word, of = head[at, depth], group[live]
        fresh = np.concatenate([[True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])])
        group[live] = live[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        alone = fresh & np.concatenate([fresh[1:], [True]])
        live = live[~alone]
        if not len(live):
            break
    result = order.tolist()
    if len(live):
        starts = np.flatnonzero(np.concatenate([[True], group[live][1:] != group[live][:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(live)], strict=True):
            low, high = int(live[a]), int(live[b - 1]) + 1
            if high - low == 2:
                x, y = result[low], result[low + 1]
                if strings[y] < strings[x]:
                    result[low], result[low + 1] = y, x
                continue
            members = result[low:high]
            trie = BlindTrie([strings[k] for k in members])
            for k in range(len(members)):
                trie.add(k)
            result[low:high] = [members[k] for k in trie.order()]
    common = [0] * n
    for k in range(1, n):
        common[k] = lcp(strings[result[k - 1]], strings[result[k]])
    return result, common
