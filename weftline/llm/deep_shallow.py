"""Deep-shallow sorting of strings: multikey quicksort to a shallow depth, then blind tries for what is still equal there."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at, eight at a time.
SHALLOW = 32
#: Strings up to which a part is put in order by insertion.
FEW = 12


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Strings by branching depth and the byte there alone; one comparison with a found leaf places a new string.

    An inner node is [depth, {byte: child}], a leaf a list of numbers of equal strings; -1 stands for the end of a string.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def _byte(self, k: int, depth: int) -> int:
        s = self.strings[k]
        return s[depth] if depth < len(s) else -1

    def add(self, k: int) -> None:
        if self.root is None:
            self.root = [None, [k]]
            return
        s, path, at = self.strings[k], [], self.root
        while at[0] is not None:  # down to any leaf that could be alike
            path.append(at)
            at = at[1].get(self._byte(k, at[0])) or next(iter(at[1].values()))
        other = at[1][0]
        depth = common_prefix(s, self.strings[other])
        if depth == len(s) == len(self.strings[other]):
            at[1].append(k)
            return
        while path and path[-1][0] >= depth:
            at = path.pop()
        if at[0] == depth:
            at[1][self._byte(k, depth)] = [None, [k]]
            return
        node = [depth, {self._byte(other, depth): at, self._byte(k, depth): [None, [k]]}]
        if path:
            above = path[-1]
            above[1][self._byte(k, above[0])] = node
        else:
            self.root = node

    def ordered(self) -> tuple[list[int], list[int]]:
        """The numbers in order, and the prefix that each has in common with the one before it."""
        out, common, todo = [], [], [(self.root, 0)]
        while todo:
            node, shared = todo.pop()
            if node[0] is None:
                for j, k in enumerate(node[1]):
                    out.append(k)
                    common.append(shared if j == 0 else len(self.strings[k]))
            else:
                children = [node[1][b] for b in sorted(node[1])]
                todo += [(c, node[0] if j else shared) for j, c in reversed(list(enumerate(children)))]
        return out, common


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings, and for each in it the length of the prefix in common with the one before (0 for the first)."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, SHALLOW // 8)
    out: list[int] = []
    common: list[int] = []

    def placed(part: list[int]) -> None:
        """Puts a part in order that is alike as far as quicksort has looked, or small."""
        if len(part) == 1:
            order, shared = part, [0]
        else:
            trie = BlindTrie(strings)
            for k in part:
                trie.add(k)
            order, shared = trie.ordered()
        shared[0] = common_prefix(strings[out[-1]], strings[order[0]]) if out else 0
        out.extend(order)
        common.extend(shared)

    todo: list[tuple[np.ndarray, int]] = [(np.arange(n), 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) <= FEW or depth == words.shape[1]:
            if len(part):
                placed(part.tolist())
            continue
        column = words[part, depth]
        pivot = np.sort(column[:: max(1, len(part) // 9)])[: 9][min(4, (len(part) - 1) // max(1, len(part) // 9) // 2)]
        todo += [(part[column > pivot], depth), (part[column == pivot], depth + 1), (part[column < pivot], depth)]
    return np.array(out), np.array(common)
