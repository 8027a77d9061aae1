"""A prefix tree over ordered sets, probed for overlaps that reach a Jaccard similarity."""

from __future__ import annotations

import numpy as np


def needed(n: int, m: int, percent: int) -> int:
    """The least overlap of sets of n and m elements whose Jaccard similarity is ``percent`` / 100 or more."""
    return -(-percent * (n + m) // (100 + percent))


class Trie:
    """Sets as paths from the root; sets that begin alike share nodes.

    ``sets`` are sorted arrays of distinct numbers: their order by value is the global order that
    all tries have in common. Each node covers a run of elements (``lo:hi`` of one member set).
    ``least`` and ``most`` are the sizes of the smallest and largest set below it.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = [len(x) for x in sets]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        values, ranks = np.unique(flat, return_inverse=True)
        self.sets = np.split(ranks, np.cumsum(self.sizes)[:-1]) if sets else []
        self._mark = np.zeros(len(values) + 1, np.int32)
        self.parent: list[int] = [-1]
        self.edge: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.depth: list[int] = [0]
        self.children: list[list[int]] = [[]]
        self.leaf: dict[int, int] = {}
        self.members: list[list[int]] = [[]]
        self._build()

    def _node(self, parent: int, edge: np.ndarray) -> int:
        self.parent.append(parent)
        self.edge.append(edge)
        self.depth.append(self.depth[parent] + len(edge))
        self.children.append([])
        self.members.append([])
        self.children[parent].append(len(self.parent) - 1)
        return len(self.parent) - 1

    def _build(self) -> None:
        order = sorted(range(len(self.sets)), key=lambda i: self.sets[i].astype(">i8").tobytes())
        path = [0]  # nodes on the way to the last set
        last = np.zeros(0, np.int64)
        for i in order:
            x = self.sets[i]
            n = min(len(x), len(last))
            other = np.flatnonzero(x[:n] != last[:n])
            common = int(other[0]) if len(other) else n
            while self.depth[path[-1]] > common:
                node = path.pop()
                if self.depth[path[-1]] < common:  # the node's run is cut in two
                    path.append(self._cut(node, common - self.depth[path[-1]]))
            if len(x) > common:
                path.append(self._node(path[-1], x[common:]))
            self.leaf[i] = path[-1]
            self.members[path[-1]].append(i)
            last = x
        self._any, self._one = [-1] * len(self.parent), [False] * len(self.parent)
        self.least, self.most = [1 << 62] * len(self.parent), [0] * len(self.parent)
        for i, node in self.leaf.items():
            while node >= 0:
                self._any[node] = i
                self.least[node] = min(self.least[node], self.sizes[i])
                self.most[node] = max(self.most[node], self.sizes[i])
                node = self.parent[node]

    def _cut(self, node: int, at: int) -> int:
        upper = self._node(self.parent[node], self.edge[node][:at])
        self.children[self.parent[node]].remove(node)
        self.edge[node] = self.edge[node][at:]
        self.parent[node] = upper
        self.children[upper].append(node)
        return upper

    def _alive(self, node: int, overlap: int, size: int, left: int, percent: int) -> bool:
        """Whether some set below may still reach the overlap that it needs: what is left of both sides bounds the gain."""
        gain = min(left, self.most[node] - self.depth[node])
        return overlap + gain >= needed(size, self.least[node], percent) and 100 * min(size, self.most[node]) >= percent * min(max(size, self.least[node]), size)

    def _joined(self, node: int, find) -> bool:
        """Whether all sets below are known to be in one component; once true it stays so."""
        if not self._one[node]:
            first = find(self._any[node])
            self._one[node] = all(self._one[c] and find(self._any[c]) == first for c in self.children[node]) and all(
                find(m) == first for m in self.members[node]
            )
        return self._one[node]

    def links(self, i: int, percent: int, targets: list[int] | None = None, find=None) -> list[int]:
        """Sets that set ``i`` is similar to: among ``targets``, or else among all others.

        With ``find``, which names a set's component, sets that are in the component of ``i``
        already may be left out, and whole subtrees of them are.

        Overlaps of shared paths are counted once; a subtree is left as soon as the elements that
        remain on either side cannot bring any of its sets to the similarity.
        """
        x, size = self.sets[i], self.sizes[i]
        if not size:
            return []
        ways = self._ways(targets) if targets is not None else None
        # how many elements of x come up to each rank is what a run's last rank says of the rest of x
        self._mark[x] = 1
        try:
            found, stack = [], [(0, 0)]
            while stack:
                node, overlap = stack.pop()
                for m in self.members[node]:
                    if m != i and (ways is None or m in ways[1]) and overlap >= needed(size, self.sizes[m], percent):
                        found.append(m)
                for child in self.children[node]:
                    if ways is not None and child not in ways[0]:
                        continue
                    if find and self._joined(child, find) and find(self._any[child]) == find(i):
                        continue
                    o, alive = self._down(child, overlap, x, size, percent)
                    if alive:
                        stack.append((child, o))
            return found
        finally:
            self._mark[x] = 0

    def _ways(self, targets: list[int]) -> tuple[set[int], set[int]]:
        """The nodes that have a target below, and the targets."""
        nodes: set[int] = set()
        for m in targets:
            node = self.leaf[m]
            while node > 0 and node not in nodes:
                nodes.add(node)
                node = self.parent[node]
        return nodes, set(targets)

    def _down(self, node: int, overlap: int, x: np.ndarray, size: int, percent: int) -> tuple[int, bool]:
        edge = self.edge[node]
        overlap += int(self._mark[edge].sum())
        left = size - int(np.searchsorted(x, edge[-1], "right"))
        return overlap, self._alive(node, overlap, size, left, percent)


def all_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all sets which chains of similar sets connect; not every pair."""
    trie = Trie(sets)
    root = list(range(len(sets)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    out = []
    for i in range(len(sets)):
        for m in trie.links(i, percent, find=find):
            if find(m) != find(i):
                root[find(m)] = find(i)
                out.append((i, m))
    return out
