"""A tree as arrays, and its text forms."""

from __future__ import annotations

import functools
import re

import numpy as np


class Tree:
    """Nodes in preorder: parent (-1 at the root), length of the branch above, name."""

    def __init__(self, parent, length, name, ids=None) -> None:
        self.parent = np.asarray(parent, np.int64)
        self.length = np.asarray(length, float)
        self.name = list(name)
        self.ids = list(range(len(self.parent))) if ids is None else list(ids)
        self.children: list[list[int]] = [[] for _ in self.parent]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(i)

    def __len__(self) -> int:
        return len(self.parent)

    @property
    def tips(self) -> np.ndarray:
        return np.array([i for i, c in enumerate(self.children) if not c], np.int64)

    @property
    def postorder(self) -> range:
        return range(len(self) - 1, -1, -1)

    @functools.cached_property
    def up_levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """From the tips up: (inner nodes whose children are all of earlier levels, these children in a row, where each node's begin)."""
        height = np.zeros(len(self), np.int64)
        for i in self.postorder:
            if i:
                p = self.parent[i]
                height[p] = max(height[p], height[i] + 1)
        out = []
        order = np.argsort(height, kind="stable")
        for nodes in np.split(order, np.flatnonzero(np.diff(height[order])) + 1)[1:]:
            n = [len(self.children[i]) for i in nodes]
            out.append((nodes, np.concatenate([self.children[i] for i in nodes]).astype(np.int64), np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)))
        return out

    @functools.cached_property
    def down_levels(self) -> list[np.ndarray]:
        """Nodes by their number of branches from the root, from 1 on."""
        d = np.zeros(len(self), np.int64)
        for i in range(1, len(self)):
            d[i] = d[self.parent[i]] + 1
        order = np.argsort(d, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(d[order])) + 1)[1:]

    def depth(self) -> np.ndarray:
        """Distance from the root."""
        d = np.zeros(len(self))
        for i in range(1, len(self)):
            d[i] = d[self.parent[i]] + self.length[i]
        return d

    @classmethod
    def from_rows(cls, node_id, parent_id, length, name, child_ix=None) -> list[Tree]:
        """The trees of a table of nodes, one per root; nodes whose parent is missing are roots too."""
        ids = list(node_id)
        at = {n: i for i, n in enumerate(ids)}
        kids: dict = {}
        rank = child_ix if child_ix is not None else [0] * len(ids)
        roots = []
        for i, p in enumerate(parent_id):
            if p is None or p != p or int(p) not in at or int(p) == ids[i]:
                roots.append(i)
            else:
                kids.setdefault(at[int(p)], []).append(i)
        key = lambda i: (0 if rank[i] is None or rank[i] != rank[i] else rank[i], ids[i])
        out = []
        for r in sorted(roots, key=key):
            order, parent, stack = [], [], [(r, -1)]
            while stack:
                i, p = stack.pop()
                k = len(order)
                order.append(i)
                parent.append(p)
                stack += [(c, k) for c in sorted(kids.get(i, []), key=key, reverse=True)]
            ln = [float(length[i]) if length[i] is not None and length[i] == length[i] else 0.0 for i in order]
            out.append(cls(parent, np.maximum(ln, 0.0), [name[i] for i in order], [ids[i] for i in order]))
        return out

    def rebuilt(self, parent: dict[int, int], length: dict[int, float], root: int, names: dict[int, str] | None = None) -> Tree:
        """A tree from parents and lengths by old index (new nodes have their own)."""
        kids: dict[int, list[int]] = {}
        for c, p in parent.items():
            kids.setdefault(p, []).append(c)
        order, par, stack = [], [], [(root, -1)]
        while stack:
            i, p = stack.pop()
            k = len(order)
            order.append(i)
            par.append(p)
            stack += [(c, k) for c in sorted(kids.get(i, []), reverse=True)]
        nm = lambda i: (names or {}).get(i, self.name[i] if i < len(self) else None)
        idn = lambda i: self.ids[i] if i < len(self) else None
        return Tree(par, [length.get(i, 0.0) for i in order], [nm(i) for i in order], [idn(i) for i in order])

    def reroot(self, node: int, x: float) -> Tree:
        """New root on the branch above node, at share x of the branch from the node; old unary roots go."""
        if self.parent[node] < 0:
            return self
        parent = {i: int(p) for i, p in enumerate(self.parent) if p >= 0}
        length = {i: float(v) for i, v in enumerate(self.length)}
        up, whole = parent[node], length[node]
        if x > 1 - 1e-5:
            root = up
        elif x < 1e-5 and self.children[node]:
            root = node
        else:
            root = len(self)
        chain = [node]
        while chain[-1] in parent:
            chain.append(parent[chain[-1]])
        flip = chain[1:] if root != node else chain
        if root == len(self):
            below = length[node]
            parent[node], length[node] = root, x * whole
            last, dist = root, (1 - x) * below
        elif root == node:
            last, dist = node, length[node]
            parent.pop(node, None)
        else:
            last, dist = None, 0.0
        prev, carry = last, dist
        for c in flip if root != node else flip[1:]:
            nxt = length[c]
            if c == root:
                parent.pop(c, None)
            else:
                parent[c], length[c] = prev, carry
            prev, carry = c, nxt
        length[root] = 0.0
        old = chain[-1]
        kids = [c for c, p in parent.items() if p == old]
        if old != root and len(kids) == 1:  # the old root joins two branches only
            c = kids[0]
            parent[c], length[c] = parent[old], length[c] + length[old]
            parent.pop(old)
        return self.rebuilt(parent, length, root)

    def collapsed(self, drop: np.ndarray) -> Tree:
        """Without the marked inner nodes; their children move up to the nearest node that stays."""
        parent, length = {}, {0: float(self.length[0])}
        for i in range(1, len(self)):
            if drop[i] and self.children[i]:
                continue
            p = int(self.parent[i])
            while p > 0 and drop[p]:
                p = int(self.parent[p])
            parent[i], length[i] = p, float(self.length[i])
        return self.rebuilt(parent, length, 0)

    def common_ancestor(self, nodes: list[int]) -> int:
        """The node farthest from the root that is above all given nodes."""
        seen: dict[int, int] = {}
        for i in set(nodes):
            while i >= 0:
                seen[i] = seen.get(i, 0) + 1
                i = int(self.parent[i])
        return max(i for i, n in seen.items() if n == len(set(nodes)))

    def newick(self) -> str:
        text: dict[int, str] = {}
        for i in self.postorder:
            inner = "(" + ",".join(text.pop(c) for c in self.children[i]) + ")" if self.children[i] else ""
            n = self.name[i] or ""
            if re.search(r"[\s()\[\],:;']", n):
                n = "'" + n.replace("'", "''") + "'"
            text[i] = f"{inner}{n}:{self.length[i]:.10g}"
        return text[0] + ";"


_TOKEN = re.compile(r"\s*(?:(\()|(\))|(,)|(;)|:\s*([-+0-9.eE]+)|\[[^\]]*\]|'((?:[^']|'')*)'|([^\s()\[\],:;']+))")


def parse_newick(text: str) -> Tree:
    """The tree of a newick text: quoted names, comments in brackets and missing lengths are read."""
    parent, length, name, at, pos = [-1], [0.0], [None], 0, 0
    kids_first: list[int] = [0]
    text = text.strip()
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"no newick at {pos}")
        pos = m.end()
        if m[1]:
            parent.append(at)
            length.append(0.0)
            name.append(None)
            at = len(parent) - 1
        elif m[3]:
            parent.append(parent[at])
            length.append(0.0)
            name.append(None)
            at = len(parent) - 1
        elif m[2]:
            at = parent[at]
            if at < 0:
                raise ValueError("brackets do not match")
        elif m[4]:
            break
        elif m[5]:
            length[at] = float(m[5])
        elif m[6] is not None or m[7]:
            name[at] = m[6].replace("''", "'") if m[6] is not None else m[7]
    if at != 0:
        raise ValueError("brackets do not match")
    return Tree.from_rows(range(len(parent)), [None if p < 0 else p for p in parent], length, name, range(len(parent)))[0]


def parse_tree(text: str) -> Tree:
    """Newick, or the first tree of a nexus text with its translate table."""
    if not text.lstrip().lower().startswith("#nexus"):
        return parse_newick(text)
    table = re.search(r"(?is)\btranslate\b(.*?);", text)
    tree = re.search(r"(?is)\btree\s+[^=;]*=\s*(?:\[[^\]]*\]\s*)*(\(.*?;)", text)
    if not tree:
        raise ValueError("no tree in the nexus text")
    t = parse_newick(tree[1])
    if table:
        names = dict(re.findall(r"\s*(\S+)\s+('(?:[^']|'')*'|[^,\s]+)\s*(?:,|$)", table[1]))
        t.name = [names.get(n, n).strip("'") if n else n for n in t.name]
    return t
