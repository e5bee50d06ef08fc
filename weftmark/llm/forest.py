"""A forest of random-projection trees and its search through one shared priority queue."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    normals: np.ndarray  # (inner nodes, dimensions)
    offsets: np.ndarray
    children: np.ndarray  # (inner nodes, 2); a negative child -k - 1 is leaf k
    leaves: int


def build(x: np.ndarray, leaf: int, draw: np.random.Generator) -> Tree:
    """Split at the median along the difference of two random points, until ``leaf`` points or fewer are left."""
    normals, offsets, children, leaves = [], [], [], 0
    stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    root = 0
    while stack:
        rows, parent, side = stack.pop()
        me = None
        if len(rows) > leaf:
            for _ in range(4):
                a, b = draw.choice(rows, 2, replace=False)
                normal = x[a] - x[b]
                norm = np.sqrt((normal**2).sum())
                if norm < 1e-12:
                    continue
                along = x[rows] @ (normal / norm)
                cut = float(np.median(along))
                right = along > cut
                if right.any():
                    me = len(normals)
                    normals.append(normal / norm)
                    offsets.append(cut)
                    children.append([0, 0])
                    stack += [(rows[~right], me, 0), (rows[right], me, 1)]
                    break
        if me is None:
            me = -leaves - 1
            leaves += 1
        if parent >= 0:
            children[parent][side] = me
        else:
            root = me
    if root < 0:
        normals, offsets, children = [np.zeros(x.shape[1])], [np.inf], [[-1, -1]]
    return Tree(np.array(normals), np.array(offsets), np.array(children), leaves)


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64)
    alive = np.arange(len(x))
    while len(alive):
        nodes = at[alive]
        right = np.einsum("ij,ij->i", x[alive], tree.normals[nodes]) > tree.offsets[nodes]
        at[alive] = tree.children[nodes, right.astype(int)]
        alive = alive[at[alive] >= 0]
    return -at - 1


def search(trees: list[Tree], q: np.ndarray, probes: int) -> list[tuple[int, int]]:
    """The ``probes`` leaves (tree, leaf) nearest to q: one queue over all trees, by the least margin on the path."""
    margins = [(t.normals @ q - t.offsets).tolist() for t in trees]
    children = [t.children.tolist() for t in trees]
    queue: list[tuple[float, int, int]] = [(-np.inf, k, 0) for k in range(len(trees))]
    out: list[tuple[int, int]] = []
    while queue and len(out) < probes:
        cost, k, node = heapq.heappop(queue)
        while node >= 0:  # down the near side, whose cost stays; the far side waits
            d = margins[k][node]
            near = d > 0
            heapq.heappush(queue, (max(cost, abs(d)), k, children[k][node][not near]))
            node = children[k][node][near]
        out.append((k, -node - 1))
    return out
