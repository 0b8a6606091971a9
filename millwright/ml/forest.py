"""Isolation forest, and Shapley values of tree ensembles."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Fixed by the method: rows of a tree's sample and number of trees.
SAMPLE, TREES = 256, 100


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search in a random binary tree of n leaves."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Random trees over samples of bounded size; anomalies are isolated at small depth."""

    trees: list[np.ndarray]
    size: int

    @classmethod
    def fit(cls, x: np.ndarray, seed: int) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(SAMPLE, len(x))
        depth = math.ceil(math.log2(max(size, 2)))
        trees = []
        for _ in range(TREES):
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, -1, -1, level + float(average_path(len(rows)))])
                spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(x.shape[1])
                if level < depth and len(rows) > 1 and (live := np.flatnonzero(spread > 0)).size:
                    f = int(rng.choice(live))
                    cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
                    left = rows[:, f] < cut
                    nodes[at][:2] = [f, cut]
                    nodes[at][2] = grow(rows[left], level + 1)
                    nodes[at][3] = grow(rows[~left], level + 1)
                return at

            grow(x[rng.choice(len(x), size, replace=False)], 0)
            trees.append(np.array(nodes))
        return cls(trees, size)

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Positive for normal rows, negative for anomalies."""
        depth = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                left = x[inner, f[inner]] < t[at[inner], 1]
                at[inner] = np.where(left, t[at[inner], 2], t[at[inner], 3]).astype(int)
            depth += t[at, 4]
        return 0.5 - 2 ** (-depth / len(self.trees) / max(float(average_path(self.size)), 1e-9))


@dataclass
class Tree:
    """A decision tree as arrays: feature (-1 at a leaf), threshold, children, value and training weight of each node."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    weight: list[float]


def read_tree(root, value_of) -> Tree:
    """Copy a fitted tree's nodes out of the JVM. Only continuous splits occur, since features are codes."""
    out = Tree([], [], [], [], [], [])

    def visit(node) -> int:
        at = len(out.feature)
        for column, v in zip((out.feature, out.threshold, out.left, out.right), (-1, 0.0, -1, -1)):
            column.append(v)
        out.value.append(float(value_of(node)))
        out.weight.append(float(node.impurityStats().count()))
        if node.subtreeDepth() > 0:
            out.feature[at], out.threshold[at] = node.split().featureIndex(), node.split().threshold()
            out.left[at] = visit(node.leftChild())
            out.right[at] = visit(node.rightChild())
        return at

    visit(root)
    return out


def tree_shap(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Shapley values of one row under the tree's own path weights.

    Each path to a leaf is a game: a player is a feature on the path, with the
    share of training weight that follows when the feature is unknown and 1 or
    0 when it is known. The leaf's value is shared out by the weights of subset
    sizes, which a polynomial in the shares of the other players holds.
    """
    phi = np.zeros(len(x))

    def walk(at: int, players: dict[int, tuple[float, float]]) -> None:
        if tree.feature[at] < 0:
            names = list(players)
            zero, one = np.array([players[k][0] for k in names]), np.array([players[k][1] for k in names])
            m = len(names)
            for i, name in enumerate(names):
                poly = np.array([1.0])
                for j in range(m):
                    if j != i:
                        # coefficient of t ** s: subsets of s known players
                        poly = np.convolve(poly, [zero[j], one[j]])
                weights = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
                phi[name] += (one[i] - zero[i]) * float(poly @ weights) * tree.value[at]
            return
        f = tree.feature[at]
        goes_left = x[f] <= tree.threshold[at]
        z, o = players.get(f, (1.0, 1.0))
        for child, hit in ((tree.left[at], goes_left), (tree.right[at], not goes_left)):
            share = tree.weight[child] / tree.weight[at] if tree.weight[at] else 0.0
            walk(child, players | {f: (z * share, o * hit)})

    walk(0, {})
    return phi
