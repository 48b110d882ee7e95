"""Small gradient-boosted trees for binary labels, fitted on the driver and applied as a Column.

Second-order boosting on the logistic loss with exact splits; made for a few thousand bounded rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf is a float, an inner node (feature, cut, tree where value < cut, tree elsewhere).
Tree = float | tuple


@dataclass
class Boosted:
    prior: float
    trees: list[Tree] = field(default_factory=list)
    #: Platt scaling of the margin.
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, row: Sequence[float]) -> float:
        total = self.prior
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
            total += tree
        return total

    def probability(self, row: Sequence[float]) -> float:
        return 1 / (1 + math.exp(-(self.scale * self.margin(row) + self.shift)))

    def calibrate(self, rows: Sequence[Sequence[float]], labels: Sequence[int], steps: int = 50) -> None:
        """Fit scale and shift by Newton's method on rows that the trees haven't seen."""
        m, y = np.array([self.margin(r) for r in rows]), np.array(labels, float)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - y) * m).sum() + 1e-2 * (a - 1), (p - y).sum()])
            h = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
            da, db = np.linalg.solve(h, g)
            a, b = a - da, b - db
        self.scale, self.shift = float(a), float(b)

    def expression(self, value: Callable[[int], Column]) -> Column:
        """The calibrated probability as a Column; `value(i)` is feature i."""

        def build(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(value(tree[0]) < F.lit(float(tree[1])), build(tree[2])).otherwise(build(tree[3]))

        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + build(tree)
        return 1 / (1 + F.exp(-(total * self.scale + self.shift)))


def fit(rows: Sequence[Sequence[float]], labels: Sequence[int], n_trees: int = 24, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: int = 5) -> Boosted:
    x, y = np.array(rows, float), np.array(labels, float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(math.log(share / (1 - share)))
    margin = np.full(len(y), model.prior)
    cuts = [(v := np.unique(x[:, j]))[:-1] + np.diff(v) / 2 for j in range(x.shape[1])]

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> Tree:
        value = -rate * g[at].sum() / (h[at].sum() + l2)
        best = (1e-6, None)
        if level and len(at) >= 2 * least:
            whole = g[at].sum() ** 2 / (h[at].sum() + l2)
            for j, edges in enumerate(cuts):
                for cut in edges:
                    low = x[at, j] < cut
                    if least <= low.sum() <= len(at) - least:
                        gl, hl = g[at][low].sum(), h[at][low].sum()
                        gr, hr = g[at].sum() - gl, h[at].sum() - hl
                        gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - whole
                        if gain > best[0]:
                            best = (gain, (j, float(cut)))
        if best[1] is None:
            return float(value)
        j, cut = best[1]
        low = x[at, j] < cut
        return (j, cut, grow(at[low], g, h, level - 1), grow(at[~low], g, h, level - 1))

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        model.trees.append(tree)
        for i in range(len(y)):
            node = tree
            while isinstance(node, tuple):
                node = node[2] if x[i, node[0]] < node[1] else node[3]
            margin[i] += node
    return model


def threshold(probabilities: Sequence[float], labels: Sequence[int], precision: float) -> float:
    """The lowest cut at which the share of true ones among those accepted is at least `precision`; 2 if there is none."""
    pairs = sorted(zip(probabilities, labels, strict=True), reverse=True)
    best, hits = 2.0, 0
    for i, (p, y) in enumerate(pairs, 1):
        hits += y
        if (i == len(pairs) or pairs[i][0] < p) and hits / i >= precision:
            best = p
    return max(best, 0.5)
