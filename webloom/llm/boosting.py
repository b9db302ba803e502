"""Gradient boosted trees for two classes, in numpy; small enough to travel with a task."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with histogram splits; features are small non-negative whole numbers."""

    def __init__(self, trees: int = 80, depth: int = 5, rate: float = 0.2, smallest: int = 10, shrink: float = 1.0, share: float = 0.4):
        self.trees, self.depth, self.rate, self.smallest, self.shrink, self.share = trees, depth, rate, smallest, shrink, share

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> BoostedTrees:
        """Each tree sees a random ``share`` of the rows; the nodes of one depth share their histograms."""
        x = np.minimum(x, 31).astype(np.int64)
        n, m = x.shape
        cells = (x + np.arange(m) * 32).astype(np.int32)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, random = np.full(n, self.base), np.random.default_rng(seed)
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((self.trees, nodes), -1, dtype=np.int64)
        self.cut, self.value = np.zeros((self.trees, nodes), dtype=np.int64), np.zeros((self.trees, nodes))
        for t in range(self.trees):
            rows = np.flatnonzero(random.random(n) < self.share)
            p = 1 / (1 + np.exp(-score[rows]))
            g, h = y[rows] - p, p * (1 - p)
            mine, at = cells[rows], np.zeros(len(rows), dtype=np.int64)
            for level in range(self.depth + 1):
                width, first = 2**level, 2**level - 1
                place = at - first
                live = np.flatnonzero(place >= 0)
                sums = [np.bincount(place[live], w[live], width) for w in (g, h)]
                self.value[t, first : first + width] = self.rate * sums[0] / (sums[1] + self.shrink)
                if level == self.depth or not len(live):
                    break
                flat = (mine[live] + (place[live] * (m * 32))[:, None].astype(np.int32)).ravel()
                left = [np.bincount(flat, np.repeat(w[live], m) if w is not None else None, width * m * 32).reshape(width, m, 32).cumsum(axis=2) for w in (g, h, None)]
                gs, hs, total = sums[0][:, None, None], sums[1][:, None, None], np.bincount(place[live], minlength=width)[:, None, None]
                gain = left[0] ** 2 / (left[1] + self.shrink) + (gs - left[0]) ** 2 / (hs - left[1] + self.shrink) - gs**2 / (hs + self.shrink)
                gain[(left[2] < self.smallest) | (total - left[2] < self.smallest)] = -1
                best = gain.reshape(width, -1).argmax(axis=1)
                good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                f, cut = np.divmod(best, 32)
                self.feature[t, first : first + width] = np.where(good, f, -1)
                self.cut[t, first : first + width] = cut
                on = live[good[place[live]]]
                down = at[on] * 2 + 1 + (x[rows[on], f[place[on]]] > cut[place[on]])
                at[:] = -1
                at[on] = down
            score += self._tree(t, x)
        return self

    def _tree(self, t: int, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[t, at]
            at = np.where(f >= 0, at * 2 + 1 + (x[rows, np.maximum(f, 0)] > self.cut[t, at]), at)
        return self.value[t, at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.minimum(x, 31)
        score = np.full(len(x), self.base)
        for t in range(self.trees):
            score += self._tree(t, x)
        return score


def calibration(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Scale and shift of a logistic curve over the margins of held-out rows (Platt), by Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        w, d = p * (1 - p) + 1e-9, target - p
        hess = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(d * margin).sum(), d.sum()]))
        a, b = a + 0.5 * step[0], b + 0.5 * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)
