"""Small tree ensembles in numpy: boosted regression and bagged calibrated classification.

They are fitted on bounded tables on the driver and applied inside Arrow batches on the executors, so the
model travels as plain arrays.
"""

from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Cut points of each column, midway between its values or quantiles."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > most:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most)))
        cuts.append((values[1:] + values[:-1]) / 2)
    return cuts


#: Rows that an ensemble looks at together.
TOGETHER = 4096


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many cut points of its column lie below it."""
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)


class Tree:
    """A regression tree with several outputs; nodes lie in arrays."""

    def __init__(self) -> None:
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[np.ndarray] = []

    def _node(self, value: np.ndarray) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.left.append(0)
        self.right.append(0)
        self.value.append(value)
        return len(self.value) - 1

    def fit(self, codes, y, w, cuts, depth: int, least: float, features: int, rng) -> "Tree":
        """Grows on ``codes``, the bins of the columns; the gains of a node's columns are worked out together."""
        wide = max(map(len, cuts), default=0) + 1

        def grow(rows: np.ndarray, level: int) -> int:
            ww, yy = w[rows], y[rows]
            total, whole = ww.sum(), (yy * ww[:, None]).sum(0)
            node = self._node(whole / total)
            if level == depth or total < 2 * least or wide < 2:
                return node
            some = rng.permutation(codes.shape[1])[:features]
            flat = (codes[rows][:, some] + np.arange(len(some)) * wide).ravel()
            added = lambda v: np.bincount(flat, np.repeat(v, len(some)), len(some) * wide).reshape(len(some), wide).cumsum(1)[:, :-1]
            mass = added(ww)
            rest = total - mass
            gain = np.zeros_like(mass)
            for k in range(y.shape[1]):
                sums = added(ww * yy[:, k])
                gain += sums**2 / np.maximum(mass, 1e-12) + (whole[k] - sums) ** 2 / np.maximum(rest, 1e-12)
            gain = np.where((mass >= least) & (rest >= least), gain - (whole**2).sum() / total, -1.0)
            j, k = divmod(int(gain.argmax()), wide - 1)
            if gain[j, k] > 1e-9 and k < len(cuts[some[j]]):
                side = codes[rows, some[j]] <= k
                self.feature[node], self.cut[node] = int(some[j]), float(cuts[some[j]][k])
                self.left[node] = grow(rows[side], level + 1)
                self.right[node] = grow(rows[~side], level + 1)
            return node

        grow(np.flatnonzero(w > 0), 0)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        at = np.zeros(len(x), dtype=int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return value[at]
            here = at[inner]
            at[inner] = np.where(x[inner, feature[here]] <= cut[here], left[here], right[here])


class BoostedRegressor:
    """Gradient boosting of squared error with shrinkage and row and column sampling."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.08, least: float = 4, columns: float = 0.5, seed: int = 7):
        self.trees, self.depth, self.rate, self.least, self.columns, self.seed = trees, depth, rate, least, columns, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedRegressor":
        rng = np.random.default_rng(self.seed)
        self.base, self.steps = float(y.mean()), []
        cuts, now = _bins(x, 64), np.full(len(y), y.mean())
        codes = _codes(x, cuts)
        some = max(1, int(x.shape[1] * self.columns))
        for _ in range(self.trees):
            w = (rng.random(len(y)) < 0.8).astype(float)
            if not w.any():
                continue
            tree = Tree().fit(codes, (y - now)[:, None], w, cuts, self.depth, self.least, some, rng)
            now = now + self.rate * tree.predict(x)[:, 0]
            self.steps.append(tree)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """All trees go down together, a level at a time, for TOGETHER rows at once."""
        if not self.steps:
            return np.full(len(x), self.base)
        wide = max(len(t.feature) for t in self.steps)
        padded = lambda name, kind: np.array([[*getattr(t, name), *[0] * (wide - len(t.feature))] for t in self.steps], dtype=kind)
        feature, cut, left, right = padded("feature", int), padded("cut", float), padded("left", int), padded("right", int)
        value = np.array([[float(v[0]) for v in t.value] + [0.0] * (wide - len(t.value)) for t in self.steps])
        trees, out = np.arange(len(self.steps)), np.empty(len(x))
        for start in range(0, len(x), TOGETHER):
            part = x[start : start + TOGETHER]
            at = np.zeros((len(part), len(trees)), dtype=int)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                asked = feature[trees, at]
                below = np.where(part[rows, asked] <= cut[trees, at], left[trees, at], right[trees, at])
                at = np.where(asked < 0, at, below)
            out[start : start + TOGETHER] = self.base + self.rate * value[trees, at].sum(1)
        return out


class BaggedClassifier:
    """A bagged forest of class probabilities, calibrated on the rows each tree did not see.

    Calibration maps the forest's top probability to the observed share of right answers among out-of-bag rows,
    in ten equally filled groups made monotone by pooling adjacent violators.
    """

    def __init__(self, trees: int = 60, depth: int = 8, least: float = 3, seed: int = 7):
        self.count, self.depth, self.least, self.seed = trees, depth, least, seed

    def fit(self, x: np.ndarray, labels: np.ndarray) -> "BaggedClassifier":
        rng = np.random.default_rng(self.seed)
        self.classes, y = np.unique(labels, return_inverse=True)
        onehot = np.eye(len(self.classes))[y]
        cuts, self.trees = _bins(x, 64), []
        codes = _codes(x, cuts)
        seen, votes = np.zeros(len(y)), np.zeros_like(onehot)
        some = max(1, int(np.ceil(x.shape[1] ** 0.5)) + 1)
        for _ in range(self.count):
            w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
            tree = Tree().fit(codes, onehot, w, cuts, self.depth, self.least, some, rng)
            self.trees.append(tree)
            out = np.flatnonzero(w == 0)
            if len(out):
                votes[out] += tree.predict(x[out])
                seen[out] += 1
        held = seen > 0
        p = votes[held] / seen[held][:, None]
        top, right = p.max(1), (p.argmax(1) == y[held]).astype(float)
        order = np.argsort(top)
        groups = [g for g in np.array_split(order, 10) if len(g)]
        blocks: list[list[float]] = []
        for g in groups:
            blocks.append([float(right[g].mean()), float(len(g)), float(top[g].max())])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[2]])
        self.edges = np.array([b[2] for b in blocks] or [1.0])
        self.levels = np.array([b[0] for b in blocks] or [0.0])
        self.lowest = float(top.min()) if len(top) else 1.0
        self.accuracy = float(right.mean()) if len(right) else 0.0
        return self

    def predict(self, x: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest class and the calibrated chance that it is right.

        ``among``, rows by classes, says which classes a row may have. Where these are not all, shares are of their votes alone,
        and the chance is 0 if they have less than half of all votes or a share below any that was calibrated.
        """
        p = np.mean([t.predict(x) for t in self.trees], axis=0)
        off = np.zeros(len(x), dtype=bool)
        if among is not None:
            votes = np.where(among, p, 0.0).sum(1)
            p = np.where(among.all(1)[:, None], p, np.where(among, p, 0.0) / np.maximum(votes, 1e-12)[:, None])
            off = ~among.all(1) & ((votes < 0.5) | (p.max(1) < self.lowest))
        at = np.minimum(np.searchsorted(self.edges, p.max(1)), len(self.levels) - 1)
        return self.classes[p.argmax(1)], np.where(off, 0.0, self.levels[at])
