"""Small gradient-boosted trees, fitted on the driver over a bounded sample and scored as SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Two levels: a split, a split on either side, four leaves."""

    root: tuple[int, float]
    sides: tuple[tuple[int, float], tuple[int, float]]
    leaves: tuple[float, float, float, float]

    def value(self, x: np.ndarray) -> np.ndarray:
        left = x[:, self.root[0]] < self.root[1]
        first = x[:, self.sides[0][0]] < self.sides[0][1]
        second = x[:, self.sides[1][0]] < self.sides[1][1]
        a, b, c, d = self.leaves
        return np.where(left, np.where(first, a, b), np.where(second, c, d))

    def sql(self, names: list[str]) -> str:
        test = lambda split: f"{names[split[0]]} < {split[1]!r}D"
        a, b, c, d = (f"{x!r}D" for x in self.leaves)
        return f"CASE WHEN {test(self.root)} THEN CASE WHEN {test(self.sides[0])} THEN {a} ELSE {b} END ELSE CASE WHEN {test(self.sides[1])} THEN {c} ELSE {d} END END"


@dataclass(frozen=True)
class Model:
    """Trees, the calibration of their sum, and the least probability that is acted on."""

    base: float
    trees: tuple[Tree, ...]
    slope: float
    shift: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(t.value(x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def sql(self, names: list[str]) -> str:
        """The calibrated probability over expressions for the features, in the order of fitting."""
        total = " + ".join([f"{self.base!r}D", *(t.sql(names) for t in self.trees)])
        return f"1D / (1D + exp(-({self.slope!r}D * ({total}) + {self.shift!r}D)))"


def _split(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
    best, found = -np.inf, (0, 0.0)
    g, h = gradient.sum(), weight.sum()
    for k, values in enumerate(cuts):
        for cut in values:
            low = x[:, k] < cut
            a, b = gradient[low].sum(), weight[low].sum()
            gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1)
            if gain > best + 1e-12:
                best, found = gain, (k, float(cut))
    return found


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3, precision: float = 0.98, seed: int = 5) -> Model:
    """Logistic boosting on half of the rows, calibration on a quarter, the threshold from the last quarter.

    The threshold is the least one from 0.5 on at which the last quarter's rows have the wanted precision.
    """
    order = np.random.default_rng(seed).permutation(len(y))
    fitted, held, last = np.split(order, [len(y) // 2, 3 * len(y) // 4])
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(middles if len(middles) <= 12 else np.unique(np.quantile(middles, np.linspace(0, 1, 12))))
    xf, yf = x[fitted], y[fitted]
    base = float(np.log((yf.mean() + 1e-6) / (1 - yf.mean() + 1e-6)))
    score, trees = np.full(len(yf), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = yf - p, p * (1 - p)
        root = _split(xf, gradient, weight, cuts)
        left = xf[:, root[0]] < root[1]
        sides, leaves = [], []
        for side in (left, ~left):
            split = _split(xf[side], gradient[side], weight[side], cuts)
            sides.append(split)
            low = xf[side][:, split[0]] < split[1]
            leaves += [round(float(rate * gradient[side][m].sum() / (weight[side][m].sum() + 1)), 9) for m in (low, ~low)]
        trees.append(Tree(root, tuple(sides), tuple(leaves)))
        score = score + trees[-1].value(xf)
    raw = Model(base, tuple(trees), 1.0, 0.0, 0.5)
    slope, shift = 1.0, 0.0
    margin, truth = raw.margin(x[held]), y[held]
    for _ in range(200):  # Platt's two parameters
        p = 1 / (1 + np.exp(-(slope * margin + shift)))
        slope += float(0.05 * ((truth - p) * margin).mean())
        shift += float(0.05 * (truth - p).mean())
    p, truth = 1 / (1 + np.exp(-(slope * raw.margin(x[last]) + shift))), y[last]
    steps = [t for t in np.linspace(0.5, 0.99, 50) if (p >= t).any() and truth[p >= t].mean() >= precision]
    return Model(base, tuple(trees), round(slope, 9), round(shift, 9), float(steps[0]) if steps else 0.99)
