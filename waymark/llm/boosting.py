"""Gradient-boosted trees for a two-class problem on a bounded table of dense features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Trees of equal depth as heaps: node i has children 2i+1 and 2i+2; a row goes right if its value is above the cut."""

    depth: int
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.full(len(rows), self.base), np.arange(len(rows))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[every, features[node]] > cuts[node])
            total += leaves[node - (2**self.depth - 1)]
        return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(
    rows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, trees: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 2.0
) -> Trees:
    """Second-order boosting of the logistic loss on binned features; without weights each row counts as one."""
    weights = np.ones(len(rows)) if weights is None else weights
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
    binned = np.stack([np.searchsorted(cut, column, side="left") for cut, column in zip(cuts, rows.T, strict=True)], axis=1)
    share = np.clip(np.average(labels, weights=weights), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(share / (1 - share))))
    margin = np.full(len(rows), model.base)
    for _ in range(trees):
        chance = _sigmoid(margin)
        slope, bend = weights * (labels - chance), weights * chance * (1 - chance)
        features, limits = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first = 2**level - 1
            for own in range(first, 2 * first + 1):
                inside = np.flatnonzero(node == own)
                feature, cut = _split(binned[inside], slope[inside], bend[inside], cuts, ridge)
                if feature >= 0:
                    features[own], limits[own] = feature, cut
            node = 2 * node + 1 + (rows[np.arange(len(rows)), features[node]] > limits[node])
        leaf = node - (2**depth - 1)
        gained = np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, bend, 2**depth) + ridge) * rate
        model.features.append(features)
        model.cuts.append(limits)
        model.leaves.append(gained)
        margin += gained[leaf]
    return model


def _split(binned: np.ndarray, slope: np.ndarray, bend: np.ndarray, cuts: list[np.ndarray], ridge: float) -> tuple[int, float]:
    """The feature and cut with the highest gain, (-1, 0) if none gains."""
    best, choice = 1e-6, (-1, 0.0)
    whole, weight = slope.sum(), bend.sum()
    for feature, cut in enumerate(cuts):
        if not len(cut) or not len(binned):
            continue
        left = np.cumsum(np.bincount(binned[:, feature], slope, len(cut) + 1))[:-1]
        mass = np.cumsum(np.bincount(binned[:, feature], bend, len(cut) + 1))[:-1]
        gain = left**2 / (mass + ridge) + (whole - left) ** 2 / (weight - mass + ridge) - whole**2 / (weight + ridge)
        at = int(gain.argmax())
        if gain[at] > best:
            best, choice = gain[at], (feature, float(cut[at]))
    return choice


@dataclass
class Isotonic:
    """Non-decreasing step means, joined by straight lines between the middles of the steps."""

    points: np.ndarray
    values: np.ndarray

    def __call__(self, margins: np.ndarray) -> np.ndarray:
        return np.interp(margins, self.points, self.values)


def calibrate(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators. Every step is drawn a little towards the mean of all labels."""
    weights = np.ones(len(margins)) if weights is None else weights
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []  # weighted labels, weight, weighted sum of margins
    for margin, label, weight in zip(margins[order], labels[order], weights[order], strict=True):
        blocks.append([float(weight * label), float(weight), float(weight * margin)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            label_, rows_, margin_ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + label_, blocks[-1][1] + rows_, blocks[-1][2] + margin_]
    mean = float(np.average(labels, weights=weights))
    points = np.array([margin / rows for _, rows, margin in blocks])
    values = np.array([(label + prior * mean) / (rows + prior) for label, rows, _ in blocks])
    return Isotonic(points, np.maximum.accumulate(values))
