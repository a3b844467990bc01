"""Gradient-boosted trees over binned features: Newton steps on the softmax (or, of two classes, logistic) loss."""

from __future__ import annotations

import io

import numpy as np


def shares(logits: np.ndarray) -> np.ndarray:
    """Class shares of rows; a single column of logits stands for the second of two classes."""
    if logits.shape[1] == 1:
        logits = np.hstack([np.zeros_like(logits), logits])
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of all bins but the last: between neighbouring values, or between percentiles if values are many."""
    distinct = np.unique(values)
    if len(distinct) > bins:
        return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="midpoint"))
    return (distinct[1:] + distinct[:-1]) / 2


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])


def grow(codes: np.ndarray, slope: np.ndarray, bend: np.ndarray, bins: int, depth: int, l2: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree as arrays over the places of a complete tree (children of i: 2i + 1 and 2i + 2): the feature that splits
    (-1: none), the last bin that goes left, the step; and the place where each row ends. Levels are split at the
    greatest gain, from sums of slopes and bends by place, feature and bin."""
    n, d = codes.shape
    places = 2 ** (depth + 1) - 1
    feature, cut, at = np.full(places, -1), np.zeros(places, int), np.zeros(n, int)
    for level in range(depth):
        begin, width = 2**level - 1, 2**level
        here = np.flatnonzero(at >= begin)
        if not len(here):
            break
        cell = (((at[here] - begin)[:, None] * d + np.arange(d)) * bins + codes[here]).ravel()
        sums = [np.bincount(cell, w, width * d * bins).reshape(width, d, bins).cumsum(axis=2) for w in (np.repeat(slope[here], d), np.repeat(bend[here], d), None)]
        (gl, hl, nl), (gr, hr, nr) = sums, [s[:, :, -1:] - s for s in sums]
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gl + gr) ** 2 / (hl + hr + l2)
        gain = np.where((nl >= least) & (nr >= least) & (hl >= 1e-3) & (hr >= 1e-3), gain, -np.inf).reshape(width, -1)
        best = gain.argmax(axis=1)
        good = gain[np.arange(width), best] > 0
        feature[begin : begin + width][good], cut[begin : begin + width][good] = best[good] // bins, best[good] % bins
        moving = here[good[at[here] - begin]]
        spot = at[moving]
        at[moving] = 2 * spot + 1 + (codes[moving, feature[spot]] > cut[spot])
    step = -np.bincount(at, slope, places) / (np.bincount(at, bend, places) + l2)
    return feature, cut, step, at


class Trees:
    """feature, bound (real values; at most this goes left) and step of all trees, each of shape rounds x columns x
    places, and the logits before the first tree."""

    def __init__(self, feature: np.ndarray, bound: np.ndarray, step: np.ndarray, base: np.ndarray):
        self.feature, self.bound, self.step, self.base = feature, bound, step, base

    def shares(self, x: np.ndarray) -> np.ndarray:
        logits = np.tile(self.base, (len(x), 1))
        rows, levels = np.arange(len(x)), int(np.log2(self.feature.shape[2] + 1)) - 1
        for feature, bound, step in zip(self.feature, self.bound, self.step):
            for c in range(logits.shape[1]):
                at = np.zeros(len(x), int)
                for _ in range(levels):
                    f = feature[c][at]
                    at = np.where(f >= 0, 2 * at + 1 + (x[rows, f] > bound[c][at]), at)
                logits[:, c] += step[c][at]
        return shares(logits)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, feature=self.feature, bound=self.bound, step=self.step, base=self.base)
        return out.getvalue()

    @staticmethod
    def from_bytes(state: bytes) -> Trees:
        with np.load(io.BytesIO(state)) as told:
            return Trees(told["feature"], told["bound"], told["step"], told["base"])


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, depth: int, rounds: int, rate: float, l2: float, bins: int = 255, least: int = 20,
          watch: int = 10_000, patience: int = 10) -> Trees:
    """Trees for y (0 to classes - 1). With more than `watch` rows a tenth is held out, and `patience` rounds that don't
    better its loss end the search; the order of rows is shuffled by a fixed seed."""
    order = np.random.default_rng(0).permutation(len(y))
    held = order[: len(y) // 10] if len(y) > watch else order[:0]
    kept = order[len(held) :]
    edges = [bin_edges(x[kept, f], bins) for f in range(x.shape[1])]
    codes, columns = binned(x, edges), 1 if classes == 2 else classes
    width = 1 + max((len(e) for e in edges), default=0)
    truth = np.eye(classes)[y][:, -columns:]
    prior = np.log(np.maximum(np.bincount(y[kept], weight[kept], classes) / weight[kept].sum(), 1e-12))
    base = np.array([prior[1] - prior[0]]) if columns == 1 else prior - prior.mean()
    logits = np.tile(base, (len(y), 1))
    grown: list[tuple[list, list, list]] = []
    losses: list[float] = []
    for _ in range(rounds):
        now = shares(logits)[:, -columns:]
        trees: tuple[list, list, list] = ([], [], [])
        for c in range(columns):
            p, w = now[:, c], weight
            feature, cut, step, _ = grow(codes[kept], (w * (p - truth[:, c]))[kept], (w * p * (1 - p))[kept], width, depth, l2, least)
            at = np.zeros(len(y), int)
            for _ in range(depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (codes[np.arange(len(y)), f] > cut[at]), at)
            logits[:, c] += rate * step[at]
            bound = [edges[f][b] if f >= 0 else 0.0 for f, b in zip(feature, cut)]
            for kind, of_tree in zip(trees, (feature, bound, rate * step)):
                kind.append(of_tree)
        grown.append(trees)
        if len(held):
            likely = shares(logits)[held, y[held]]
            losses.append(float(-(weight[held] * np.log(np.maximum(likely, 1e-300))).sum() / weight[held].sum()))
            if len(losses) > patience and min(losses[-patience:]) >= min(losses[:-patience]) - 1e-7:
                break
    feature, bound, step = (np.array([t[i] for t in grown]).reshape(len(grown), columns, 2 ** (depth + 1) - 1) for i in range(3))
    return Trees(feature, bound, step, base)
