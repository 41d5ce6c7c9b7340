"""Small boosted models for dense features, fitted on the driver from a bounded sample.

Two learners share the binning: gradient-boosted trees with isotonic calibration, and an
additive model of per-feature lookup tables with pairwise tables on top. Both are plain
arrays after fitting, so they are shipped to executors by value and score in whole batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending quantile cuts of every column; equal values never fall on both sides."""
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1).astype(np.int32) if x.size else np.zeros(x.shape, np.int32)


def base_rate(y: np.ndarray) -> float:
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    return float(np.log(p / (1 - p)))


# ---------------------------------------------------------------- gradient-boosted trees


@dataclass
class Trees:
    """Trees in level order: node i has children 2i+1 and 2i+2; feature -1 keeps left."""

    cuts: list[np.ndarray]
    start: float
    depth: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    split: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        out = np.full(len(b), self.start)
        rows = np.arange(len(b))
        for f, s, w in zip(self.feature, self.split, self.leaf, strict=True):
            at = np.zeros(len(b), np.int32)
            for _ in range(self.depth):
                chosen = f[at]
                right = (chosen >= 0) & (b[rows, np.maximum(chosen, 0)] > s[at])
                at = 2 * at + 1 + right
            out += w[at - (2**self.depth - 1)]
        return out


def _grow(b, grad, hess, widths, depth, ridge, least):
    """One tree on binned rows by second-order gains; returns features, splits and leaves."""
    inner = 2**depth - 1
    feature, split = np.full(inner, -1, np.int32), np.zeros(inner, np.int32)
    node = np.zeros(len(b), np.int64)
    for level in range(depth):
        first, count = 2**level - 1, 2**level
        local = node - first
        best = np.full(count, 1e-6)
        for j in range(b.shape[1]):
            w = widths[j]
            if w < 2:
                continue
            key = local * w + b[:, j]
            g = np.bincount(key, grad, count * w).reshape(count, w).cumsum(axis=1)
            h = np.bincount(key, hess, count * w).reshape(count, w).cumsum(axis=1)
            gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            at = gain.argmax(axis=1)
            value = gain[np.arange(count), at]
            better = value > best
            best[better] = value[better]
            feature[first : first + count][better] = j
            split[first : first + count][better] = at[better]
        chosen = feature[node]
        node = 2 * node + 1 + ((chosen >= 0) & (b[np.arange(len(b)), np.maximum(chosen, 0)] > split[node]))
    leaf_of = node - inner
    g, h = np.bincount(leaf_of, grad, inner + 1), np.bincount(leaf_of, hess, inner + 1)
    return feature, split, -g / (h + ridge), leaf_of


def fit_trees(x, y, rounds=120, depth=3, rate=0.15, bins=64, ridge=1.0, least=1.0) -> Trees:
    """Logistic gradient boosting on histogram bins."""
    cuts = cut_points(x, bins)
    b, widths = binned(x, cuts), [len(c) + 1 for c in cuts]
    model = Trees(cuts, base_rate(y), depth)
    margin = np.full(len(y), model.start)
    found = []
    for _ in range(rounds):
        p = sigmoid(margin)
        f, s, w, leaf_of = _grow(b, p - y, p * (1 - p), widths, depth, ridge, least)
        found.append((f, s, rate * w))
        margin += rate * w[leaf_of]
    model.feature, model.split, model.leaf = (np.stack(z) for z in zip(*found, strict=True))
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, probability) of the best rising step fit."""
    order = np.argsort(score, kind="stable")
    stack: list[list[float]] = []  # sum of y, weight, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        stack.append([float(v), 1.0, float(s)])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top, strict=True)]
    knots = np.array([[s / w, (v + 0.02) / (w + 0.04)] for v, w, s in stack])
    return knots[:, 0], np.maximum.accumulate(knots[:, 1])


@dataclass
class CalibratedTrees:
    """Trees whose margins are mapped to probabilities by an out-of-fold isotonic fit."""

    trees: Trees
    at: np.ndarray
    probability: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), self.at, self.probability), 0.0, 1.0)


def fit_calibrated(x: np.ndarray, y: np.ndarray, fold: np.ndarray | None = None, without=None, **how) -> CalibratedTrees:
    """Fit on all rows; calibrate on margins that each row got from folds without it.

    ``fold`` numbers each row's fold (four by turns if there is none). Where features are learnt
    themselves, ``without(k)`` gives all rows' features as learnt without fold k.
    """
    if fold is None:
        fold = np.arange(len(y)) % 4
    out = np.zeros(len(y))
    for k in np.unique(fold):
        held, own = fold == k, x if without is None else without(k)
        if (~held).any():
            out[held] = fit_trees(own[~held], y[~held], **how).margin(own[held])
    return CalibratedTrees(fit_trees(x, y, **how), *isotonic(out, y))


# ------------------------------------------------- additive model with pairwise tables


@dataclass
class Additive:
    """Sum of one lookup table per feature and one two-way table per chosen pair."""

    start: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        out = np.full(len(b), self.start)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        if self.pairs:
            c = binned(x, self.coarse)
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                out += t[c[:, i], c[:, j]]
        return sigmoid(out)


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float, least: float, leaves: int = 4) -> np.ndarray:
    """A tree of a few leaves over one feature's bins: the step per bin."""
    edges = [0, len(g)]
    cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            k = np.arange(lo + 1, hi)
            gl, hl = cg[k] - cg[lo], ch[k] - ch[lo]
            gr, hr = cg[hi] - cg[k], ch[hi] - ch[k]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
            gain[(hl < least) | (hr < least)] = 0
            if gain.max() > best:
                best, where = gain.max(), k[gain.argmax()]
        if where is None:
            break
        edges = sorted([*edges, int(where)])
    out = np.zeros(len(g))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out[lo:hi] = -(cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def fit_additive(x, y, rounds=150, rate=0.1, bins=64, pair_bins=8, max_pairs=10, pair_rounds=100, ridge=1.0, least=2.0) -> Additive:
    """Cyclic boosting: every round visits each feature once with one shallow tree.

    Then the pairs whose two-way cells explain most of what is left are boosted in turn,
    on ``pair_bins`` quantiles each way.
    """
    cuts, coarse = cut_points(x, bins), cut_points(x, pair_bins)
    b, c = binned(x, cuts), binned(x, coarse)
    n = x.shape[1]
    tables = [np.zeros(len(k) + 1) for k in cuts]
    start = base_rate(y)
    margin = np.full(len(y), start)
    for _ in range(rounds):
        for j in range(n):
            if len(tables[j]) < 2:
                continue
            p = sigmoid(margin)
            step = rate * _shallow(np.bincount(b[:, j], p - y, len(tables[j])), np.bincount(b[:, j], p * (1 - p), len(tables[j])), ridge, least)
            tables[j] += step
            margin += step[b[:, j]]
    p = sigmoid(margin)
    gains = []
    for i in range(n):
        for j in range(i + 1, n):
            w = len(coarse[j]) + 1
            size = (len(coarse[i]) + 1) * w
            key = c[:, i] * w + c[:, j]
            g, h = np.bincount(key, p - y, size), np.bincount(key, p * (1 - p), size)
            gains.append((float((g**2 / (h + 4 * ridge)).sum()), i, j))
    pairs = [(i, j) for _, i, j in sorted(gains, key=lambda z: (-z[0], z[1], z[2]))[:max_pairs]]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(pair_rounds):
        for t, (i, j) in zip(pair_tables, pairs, strict=True):
            p = sigmoid(margin)
            key = c[:, i] * t.shape[1] + c[:, j]
            g, h = np.bincount(key, p - y, t.size), np.bincount(key, p * (1 - p), t.size)
            step = (-0.1 * g / (h + 4 * ridge)).reshape(t.shape)
            t += step
            margin += step[c[:, i], c[:, j]]
    return Additive(start, cuts, tables, coarse, pairs, pair_tables)
