"""Boosted trees for one point of a hyper-parameter search.

The search (``operators.model.search``) gives every (point, fold) pair its own task, because a
sample of bounded size needs no cluster to be fitted but a grid needs many fits.  This is the fit:
logistic loss, histograms of quantile bins, trees grown best leaf first.  The chosen point
is fitted on all rows by Spark ML.
"""

from __future__ import annotations

import numpy as np

BINS = 64


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1).astype(np.int64)


def _histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of (1, g, h) per feature and bin."""
    n, width = bins.shape
    cell = (bins + np.arange(width) * BINS).ravel()
    sums = [np.bincount(cell, np.repeat(v, width), width * BINS) for v in (np.ones(n), g, h)]
    return np.stack(sums).reshape(3, width, BINS)


def _best_split(hist: np.ndarray, p: dict, allowed: np.ndarray) -> tuple[float, int, int]:
    left = hist.cumsum(axis=2)
    right = left[:, :, -1:] - left

    def worth(s):
        g = np.sign(s[1]) * np.maximum(np.abs(s[1]) - p["reg_alpha"], 0)
        return g * g / (s[2] + p["reg_lambda"] + 1e-12)

    gain = worth(left) + worth(right) - worth(left[:, :, -1:])
    fits = (left[0] >= p["min_rows"]) & (right[0] >= p["min_rows"]) & (left[2] >= p["min_weight"]) & (right[2] >= p["min_weight"])
    gain = np.where(fits & allowed[:, None], gain, -np.inf)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // BINS, at % BINS


DEFAULTS = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "leaves": 31, "min_rows": 20, "min_weight": 1e-3,
            "subsample": 0.8, "colsample": 0.8, "gamma": 0.0, "reg_alpha": 0.0, "reg_lambda": 0.0, "max_delta_step": 0.0}


def fit_margins(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray, params: dict, stages: list[int],
                seed: int) -> dict[int, np.ndarray]:
    """Margins of the rows ``held`` after each number of trees in ``stages`` (a longer ensemble holds the
    shorter ones, so one fit serves all of them)."""
    p = DEFAULTS | params
    edges = bin_edges(x)
    bins, test = binned(x, edges), binned(held, edges)
    rate = float(np.average(y, weights=weight))
    start = np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))
    margin, out = np.full(len(y), start), np.full(len(held), start)
    rng = np.random.default_rng(seed)
    kept, width = {}, bins.shape[1]
    for tree in range(1, max(stages) + 1):
        prob = 1 / (1 + np.exp(-margin))
        g, h = weight * (prob - y), weight * prob * (1 - prob)
        rows = np.flatnonzero(rng.random(len(y)) < p["subsample"])
        allowed = rng.random(width) < p["colsample"]
        allowed[rng.integers(width)] = True
        _grow(bins, g, h, rows, allowed, p, margin, test, out)
        if tree in stages:
            kept[tree] = out.copy()
    return kept


def _grow(bins, g, h, rows, allowed, p, margin, test, out) -> None:
    """Grow one tree on ``rows`` and add its leaves to the margins of all and of the held rows."""
    def leaf(fit, every, held, depth, hist=None):
        hist = _histogram(bins[fit], g[fit], h[fit]) if hist is None else hist
        best = _best_split(hist, p, allowed) if depth < p["max_depth"] else (-np.inf, 0, 0)
        return best, fit, every, held, depth, hist

    leaves = [leaf(rows, np.arange(len(margin)), np.arange(len(out)), 0)]
    while len(leaves) < p["leaves"]:
        at = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
        (gain, feature, cut), fit, every, held, depth, hist = leaves[at]
        if not gain > max(2 * p["gamma"], 1e-9):
            break
        sides = [[part[bins_[part, feature] <= cut], part[bins_[part, feature] > cut]]
                 for part, bins_ in ((fit, bins), (every, bins), (held, test))]
        small = int(len(sides[0][0]) > len(sides[0][1]))
        first = leaf(*[s[small] for s in sides], depth + 1)
        leaves[at] = first
        leaves.append(leaf(*[s[1 - small] for s in sides], depth + 1, hist - first[5]))
    for _, fit, every, held, _, _ in leaves:
        total = g[fit].sum()
        value = -np.sign(total) * max(abs(total) - p["reg_alpha"], 0) / (h[fit].sum() + p["reg_lambda"] + 1e-12)
        if p["max_delta_step"]:
            value = float(np.clip(value, -p["max_delta_step"], p["max_delta_step"]))
        margin[every] += p["learning_rate"] * value
        out[held] += p["learning_rate"] * value


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half; 0.5 where one class is missing."""
    values, at = np.unique(score, return_inverse=True)
    pos, neg = np.bincount(at, y, len(values)), np.bincount(at, 1 - y, len(values))
    if not pos.sum() or not neg.sum():
        return 0.5
    return float((pos * (neg.cumsum() - neg / 2)).sum() / (pos.sum() * neg.sum()))
