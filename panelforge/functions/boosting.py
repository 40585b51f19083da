"""Histogram gradient boosting, leaf by leaf, of many fits in lock step.

The fits of a batch share their cells and differ in which of them train. A cell's features are bin numbers (from quantiles of the
training cells), the first feature is a category. Gradient sums by (fit, leaf, bin) are one count over all fits, and the
best split of every new leaf one scan over its bins; the leaf of greatest gain is split next, in each fit its own. Sums are taken of
one new leaf, the other's are what is left.
"""

from __future__ import annotations

import numpy as np

#: The sensitivity run's settings.
RATE, LEAST, PENALTY, BINS, SUPPORT = 0.05, 20, 1.0, 255, 10


def edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper bounds of bins: midpoints of distinct values, or of the values around each of the bins' quantiles."""
    known = np.unique(x)
    if known.size <= bins:
        return (known[1:] + known[:-1]) / 2
    return np.percentile(x, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint")


def _more(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where x is above y by more than the noise of sums."""
    return x > y + 1e-12 * np.where(np.isfinite(y), np.abs(y), 0)


def _numeric(g: np.ndarray, n: np.ndarray, parent: np.ndarray):
    """Best (gain, bin) of each row's bins: those up to it go left; the first of equals."""
    left, count = g.cumsum(axis=1), n.cumsum(axis=1)
    right, rest = left[:, -1:] - left, count[:, -1:] - count
    gain = np.where((count >= LEAST) & (rest >= LEAST), left**2 / (count + PENALTY) + right**2 / (rest + PENALTY) - parent[:, None], -np.inf)
    at = gain.argmax(axis=1)
    return gain[np.arange(len(g)), at], at


def _category(g: np.ndarray, n: np.ndarray, parent: np.ndarray):
    """Best (gain, left set) of each row's categories: in the order of their mean gradients, at most half of them from either end. Rare ones go right."""
    used = n >= SUPPORT
    order = np.argsort(np.where(used, g / (n + SUPPORT), np.inf), axis=1, kind="stable")
    some, half = used.sum(axis=1), (used.sum(axis=1) + 1) // 2
    place = np.arange(g.shape[1])[None, :]
    best, left = np.full(len(g), -np.inf), np.zeros(g.shape, bool)
    for back in (False, True):
        # where the i-th category from this end is in the order
        at = np.where(place < some[:, None], some[:, None] - 1 - place, place) if back else np.broadcast_to(place, g.shape)
        of = np.take_along_axis(order, at, axis=1)
        gl, nl = np.take_along_axis(g, of, axis=1).cumsum(axis=1), np.take_along_axis(n, of, axis=1).cumsum(axis=1)
        gr, nr = g.sum(axis=1)[:, None] - gl, n.sum(axis=1)[:, None] - nl
        gain = np.where((place < half[:, None]) & (nl >= LEAST) & (nr >= LEAST), gl**2 / (nl + PENALTY) + gr**2 / (nr + PENALTY) - parent[:, None], -np.inf)
        cut = gain.argmax(axis=1)
        top = gain[np.arange(len(g)), cut]
        better = _more(top, best)
        best = np.where(better, top, best)
        into = np.zeros(g.shape, bool)
        np.put_along_axis(into, of, place <= cut[:, None], axis=1)
        left[better] = into[better]
    return best, left


def boosted(category: np.ndarray, numbers: np.ndarray, y: np.ndarray, train: np.ndarray, leaves: int, rounds: list[int]) -> list[np.ndarray]:
    """Predictions (fits, cells) after each number of rounds. category: codes (cells); numbers: (features, cells); train: (fits, cells)."""
    fits, cells = train.shape
    kinds, features = int(category.max()) + 1, len(numbers)
    codes = np.stack([[np.searchsorted(edges(x[t]), x, side="left") for t in train] for x in numbers])
    width = int(codes.max(initial=0)) + 1
    total = kinds + features * width
    fit, row = np.nonzero(train)  # training cells, by fit
    keys = np.stack([fit * total + category[row], *(fit * total + kinds + f * width + codes[f, fit, row] for f in range(features))])
    predicted = np.repeat(((y * train).sum(axis=1) / train.sum(axis=1))[:, None], cells, axis=1)
    every, out = np.arange(fits), []

    def sums(some: np.ndarray, gradient: np.ndarray):
        """Gradients and cells by fit and bin, of some of the training cells."""
        key = keys[:, some].ravel()
        return np.bincount(key, np.tile(gradient[some], features + 1), fits * total).reshape(fits, total), np.bincount(key, minlength=fits * total).reshape(fits, total)

    def best_of(g: np.ndarray, n: np.ndarray):
        """Best split of each row of bins: gain, feature (0: the category), bin, left set."""
        parent = g[:, :kinds].sum(axis=1) ** 2 / (n[:, :kinds].sum(axis=1) + PENALTY)
        top, into = _category(g[:, :kinds], n[:, :kinds], parent)
        which, cut = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for f in range(features):
            own = slice(kinds + f * width, kinds + (f + 1) * width)
            value, bin_ = _numeric(g[:, own], n[:, own], parent)
            better = _more(value, top)
            top, which, cut = np.where(better, value, top), np.where(better, f + 1, which), np.where(better, bin_, cut)
        return top, which, cut, into

    for step in range(1, max(rounds) + 1):
        gradient = (predicted - y)[fit, row]
        leaf, mine = np.zeros((fits, cells), np.int64), np.zeros(fit.size, np.int64)
        g, n = np.zeros((fits, leaves, total)), np.zeros((fits, leaves, total), np.int64)
        g[:, 0], n[:, 0] = sums(np.arange(fit.size), gradient)
        gain = np.full((fits, leaves), -np.inf)
        feature, at, sets = np.zeros((fits, leaves), np.int64), np.zeros((fits, leaves), np.int64), np.zeros((fits, leaves, kinds), bool)
        gain[:, 0], feature[:, 0], at[:, 0], sets[:, 0] = best_of(g[:, 0], n[:, 0])
        for new in range(1, leaves):  # all that still grow have as many leaves
            grow = every[gain.max(axis=1) > 0]
            if not grow.size:
                break
            best = gain[grow].argmax(axis=1)
            f, cut = feature[grow, best], at[grow, best]
            right = np.where(f[:, None] == 0, ~sets[grow, best][:, category], codes[np.maximum(f - 1, 0), grow] > cut[:, None])
            moves = np.zeros((fits, cells), bool)
            moves[grow] = (leaf[grow] == best[:, None]) & right
            leaf[moves] = new
            some = np.flatnonzero(moves[fit, row])
            mine[some] = new
            more, count = sums(some, gradient)
            g[grow, new], n[grow, new] = more[grow], count[grow]
            g[grow, best] -= more[grow]
            n[grow, best] -= count[grow]
            who, of = np.concatenate((grow, grow)), np.concatenate((best, np.full(grow.size, new)))
            gain[who, of], feature[who, of], at[who, of], sets[who, of] = best_of(g[who, of], n[who, of])
        key = fit * leaves + mine
        value = np.bincount(key, gradient, fits * leaves) / (np.bincount(key, minlength=fits * leaves) + PENALTY)
        predicted = predicted - RATE * np.take_along_axis(value.reshape(fits, leaves), leaf, axis=1)
        if step in rounds:
            out.append(predicted)
    return out
