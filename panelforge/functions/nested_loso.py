"""Nested leave-one-subject-out ridge from sufficient statistics: what one permutation replicate costs is index gathers.

With w = (features, outcome) centred once per region, every split's Gram matrix follows from the subject-by-subject
products P[i, j] = sum over regions of w_i w_j'. A whole-block permutation re-indexes the feature side of P, so
nothing is summed over regions again. Small NumPy helper: Spark deals the replicates out.
"""

from __future__ import annotations

import numpy as np

#: The penalty grid.
LAMBDAS = (0.0, 0.01, 0.1, 1.0, 10.0, 100.0, np.inf)


class Panel:
    """Products of a panel x[subject, region, feature], y[subject, region]."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.n, self.regions, self.f = x.shape
        if self.n < 3 or not (np.isfinite(x).all() and np.isfinite(y).all()):
            raise ValueError("a panel takes three subjects or more, and finite values")
        xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
        self.xx = np.einsum("irf,jrg->ijfg", xc, xc)
        self.xy = np.einsum("irf,jr->ijf", xc, yc)
        self.yy = yc @ yc.T
        # subjects whose whole block of a feature is the same: a feature is constant in training if all are
        self.block = np.stack([np.unique(x[:, :, k], axis=0, return_inverse=True)[1].ravel() for k in range(self.f)], axis=1)

    def folds(self, donors: np.ndarray | None = None, lambdas=LAMBDAS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(selected penalty, baseline mse, ridge mse) of each subject, its features taken from donors."""
        n, f, d = self.n, self.f, np.arange(self.n) if donors is None else np.asarray(donors)
        p = np.empty((n, n, f + 1, f + 1))
        p[:, :, :f, :f] = self.xx[np.ix_(d, d)]
        p[:, :, :f, f] = self.xy[d]
        p[:, :, f, :f] = self.xy[d].transpose(1, 0, 2)
        p[:, :, f, f] = self.yy
        q = p[np.arange(n), np.arange(n)]
        own = np.eye(n, dtype=bool)
        m = np.where(own, n - 1, n - 2)[:, :, None, None].astype(float)
        out = np.where(own[:, :, None, None], q[:, None], q[:, None] + q[None, :] + p + p.transpose(1, 0, 2, 3))  # sum of what is left out, squared
        gone = np.where(own[:, :, None, None], q[:, None], q[:, None] + q[None, :])
        gram = q.sum(axis=0) - gone - out / m
        cross = p.transpose(1, 0, 2, 3) + p  # w_v w_o' + w_o w_v'
        held = np.where(own[:, :, None, None], q[:, None] * (1 + 1 / m) ** 2, q[None, :] * (1 + 1 / m) ** 2 + cross * (1 + 1 / m) / m + q[:, None] / m**2)
        rows = m[:, :, 0, 0] * self.regions
        omitted = self._omitted(d)
        scale = np.sqrt(np.maximum(np.einsum("ovff->ovf", gram[:, :, :f, :f]), 0) / rows[:, :, None])
        scale = np.where(omitted | (scale == 0), 1.0, scale)
        keep = ~omitted
        a = gram[:, :, :f, :f] / rows[:, :, None, None] / (scale[:, :, :, None] * scale[:, :, None, :]) * (keep[:, :, :, None] & keep[:, :, None, :])
        b = gram[:, :, :f, f] / rows[:, :, None] / scale * keep
        # one eigendecomposition a split serves every penalty; directions without variance are left out, as by a pseudo-inverse
        values, vectors = np.linalg.eigh(a)
        turned = np.einsum("ovfg,ovf->ovg", vectors, b)
        low = 1e-12 * np.abs(values).max(axis=-1, keepdims=True)
        loss = np.empty((len(lambdas), n, n))
        for i, lam in enumerate(lambdas):
            if np.isinf(lam):
                loss[i] = held[:, :, f, f] / self.regions
                continue
            spread = values + lam
            beta = np.einsum("ovfg,ovg->ovf", vectors, np.divide(turned, spread, out=np.zeros_like(turned), where=spread > (low if lam == 0 else 0)))
            c = np.concatenate([-beta / scale * keep, np.ones((n, n, 1))], axis=2)
            loss[i] = (np.matmul(held, c[..., None])[..., 0] * c).sum(axis=2) / self.regions
        score = np.where(own, 0, loss).sum(axis=2) / (n - 1)
        infinite = int(np.flatnonzero(np.isinf(lambdas))[0])
        tied = score - score.min(axis=0) <= 1e-12 * score[infinite]
        values = np.array(lambdas)
        best = np.where(tied, values[:, None], -1.0).max(axis=0)
        chosen = np.array([int(np.flatnonzero(values == v)[0]) for v in best])
        at = np.arange(n)
        base, ridge = loss[infinite, at, at], loss[chosen, at, at]
        return best, base, np.where(np.isinf(best), base, ridge)

    def _omitted(self, d: np.ndarray) -> np.ndarray:
        """[o, v, feature]: are all training subjects' blocks the same?"""
        blocks = self.block[d]
        n = self.n
        out = np.zeros((n, n, self.f), bool)
        for k in range(self.f):
            values, counts = np.unique(blocks[:, k], return_counts=True)
            if counts.max() < n - 2:
                continue
            common = blocks[:, k] == values[counts.argmax()]
            odd = np.flatnonzero(~common)
            if odd.size == 0:
                out[:, :, k] = True
            elif odd.size == 1:
                out[odd[0], :, k] = out[:, odd[0], k] = True
            elif odd.size == 2:
                out[odd[0], odd[1], k] = out[odd[1], odd[0], k] = True
        return out

    def statistic(self, donors: np.ndarray | None = None) -> float:
        """Mean over subjects of baseline minus ridge mse."""
        _, base, ridge = self.folds(donors)
        return float((base - ridge).mean())


def assignments(strata: list[list[int]], replicates: int, seed: int) -> np.ndarray:
    """donors[replicate, subject]: a permutation inside each stratum, in listed order, from one seeded stream."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.empty((replicates, sum(map(len, strata))), np.int64)
    for b in range(replicates):
        for members in strata:
            m = np.asarray(members)
            out[b, m] = m[rng.permutation(len(m))]
    return out
