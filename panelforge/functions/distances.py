"""Euclidean distance transform: squared distances along one axis after another, by the lower envelope of parabolas."""

from __future__ import annotations

import numpy as np


def along(f: np.ndarray, spacing: float) -> np.ndarray:
    """min over q of f[:, q] + ((p - q) * spacing)**2 for each place p of each line (rows). All lines move together; the work is linear in a line."""
    lines, n = f.shape
    w = spacing * spacing
    apex, start = np.zeros((lines, n), np.int64), np.full((lines, n + 1), np.inf)
    top, every = np.full(lines, -1), np.arange(lines)
    for q in range(n):
        left = every[np.isfinite(f[:, q])]  # parabolas without a height take no part
        begins = np.full(lines, -np.inf)
        while left.size:
            left = left[top[left] >= 0]
            v = apex[left, top[left]]
            begins[left] = (f[left, q] - f[left, v] + w * (q * q - v * v)) / (2 * w * (q - v))
            left = left[begins[left] <= start[left, top[left]]]
            top[left] -= 1
            begins[left[top[left] < 0]] = -np.inf
        new = every[np.isfinite(f[:, q])]
        top[new] += 1
        apex[new, top[new]], start[new, top[new]] = q, begins[new]
        start[new, top[new] + 1] = np.inf
    out, at = np.full(f.shape, np.inf), np.zeros(lines, np.int64)
    some = every[top >= 0]
    for p in range(n):
        more = some
        while more.size:
            more = more[(at[more] < top[more]) & (start[more, np.minimum(at[more] + 1, n)] < p)]
            at[more] += 1
        v = apex[some, at[some]]
        out[some, p] = f[some, v] + w * (p - v) ** 2
    return out


def of_planes(planes: np.ndarray, spacing: tuple[float, float]) -> np.ndarray:
    """Squared distances within planes (count, rows, columns), from 0 at the background and infinity elsewhere."""
    count, rows, columns = planes.shape
    d = along(planes.reshape(-1, columns), spacing[1]).reshape(planes.shape)
    d = along(d.transpose(0, 2, 1).reshape(-1, rows), spacing[0])
    return d.reshape(count, columns, rows).transpose(0, 2, 1)
