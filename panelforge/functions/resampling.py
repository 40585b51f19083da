"""Volumes in array columns, sampled on another grid through an affine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.affine import Matrix, compose, inverse

#: Target voxels that are worked out at once.
SLAB = 1 << 20


def voxel_map(source: Matrix, target: Matrix, world: Matrix | None = None) -> Column:
    """Array of the 3 x 4 from the target's voxels to the source's: the target's affine, a transform of the world if any, and the source's affine undone."""
    m = compose(inverse(source), compose(world, target) if world else target)
    return F.array(*[c for row in m for c in row])


def pick(volume: np.ndarray, m: np.ndarray, shape: tuple[int, int, int], order: int) -> np.ndarray:
    """The volume at the places that m gives the voxels of a grid of `shape`: the nearest voxel (order 0) or between voxels (order 1); 0 where a place is outside the voxels' centres."""
    top = np.array(volume.shape)[:, None] - 1
    out, step = np.zeros(shape), max(1, SLAB // max(1, shape[1] * shape[2]))
    for a in range(0, shape[0], step):
        grid = np.indices((min(step, shape[0] - a), *shape[1:])).reshape(3, -1).astype(float)
        grid[0] += a
        at = m[:, :3] @ grid + m[:, 3:]
        inside = ((at >= 0) & (at <= top)).all(axis=0)
        at = at[:, inside]
        found = np.zeros(inside.size)
        if order == 0:
            found[inside] = volume[tuple(np.minimum(np.floor(at + 0.5).astype(np.int64), top))]
        else:
            low = np.minimum(np.floor(at).astype(np.int64), np.maximum(top - 1, 0))
            part = at - low
            total = np.zeros(at.shape[1])
            for corner in np.ndindex(2, 2, 2):
                c = np.array(corner)[:, None]
                total += np.where(c == 1, part, 1 - part).prod(axis=0) * volume[tuple(np.minimum(low + c, top))]
            found[inside] = total
        out[a : a + step] = found.reshape(-1, *shape[1:])
    return out


def resampled(values: Column, shape: Column, m: Column, target: tuple[int, int, int], order: int) -> Column:
    """array<double>, row by row, of a volume (values row by row, shape: three whole numbers) on a grid of `target` voxels; null volumes give null.

    m: see voxel_map(). A volume of another size than its shape says raises.
    """

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, shape: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for v, s, a in zip(values, shape, m, strict=True):
            if v is None:
                out.append(None)
                continue
            if len(v) != int(np.prod(s)):
                raise ValueError(f"{len(v)} values for a volume of {tuple(s)}")
            out.append(pick(np.asarray(v, float).reshape(tuple(s)), np.asarray(a, float).reshape(3, 4), target, order).ravel())
        return pd.Series(out)

    return run(values, shape, m)
