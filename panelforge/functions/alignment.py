"""Alignment of volumes by normalised mutual information: profiles along six axes, a mirrored control, and a bounded search by direction sets.

The anatomy moves, the target's values stay where they are. A trial is a transform: the anatomy is sampled at the target's voxels through
it and the joint histogram taken there, many trials at once; no volume is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.affine import Matrix, applied, rigid, rotation
from panelforge.functions.resampling import voxel_map
from panelforge.functions.shared import materialised

AXES = ("tx", "ty", "tz", "rx", "ry", "rz")
#: Points of a line search besides the place it starts from, and rounds over all directions.
POINTS, SWEEPS = 12, 3
#: Voxels of trials that are sampled at once, and of scans that move together.
SLAB, GROUP = 1 << 15, 1 << 17


def share(values: Column, q: float) -> Column:
    """Quantile of an array, linear between ranks."""
    s = F.array_sort(values)
    h = (F.size(values) - 1) * F.lit(q)
    low, high = F.get(s, F.floor(h).cast("int")), F.get(s, F.ceil(h).cast("int"))
    return low + (h - F.floor(h)) * (high - low)


def bins(values: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Bin numbers over [low, high] (a row each), the last bin closed; -1 outside, or where there is no room."""
    room = high > low
    codes = np.minimum(np.floor((values - low) / np.where(room, high - low, 1.0) * n), n - 1)
    return np.where(room & (values >= low) & (values <= high), codes, -1).astype(np.int64)


def _entropy(counts: np.ndarray) -> np.ndarray:
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return -(p * np.log(np.where(p > 0, p, 1.0))).sum(axis=1)


def nmi(joint: np.ndarray) -> np.ndarray:
    """(H(A) + H(B)) / H(A, B) of joint histograms (k x n x n); NaN if the joint entropy is 0 or nothing was counted."""
    both = _entropy(joint.reshape(len(joint), -1))
    some = both > 1e-12
    return np.where(some, (_entropy(joint.sum(axis=2)) + _entropy(joint.sum(axis=1))) / np.where(some, both, 1.0), np.nan)


def between(volumes: np.ndarray, which: np.ndarray, at: list[np.ndarray], shape: tuple[int, int, int]) -> np.ndarray:
    """Values between voxels at places inside the volumes, each in the volume (a row) that `which` says."""
    flat, steps = volumes.ravel(), (shape[1] * shape[2], shape[2], 1)
    low = [np.minimum(np.floor(a).astype(np.int64), max(top - 2, 0)) for a, top in zip(at, shape, strict=True)]
    part = [a - b for a, b in zip(at, low, strict=True)]
    share = [(1 - p, p) for p in part]
    index = [(b * step, np.minimum(b + 1, top - 1) * step) for b, top, step in zip(low, shape, steps, strict=True)]
    total, base = np.zeros(len(which)), which * volumes.shape[1]
    for i, j, k in np.ndindex(2, 2, 2):
        total += share[0][i] * share[1][j] * share[2][k] * flat[base + index[0][i] + index[1][j] + index[2][k]]
    return total


def scores(values: np.ndarray, anatomy: np.ndarray, own: np.ndarray, other: np.ndarray, m: np.ndarray, shape: tuple[int, int, int], n: int) -> np.ndarray:
    """NMI (scans x trials) of volumes (a row each) with anatomies sampled through 3 x 4 voxel maps (scans x trials x 12); 0 where a place is outside. At most SLAB voxels of trials at once."""
    (size, trials), voxels = m.shape[:2], int(np.prod(shape))
    if values.shape[1] != voxels or anatomy.shape[1] != voxels:
        raise ValueError(f"{values.shape[1]} and {anatomy.shape[1]} values for volumes of {shape}")
    code, out = bins(values, own[:, :1], own[:, 1:], n), np.empty((size, trials))
    rows, wide = max(1, SLAB // (trials * voxels)), max(1, SLAB // trials)
    for s in range(0, size, rows):
        t = m[s : s + rows, :, :, None]
        joint = np.zeros(len(t) * trials * n * n, np.int64)
        for v in range(0, voxels, wide):
            x, y, z = (a.astype(float) for a in np.unravel_index(np.arange(v, min(v + wide, voxels)), shape))
            at = [t[:, :, 4 * c] * x + t[:, :, 4 * c + 1] * y + t[:, :, 4 * c + 2] * z + t[:, :, 4 * c + 3] for c in range(3)]
            inside = np.flatnonzero(np.logical_and.reduce([(a >= 0) & (a <= top - 1) for a, top in zip(at, shape, strict=True)]))
            moved = np.zeros(at[0].shape)
            moved.ravel()[inside] = between(anatomy[s : s + rows], inside // (trials * len(x)), [a.ravel()[inside] for a in at], shape)
            b = bins(moved, other[s : s + rows, :1, None], other[s : s + rows, 1:, None], n)
            a = np.broadcast_to(code[s : s + rows, None, v : v + wide], b.shape)
            cell = (np.arange(len(t) * trials).reshape(len(t), trials, 1) * n + a) * n + b
            joint += np.bincount(cell[(a >= 0) & (b >= 0)], minlength=joint.size)
        out[s : s + rows] = nmi(joint.reshape(-1, n, n)).reshape(len(t), trials)
    return out


def rigid_maps(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """transform_of() for arrays: 3 x 4 (scans x trials x 12) of six parameters (scans x trials x 6) about centres (scans x 3)."""
    c, s, turns = np.cos(np.radians(x[..., 3:])), np.sin(np.radians(x[..., 3:])), []
    for axis in range(3):
        i, j = (axis + 1) % 3, (axis + 2) % 3
        r = np.zeros((*x.shape[:2], 3, 3)) + np.eye(3)
        r[..., i, i], r[..., i, j], r[..., j, i], r[..., j, j] = c[..., axis], -s[..., axis], s[..., axis], c[..., axis]
        turns.append(r)
    r, about = turns[2] @ (turns[1] @ turns[0]), centre[:, None, :]
    shift = about - (r * about[:, :, None, :]).sum(axis=3) + x[..., :3]
    return np.concatenate([r, shift[..., None]], axis=3).reshape(*x.shape[:2], 12)


def search(score, centre: np.ndarray, bounds: list[float], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(x, header, best, evaluations) of scans that move together, see Alignment.optimum(); score: NMI of voxel maps (scans x trials x 12)."""
    limits, scans = np.array(bounds), np.arange(len(centre))
    x = np.zeros((len(centre), 6))
    header = score(rigid_maps(x[:, None], centre))[:, 0]
    best, ways, used = np.nan_to_num(header), np.tile(np.diag(limits), (len(centre), 1, 1)), 1
    for sweep in range(SWEEPS):
        start, gains = x.copy(), np.zeros((len(centre), 6))
        for k in range(7):
            if used + POINTS > most:
                return x, header, best, used
            way, span = ways[:, k] if k < 6 else x - start, 0.5**sweep
            # how far each parameter lets the line go, up and down
            step, goes = np.where(way == 0, 1.0, way), way != 0
            ends = [np.where(goes, (np.where(way > 0, side, -side) - x) / step, far) for side, far in ((limits, np.inf), (-limits, -np.inf))]
            moves = goes.any(axis=1)
            high, low = np.where(moves, np.minimum(ends[0].min(axis=1), span), 0.0), np.where(moves, np.maximum(ends[1].max(axis=1), -span), 0.0)
            t = low[:, None] + (high - low)[:, None] * np.arange(POINTS) / (POINTS - 1)
            trial = np.clip(x[:, None] + t[..., None] * way[:, None], -limits, limits)
            value = np.nan_to_num(score(rigid_maps(trial, centre)))
            # the greatest value, of equals the nearest place, then the greatest parameters
            at = np.lexsort((*np.moveaxis(trial, 2, 0)[::-1], -np.abs(t), value), axis=1)[:, -1]
            top, used = value[scans, at], used + POINTS
            better = top > best
            if k < 6:
                gains[:, k] = np.where(better, top - best, 0.0)
            x, best = np.where(better[:, None], trial[scans, at], x), np.maximum(best, top)
        # the way that the sweep came takes the place of the direction that gained most
        came = x - start
        went = np.flatnonzero((came != 0).any(axis=1))
        ways[went, gains[went].argmax(axis=1)] = came[went]
    return x, header, best, used


def transform_of(x: list[Column], centre: list[Column]) -> Matrix:
    """3 x 4 of six parameters (shifts, degrees) about a centre."""
    return rigid(rotation(*x[3:]), x[:3], centre)


def _stacked(columns: list[pd.Series], shape: tuple[int, int, int]):
    """Columns of arrays as matrices, a row a scan, as many rows at once as fill a group."""
    rows = max(1, GROUP // int(np.prod(shape)))
    for i in range(0, len(columns[0]), rows):
        yield [np.stack([np.asarray(x, float) for x in c.iloc[i : i + rows]]) for c in columns]


class Alignment:
    """Trials of a table (scan, values, anatomy, centre): two volumes of one shape, in voxels of one unit, and the point to turn about."""

    def __init__(self, scans: DataFrame, shape: tuple[int, int, int], n: int = 8, clip: tuple[float, float] = (0.02, 0.98)):
        self.shape, self.n = shape, n
        unit = [[F.lit(float(i == j)) for j in range(4)] for i in range(3)]
        self.unit = unit
        range_of = lambda c: F.array(share(F.col(c), clip[0]), share(F.col(c), clip[1])).alias(f"{c}_range")
        own = scans.repartition(max(8, scans.sparkSession.sparkContext.defaultParallelism), "scan")  # trials are work, not bytes
        self.scans = materialised(own.select("scan", "values", "anatomy", "centre", range_of("values"), range_of("anatomy")))

    def score(self, trials: DataFrame, m: Matrix, name: str) -> DataFrame:
        """trials (scans' rows and more) with the NMI under a transform of the anatomy's world."""
        shape, n = self.shape, self.n

        @F.pandas_udf("double")
        def scored(values: pd.Series, anatomy: pd.Series, own: pd.Series, other: pd.Series, m: pd.Series) -> pd.Series:
            parts = [scores(v, a, r, s, t[:, None], shape, n)[:, 0] for v, a, r, s, t in _stacked([values, anatomy, own, other, m], shape)]
            return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

        return trials.withColumn(name, scored("values", "anatomy", "values_range", "anatomy_range", voxel_map(self.unit, self.unit, m)))

    @property
    def centre(self) -> list[Column]:
        return [F.get("centre", F.lit(i)) for i in range(3)]

    def profiles(self, shifts: list[float], degrees: list[float]) -> DataFrame:
        """(scan, axis, offset, nmi): one parameter moved at a time."""
        moves = [F.struct(F.lit(a).alias("axis"), F.lit(float(v)).alias("offset"), F.array(*[F.lit(float(v) if b == a else 0.0) for b in AXES]).alias("x")) for a in AXES for v in (shifts if a[0] == "t" else degrees)]
        trials = self.scans.select("*", F.inline(F.array(*moves)))
        x = [F.get("x", F.lit(i)) for i in range(6)]
        return self.score(trials, transform_of(x, self.centre), "nmi").select("scan", "axis", "offset", "nmi")

    def mirrored(self) -> DataFrame:
        """(scan, nmi) with the anatomy mirrored along the first axis at the centre."""
        m = [list(row) for row in self.unit]
        m[0][0], m[0][3] = F.lit(-1.0), 2 * self.centre[0]
        return self.score(self.scans, m, "nmi").select("scan", "nmi")

    def optimum(self, shift: float, degrees: float, most: int = 600) -> DataFrame:
        """(scan, x, header, best, evaluations): the parameters of greatest NMI within the bounds, from 0, by at most `most` evaluations a scan.

        Direction sets: lines along six directions in turn, then along the way that the sweep came, which takes the place of
        the direction that gained most. A line is searched at POINTS places, over half the span from sweep to sweep. A scan's
        search needs no other scan: it is one pass, in which the scans of a group move together.
        """
        shape, n, bounds = self.shape, self.n, [shift] * 3 + [degrees] * 3

        def found(batches):
            for batch in batches:
                at = 0
                for v, a, r, s, centre in _stacked([batch[c] for c in ("values", "anatomy", "values_range", "anatomy_range", "centre")], shape):
                    x, header, best, used = search(lambda m: scores(v, a, r, s, m, shape, n), centre, bounds, most)  # noqa: B023
                    yield pd.DataFrame({"scan": batch["scan"].iloc[at : at + len(v)].to_numpy(), "x": list(x), "header": header, "best": best, "evaluations": used})
                    at += len(v)

        kinds = T.StructType([self.scans.schema["scan"], T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("header", T.DoubleType()), T.StructField("best", T.DoubleType()), T.StructField("evaluations", T.IntegerType())])
        return materialised(self.scans.mapInPandas(found, kinds))


def displacements(points: Column, m: Matrix) -> Column:
    """struct(mean, most): how far a transform moves an array of points (structs x, y, z)."""

    def moved(p: Column) -> Column:
        at = [p["x"], p["y"], p["z"]]
        return F.sqrt(sum(((b - a) * (b - a) for a, b in zip(at, applied(m, at), strict=True)), F.lit(0.0)))

    far = F.transform(points, moved)
    return F.struct((F.aggregate(far, F.lit(0.0), lambda s, x: s + x) / F.size(far)).alias("mean"), F.array_max(far).alias("most"))
