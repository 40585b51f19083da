"""Alignment: NMI against definitions, profiles voxel by voxel, and a search that stays in its bounds and finds a known shift."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def found(spark):
    from panelforge.functions.alignment import Alignment

    r = np.random.default_rng(5)
    shape = (7, 6, 8)
    at = np.indices(shape).astype(float)
    rows = []
    for scan, shift in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, -1.0), (-1.5, 1.0, 0.0)]):
        blob = lambda c: np.exp(-(((at - np.array(c)[:, None, None, None]) / np.array([1.6, 1.9, 2.3])[:, None, None, None]) ** 2).sum(axis=0))
        anatomy = blob((3.0, 2.5, 3.5)) + 0.6 * blob((1.5, 4.0, 5.5))
        moved = blob(np.array((3.0, 2.5, 3.5)) - shift) + 0.6 * blob(np.array((1.5, 4.0, 5.5)) - shift) + 0.003 * r.normal(size=shape)
        rows.append((scan, moved.ravel().tolist(), anatomy.ravel().tolist(), [3.0, 2.5, 3.5]))
    rows.append((9, [1.0] * 336, rows[0][2], [3.0, 2.5, 3.5]))  # nothing to tell bins by
    return rows, shape, Alignment(spark.createDataFrame(rows, "scan long, values array<double>, anatomy array<double>, centre array<double>"), shape, 8)


def direct(values, anatomy, centre, shape, x, mirror=False):
    """NMI from a two-way histogram, the transform as plain matrices."""
    from panelforge.functions.resampling import pick

    def about(axis, degrees):
        c, s, m = np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), np.eye(3)
        i, j = (axis + 1) % 3, (axis + 2) % 3
        m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
        return m

    linear = about(2, x[5]) @ about(1, x[4]) @ about(0, x[3])
    if mirror:
        linear = np.diag([-1.0, 1, 1])
    m = np.hstack([linear, (np.array(centre) - linear @ centre + np.array(x[:3]))[:, None]])
    a, b = np.array(values), pick(np.reshape(anatomy, shape), m, shape, 1).ravel()
    ranges = [np.quantile(v, [0.02, 0.98]) for v in (a, np.array(anatomy))]
    if ranges[0][0] == ranges[0][1]:
        return None
    h = np.histogram2d(a, b, bins=8, range=ranges)[0]
    entropy = lambda p: -sum(v * np.log(v) for v in (p / p.sum()).ravel() if v > 0)
    return (entropy(h.sum(0)) + entropy(h.sum(1))) / entropy(h)


def test_profiles_and_mirror(found):
    rows, shape, alignment = found
    by = {r[0]: r for r in rows}
    got = alignment.profiles([-1.0, 0.0, 0.5], [-10.0, 25.0]).collect()
    assert len(got) == 4 * (3 * 3 + 3 * 2)
    for g in got:
        x = [g.offset if a == g.axis else 0.0 for a in ("tx", "ty", "tz", "rx", "ry", "rz")]
        want = direct(*by[g.scan][1:], shape, x)
        assert g.nmi is None if want is None else g.nmi == pytest.approx(want, abs=1e-9)
    for g in alignment.mirrored().collect():
        want = direct(*by[g.scan][1:], shape, [0.0] * 6, mirror=True)
        assert g.nmi is None if want is None else g.nmi == pytest.approx(want, abs=1e-9)


def test_the_search(found):
    from panelforge.functions.alignment import displacements, transform_of

    rows, shape, alignment = found
    by = {r[0]: r for r in rows}
    best = alignment.optimum(2.0, 15.0).collect()
    assert {b.scan for b in best} == {0, 1, 2, 9}
    for b in best:
        assert 1 < b.evaluations <= 600 and all(abs(v) <= 2.0 + 1e-9 for v in b.x[:3]) and all(abs(v) <= 15.0 + 1e-9 for v in b.x[3:])
        if b.scan == 9:
            assert b.header is None and b.best == 0 and b.x == [0.0] * 6
            continue
        assert b.best == pytest.approx(direct(*by[b.scan][1:], shape, b.x), abs=1e-9) and b.best >= b.header == pytest.approx(direct(*by[b.scan][1:], shape, [0.0] * 6), abs=1e-9)
    shifts = {b.scan: b.x[:3] for b in best}
    assert np.allclose(shifts[1], (1.0, 0.0, -1.0), atol=0.35) and np.allclose(shifts[2], (-1.5, 1.0, 0.0), atol=0.45)
    few = alignment.optimum(2.0, 15.0, most=30).collect()
    assert all(b.evaluations == 25 for b in few)
    point = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    turned = transform_of([F.lit(v) for v in (0.0, 0.0, 2.0, 0.0, 0.0, 180.0)], [F.lit(0.0)] * 3)
    moved = alignment.scans.limit(1).select(displacements(point, turned).alias("d")).first().d
    assert moved["mean"] == pytest.approx((8**0.5 + 2) / 2) and moved["most"] == pytest.approx(8**0.5)
