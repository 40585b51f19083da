"""Volumes against loops over voxels: sampling, distances, components; exact quantiles against NumPy; ridge in the plan against direct fits."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


def rotation(axis, degrees):
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    m = np.eye(3)
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
    return m


# ---- sampling


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("slab", [1 << 20, 7])
def test_pick_voxel_by_voxel(order, slab, monkeypatch):
    from panelforge.functions import resampling

    monkeypatch.setattr(resampling, "SLAB", slab)
    r = np.random.default_rng(order)
    v, shape = r.normal(size=(5, 3, 6)), (4, 5, 3)
    m = np.hstack([rotation(0, 20) @ rotation(2, -35) * 1.1, [[1.3], [0.4], [0.7]]])
    got = resampling.pick(v, m, shape, order)
    inside = 0
    for p in np.ndindex(shape):
        at = m[:, :3] @ p + m[:, 3]
        want = 0.0
        if all(0 <= x <= n - 1 for x, n in zip(at, v.shape, strict=True)):
            inside += 1
            if order == 0:
                want = v[tuple(int(np.floor(x + 0.5)) for x in at)]
            else:
                low = np.floor(at).astype(int)
                for c in np.ndindex(2, 2, 2):
                    w = np.prod([(x - a) if b else 1 - (x - a) for x, a, b in zip(at, low, c, strict=True)])
                    if w:
                        want += w * v[tuple(low + c)]
        assert abs(got[p] - want) < 1e-12
    assert 3 < inside < 60


def test_resampled_identity_flat_volumes_and_faults(spark):
    from pyspark.sql import functions as F

    from panelforge.functions.resampling import pick, resampled, voxel_map

    values = [float(i) for i in range(24)]
    df = spark.createDataFrame([(values, [2, 3, 4]), (None, [2, 3, 4])], "v array<double>, s array<int>")
    unit = [[F.lit(float(i == j)) for j in range(4)] for i in range(3)]
    doubled = [[F.lit(2.0 if i == j else 0.0) for j in range(4)] for i in range(3)]
    for order in (0, 1):
        same = df.select(resampled(F.col("v"), F.col("s"), voxel_map(unit, unit), (2, 3, 4), order)).collect()
        assert [r[0] for r in same] == [values, None]
        # a source of twice the size, a world that doubles: nothing moves
        assert df.select(resampled(F.col("v"), F.col("s"), voxel_map(doubled, unit, doubled), (2, 3, 4), order)).first()[0] == values
        half = df.select(resampled(F.col("v"), F.col("s"), voxel_map(unit, doubled), (1, 2, 3), order)).first()[0]
        assert half == [0.0, 2.0, 0.0, 8.0, 10.0, 0.0]
    flat = np.arange(5.0).reshape(1, 1, 5)
    assert pick(flat, np.hstack([np.eye(3), [[0], [0], [0.5]]]), (1, 1, 5), 1).ravel().tolist() == [0.5, 1.5, 2.5, 3.5, 0.0]
    with pytest.raises(Exception, match="24 values"):
        df.select(resampled(F.col("v"), F.array(F.lit(2), F.lit(2), F.lit(2)), voxel_map(unit, unit), (1, 1, 1), 0)).collect()


# ---- distances


@given(st.integers(0, 10**6), st.integers(1, 9), st.sampled_from([0.5, 1.0, 1.5]), st.floats(0, 1))
@settings(max_examples=60, deadline=None)
def test_envelope_is_the_minimum(seed, n, spacing, gaps):
    from panelforge.functions.distances import along

    r = np.random.default_rng(seed)
    f = np.where(r.random((7, n)) < gaps, np.inf, r.integers(0, 20, (7, n)).astype(float))
    p = np.arange(n)
    want = (f[:, None, :] + (spacing * (p[:, None] - p[None, :])) ** 2).min(axis=2)
    got = along(f, spacing)
    assert (np.isinf(got) == np.isinf(want)).all() and np.allclose(got[np.isfinite(got)], want[np.isfinite(want)])


def test_distances_of_volumes(spark):
    from panelforge.jobs.volumes import distances

    r = np.random.default_rng(8)
    shapes, spacings = [(3, 5, 4), (6, 2, 3), (1, 1, 7), (2, 2, 2)], [(1.0, 1.5, 2.0), (2.0, 1.0, 1.0), (1.0, 1.0, 0.5), (1.0, 1.0, 1.0)]
    volumes = [(r.random(s) > 0.25).astype(float) for s in shapes]
    volumes[3][:] = 1.0  # no background
    df = spark.createDataFrame([(i, v.ravel().tolist(), list(s), list(w)) for i, (v, s, w) in enumerate(zip(volumes, shapes, spacings, strict=True))], "scan long, values array<double>, shape array<int>, spacing array<double>")
    got = {(x.scan, x.i, x.k): x.line for x in distances(df).collect()}
    for n, (v, w) in enumerate(zip(volumes, spacings, strict=True)):
        back = np.argwhere(v <= 0)
        for i, j, k in np.ndindex(v.shape):
            want = np.sqrt((((back - (i, j, k)) * w) ** 2).sum(axis=1)).min() if len(back) else np.inf
            assert got[n, i, k][j] == pytest.approx(want)


# ---- components


def flood(mask):
    left, out = {tuple(p) for p in np.argwhere(mask)}, {}
    while left:
        todo, seen = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.discard(p)
                seen.add(p)
                todo += [tuple(np.add(p, s)) for s in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
        out[int(np.ravel_multi_index(min(seen), mask.shape))] = len(seen)
    return out


def test_clusters(spark):
    from panelforge.jobs.volumes import clusters

    r = np.random.default_rng(4)
    snake = np.zeros((9, 9, 3), bool)  # one long path
    snake[::2] = True
    snake[1::4, 8], snake[3::4, 0] = True, True
    snake[::2, :, 1:] = False
    snake[1::2, :, 1:] = False
    masks = [r.random((4, 5, 6)) > 0.5, r.random((1, 7, 3)) > 0.4, np.ones((3, 3, 3), bool), np.zeros((2, 2, 2), bool), snake]
    df = spark.createDataFrame([(i, m.ravel().tolist(), list(m.shape)) for i, m in enumerate(masks)], "scan long, mask array<boolean>, shape array<int>")
    got = {}
    for x in clusters(df).collect():
        got.setdefault(x.scan, {})[x.component] = x.size
    assert got == {i: flood(m) for i, m in enumerate(masks) if m.any()}


def test_components_of_a_long_path_settle_in_few_rounds(spark, monkeypatch):
    from panelforge.functions import components as graph

    rounds = []
    stars = graph._stars
    monkeypatch.setattr(graph, "_stars", lambda e, large: rounds.append(large) or stars(e, large))
    r = np.random.default_rng(1)
    name = r.permutation(300).tolist()
    edges = [(name[i], name[i + 1]) for i in range(299)] + [(900, 901), (901, 900), (950, 950)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(300)} | {900: 900, 901: 900} and len(rounds) <= 30


# ---- quantiles


def test_exact_quantiles(spark):
    from panelforge.functions.quantiles import exact_quantiles

    r = np.random.default_rng(6)
    groups = {"wide": np.exp(r.normal(size=3000) * 30), "hot": np.where(r.random(4000) < 0.6, 7.5, r.normal(size=4000)), "one": np.array([3.0]), "signs": np.array([-0.0, 0.0, -1.0, 1e300, -1e300, float("inf")]), None: np.arange(10.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("wide", None), ("hot", float("nan")), ("nothing", None)]
    shares = [0.0, 0.005, 0.25, 0.5, 0.9, 1.0]
    got = {(x.g, x.share): (x.n, x.value) for x in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", shares).collect()}
    assert len(got) == len(groups) * len(shares)
    for g, x in groups.items():
        for s in shares:
            n, value = got[g, s]
            assert n == len(x) and (value == pytest.approx(np.quantile(x, s), rel=1e-12) or g == "signs" and s in (0.9, 1.0) and value == float("inf"))
    every = exact_quantiles(spark.createDataFrame([(float(i),) for i in range(101)], "v double"), [], "v", [0.37]).collect()
    assert [x.value for x in every] == [37.0] and exact_quantiles(spark.createDataFrame([], "v double"), [], "v", [0.5]).count() == 0


# ---- ridge in the plan


@pytest.mark.parametrize("n", [1, 2, 4])
def test_eigen_rank_and_solution(spark, n):
    from pyspark.sql import functions as F

    from panelforge.functions.symmetric import eigen, rank, solution

    r = np.random.default_rng(n)
    full = [(lambda z: z.T @ z)(r.normal(size=(9, n))) for _ in range(5)]
    low = [np.outer(u, u) for u in r.normal(size=(3, n))] + [np.zeros((n, n))]
    rows = [(a.ravel().tolist(), r.normal(size=n).tolist() if i < 5 else (a @ r.normal(size=n)).tolist(), lam) for i, a in enumerate(full + low) for lam in (0.0, 0.7)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, lam double").withColumn("e", eigen(F.col("a"), n))
    for x in df.select("a", "b", "lam", "e", rank(F.col("e.values")).alias("rank"), solution(F.col("e"), F.col("b"), F.col("lam"), n).alias("x")).collect():
        a = np.array(x.a).reshape(n, n)
        assert np.allclose(sorted(x.e["values"]), np.linalg.eigvalsh(a), atol=1e-10) and x["rank"] == np.linalg.matrix_rank(a)
        want = np.linalg.solve(a + x.lam * np.eye(n), x.b) if x.lam else np.linalg.lstsq(a, np.array(x.b), rcond=None)[0]
        assert np.allclose(x.x, want, atol=1e-8)


def test_ridge_with_any_features(spark):
    """Slopes, ranks and losses of three features, one a multiple of another in all splits, one constant but for one subject."""
    from panelforge.jobs.ridge import complete, folds, split_fits, split_losses

    r = np.random.default_rng(12)
    subjects, regions = 5, 6
    x = r.normal(size=(subjects, regions, 4))
    x[..., 1] = -2 * x[..., 0]
    x[..., 3] = 1.0
    x[0, :, 3] = r.normal(size=regions)  # does not vary where subject 0 is out
    y = x[..., 0] + r.normal(size=(subjects, regions))
    panel = spark.createDataFrame([(s, f"r{k}", *map(float, x[s, k]), float(y[s, k])) for s in range(subjects) for k in range(regions)], "s int, r string, x0 double, x1 double, x2 double, x3 double, y double")
    grid = (0, 0.5, -1)
    _, fits = split_fits(complete(panel), 4, grid)
    losses = {(q.o, q.v, q.lam): q.loss for q in split_losses(panel, 4, grid).collect()}
    rows = fits.collect()
    assert len(rows) == len(losses) == subjects**2 * 3
    for f in rows:
        train = [s for s in range(subjects) if s not in (f.o, f.v)]
        d = x[train] - x[train].mean(axis=0)
        scale = np.sqrt((d**2).mean(axis=(0, 1)))
        scale[scale < 1e-14] = 0
        on = scale > 0
        z, u = (d[..., on] / scale[on]).reshape(-1, on.sum()), (y[train] - y[train].mean(axis=0)).ravel()
        beta = np.zeros(4)
        if f.lam == 0:
            beta[on], _, rank, _ = np.linalg.lstsq(z, u, rcond=None)
            assert f["rank"] == rank
        elif f.lam > 0:
            beta[on] = np.linalg.solve(z.T @ z / len(u) + f.lam * np.eye(on.sum()), z.T @ u / len(u))
        assert np.allclose(f.beta, beta, atol=1e-8) and (f.lam == 0 or f["rank"] is None)
        held = np.where(on, (x[f.v] - x[train].mean(axis=0)) / np.where(on, scale, 1), 0)
        assert losses[f.o, f.v, f.lam] == pytest.approx(np.mean((y[f.v] - y[train].mean(axis=0) - held @ beta) ** 2), abs=1e-9)
    assert folds(split_losses(panel, 4, grid)).count() == subjects
    for bad in (panel.limit(29), panel.union(panel.limit(1)), panel.selectExpr("s", "r", "x0", "x1", "x2", "IF(s = 1, double('nan'), x3) AS x3", "y"), panel.where("s < 2")):
        with pytest.raises(ValueError):
            complete(bad)
