"""Boosted trees against a direct recursion, one fit and one leaf at a time."""

import numpy as np
import pytest


def grown(category, numbers, y, train, leaves, rounds):
    """Reference: lists and loops, after the same rules."""
    cuts = []
    for x in numbers:
        known = sorted(set(x[train]))
        cuts.append([(a + b) / 2 for a, b in zip(known, known[1:], strict=False)] if len(known) <= 255 else list(np.percentile(x[train], np.linspace(0, 100, 256)[1:-1], method="midpoint")))
    p = np.full(len(y), y[train].mean())

    def split(rows, g):
        total, best = g[rows].sum() ** 2 / (len(rows) + 1), (0.0, None)
        options = []
        by = {k: [i for i in rows if category[i] == k] for k in set(category[rows])}
        order = sorted((k for k in by if len(by[k]) >= 10), key=lambda k: (g[by[k]].sum() / (len(by[k]) + 10), k))
        for seq in (order, order[::-1]):
            for m in range(1, (len(order) + 1) // 2 + 1):
                options.append(("c", frozenset(seq[:m])))
        for f, x in enumerate(numbers):
            options += [(f, c) for c in cuts[f]]
        for kind, at in options:
            left = [i for i in rows if (category[i] in at if kind == "c" else numbers[kind][i] <= at)]
            if len(left) >= 20 and len(rows) - len(left) >= 20:
                gl, gr = g[left].sum(), g[rows].sum() - g[left].sum()
                gain = gl**2 / (len(left) + 1) + gr**2 / (len(rows) - len(left) + 1) - total
                if gain > best[0] * (1 + 1e-12):
                    best = (gain, (kind, at))
        return best

    for _ in range(rounds):
        g = p - y
        nodes = [(np.flatnonzero(train), np.arange(len(y)), None)]
        nodes = [(a, b, split(a, g)) for a, b, _ in nodes]
        while len(nodes) < leaves:
            i = max(range(len(nodes)), key=lambda k: (nodes[k][2][0], -k))
            rows, every, (gain, how) = nodes[i]
            if gain <= 0:
                break
            kind, at = how
            goes = lambda j: category[j] in at if kind == "c" else numbers[kind][j] <= at  # noqa: B023, E731
            parts = [(np.array([j for j in rows if goes(j) == side]), np.array([j for j in every if goes(j) == side])) for side in (True, False)]
            nodes[i] = (*parts[0], split(parts[0][0], g))
            nodes.append((*parts[1], split(parts[1][0], g)))
        p = p.copy()
        for rows, every, _ in nodes:
            p[every] -= 0.05 * g[rows].sum() / (len(rows) + 1)
    return p


@pytest.mark.parametrize(("leaves", "subjects", "regions"), [(3, 9, 14), (7, 24, 12)])
def test_lock_step_equals_one_at_a_time(leaves, subjects, regions):
    from panelforge.functions.boosting import boosted

    r = np.random.default_rng(leaves)
    s, k = (a.ravel() for a in np.indices((subjects, regions)))
    x = r.normal(size=(2, s.size)) + s / 9
    y = np.sin(2 * x[0]) + 0.5 * (x[1] > 0.4) + r.normal(size=regions)[k] + 0.2 * r.normal(size=s.size)
    train = np.stack([(s != 0) & (s != v) for v in range(4)])
    for rounds, got in zip((1, 6), boosted(k, x, y, train, leaves, [1, 6]), strict=True):
        for b in range(len(train)):
            assert np.allclose(got[b], grown(k, x, y, train[b], leaves, rounds), atol=1e-10)


def test_many_values_get_quantile_bins():
    from panelforge.functions.boosting import edges

    x = np.random.default_rng(0).normal(size=3000)
    assert edges(x).size == 254 and edges(np.array([1.0, 1.0, 2.0])).tolist() == [1.5]


def test_losses_and_choice(spark):
    """Losses by split against direct fits, and the choice with its tie rule."""
    from panelforge.jobs.boosted import chosen, losses

    r = np.random.default_rng(3)
    rows = [(s, f"r{k:02}", float(x1), float(x2), float(np.tanh(x1) + 0.3 * k + 0.1 * r.normal())) for s in range(5) for k in range(12) for x1, x2 in [r.normal(size=2)]]
    got = losses(spark.createDataFrame(rows, "s int, r string, x1 double, x2 double, y double"), (3, 4), (2, 5)).collect()
    assert len(got) == 25 * 5
    s, k = np.array([x[0] for x in rows]), np.array([int(x[1][1:]) for x in rows])
    x, y = np.array([x[2:4] for x in rows]).T, np.array([x[4] for x in rows])
    for g in got:
        train = (s != g.o) & (s != g.v)
        p = grown(k, x, y, train, g.leaves, g.rounds) if g.leaves else np.array([y[train & (k == j)].mean() for j in k])
        assert abs(g.loss - np.mean((y - p)[s == g.v] ** 2)) < 1e-9
    best = {c.subject: c for c in chosen(spark.createDataFrame(got)).collect()}
    for o in range(5):
        score = {}
        for g in got:
            if g.o == o and g.v != o:
                score.setdefault((g.leaves, g.rounds), []).append(g.loss)
        score = {c: np.mean(v) for c, v in score.items()}
        base = score.pop((0, 0))
        low = min(score.values())
        assert (best[o].max_leaf_nodes, best[o].max_iter) == min(c for c, v in score.items() if v - low <= 1e-12 * base)
    tied = [(o, v, n, m, 1.0 if n else 2.0) for o in (1, 2, 3) for v in (1, 2, 3) for n, m in ((0, 0), (3, 100), (3, 300), (7, 100))]
    assert {(c.max_leaf_nodes, c.max_iter, c.d) for c in chosen(spark.createDataFrame(tied, "o int, v int, leaves int, rounds int, loss double")).collect()} == {(3, 100, 1.0)}
