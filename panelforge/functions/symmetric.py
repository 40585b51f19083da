"""Symmetric matrices in array columns: eigenvalues by Jacobi rotations, and solutions of minimum norm, row by row in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SWEEPS = 12
#: Eigenvalues below this share of the largest count as zero.
RANK = 1e-12


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _rotated(m: Column, p: Column, q: Column, c: Column, s: Column, n: int, columns: bool) -> Column:
    """m with its columns (or rows) p and q turned by c, s."""
    own = F.sequence(F.lit(0), F.lit(n * n - 1))

    def cell(at: Column) -> Column:
        i, j = F.floor(at / n).cast("int"), (at % n).cast("int")
        line, other = (j, i) if columns else (i, j)
        value = lambda k: F.get(m, other * n + k if columns else k * n + other)
        return F.when(line == p, c * value(p) - s * value(q)).when(line == q, s * value(p) + c * value(q)).otherwise(F.get(m, at))

    return F.transform(own, cell)


def eigen(matrix: Column, n: int) -> Column:
    """struct(values array, vectors array: n x n, row by row, a column an eigenvector) of a symmetric n x n matrix in an array column, row by row."""
    unit = F.array(*[F.lit(float(i == j)) for i in range(n) for j in range(n)])
    turns = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for _ in range(SWEEPS) for p in range(n) for q in range(p + 1, n)])
    start = F.struct(matrix.alias("a"), unit.alias("v"))
    if n == 1:
        return F.struct(matrix.alias("values"), unit.alias("vectors"))

    def turn(state: Column, at: Column) -> Column:
        a, p, q = state["a"], at["p"], at["q"]
        off = F.get(a, p * n + q)
        theta = (F.get(a, q * n + q) - F.get(a, p * n + p)) / (2 * off)
        t = F.when(off == 0, F.lit(0.0)).otherwise(F.when(theta < 0, -1.0).otherwise(1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1)))

        def by(t: Column) -> Column:
            c = 1 / F.sqrt(t * t + 1)
            return _let(F.struct(c.alias("c"), (t * c).alias("s")), lambda r: F.struct(
                _let(_rotated(a, p, q, r["c"], r["s"], n, True), lambda m: _rotated(m, p, q, r["c"], r["s"], n, False)).alias("a"), _rotated(state["v"], p, q, r["c"], r["s"], n, True).alias("v")
            ))

        return F.when(off == 0, state).otherwise(_let(t, by))

    done = F.aggregate(turns, start, turn)
    return _let(done, lambda d: F.struct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(d["a"], i * n + i)).alias("values"), d["v"].alias("vectors")))


def rank(values: Column) -> Column:
    """How many eigenvalues are not zero against the largest."""
    top = F.array_max(values)
    return F.size(F.filter(values, lambda w: (w > RANK * top) & (top > 0)))


def solution(eigens: Column, right: Column, shift: Column, n: int) -> Column:
    """Minimum-norm x of (A + shift) x = right, as an array; A by its eigen() struct. Directions whose eigenvalue is zero are left out where shift is 0."""
    values, vectors = eigens["values"], eigens["vectors"]
    each = F.sequence(F.lit(0), F.lit(n - 1))
    dot = lambda f: F.aggregate(F.transform(each, f), F.lit(0.0), lambda acc, x: acc + x)
    zero = lambda w: (shift == 0) & ((w <= RANK * F.array_max(values)) | (F.array_max(values) <= 0))
    weights = F.transform(each, lambda k: F.when(zero(F.get(values, k)), F.lit(0.0)).otherwise(dot(lambda i: F.get(vectors, i * n + k) * F.get(right, i)) / (F.get(values, k) + shift)))
    return _let(weights, lambda w: F.transform(each, lambda i: dot(lambda k: F.get(vectors, i * n + k) * F.get(w, k))))
