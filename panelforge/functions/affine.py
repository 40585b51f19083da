"""Matrices of column expressions: rigid transforms, voxel-to-world matrices, products and inverses, row by row in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def product(a: Matrix, b: Matrix) -> Matrix:
    def element(row: list[Column], j: int) -> Column:
        out = row[0] * b[0][j]
        for k in range(1, len(b)):
            out = out + row[k] * b[k][j]
        return out

    return [[element(row, j) for j in range(len(b[0]))] for row in a]


def rotation(rx: Column, ry: Column, rz: Column) -> Matrix:
    """Rotation by angles in degrees about the first, then the second, then the third axis."""

    def about(axis: int, degrees: Column) -> Matrix:
        c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
        out = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
        i, j = (axis + 1) % 3, (axis + 2) % 3
        out[i][i], out[i][j], out[j][i], out[j][j] = c, -s, s, c
        return out

    return product(about(2, rz), product(about(1, ry), about(0, rx)))


def rigid(r: Matrix, shift: list[Column], centre: list[Column]) -> Matrix:
    """3 x 4: rotate about a centre, then shift."""
    moved = product(r, [[c] for c in centre])
    return [[*r[i], centre[i] - moved[i][0] + shift[i]] for i in range(3)]


def determinant(m: Matrix) -> Column:
    a, b, c = (row[:3] for row in m)
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def angle(m: Matrix) -> Column:
    """Rotation angle in degrees."""
    cosine = (m[0][0] + m[1][1] + m[2][2] - 1) / 2
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def applied(m: Matrix, point: list[Column]) -> list[Column]:
    return [row[0] * point[0] + row[1] * point[1] + row[2] * point[2] + row[3] for row in m]


def compose(a: Matrix, b: Matrix) -> Matrix:
    """a after b, both 3 x 4."""
    linear = product([row[:3] for row in a], [row[:3] for row in b])
    return [[*linear[i], applied(a, [b[0][3], b[1][3], b[2][3]])[i]] for i in range(3)]


def inverse(m: Matrix) -> Matrix:
    """Inverse of a 3 x 4 by the adjugate."""
    det = determinant(m)
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    linear = [[minor(j, i) / det for j in range(3)] for i in range(3)]
    shift = product(linear, [[m[k][3]] for k in range(3)])
    return [[*linear[i], -shift[i][0]] for i in range(3)]


def vox2ras(dims: list[Column], size: list[Column], cosines: Matrix, centre: list[Column]) -> Matrix:
    """Voxel indices to world: cosines' columns are the axes' directions; the middle of the grid (dims / 2) lies at centre."""
    linear = [[cosines[i][j] * size[j] for j in range(3)] for i in range(3)]
    middle = product(linear, [[d / 2] for d in dims])
    return [[*linear[i], centre[i] - middle[i][0]] for i in range(3)]


def as_columns(m: Matrix, digits: int | None = None) -> list[Column]:
    """Named m00, m01, ...; rounded to digits."""
    return [(F.round(c, digits) if digits is not None else c).alias(f"m{i}{j}") for i, row in enumerate(m) for j, c in enumerate(row)]


def from_array(name: str) -> Matrix:
    """3 x 4 from a column of at least 12 numbers, row by row."""
    return [[F.get(name, F.lit(4 * i + j)) for j in range(4)] for i in range(3)]
