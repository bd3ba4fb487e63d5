"""Rigid geometry as column expressions.

Vectors are lists of three columns, matrices lists of columns row by row, so an
expression stays flat and inside generated code; `pack` makes an array of them
and `unpack` takes one apart.  Quaternions are in the order w, x, y, z.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cols = list[Column]


def hold(df: DataFrame, prefix: str, cols: Cols) -> tuple[DataFrame, Cols]:
    """The frame with the values as columns of their own, and those columns: later expressions name them instead of repeating them."""
    names = [f"_{prefix}{i}" for i in range(len(cols))]
    return df.withColumns(dict(zip(names, cols, strict=True))), [F.col(n) for n in names]


def unpack(array: Column, n: int, start: int = 0) -> Cols:
    return [F.get(array, F.lit(start + i)).cast("double") for i in range(n)]


def pack(cols: Cols) -> Column:
    return F.array(*cols)


def add_all(cols: Cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def dot(a: Cols, b: Cols) -> Column:
    return add_all([x * y for x, y in zip(a, b, strict=True)])


def sub(a: Cols, b: Cols) -> Cols:
    return [x - y for x, y in zip(a, b, strict=True)]


def norm(a: Cols) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Cols, eps: float = 1e-12) -> Cols:
    n = F.greatest(norm(a), F.lit(eps))
    return [x / n for x in a]


def cross(a: Cols, b: Cols) -> Cols:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def matvec(m: Cols, v: Cols) -> Cols:
    n = len(v)
    return [dot(m[i * n : i * n + n], v) for i in range(len(m) // n)]


def matmul(a: Cols, b: Cols, n: int) -> Cols:
    return [dot(a[i * n : i * n + n], b[j::n]) for i in range(n) for j in range(n)]


def transpose(m: Cols, n: int) -> Cols:
    return [m[j * n + i] for i in range(n) for j in range(n)]


def rigid(rot: Cols, t: Cols, s: Column | None = None) -> Cols:
    """4x4 of a rotation and a translation; the corner is 1 / s."""
    one = F.lit(1.0) if s is None else 1.0 / s
    zero = F.lit(0.0)
    return [*rot[:3], t[0], *rot[3:6], t[1], *rot[6:], t[2], zero, zero, zero, one]


def rotation_of(m: Cols) -> Cols:
    return [*m[0:3], *m[4:7], *m[8:11]]


def translation_of(m: Cols) -> Cols:
    return [m[3], m[7], m[11]]


def invert_rigid(m: Cols) -> Cols:
    back = transpose(rotation_of(m), 3)
    return rigid(back, [-x for x in matvec(back, translation_of(m))])


def apply_rigid(m: Cols, v: Cols) -> Cols:
    return [x + t for x, t in zip(matvec(rotation_of(m), v), translation_of(m), strict=True)]


def rot6_to_matrix(six: Cols) -> Cols:
    """Gram-Schmidt on two vectors, which become the first two columns; the third is their cross product."""
    x = unit(six[:3])
    along = dot(x, six[3:])
    y = unit([b - along * a for a, b in zip(x, six[3:], strict=True)])
    z = cross(x, y)
    return [c[i] for i in range(3) for c in (x, y, z)]


def matrix_to_rot6(m: Cols) -> Cols:
    return [m[0], m[3], m[6], m[1], m[4], m[7]]


def quat_to_matrix(q: Cols) -> Cols:
    w, x, y, z = unit(q)
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def quat_product(a: Cols, b: Cols) -> Cols:
    return [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]


def matrix_to_quat(m: Cols) -> Cols:
    """With w >= 0; a component's size comes from the diagonal, its sign from the off-diagonal differences.

    Near half turns the largest component leads, which keeps the quotient stable.
    """
    size = [1 + m[0] + m[4] + m[8], 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8]]
    wx, wy, wz = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    xy, xz, yz = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    rows = [[size[0], wx, wy, wz], [wx, size[1], xy, xz], [wy, xy, size[2], yz], [wz, xz, yz, size[3]]]
    top = F.greatest(*size)
    lead = [F.when(size[0] == top, rows[0][i]).when(size[1] == top, rows[1][i]).when(size[2] == top, rows[2][i]).otherwise(rows[3][i]) for i in range(4)]
    q = unit(lead)
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return [c * sign for c in q]


def project(point: Cols, w2c: Cols, k: Cols, least_depth: float = 1e-5) -> Cols:
    """World point to pixel x, y and depth; k is fx, fy, cx, cy."""
    x, y, z = apply_rigid(w2c, point)
    d = F.greatest(z, F.lit(least_depth))
    return [k[0] * x / d + k[2], k[1] * y / d + k[3], z]


def unproject(px: Column, py: Column, depth: Column, c2w: Cols, k: Cols) -> Cols:
    return apply_rigid(c2w, [(px - k[2]) / k[0] * depth, (py - k[3]) / k[1] * depth, depth])


def solve3(a: Cols, b: Cols) -> Cols:
    """Solution of a 3x3 system by cofactors; NULL where it is singular."""
    cof = cross(a[3:6], a[6:9]), cross(a[6:9], a[0:3]), cross(a[0:3], a[3:6])
    det = dot(a[0:3], cof[0])
    return [F.try_divide(cof[0][i] * b[0] + cof[1][i] * b[1] + cof[2][i] * b[2], det) for i in range(3)]
