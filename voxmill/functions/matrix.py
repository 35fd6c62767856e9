"""Affine matrices as nested columns (E tier) and on the driver.

A matrix is a list of rows whose entries are columns or numbers; it is built
when the plan is, per-sample parameters being columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list  # rows of columns or numbers


def _sin(x):
    return F.sin(x) if isinstance(x, Column) else math.sin(x)


def _cos(x):
    return F.cos(x) if isinstance(x, Column) else math.cos(x)


def matmul(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        line = []
        for j in range(len(b[0])):
            terms = [x * b[i][j] if isinstance(x, Column) or not isinstance(b[i][j], Column) else b[i][j] * x
                     for i, x in enumerate(row) if not _zero(x) and not _zero(b[i][j])]
            total = terms[0] if terms else 0.0
            for t in terms[1:]:
                total = total + t
            line.append(total)
        out.append(line)
    return out


def _zero(x) -> bool:
    return not isinstance(x, Column) and x == 0


def eye(n: int) -> Matrix:
    return [[float(i == j) for j in range(n)] for i in range(n)]


def batched_eye(batch: int, n: int) -> np.ndarray:
    return np.broadcast_to(np.eye(n), (batch, n, n)).copy()


def deg_to_rad(angle):
    return F.radians(angle) if isinstance(angle, Column) else angle * math.pi / 180


def unit_box(n: int, scale: Sequence[float] | None = None) -> np.ndarray:
    from .kernels import corners

    return corners(n) * (1.0 if scale is None else np.asarray(scale, float))


def points_to_homogeneous(point: Sequence) -> list:
    return [*point, 1.0]


def points_to_cartesian(point: Sequence) -> list:
    return [x / point[-1] for x in point[:-1]]


def matrix_to_homogeneous(m: Matrix) -> Matrix:
    """A square matrix gets a zero column first; then the row 0 ... 0 1 is added."""
    n = len(m)
    rows = [[*r, 0.0] if len(r) == n else list(r) for r in m]
    return [*rows, [0.0] * n + [1.0]]


def matrix_to_cartesian(m: Matrix, keep_square: bool = False) -> Matrix:
    rows = m[:-1]
    return [r[:-1] for r in rows] if keep_square else [list(r) for r in rows]


def revert_coordinate_order(m: Matrix) -> Matrix:
    """Flips the order of coordinates of a [D, D + 1] or [D + 1, D + 1] matrix, in a copy.

    Rows but a homogeneous last one, and columns but the last, are reversed.
    """
    d = len(m[0]) - 1
    rows = [list(reversed(r[:d])) + [r[d]] for r in m[:d]]
    return rows[::-1] + [list(r) for r in m[d:]]


def orthogonal_inverse(m: Matrix) -> Matrix:
    return [list(r) for r in zip(*m)]


def expand_param(param, ndim: int, what: str = "parameter") -> list:
    """One value for all dimensions, or one each."""
    if isinstance(param, (list, tuple)):
        if len(param) == 1:
            return list(param) * ndim
        if len(param) != ndim:
            raise ValueError(f"{what}: {len(param)} values for {ndim} dimensions")
        return list(param)
    return [param] * ndim


def expand_scalar_param(param, batch: int, ndim: int) -> np.ndarray:
    """Numbers as [batch, ndim]: a scalar, one per dimension (looked at first) or one per sample."""
    a = np.asarray(param, float)
    if a.ndim == 2 and a.shape == (batch, ndim):
        return a
    if a.ndim == 0 or a.size == 1:
        return np.full((batch, ndim), float(a.reshape(-1)[0]))
    if a.shape == (ndim,):
        return np.broadcast_to(a, (batch, ndim)).copy()
    if a.shape == (batch,):
        return np.repeat(a[:, None], ndim, axis=1)
    raise ValueError(f"{a.shape} fits neither {ndim} dimensions nor {batch} samples")


def create_scale(scale, ndim: int, image: bool = True) -> Matrix:
    """Homogeneous; images sample with the inverse.  None: 1."""
    s = expand_param(1.0 if scale is None else scale, ndim, "scale")
    m = eye(ndim + 1)
    for i, x in enumerate(s):
        m[i][i] = 1.0 / x if image else x
    return m


def create_translation(offset, ndim: int, image: bool = True) -> Matrix:
    t = expand_param(0.0 if offset is None else offset, ndim, "translation")
    m = eye(ndim + 1)
    for i, x in enumerate(t):
        m[i][ndim] = -x if image else x
    return m


def _turn(n: int, plane: tuple[int, int], angle) -> Matrix:
    """The rotation of a plane's first axis towards its second."""
    (i, j), m = plane, eye(n)
    m[i][i] = m[j][j] = _cos(angle)
    m[j][i] = _sin(angle)
    m[i][j] = -m[j][i]
    return m


def create_rotation_2d(angle) -> Matrix:
    return _turn(2, (0, 1), angle)


def create_rotation_3d_0(angle) -> Matrix:
    return _turn(3, (1, 2), angle)


def create_rotation_3d_1(angle) -> Matrix:
    return _turn(3, (2, 0), angle)


def create_rotation_3d_2(angle) -> Matrix:
    return _turn(3, (0, 1), angle)


def create_rotation_3d(angles: Sequence) -> Matrix:
    a, b, c = angles
    return matmul(create_rotation_3d_2(c), matmul(create_rotation_3d_1(b), create_rotation_3d_0(a)))


def create_rotation(rotation, ndim: int, degree: bool = False, image: bool = True) -> Matrix:
    """One angle in two dimensions, three in three; images sample with the inverse, the transpose."""
    if ndim not in (2, 3):
        raise ValueError("rotations are of 2 or 3 dimensions")
    r = expand_param(0.0 if rotation is None else rotation, 1 if ndim == 2 else ndim, "rotation")
    r = [deg_to_rad(x) for x in r] if degree else r
    m = create_rotation_2d(r[0]) if ndim == 2 else create_rotation_3d(r)
    return matrix_to_homogeneous(orthogonal_inverse(m) if image else m)


def parametrize_matrix(scale, rotation, translation, ndim: int, degree: bool = False, image: bool = True) -> Matrix:
    """[D, D + 1]: translation, rotation, scale in this order for images, the reverse for points."""
    s, r = create_scale(scale, ndim, image), create_rotation(rotation, ndim, degree, image)
    t = create_translation(translation, ndim, image)
    return matrix_to_cartesian(matmul(matmul(t, r), s) if image else matmul(matmul(s, r), t))


def apply_to_point(m: Matrix, point: Sequence) -> list:
    """A point times a [D, D + 1] matrix, by homogeneous coordinates."""
    moved = matmul(matrix_to_homogeneous(m), [[x] for x in points_to_homogeneous(point)])
    return points_to_cartesian([r[0] for r in moved])


def as_column(m: Matrix) -> Column:
    """Row-major array<double>."""
    return F.array(*[x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for r in m for x in r])


def normalise_matrix(matrix, ndim: int) -> Matrix:
    """[D, D], [D, D + 1] or [D + 1, D + 1] as [D, D + 1]."""
    if matrix is None:
        raise ValueError("a matrix is needed")
    rows = matrix.tolist() if isinstance(matrix, np.ndarray) else [list(r) if isinstance(r, (list, tuple)) else r for r in matrix]
    if not all(isinstance(r, list) for r in rows):
        raise ValueError("a matrix of two dimensions is needed")
    shape = (len(rows), len(rows[0]))
    if shape == (ndim, ndim):
        return [[*r, 0.0] for r in rows]
    if shape == (ndim, ndim + 1):
        return rows
    if shape == (ndim + 1, ndim + 1):
        return rows[:-1]
    raise ValueError(f"a matrix of shape {shape} for {ndim} dimensions")
