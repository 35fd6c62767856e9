"""Affine transforms: matrices as columns, one sampling kernel."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import matrix as mx
from ..functions.rng import AbstractParameter, as_parameter
from ..functions.spec import RAGGED, TensorSpec, per_dim
from .base import KeyedTransform, Samples, kernel, over_batch, sampled


class Affine(KeyedTransform):
    """Samples images through a matrix [D, D], [D, D + 1] or [D + 1, D + 1].

    The matrix maps normalised output coordinates, last axis first, to input
    ones.  ``output_size`` sets the extents; else ``adjust_size`` makes them hold
    the moved corners of every image in the batch; else they stay.
    """

    def __init__(
        self, matrix=None, keys: Sequence[str] = ("data",), output_size=None, adjust_size=False, interpolation_mode="bilinear",
        padding_mode="zeros", align_corners=False, reverse_order=False, per_sample=True, name=None,
    ):
        super().__init__(keys, name)
        if matrix is None and type(self) is Affine:
            raise ValueError("a matrix is needed")
        self.matrix, self.output_size, self.adjust_size = matrix, output_size, adjust_size
        self.mode, self.padding, self.align = interpolation_mode, padding_mode, align_corners
        self.reverse_order, self.per_sample = reverse_order, per_sample

    def options(self) -> dict:
        return {"keys": self.keys, "output_size": self.output_size, "adjust_size": self.adjust_size, "interpolation_mode": self.mode, "padding_mode": self.padding,
                "align_corners": self.align, "reverse_order": self.reverse_order, "per_sample": self.per_sample}

    def assemble_matrix(self, s: Samples, op: str) -> mx.Matrix:
        """[D, D + 1], entries being numbers or columns."""
        return mx.normalise_matrix(self.matrix, s.spec(self.keys[0]).ndim)

    def size(self, spec: TensorSpec) -> tuple[int, ...] | None:
        return None if self.output_size is None else tuple(int(n) for n in per_dim(self.output_size, spec.ndim))

    def apply(self, s: Samples) -> Samples:
        s.need(self.keys)
        s, op = s.op(self.name)
        m = self.assemble_matrix(s, op)
        if self.reverse_order:
            m = mx.revert_coordinate_order(m)
        theta = mx.as_column(m)
        if self.output_size is not None and self.adjust_size:
            warnings.warn("a given output size goes before an adjusted one", UserWarning, stacklevel=2)
        for key in self.keys:
            s = self.sample(s, key, theta)
        return s

    def sample(self, s: Samples, key: str, theta: Column) -> Samples:
        spec, d = s.spec(key), s.spec(key).ndim
        mode, padding, align, size = self.mode, self.padding, self.align, self.size(spec)
        if size is None and self.adjust_size:
            return self._adjusted(s, key, theta)
        size = size or spec.spatial

        def run(x: np.ndarray, t: np.ndarray) -> np.ndarray:
            return kernels.grid_sample(x, kernels.affine_grid(t.reshape(len(t), d, d + 1), size, align), mode, padding, align)

        return kernel(s, key, run, TensorSpec((spec.channels, *size)), theta)

    def _adjusted(self, s: Samples, key: str, theta: Column) -> Samples:
        """Extents from the moved corners, the largest of the batch: a window over batches, of two numbers a sample."""
        spec, d = s.spec(key), s.spec(key).ndim
        box = mx.unit_box(d, spec.spatial)
        t = [[theta[i * (d + 1) + j] for j in range(d + 1)] for i in range(d)]
        spans = []
        for i in range(d):
            moved = [sum((t[i][j] * float(p[j]) for j in range(d)), F.lit(0.0)) + t[i][d] for p in box]
            spans.append(F.greatest(*moved) - F.least(*moved))
        mode, padding, align = self.mode, self.padding, self.align
        names = [f"__extent{i}" for i in range(d)]
        s = over_batch(s, **{n: F.max(x) for n, x in zip(names, spans)})
        size = F.array(*[F.greatest(F.floor(F.col(n) + 1e-4), F.lit(1)).cast("double") for n in names])

        def run(x: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
            grid = kernels.affine_grid(t.reshape(len(t), d, d + 1), [int(k) for k in n[0]], align)
            return kernels.grid_sample(x, grid, mode, padding, align)

        out = kernel(s, key, run, RAGGED, theta, size)
        return out.with_df(out.df.drop(*names))

    def __add__(self, other) -> StackedAffine:
        return StackedAffine(self, other if isinstance(other, Affine) else Affine(other), **self.options())

    def __radd__(self, other) -> StackedAffine:
        return StackedAffine(other if isinstance(other, Affine) else Affine(other), self, **self.options())


class StackedAffine(Affine):
    """The product of several transforms' matrices, sampled once."""

    def __init__(self, *transforms, name=None, **options):
        super().__init__(None, name=name, **options)
        if len(transforms) == 1 and isinstance(transforms[0], (list, tuple)):
            transforms = tuple(transforms[0])
        self.transforms = [t if isinstance(t, Affine) else Affine(t) for t in transforms]
        if not self.transforms:
            raise ValueError("at least one transform is needed")

    def assemble_matrix(self, s, op):
        out = None
        for i, t in enumerate(self.transforms):
            m = mx.matrix_to_homogeneous(t.assemble_matrix(s, f"{op}/{i}"))
            out = m if out is None else mx.matmul(out, m)
        return mx.matrix_to_cartesian(out)


class BaseAffine(Affine):
    """Scale, rotation and translation, each None, a number, one per dimension, or drawn; in degrees if asked.

    Drawn parameters are drawn for every sample, or once a batch without
    ``per_sample``.  A None is the identity.
    """

    def __init__(self, scale=None, rotation=None, translation=None, degree: bool = False, image_transform: bool = True, **options):
        super().__init__(None, **options)
        self.scale, self.rotation, self.translation, self.degree, self.image = scale, rotation, translation, degree, image_transform

    def _drawn(self, value, s: Samples, op: str, what: str, n: int):
        draws = s.draws(f"{op}:{what}", "sample" if self.per_sample else "batch")
        if isinstance(value, (list, tuple)):
            if len(value) not in (1, n):
                raise ValueError(f"{what}: {len(value)} values for {n}")
            first, out = 0, []
            for v in value:
                out.append(sampled(v, draws, first) if isinstance(v, AbstractParameter) else v)
                first += as_parameter(v).width
            return out
        if isinstance(value, AbstractParameter):  # one draw for each dimension it has to fill
            x = [sampled(value, draws, i * value.width) for i in range(n if what == "rotation" else 1)]
            return x if what == "rotation" else x[0]
        return value

    def assemble_matrix(self, s, op):
        d = s.spec(self.keys[0]).ndim
        return mx.parametrize_matrix(
            self._drawn(self.scale, s, op, "scale", d), self._drawn(self.rotation, s, op, "rotation", 1 if d == 2 else d),
            self._drawn(self.translation, s, op, "translation", d), d, self.degree, self.image,
        )


class Rotate(BaseAffine):
    def __init__(self, rotation, degree: bool = False, **options):
        super().__init__(None, rotation, None, degree, **options)


class Translate(BaseAffine):
    """``unit`` pixel: offsets are divided by the extents, in their order."""

    def __init__(self, translation, unit: str = "pixel", **options):
        super().__init__(None, None, translation, **options)
        self.unit = unit

    def assemble_matrix(self, s, op):
        m = super().assemble_matrix(s, op)
        if self.unit.lower() == "pixel":
            m = [[*row[:-1], row[-1] / n] for row, n in zip(m, s.spec(self.keys[0]).spatial)]
        return m


class Scale(BaseAffine):
    def __init__(self, scale, **options):
        super().__init__(scale, None, None, **options)


class Resize(Scale):
    """An output size; the scale is output over input, on top of the changed grid."""

    def __init__(self, size, **options):
        super().__init__(None, output_size=size, **options)

    def assemble_matrix(self, s, op):
        extents = s.spec(self.keys[0]).spatial
        self_size = per_dim(self.output_size, len(extents))
        return mx.parametrize_matrix([float(a) / float(b) for a, b in zip(self_size, extents)], None, None, len(extents), False, self.image)


class AffinePoints(KeyedTransform):
    """Multiplies points, array<array<double>>, by a [D, D + 1] matrix of numbers or columns."""

    def __init__(self, matrix, ndim: int, keys: Sequence[str] = ("points",), name=None):
        super().__init__(keys, name)
        self.matrix, self.ndim = mx.normalise_matrix(matrix, ndim), ndim

    def change(self, s, key, op):
        moved = F.transform(key, lambda p: F.array(*mx.apply_to_point(self.matrix, [p[i] for i in range(self.ndim)])))
        return s.with_column(key, moved)


def affine_image_transform(x: np.ndarray, theta: np.ndarray, output_size=None, adjust_size=False, interpolation_mode="bilinear", padding_mode="zeros", align_corners=False, reverse_order=False) -> np.ndarray:
    """The same on numpy batches."""
    d = x.ndim - 2
    t = np.asarray(theta, float)
    t = np.broadcast_to(t, (len(x), d, d + 1)) if t.ndim == 2 else t
    if reverse_order:
        t = np.array([mx.revert_coordinate_order(m.tolist()) for m in t])
    if output_size is not None:
        size = [int(n) for n in per_dim(output_size, d)]
    else:
        size = [max(1, int(n + 1e-4)) for n in kernels.moved_extents(x.shape[2:], t)] if adjust_size else x.shape[2:]
    return kernels.grid_sample(x, kernels.affine_grid(t, size, align_corners), interpolation_mode, padding_mode, align_corners)


def affine_point_transform(points: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """[N, P, D] by [N, D, D + 1]."""
    h = np.concatenate([points, np.ones((*points.shape[:2], 1))], axis=2)
    return np.einsum("nij,npj->npi", theta, h)
