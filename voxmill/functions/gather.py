"""Re-indexing operators as gather maps: out[j] = x[map[j]].

Maps compose, so a chain of mirrors, rotations, permutations, crops and nearest
resizes costs one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .spec import TensorSpec


def axis(dim: int, spec: TensorSpec) -> int:
    """The tensor axis of a spatial dimension; channels are axis 0."""
    if not -spec.ndim <= dim < spec.ndim:
        raise ValueError(f"dimension {dim} of {spec.ndim}")
    return dim % spec.ndim + 1


def mirror(spec: TensorSpec, dims: Sequence[int]) -> np.ndarray:
    return np.flip(spec.positions(), [axis(d, spec) for d in dims])


def rot90(spec: TensorSpec, k: int, dims: Sequence[int]) -> np.ndarray:
    return np.rot90(spec.positions(), k, [axis(d, spec) for d in dims])


def permute(spec: TensorSpec, order: Sequence[int]) -> np.ndarray:
    """``order`` is of all tensor axes, channels first."""
    return np.transpose(spec.positions(), order)


def crop(spec: TensorSpec, corner, size) -> np.ndarray:
    """Of the last dimensions; past the edge it ends early, like a slice."""
    at = [slice(None)] * (len(spec.fixed) - len(corner))
    ends = [a + n for a, n in zip(corner, size)]
    return spec.positions()[(*at, *map(slice, corner, ends))]


def centre_corner(extents: Sequence[int], size: Sequence[int]) -> list[int]:
    """Half of what is left over, ties to even."""
    return [int(round((n - s) / 2.0)) for n, s in zip(extents, size)]


def nearest(spec: TensorSpec, size: Sequence[int], factors: Sequence[float | None] | None = None) -> np.ndarray:
    """A map to ``size``; a factor that was asked for sets the step, else the extents do."""
    out = spec.positions()
    for d, (n, m) in enumerate(zip(spec.spatial, size)):
        step = 1 / factors[d] if factors and factors[d] else n / m
        out = out.take(np.minimum(np.floor(np.arange(m) * step).astype(int), n - 1), axis=d + 1)
    return out
