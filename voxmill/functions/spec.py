"""Shapes that are known when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np


@dataclass(frozen=True)
class TensorSpec:
    """Channels first, then the spatial extents; values lie flat, row-major.

    ``shape`` None: each row has its own, as struct<shape array<int>, data array<double>>.
    """

    shape: tuple[int, ...] | None

    @property
    def ragged(self) -> bool:
        return self.shape is None

    @property
    def size(self) -> int:
        return prod(self.fixed)

    @property
    def fixed(self) -> tuple[int, ...]:
        if self.shape is None:
            raise ValueError("this operator needs one shape for all samples; the samples are ragged")
        return self.shape

    @property
    def channels(self) -> int:
        return self.fixed[0]

    @property
    def spatial(self) -> tuple[int, ...]:
        return self.fixed[1:]

    @property
    def ndim(self) -> int:
        """Number of spatial dimensions."""
        return len(self.fixed) - 1

    def positions(self) -> np.ndarray:
        """Flat positions, in the tensor's shape."""
        return np.arange(self.size).reshape(self.fixed)


RAGGED = TensorSpec(None)


def per_dim(value, ndim: int, what: str = "size") -> tuple:
    """A scalar for every dimension, or one value each."""
    if isinstance(value, (list, tuple, np.ndarray)):
        if len(value) != ndim:
            raise ValueError(f"{what}: {len(value)} values for {ndim} dimensions")
        return tuple(value)
    return (value,) * ndim
