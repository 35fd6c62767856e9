"""Convolutions and painting, on the Arrow kernel."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.spec import TensorSpec, per_dim
from .base import KeyedTransform, kernel
from .compose import conditionally


class KernelTransform(KeyedTransform):
    """Pads and correlates each channel with its kernel, which ``create_kernel`` makes once on the driver."""

    def __init__(self, in_channels: int, kernel_size, dim: int = 2, stride=1, padding=0, padding_mode: str = "zero", keys: Sequence[str] = ("data",), name=None):
        super().__init__(keys, name)
        if dim not in (1, 2, 3):
            raise TypeError("convolutions are of 1, 2 or 3 dimensions")
        self.channels, self.dim = in_channels, dim
        self.kernel_size, self.stride, self.padding = (per_dim(v, dim) for v in (kernel_size, stride, padding))
        self.padding_mode = padding_mode
        self.kernel = self.create_kernel()

    def create_kernel(self) -> np.ndarray:
        """[channels, 1, size...]."""
        raise NotImplementedError

    def change(self, s, key, op):
        spec = s.spec(key)
        if spec.ndim != self.dim or spec.channels != self.channels:
            raise ValueError(f"{key} has {spec.channels} channels of {spec.ndim} dimensions")
        k, stride, mode, pads = self.kernel, self.stride, self.padding_mode, [(p, p) for p in self.padding]
        extents = [(n + 2 * p - m) // t + 1 for n, p, m, t in zip(spec.spatial, self.padding, self.kernel_size, stride)]

        def run(x: np.ndarray) -> np.ndarray:
            return kernels.convolve(kernels.pad(x, pads, mode), k, stride)

        return kernel(s, key, run, TensorSpec((spec.channels, *extents)))


class GaussianSmoothing(KernelTransform):
    def __init__(self, in_channels: int, kernel_size, std, dim: int = 2, stride=1, padding=0, padding_mode: str = "reflect", keys=("data",), name=None):
        self.std = per_dim(std, dim, "standard deviation")
        super().__init__(in_channels, kernel_size, dim, stride, padding, padding_mode, keys, name)

    def create_kernel(self):
        return kernels.gaussian_kernel(self.channels, self.kernel_size, self.std)


class _Painting(KeyedTransform):
    """Works on volumes, with a numpy generator seeded by seed, epoch, operator and sample."""

    def paint(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError

    def change(self, s, key, op):
        if s.spec(key).ndim != 3:
            raise ValueError("painting works on volumes")
        paint, seed = self.paint, [s.seed, s.epoch, zlib.crc32(f"{op}:{key}".encode())]

        def run(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
            return np.stack([paint(v, np.random.default_rng([*seed, int(i) & (2**63 - 1)])) for v, i in zip(x, ids)])

        return kernel(s, key, run, s.spec(key), F.xxhash64(F.col(s.id_col)))


class LocalPixelShuffle(_Painting):
    """n < 0: 1000 blocks a channel."""

    def __init__(self, n=-1, keys=("data",), block_size=(0, 0, 0), rel_block_size=0.1, name=None):
        super().__init__(keys, name)
        n_, b, r = n, tuple(block_size), rel_block_size
        self.paint = lambda x, rng: kernels.pixel_shuffle(x, rng, n_, b, r)


class RandomInpainting(_Painting):
    def __init__(self, n=5, maxv=1.0, minv=0.0, keys=("data",), name=None):
        super().__init__(keys, name)
        self.paint = lambda x, rng: kernels.inpaint(x, rng, n, maxv, minv)


class RandomOutpainting(_Painting):
    """With a probability, drawn for each batch and shared by all keys."""

    def __init__(self, prob=0.5, maxv=1.0, minv=0.0, keys=("data",), name=None):
        super().__init__(keys, name)
        self.prob = prob
        self.paint = lambda x, rng: kernels.outpaint(x, rng, maxv, minv)

    def apply(self, s):
        if self.prob >= 1:
            return super().apply(s)
        s, op = s.op(f"{self.name}?")
        return conditionally(s, s.draws(op).column() < float(self.prob), super().apply)


class RandomInOrOutpainting(KeyedTransform):
    """Outpainting with the probability, else inpainting."""

    def __init__(self, prob=0.5, n=5, maxv=1.0, minv=0.0, keys=("data",), name=None):
        super().__init__(keys, name)
        self.prob = prob
        self.out, self.inner = RandomOutpainting(1.0, maxv, minv, self.keys), RandomInpainting(n, maxv, minv, self.keys)

    def apply(self, s):
        s, op = s.op(self.name)
        on = s.draws(op).column() < float(self.prob)
        return conditionally(conditionally(s, on, self.out), ~on, self.inner)
