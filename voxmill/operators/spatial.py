"""Mirroring, rotation, resizing and cropping."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import gather as maps
from ..functions import kernels
from ..functions.rng import AbstractParameter, UniformParameter
from ..functions.spec import RAGGED, TensorSpec, per_dim
from .base import MAP_LITERALS, KeyedTransform, Samples, bound, constant, elementwise, gather, integers, kernel, over_batch, sampled
from .compose import conditionally


def _pairs(dims: Sequence[int]) -> list[tuple[int, ...]]:
    """More than two dimensions: all pairs, of which one is drawn."""
    return list(itertools.combinations(dims, 2)) if len(dims) > 2 else [tuple(dims)]


def _taken(index: Column, v: Column) -> Column:
    return F.transform(index, lambda i: F.get(v, i))


class _RandomGather(KeyedTransform):
    """One of several gather maps, drawn for each batch, or none with probability 1 - prob."""

    prob: float

    def options(self) -> list[Callable[[TensorSpec], np.ndarray]]:
        raise NotImplementedError

    def deterministic(self) -> bool:
        return self.prob >= 1 and len(self.options()) == 1

    def index_map(self, spec: TensorSpec) -> np.ndarray:
        return self.options()[0](spec)

    def apply(self, s: Samples) -> Samples:
        s.need(self.keys)
        s, op = s.op(self.name)
        options = self.options()

        def one(fn):
            def run(x: Samples) -> Samples:
                for key in self.keys:
                    x = gather(x, key, fn(x.spec(key)))
                return x

            return run

        if self.deterministic():
            return one(options[0])(s)
        on, u, n = s.draws(op).column(0) < float(self.prob), s.draws(op).column(1), len(options)
        drawn = {key: [fn(s.spec(key)) for fn in options] for key in self.keys if not s.spec(key).ragged}
        if all(key in drawn and all(m.shape == s.spec(key).fixed and m.size * n <= MAP_LITERALS for m in drawn[key]) for key in self.keys):
            for key, tables in drawn.items():  # shapes stay: one look-up in the drawn map, and none where it isn't on
                x, which = F.col(key), F.lit(0) if n == 1 else F.least(F.floor(u * n), F.lit(n - 1)).cast("int")
                flat = F.array(*[integers(m) for m in tables])
                turned = bound(x, partial(_taken, F.get(flat, which)))
                s = s.with_column(key, F.when(on & x.isNotNull(), turned).otherwise(x), s.spec(key))
            return s
        for i, fn in enumerate(options):
            chosen = on if n == 1 else on & (F.least(F.floor(u * n), F.lit(n - 1)) == i)
            s = conditionally(s, chosen, one(fn))
        return s


class Mirror(_RandomGather):
    """Flips dimensions; of more than two, a pair is drawn for each batch, the same for all keys."""

    def __init__(self, dims: int | Sequence[int], keys=("data",), prob=0.5, name=None):
        super().__init__(keys, name)
        self.dims, self.prob = (dims,) if isinstance(dims, int) else tuple(dims), prob

    def options(self):
        return [lambda spec, d=d: maps.mirror(spec, d) for d in _pairs(self.dims)]


class Rot90(_RandomGather):
    """Rotates from the first dimension towards the second, a drawn number of times 90 degrees."""

    def __init__(self, dims: Sequence[int], keys=("data",), num_rots=(0, 1, 2, 3), prob=0.5, name=None):
        super().__init__(keys, name)
        if len(dims) < 2:
            raise ValueError("two dimensions or more are needed")
        self.dims, self.rots, self.prob = tuple(dims), tuple(num_rots), prob

    def options(self):
        return [lambda spec, k=k, d=d: maps.rot90(spec, k, d) for k in self.rots for d in _pairs(self.dims)]


class ResizeNative(KeyedTransform):
    """Resizes to ``size``, or by ``scale_factor``; ``preserve_range`` clamps to the range of the whole batch."""

    def __init__(self, size=None, mode="nearest", align_corners=None, preserve_range=False, keys=("data",), scale_factor=None, name=None):
        super().__init__(keys, name)
        if (size is None) == (scale_factor is None):
            raise ValueError("either a size or a scale factor is needed")
        self.size, self.mode, self.align, self.preserve, self.factor = size, mode, align_corners, preserve_range, scale_factor

    def deterministic(self) -> bool:
        fixed = [constant(v) is not None for v in (self.size, self.factor) if v is not None]
        return self.mode == "nearest" and self.align is None and not self.preserve and all(fixed) and not self._tuple_drawn()

    def _tuple_drawn(self) -> bool:
        v = self.size if self.size is not None else self.factor
        return isinstance(v, (list, tuple)) and any(isinstance(x, AbstractParameter) for x in v)

    def target(self, extents: Sequence[int]) -> tuple[tuple[int, ...], tuple[float, ...] | None]:
        if self.size is not None:
            return tuple(int(x) for x in per_dim(self.size, len(extents))), None
        f = per_dim(self.factor, len(extents), "scale factor")
        return tuple(int(np.floor(n * x)) for n, x in zip(extents, f)), tuple(float(x) for x in f)

    def index_map(self, spec: TensorSpec) -> np.ndarray:
        return maps.nearest(spec, *self.target(spec.spatial))

    def change(self, s, key, op):
        spec = s.spec(key)
        drawn = self._tuple_drawn() or isinstance(self.size if self.size is not None else self.factor, AbstractParameter)
        low_high = None
        if self.preserve:
            x = F.col(f"{key}.data") if spec.ragged else F.col(key)
            s = over_batch(s, __low=F.min(F.array_min(x)), __high=F.max(F.array_max(x)))
            low_high = (F.col("__low").cast("double"), F.col("__high").cast("double"))
        if not drawn and self.deterministic() and not spec.ragged:
            out = gather(s, key, self.index_map(spec))
        else:
            out = self._by_kernel(s, key, op, drawn)
        if low_high:
            out = elementwise(out, key, lambda e: F.least(F.greatest(e, low_high[0]), low_high[1]))
            out = out.with_df(out.df.drop("__low", "__high"))
        return out

    def _by_kernel(self, s: Samples, key: str, op: str, drawn: bool) -> Samples:
        spec, mode, align = s.spec(key), self.mode, self.align
        if not drawn:
            target = self.target
            out = RAGGED if spec.ragged else TensorSpec((spec.channels, *target(spec.spatial)[0]))

            def run(x: np.ndarray) -> np.ndarray:
                size, f = target(x.shape[2:])
                return kernels.interpolate(x, size, mode, align, f)

            return kernel(s, key, run, out)
        value, by_size = (self.size, True) if self.size is not None else (self.factor, False)
        each, draws, first = list(value) if isinstance(value, (list, tuple)) else [value], s.draws(op), 0
        columns = []
        for v in each:
            columns.append(sampled(v, draws, first).cast("double"))
            first += getattr(v, "width", 0)

        def run_drawn(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            v = np.broadcast_to(p[0], (x.ndim - 2,))
            size = [int(k) for k in v] if by_size else [int(np.floor(n * k)) for n, k in zip(x.shape[2:], v)]
            return kernels.interpolate(x, size, mode, align, None if by_size else [float(k) for k in v])

        return kernel(s, key, run_drawn, RAGGED, F.array(*columns))


class Zoom(ResizeNative):
    """Resizes by a factor: one number, one for each dimension, or drawn."""

    def __init__(self, scale_factor=(0.75, 1.25), mode="nearest", align_corners=None, preserve_range=False, keys=("data",), name=None):
        super().__init__(None, mode, align_corners, preserve_range, keys, scale_factor, name)


class SizeStepScheduler:
    """The size of a step: the first size until the first milestone is reached, and so on."""

    def __init__(self, milestones, sizes):
        if len(sizes) != len(milestones) + 1:
            raise TypeError("one more size than milestones is needed")
        order = sorted(range(len(milestones)), key=lambda i: milestones[i])
        self.milestones = [milestones[i] for i in order]
        self.sizes = [sizes[0], *[sizes[i + 1] for i in order]]

    def __call__(self, step: int):
        return self.sizes[sum(step >= m for m in self.milestones)]

    def column(self, step):
        """The same on a column of steps."""
        out = F.lit(self.sizes[0])
        for m, size in zip(self.milestones, self.sizes[1:]):
            out = F.when(step >= m, F.lit(size)).otherwise(out)
        return out


class ProgressiveResize(KeyedTransform):
    """Resizes to scheduler(step); the step of a batch is its number plus ``start``, whatever worker loads it."""

    def __init__(self, scheduler: Callable, mode="nearest", align_corners=None, preserve_range=False, keys=("data",), start: int = 0, name=None):
        super().__init__(keys, name)
        self.scheduler, self.mode, self.align, self.preserve, self.start = scheduler, mode, align_corners, preserve_range, start

    def reset_step(self) -> ProgressiveResize:
        self.start = 0
        return self

    def increment(self, by: int = 1) -> ProgressiveResize:
        self.start += by
        return self

    @property
    def step(self) -> int:
        return self.start

    def change(self, s, key, op):
        scheduler, mode, align = self.scheduler, self.mode, self.align
        step = (F.col(s.batch_col) if s.batch_col else F.lit(0)).cast("long") + self.start

        def run(x: np.ndarray, step: np.ndarray) -> np.ndarray:
            return kernels.interpolate(x, [int(n) for n in per_dim(scheduler(int(step[0])), x.ndim - 2)], mode, align)

        if not self.preserve:
            return kernel(s, key, run, RAGGED, step)
        x = F.col(f"{key}.data") if s.spec(key).ragged else F.col(key)
        s = over_batch(s, __low=F.min(F.array_min(x)).cast("double"), __high=F.max(F.array_max(x)).cast("double"))
        out = elementwise(kernel(s, key, run, RAGGED, step), key, lambda e: F.least(F.greatest(e, F.col("__low")), F.col("__high")))
        return out.with_df(out.df.drop("__low", "__high"))


class Crop(KeyedTransform):
    """From a corner; past the edge it ends early."""

    def __init__(self, corner: Sequence[int], size: int | Sequence[int], keys=("data",), name=None):
        super().__init__(keys, name)
        self.corner, self.size = tuple(corner), size

    def deterministic(self) -> bool:
        return True

    def index_map(self, spec: TensorSpec) -> np.ndarray:
        return maps.crop(spec, self.corner, per_dim(self.size, len(self.corner)))

    def change(self, s, key, op):
        return gather(s, key, self.index_map(s.spec(key)))


class CenterCrop(KeyedTransform):
    """The middle; of a size, or of a drawn one."""

    def __init__(self, size, keys=("data",), name=None):
        super().__init__(keys, name)
        self.size = size

    def deterministic(self) -> bool:
        return not isinstance(self.size, AbstractParameter)

    def index_map(self, spec: TensorSpec) -> np.ndarray:
        size = per_dim(self.size, spec.ndim)
        return maps.crop(spec, maps.centre_corner(spec.spatial, size), size)

    def change(self, s, key, op):
        if self.deterministic():
            return gather(s, key, self.index_map(s.spec(key)))

        def run(x: np.ndarray, size: np.ndarray) -> np.ndarray:
            spec = TensorSpec(x.shape[1:])
            n = (int(size[0]),) * spec.ndim
            return x.reshape(1, -1)[:, maps.crop(spec, maps.centre_corner(spec.spatial, n), n)]

        return kernel(s, key, run, RAGGED, sampled(self.size, s.draws(op)).cast("double"))


class RandomCrop(KeyedTransform):
    """A crop whose corner is drawn for each batch, the same for all keys, ``dist`` off the far edge."""

    def __init__(self, size: int | Sequence[int], dist: int | Sequence[int] = 0, keys=("data",), name=None):
        super().__init__(keys, name)
        self.size, self.dist = size, dist

    def change(self, s, key, op):
        spec = s.spec(key)
        size, dist = per_dim(self.size, spec.ndim), per_dim(self.dist, spec.ndim, "distance")
        if any(c + d >= n for c, d, n in zip(size, dist, spec.spatial)):
            raise TypeError(f"crop {size} and distance {dist} don't fit into {spec.spatial}")
        at = F.lit(0)  # the flat position of the corner
        for d, (n, c, o) in enumerate(zip(spec.spatial, size, dist)):
            stride = int(np.prod(spec.spatial[d + 1 :], dtype=int))
            at = at + F.floor(s.draws(op).column(d) * (n - c - o)).cast("int") * stride
        base = maps.crop(spec, (0,) * spec.ndim, size)
        flat, x = integers(base), F.col(key)
        out = F.when(x.isNotNull(), bound(x, lambda v: F.transform(flat, lambda i: F.get(v, i + at))))
        return s.with_column(key, out, TensorSpec(base.shape))


__all__ = ["CenterCrop", "Crop", "Mirror", "ProgressiveResize", "RandomCrop", "ResizeNative", "Rot90", "SizeStepScheduler", "UniformParameter", "Zoom"]
