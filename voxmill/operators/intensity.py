"""Intensity transforms as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.rng import TWO32, AbstractParameter, normal_of, uniform
from .base import BaseTransform, KeyedTransform, bound, elementwise, kernel, per_channel, sampled, values, with_values


def clamp(x: Column, min: Column | float, max: Column | float) -> Column:
    lo, hi = _num(min), _num(max)
    return F.transform(x, lambda e: F.least(F.greatest(e, lo), hi))


def _num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _extremes(x: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """use(element, least, greatest) on each element; extremes are found once."""
    facts = F.struct(x.alias("v"), F.array_min(x).alias("a"), F.array_max(x).alias("b"))
    return bound(facts, lambda t: F.transform(t["v"], lambda e: use(e, t["a"], t["b"])))


def norm_min_max(x: Column, eps: float | None = 1e-8) -> Column:
    """(x - min) / (max - min + eps)."""
    return _extremes(x, lambda e, a, b: (e - a) / (b - a + float(eps or 0.0)))


def norm_range(x: Column, min: Column | float, max: Column | float) -> Column:
    lo, hi = _num(min), _num(max)
    return _extremes(x, lambda e, a, b: (e - a) / (b - a + 1e-8) * (hi - lo) + lo)


def norm_zero_mean_unit_std(x: Column, eps: float | None = 1e-8) -> Column:
    """(x - mean) / (std + eps), std unbiased; one value gives NaN."""
    total = F.aggregate(x, F.lit(0.0), lambda a, e: a + e)
    facts = F.struct(x.alias("v"), (total / F.size(x)).alias("m"))

    def spread(t: Column) -> Column:
        squares = F.aggregate(t["v"], F.lit(0.0), lambda a, e: a + (e - t["m"]) * (e - t["m"]))
        n = F.size(t["v"])
        return F.struct(t["v"].alias("v"), t["m"].alias("m"), F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(float("nan")).alias("s"))

    return bound(facts, lambda t: bound(spread(t), lambda w: F.transform(w["v"], lambda e: (e - w["m"]) / (w["s"] + float(eps or 0.0)))))


def norm_mean_std(x: Column, mean: float, std: float) -> Column:
    return F.transform(x, lambda e: (e - float(mean)) / float(std))


def gamma_correction(x: Column, gamma) -> Column:
    return F.transform(x, lambda e: F.pow(e, _num(gamma)))


def add_value(x: Column, value) -> Column:
    return F.transform(x, lambda e: e + _num(value))


def scale_by_value(x: Column, value) -> Column:
    return F.transform(x, lambda e: e * _num(value))


class Clamp(BaseTransform):
    def __init__(self, min, max, keys: Sequence[str] = ("data",), name=None):
        super().__init__(clamp, keys, name, min=min, max=max)


class _Norm(KeyedTransform):
    """One statistic a channel, or a sample without ``per_channel``; samples keep to their row, so nothing is shuffled."""

    def __init__(self, per_channel: bool = True, keys: Sequence[str] = ("data",), name=None):
        super().__init__(keys, name)
        self.per_channel = per_channel

    def norm(self, x: Column, s, op: str) -> Column:
        raise NotImplementedError

    def change(self, s, key, op):
        if self.per_channel and not s.spec(key).ragged:
            return per_channel(s, key, lambda x, c: self.norm(x, s, op))
        x = values(s, key).cast("array<double>")
        if not self.per_channel:
            return with_values(s, key, self.norm(x, s, op))
        channels = F.col(f"{key}.shape")[0]  # samples of several shapes: as many as each has
        n = (F.size(x) / channels).cast("int")
        parts = F.transform(F.sequence(F.lit(0), channels - 1), lambda c: self.norm(F.slice(x, c * n + 1, n), s, op))
        return with_values(s, key, F.when(F.size(x) > 0, F.flatten(parts)).otherwise(x))


class NormRange(_Norm):
    def __init__(self, min, max, keys=("data",), per_channel: bool = True, name=None):
        super().__init__(per_channel, keys, name)
        self.min, self.max = min, max

    def norm(self, x, s, op):
        return norm_range(x, sampled(self.min, s.draws(op)), sampled(self.max, s.draws(op), getattr(self.min, "width", 0)))


class NormMinMax(_Norm):
    def __init__(self, keys=("data",), per_channel: bool = True, eps: float | None = 1e-8, name=None):
        super().__init__(per_channel, keys, name)
        self.eps = eps

    def norm(self, x, s, op):
        return norm_min_max(x, self.eps)


class NormZeroMeanUnitStd(_Norm):
    def __init__(self, keys=("data",), per_channel: bool = True, eps: float | None = 1e-8, name=None):
        super().__init__(per_channel, keys, name)
        self.eps = eps

    def norm(self, x, s, op):
        return norm_zero_mean_unit_std(x, self.eps)


class NormMeanStd(KeyedTransform):
    """Given mean and std, one for all channels or one each."""

    def __init__(self, mean, std, keys=("data",), per_channel: bool = True, name=None):
        super().__init__(keys, name)
        self.mean, self.std, self.per_channel = mean, std, per_channel

    def change(self, s, key, op):
        n = s.spec(key).channels if self.per_channel else 1
        m, d = (v if isinstance(v, (list, tuple)) else [v] * n for v in (self.mean, self.std))
        if self.per_channel:
            return per_channel(s, key, lambda x, c: norm_mean_std(x, m[c], d[c]))
        return with_values(s, key, norm_mean_std(F.col(key).cast("array<double>"), m[0], d[0]))


def _exponential(u, lambd=1.0):
    return -F.log(1.0 - u(0)) / float(lambd)


#: Element samplers: (u(draw) -> column, parameters).
NOISE: dict[str, Callable[..., Column]] = {
    "normal": lambda u, mean=0.0, std=1.0: normal_of(u(0), u(1)) * float(std) + float(mean),
    "uniform": lambda u, low=0.0, high=1.0: u(0) * float(high - low) + float(low),
    "exponential": _exponential,
    "log_normal": lambda u, mean=1.0, std=2.0: F.exp(normal_of(u(0), u(1)) * float(std) + float(mean)),
    "cauchy": lambda u, median=0.0, sigma=1.0: F.tan((u(0) - 0.5) * math.pi) * float(sigma) + float(median),
    "geometric": lambda u, p=0.5: F.floor(F.log(F.greatest(1.0 - u(0), F.lit(1 / TWO32))) / math.log(1 - p)).cast("double") + 1.0,
    "bernoulli": lambda u, p=0.5: (u(0) < float(p)).cast("double"),
    "random": lambda u, low=0, high=2: F.floor(u(0) * float(high - low)).cast("double") + float(low),
}


class Noise(KeyedTransform):
    """Adds a draw of its own to every element of every key; a final ``_`` in the type is let go."""

    def __init__(self, noise_type, per_channel=False, keys=("data",), name=None, **params):
        super().__init__(keys, name)
        kind = noise_type.removesuffix("_")
        if kind not in NOISE:
            raise ValueError(f"unknown noise {noise_type}")
        self.sampler, self.params, self.per_channel = NOISE[kind], params, per_channel

    def change(self, s, key, op):
        def noisy(e: Column, i: Column) -> Column:
            scope = F.concat_ws(":", F.col(s.id_col).cast("string"), i.cast("string"))
            return e + self.sampler(lambda d: uniform(s.seed, s.epoch, scope, f"{op}:{key}", d), **self.params)

        return elementwise(s, key, noisy)


class ExponentialNoise(Noise):
    def __init__(self, lambd: float, keys=("data",), name=None):
        super().__init__("exponential", keys=keys, name=name, lambd=lambd)


class GaussianNoise(Noise):
    def __init__(self, mean: float, std: float, keys=("data",), name=None):
        super().__init__("normal", keys=keys, name=name, mean=mean, std=std)


class GammaCorrection(BaseTransform):
    def __init__(self, gamma, keys=("data",), name=None):
        super().__init__(gamma_correction, keys, name, gamma=gamma)


class RandomValuePerChannel(KeyedTransform):
    """augment(x, value=draw) with a draw for each batch, or for each batch and channel."""

    def __init__(self, augment: Callable, random_sampler: AbstractParameter | float, per_channel: bool = False, keys=("data",), name=None):
        super().__init__(keys, name)
        self.augment, self.sampler, self.per_channel = augment, random_sampler, per_channel

    def change(self, s, key, op):
        draws, width = s.draws(op), getattr(self.sampler, "width", 0)
        if self.per_channel:
            return per_channel(s, key, lambda x, c: self.augment(x, value=sampled(self.sampler, draws, c * width)))
        return with_values(s, key, self.augment(values(s, key).cast("array<double>"), value=sampled(self.sampler, draws)))


class RandomAddValue(RandomValuePerChannel):
    def __init__(self, random_sampler, per_channel: bool = False, keys=("data",), name=None):
        super().__init__(add_value, random_sampler, per_channel, keys, name)


class RandomScaleValue(RandomValuePerChannel):
    def __init__(self, random_sampler, per_channel: bool = False, keys=("data",), name=None):
        super().__init__(scale_by_value, random_sampler, per_channel, keys, name)


class RandomBezierTransform(KeyedTransform):
    """Maps values through a cubic curve whose control points are drawn for each key and batch, or given."""

    def __init__(self, maxv=1.0, minv=0.0, keys=("data",), points: Sequence[float] | None = None, name=None):
        super().__init__(keys, name)
        self.high, self.low, self.points = maxv, minv, points

    def change(self, s, key, op):
        low, high = self.low, self.high
        draws = s.draws(f"{op}:{key}")
        points = [F.lit(float(p)) for p in self.points] if self.points else [draws.column(i) for i in range(4)]

        def run(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            out = np.empty_like(x, dtype=float)
            for q in np.unique(p, axis=0):
                rows = (p == q).all(axis=1)
                out[rows] = kernels.interp1d(*kernels.bezier_curve(q[:2], q[2:], low, high), x[rows])
            return out

        return kernel(s, key, run, s.spec(key), F.array(*points))


class InvertAmplitude(KeyedTransform):
    """max + min - x with a probability, drawn for each key and batch."""

    def __init__(self, prob=0.5, maxv=1.0, minv=0.0, keys=("data",), name=None):
        super().__init__(keys, name)
        self.prob, self.total = prob, float(maxv) + float(minv)

    def change(self, s, key, op):
        on = s.draws(f"{op}:{key}").column() < float(self.prob)
        return elementwise(s, key, lambda e: F.when(on, self.total - e).otherwise(e))
