"""Counter-based randomness: a draw is a function of seed, epoch, scope, operator and number.

Nothing depends on partitioning or order, a retried task draws the same, and
SQL engines with md5 can reproduce every draw.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def uniform(seed: int, epoch: int, scope, op: str, draw=0) -> Column:
    """[0, 1) as a column; ``scope`` and ``draw`` may be columns."""
    parts = [p if isinstance(p, Column) else F.lit(str(p)) for p in (seed, epoch, scope, op, draw)]
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(TWO32)


def uniform_value(seed: int, epoch: int, scope, op: str, draw=0) -> float:
    """The same draw on the driver."""
    text = ":".join(str(p) for p in (seed, epoch, scope, op, draw))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / TWO32


def normal_of(u1: Column, u2: Column) -> Column:
    """Standard normal by Box and Muller; u1 = 0 counts as the least positive draw."""
    return F.sqrt(-2.0 * F.log(F.greatest(u1, F.lit(1 / TWO32)))) * F.cos(2.0 * math.pi * u2)


def normal_value(u1: float, u2: float) -> float:
    return math.sqrt(-2.0 * math.log(max(u1, 1 / TWO32))) * math.cos(2.0 * math.pi * u2)


class Draws:
    """Where draws come from: uniform(draw) gives a column or, on the driver, a number."""

    def __init__(self, seed: int, epoch: int, scope, op: str):
        self.seed, self.epoch, self.scope, self.op = seed, epoch, scope, op

    def column(self, draw=0) -> Column:
        return uniform(self.seed, self.epoch, self.scope, self.op, draw)

    def value(self, draw=0) -> float:
        return uniform_value(self.seed, self.epoch, self.scope, self.op, draw)


class AbstractParameter(ABC):
    """A distribution or population; draws number ``first`` and on are used."""

    width = 1  # uniform draws that a sample takes

    @abstractmethod
    def column(self, draws: Draws, first: int = 0) -> Column | None:
        """One sample as a column; None for a sample that is None."""

    @abstractmethod
    def one(self, u: Callable[[int], float], first: int = 0):
        """One sample on the driver, of uniforms u(number)."""

    def sample(self, n: int, u: Callable[[int], float], first: int = 0) -> list:
        return [self.one(u, first + i * self.width) for i in range(n)]

    @staticmethod
    def count(size) -> int:
        """Samples that a tensor of this size takes; one for no size."""
        if size is None:
            return 1
        return math.prod(size) if isinstance(size, (list, tuple)) else int(size)

    def draw(self, size=None, u: Callable[[int], float] | None = None):
        """Samples in the shape ``size``; one scalar for none; None if any sample is None."""
        flat = self.sample(self.count(size), u or Draws(0, 0, 0, type(self).__name__).value)
        if any(x is None for x in flat):
            return None
        return flat[0] if size is None else reshape_list(flat, size)


def reshape_list(flat: Sequence, size) -> list:
    """A nested list of the shape ``size``; the flat list stays as it is."""
    size = list(size) if isinstance(size, (list, tuple)) else [size]
    if len(flat) != math.prod(size):
        raise ValueError(f"{len(flat)} values don't fill {size}")
    out = list(flat)
    for n in reversed(size[1:]):
        out = [out[i : i + n] for i in range(0, len(out), n)]
    return out


class ConstantParameter(AbstractParameter):
    width = 0

    def __init__(self, value):
        self.value = value

    def column(self, draws, first=0):
        return None if self.value is None else F.lit(self.value)

    def one(self, u, first=0):
        return self.value


class ContinuousParameter(AbstractParameter):
    """Any distribution, by its inverse distribution function on columns and on numbers."""

    def __init__(self, inverse_column: Callable[[Column], Column], inverse: Callable[[float], float]):
        self.inverse_column, self.inverse = inverse_column, inverse

    def column(self, draws, first=0):
        return self.inverse_column(draws.column(first))

    def one(self, u, first=0):
        return self.inverse(u(first))


class UniformParameter(ContinuousParameter):
    """[low, high)."""

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high
        super().__init__(lambda u: F.lit(float(low)) + u * float(high - low), lambda u: low + u * (high - low))


class NormalParameter(AbstractParameter):
    width = 2

    def __init__(self, mu: float, sigma: float):
        self.mu, self.sigma = mu, sigma

    def column(self, draws, first=0):
        return normal_of(draws.column(first), draws.column(first + 1)) * float(self.sigma) + float(self.mu)

    def one(self, u, first=0):
        return normal_value(u(first), u(first + 1)) * self.sigma + self.mu


class DiscreteParameter(AbstractParameter):
    """A population, drawn with or without replacement; weights only with it.

    Members may be numbers or None; a None among those that may be drawn makes
    a column sample null.
    """

    def __init__(self, population, replacement=False, weights=None, cum_weights=None):
        if not len(population):
            raise ValueError("an empty population")
        if (weights is not None or cum_weights is not None) and not replacement:
            raise ValueError("weights need replacement")
        if weights is not None and cum_weights is not None:
            raise TypeError("weights and cumulative weights exclude each other")
        if weights is not None:
            cum_weights = list(itertools.accumulate(weights))
        if cum_weights is not None and len(cum_weights) != len(population):
            raise ValueError("as many weights as members are needed")
        self.population, self.replacement, self.cum = list(population), replacement, cum_weights

    def index(self, u: float) -> int:
        n = len(self.population)
        if self.cum is None:
            return min(int(u * n), n - 1)
        return next((i for i, c in enumerate(self.cum) if u * self.cum[-1] < c), n - 1)

    def index_column(self, u: Column) -> Column:
        n = len(self.population)
        if self.cum is None:
            return F.least(F.floor(u * n), F.lit(n - 1)).cast("int")
        out = F.when(u * float(self.cum[-1]) < float(self.cum[0]), 0)
        for i, c in enumerate(self.cum[1:], 1):
            out = out.when(u * float(self.cum[-1]) < float(c), i)
        return out.otherwise(n - 1).cast("int")

    def column(self, draws, first=0):
        return F.get(F.array(*[F.lit(x) for x in self.population]), self.index_column(draws.column(first)))

    def one(self, u, first=0):
        return self.population[self.index(u(first))]

    def sample(self, n, u, first=0):
        if self.replacement:
            return super().sample(n, u, first)
        if n > len(self.population):
            raise ValueError("more samples than members, without replacement")
        if n == 1:
            return [self.one(u, first)]
        keys = sorted(range(len(self.population)), key=lambda i: (u(first + i), i))
        return [self.population[i] for i in keys[:n]]


def combinations_all(data: Sequence) -> list[tuple]:
    """All combinations that aren't empty, by size."""
    return [c for k in range(1, len(data) + 1) for c in itertools.combinations(data, k)]


class DiscreteCombinationsParameter(DiscreteParameter):
    def __init__(self, population, replacement=False):
        super().__init__(combinations_all(population), replacement)


def as_parameter(value) -> AbstractParameter:
    return value if isinstance(value, AbstractParameter) else ConstantParameter(value)


def check_scalar(x) -> bool:
    """Whether x is one number; booleans are, arrays of one element too."""
    if isinstance(x, (int, float)):
        return True
    return getattr(x, "size", None) == 1 and hasattr(x, "dtype")
