"""Chains, random application and choice, with plan rules for chains."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rng import uniform_value
from ..functions.spec import RAGGED
from ..plans.rules import optimise
from .base import Samples, Transform, UDFTransform


def as_transform(t) -> Transform:
    return t if isinstance(t, Transform) else UDFTransform(t)


def dict_call(s: Samples, transform: Callable) -> Samples:
    return transform(s)


def as_ragged(s: Samples, key: str) -> Samples:
    spec = s.spec(key)
    if spec.ragged:
        return s
    shape = F.array(*[F.lit(n) for n in spec.fixed])
    data = F.col(key).cast("array<double>")
    return s.with_column(key, F.when(F.col(key).isNotNull(), F.struct(shape.alias("shape"), data.alias("data"))), RAGGED)


def conditionally(s: Samples, when: Column, transform: Callable[[Samples], Samples]) -> Samples:
    """transform(s) where the condition holds, row by row; keys whose shape may change become ragged."""
    kept = [k for k in s.df.columns if k not in (s.id_col, s.batch_col)]
    held = {k: f"__was_{len(s.used)}_{k}" for k in kept}
    flag = f"__if_{len(s.used)}"
    old = s
    s = s.with_df(s.df.withColumns({flag: when, **{h: F.col(k) for k, h in held.items()}}))
    s = s.__class__(**{**s.__dict__, "specs": {**s.specs, **{held[k]: v for k, v in old.specs.items() if k in held}}})
    new = transform(s)
    if set(kept) - set(new.df.columns):
        raise ValueError("a transform that takes keys away can't be applied at random")
    for k in kept:
        a, b = new.specs.get(k), old.specs.get(k)
        if a != b:
            new = as_ragged(as_ragged(new, k), held[k])
        x, y = F.col(k), F.col(held[k])
        if new.df.schema[k].dataType != new.df.schema[held[k]].dataType:
            y = y.cast(new.df.schema[k].dataType)
        spec = new.specs.get(k)
        new = new.with_column(k, F.when(F.col(flag), x).otherwise(y), spec)
    return new.with_df(new.df.drop(flag, *held.values()))


class Compose(Transform):
    """Transforms in order.  With ``shuffle``, in an order drawn once per epoch from the seed.

    Chains are optimised first: no-ops go, re-indexing is fused.
    """

    def __init__(self, *transforms, shuffle: bool = False, transform_call: Callable = dict_call, name: str = "Compose", optimised: bool = True):
        if len(transforms) == 1 and isinstance(transforms[0], (list, tuple)):
            transforms = tuple(transforms[0])
        if not transforms:
            raise ValueError("at least one transform is needed")
        self.transforms = [as_transform(t) for t in transforms]
        self.shuffle, self.call, self.name, self.optimised = shuffle, transform_call, name, optimised

    def ordered(self, s: Samples) -> list[Transform]:
        out = list(self.transforms)
        if self.shuffle:
            out = [t for _, _, t in sorted((uniform_value(s.seed, s.epoch, 0, self.name, i), i, t) for i, t in enumerate(out))]
        return optimise(out) if self.optimised else out

    def apply(self, s):
        for t in self.ordered(s):
            s = self.call(s, t)
        return s


class DropoutCompose(Compose):
    """Each transform is applied in the batches whose draw is above its dropout."""

    def __init__(self, *transforms, dropout: float | Sequence[float] = 0.5, shuffle: bool = False, transform_call: Callable = dict_call, name: str = "DropoutCompose"):
        super().__init__(*transforms, shuffle=shuffle, transform_call=transform_call, name=name, optimised=False)
        n = len(self.transforms)
        if isinstance(dropout, (list, tuple)) and len(dropout) != n:
            raise TypeError("as many dropouts as transforms are needed")
        self.dropout = list(dropout) if isinstance(dropout, (list, tuple)) else [dropout] * n

    def apply(self, s):
        s, op = s.op(self.name)
        at = {id(t): i for i, t in enumerate(self.transforms)}
        for t in self.ordered(s):
            i = at[id(t)]
            s = conditionally(s, s.draws(op).column(i) > float(self.dropout[i]), lambda x, t=t: self.call(x, t))
        return s


class OneOf(Transform):
    """With probability ``p`` exactly one of the transforms, by weight, in each batch."""

    def __init__(self, *transforms, weights: Sequence[float] | None = None, p: float = 1.0, transform_call: Callable = dict_call, name: str = "OneOf"):
        if len(transforms) == 1 and isinstance(transforms[0], (list, tuple)):
            transforms = tuple(transforms[0])
        self.transforms = [as_transform(t) for t in transforms]
        self.weights = [1.0] * len(self.transforms) if weights is None else list(weights)
        if len(self.weights) != len(self.transforms):
            raise ValueError("as many weights as transforms are needed")
        self.p, self.call, self.name = p, transform_call, name

    def apply(self, s):
        s, op = s.op(self.name)
        total = sum(self.weights)
        ends = [c / total for c in itertools.accumulate(self.weights)]
        u, draws = s.draws(op).column(1), s.draws(op)
        on, low = draws.column(0) < float(self.p), 0.0
        for i, (t, high) in enumerate(zip(self.transforms, ends)):
            inside = (u >= low) if i == len(ends) - 1 else (u >= low) & (u < high)
            s = conditionally(s, on & inside, lambda x, t=t: self.call(x, t))
            low = high
        return s


class DoNothing(Transform):
    name = "DoNothing"

    def apply(self, s):
        return s
