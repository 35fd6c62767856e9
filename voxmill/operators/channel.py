"""Labels, types, boxes and keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gather as maps
from ..functions.spec import RAGGED, TensorSpec
from .base import KeyedTransform, Samples, Transform, bound, gather, integers, kernel, lists_of, mapped, to_list_array, values, with_values

_INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


class OneHot(KeyedTransform):
    """[1, ...] of labels to [K, ...]; labels beyond K give all zeros.

    Without ``num_classes`` K is the largest label of all samples plus 1, found
    by one small job.  Values must be integers.
    """

    def __init__(self, num_classes: int | None = None, keys: Sequence[str] = ("seg",), dtype: str | None = None, name=None):
        super().__init__(keys, name)
        self.num_classes, self.dtype = num_classes, dtype

    def change(self, s, key, op):
        kind = s.df.schema[key].dataType
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, _INTEGERS):
            raise TypeError("one-hot encoding needs integers")
        spec = s.spec(key)
        if spec.channels != 1:
            raise ValueError("one-hot encoding needs one channel")
        k = self.num_classes
        if k is None:
            k = (s.df.agg(F.max(F.array_max(key))).first()[0] or 0) + 1
        to = self.dtype or kind.elementType.simpleString()
        classes = F.sequence(F.lit(0), F.lit(k - 1))
        hot = F.flatten(bound(F.col(key), lambda x: F.transform(classes, lambda c: F.transform(x, lambda e: (e == c).cast(to)))))
        return s.with_column(key, hot, TensorSpec((k, *spec.spatial)))


def one_hot(label: Column, num_classes: int) -> Column:
    """A scalar label as an array of K integers."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda c: (label == c).cast("long"))


def np_one_hot(x: np.ndarray, num_classes: int | None = None) -> np.ndarray:
    """The class axis last; labels out of range give zeros."""
    k = int(x.max()) + 1 if num_classes is None else num_classes
    return (np.asarray(x)[..., None] == np.arange(k)).astype(x.dtype)


class ArgMax(KeyedTransform):
    """Position of the largest value along a tensor axis, channels being 0; ties to the first."""

    def __init__(self, dim: int = 0, keepdim: bool = True, keys: Sequence[str] = ("seg",), name=None):
        super().__init__(keys, name)
        self.dim, self.keepdim = dim, keepdim

    def change(self, s, key, op):
        spec = s.spec(key)
        index = np.moveaxis(spec.positions(), self.dim, -1)
        shape = index.shape[:-1]
        out = TensorSpec(shape if not self.keepdim else tuple(1 if i == self.dim % len(spec.fixed) else n for i, n in enumerate(spec.fixed)))
        n, step = index.shape[-1], int(index.reshape(-1, index.shape[-1])[0, 1] - index.reshape(-1, index.shape[-1])[0, 0]) if index.shape[-1] > 1 else 1
        starts = integers(index[..., 0])
        x = F.col(key)

        def all_best(y: Column) -> Column:
            def best(start: Column) -> Column:
                line = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(y, start + j * step))
                return (bound(line, lambda v: F.array_position(v, F.array_max(v))) - 1).cast("long")

            return F.transform(starts, best)

        return s.with_column(key, F.when(x.isNotNull(), bound(x, all_best)), out)


class ToDtype(KeyedTransform):
    """Casts elements; fractions are cut off towards zero."""

    def __init__(self, dtype: str, keys: Sequence[str] = ("data",), name=None):
        super().__init__(keys, name)
        self.dtype = dtype

    def change(self, s, key, op):
        if isinstance(s.df.schema[key].dataType, T.ArrayType):
            return s.with_column(key, F.col(key).cast(f"array<{self.dtype}>"), s.specs.get(key))
        if key in s.specs and s.specs[key].ragged:
            return s.with_column(key, F.col(key).cast(f"struct<shape:array<int>,data:array<{self.dtype}>>"), RAGGED)
        if isinstance(s.df.schema[key].dataType, T.StringType):
            return s
        return s.with_column(key, F.col(key).cast(self.dtype))


class ToTensor(ToDtype):
    """Gives arrays an element type and a shape."""

    def __init__(self, keys: Sequence[str] = ("data",), shape: Sequence[int] | None = None, dtype: str = "double", name=None):
        super().__init__(dtype, keys, name)
        self.shape = tuple(shape) if shape else None

    def change(self, s, key, op):
        s = super().change(s, key, op)
        return s.with_column(key, F.col(key), TensorSpec(self.shape)) if self.shape else s


class ToDevice(Transform):
    """Data has no device here; kept so that chains read the same."""

    def __init__(self, device: str = "cpu", keys: Sequence[str] = ("data",), **ignored):
        self.device, self.keys, self.name = device, tuple(keys), "ToDevice"

    def apply(self, s):
        s.need(self.keys)
        return s


class ToDeviceDtype(ToDtype):
    def __init__(self, device: str = "cpu", dtype: str = "double", keys: Sequence[str] = ("data",), name=None, **ignored):
        super().__init__(dtype, keys, name)
        self.device = device


_E = F.transform
#: Element operations, then those that take a tensor to one number.
TENSOR_OPS: dict[str, Callable[..., Column]] = {
    "abs": lambda x: _E(x, F.abs), "neg": lambda x: _E(x, lambda e: -e), "sqrt": lambda x: _E(x, F.sqrt), "exp": lambda x: _E(x, F.exp),
    "log": lambda x: _E(x, F.log), "sign": lambda x: _E(x, F.signum), "floor": lambda x: _E(x, lambda e: F.floor(e).cast("double")),
    "ceil": lambda x: _E(x, lambda e: F.ceil(e).cast("double")), "round": lambda x: _E(x, F.rint), "square": lambda x: _E(x, lambda e: e * e),
    "sin": lambda x: _E(x, F.sin), "cos": lambda x: _E(x, F.cos), "tanh": lambda x: _E(x, F.tanh), "sigmoid": lambda x: _E(x, lambda e: 1 / (1 + F.exp(-e))),
    "add": lambda x, v: _E(x, lambda e: e + v), "sub": lambda x, v: _E(x, lambda e: e - v), "mul": lambda x, v: _E(x, lambda e: e * v),
    "div": lambda x, v: _E(x, lambda e: e / v), "pow": lambda x, v: _E(x, lambda e: F.pow(e, F.lit(float(v)))),
    "clamp": lambda x, a, b: _E(x, lambda e: F.least(F.greatest(e, F.lit(float(a))), F.lit(float(b)))),
    "sum": lambda x: F.array(F.aggregate(x, F.lit(0.0), lambda a, e: a + e)), "min": lambda x: F.array(F.array_min(x)), "max": lambda x: F.array(F.array_max(x)),
    "mean": lambda x: F.array(F.aggregate(x, F.lit(0.0), lambda a, e: a + e) / F.size(x)),
    "long": lambda x: x.cast("array<bigint>"), "float": lambda x: x.cast("array<float>"), "double": lambda x: x.cast("array<double>"),
}
_REDUCE = {"sum", "min", "max", "mean"}


class TensorOp(KeyedTransform):
    """An operation by name: one of the registry, flip, permute, transpose, or a numpy method on the Arrow kernel."""

    def __init__(self, op_name, *args, keys=("data",), name=None):
        super().__init__(keys, name)
        self.op_name, self.args = op_name.removesuffix("_"), args

    def change(self, s, key, op):
        n, args = self.op_name, self.args
        if n in TENSOR_OPS:
            out = with_values(s, key, TENSOR_OPS[n](values(s, key).cast("array<double>"), *args))
            return out.with_column(key, F.col(key), TensorSpec((1,))) if n in _REDUCE else out
        if n == "flip":
            return gather(s, key, np.flip(s.spec(key).positions(), args[0] if len(args) == 1 else args))
        if n == "permute":
            return gather(s, key, maps.permute(s.spec(key), args[0] if len(args) == 1 else args))
        if n == "transpose":
            return gather(s, key, np.swapaxes(s.spec(key).positions(), *args))
        if not callable(getattr(np.ndarray, n, None)):
            raise ValueError(f"unknown operation {n}")
        probe = np.asarray(getattr(np.zeros(s.spec(key).fixed), n)(*args))
        return kernel(s, key, lambda x: np.stack([np.asarray(getattr(v, n)(*args)) for v in x]), TensorSpec(probe.shape or (1,)))


class Permute(Transform):
    """{key: order of the tensor axes, channels being 0}."""

    def __init__(self, dims: Mapping[str, Sequence[int]], name=None):
        self.dims, self.name = dict(dims), name or "Permute"

    def apply(self, s):
        s.need(list(self.dims))
        for key, order in self.dims.items():
            s = gather(s, key, maps.permute(s.spec(key), order))
        return s


class SegToBox(Transform):
    """{segmentation key: box key}: boxes of the instances 1, 2, ... as [low..., high...], inclusive.

    An id that lacks below the largest gives a null box.  One look at each
    value, whatever the number of instances; nothing is shuffled.
    """

    def __init__(self, keys: dict[str, str], name=None):
        self.keys, self.name = dict(keys), name or "SegToBox"

    def apply(self, s):
        s.need(list(self.keys))
        kind = T.ArrayType(T.ArrayType(T.DoubleType()))
        for key, to in self.keys.items():
            spatial = tuple(s.spec(key).spatial)

            def boxes(v: np.ndarray) -> list | None:
                top = int(v.max()) if len(v) and v.max() >= 1 else 0
                at = np.flatnonzero((v >= 1) & (v == np.floor(v)))
                ids = v[at].astype(np.int64) - 1
                low, high = np.full((top, len(spatial)), np.inf), np.full((top, len(spatial)), -np.inf)
                for k, place in enumerate(np.unravel_index(at % max(int(np.prod(spatial)), 1), spatial)):
                    np.minimum.at(low[:, k], ids, place)
                    np.maximum.at(high[:, k], ids, place)
                return [[*a, *b] if np.isfinite(a[0]) else None for a, b in zip(low.tolist(), high.tolist())]

            def run(x: pa.Array) -> pa.Array:
                valid = x.is_valid().to_numpy(zero_copy_only=False)
                flat, ends = lists_of(x.filter(pa.array(valid)))
                rows = iter(np.split(flat, ends[:-1]) if len(ends) else [])
                return pa.array([boxes(next(rows)) if ok else None for ok in valid], pa.list_(pa.list_(pa.float64())))

            s = s.with_df(mapped(s.df, key, kind, run, to=to))
        return s


class BoxToSeg(Transform):
    """{box key: segmentation key}: draws inclusive boxes with ids from 1; later ones go over earlier ones."""

    def __init__(self, keys: dict[str, str], shape: Sequence[int], dtype: str = "long", name=None):
        self.keys, self.shape, self.dtype, self.name = dict(keys), tuple(shape), dtype, name or "BoxToSeg"

    def apply(self, s):
        s.need(list(self.keys))
        d, spec = len(self.shape), TensorSpec((1, *self.shape))
        if d not in (2, 3):
            raise TypeError("boxes have 2 or 3 dimensions")
        for key, to in self.keys.items():
            shape, size = self.shape, spec.size

            def drawn(held: list, shape: tuple[int, ...] = shape) -> np.ndarray:
                out = np.zeros(shape)
                for i, b in enumerate(held, 1):
                    if b is not None and None not in b:
                        low, high = np.maximum(np.ceil(b[:d]), 0).astype(int), np.floor(b[d:]).astype(int) + 1
                        out[tuple(slice(a, max(c, a)) for a, c in zip(low, high))] = i
                return out.ravel()

            def run(x: pa.Array, size: int = size, drawn: Callable = drawn) -> pa.Array:
                valid = x.is_valid().to_numpy(zero_copy_only=False)
                rows = np.zeros((int(valid.sum()), size))
                for n, held in enumerate(x.filter(pa.array(valid)).to_pylist()):
                    rows[n] = drawn(held)
                return to_list_array(rows, valid)

            s = s.with_df(mapped(s.df, key, T.ArrayType(T.DoubleType()), run, to=to))
            s = s.with_column(to, F.col(to).cast(f"array<{self.dtype}>"), spec)
        return s


class InstanceToSemantic(Transform):
    """{instance key: semantic key}: instance i takes class i of ``cls_key``; others take 0."""

    def __init__(self, keys: dict[str, str], cls_key: str, name=None):
        self.keys, self.cls_key, self.name = dict(keys), cls_key, name or "InstanceToSemantic"

    def apply(self, s):
        s.need([*self.keys, self.cls_key])
        for key, to in self.keys.items():
            cls = F.col(self.cls_key)

            def semantic(c: Column) -> Column:
                return F.transform(F.col(key), lambda e: F.when(e >= 1, F.coalesce(F.get(c, e.cast("int") - 1).cast("long"), F.lit(0).cast("long"))).otherwise(0))

            look = bound(cls, semantic)
            s = s.with_column(to, look, s.specs.get(key))
        return s


def _rest(s: Samples, keep: Sequence[str]) -> Samples:
    fixed = [c for c in (s.id_col, s.batch_col) if c and c in s.df.columns]
    return s.with_df(s.df.select(*fixed, *[c for c in keep if c not in fixed]))


def _picked(s: Samples, keys: Callable[[str], bool] | Sequence[str]) -> list[str]:
    own = [c for c in s.df.columns if c not in (s.id_col, s.batch_col)]
    return [c for c in own if keys(c)] if callable(keys) else [c for c in own if c in set(keys)]


class MapToSeq(Transform):
    """Keys in an order."""

    def __init__(self, *keys: str):
        self.keys, self.name = keys[0] if len(keys) == 1 and isinstance(keys[0], (list, tuple)) else keys, "MapToSeq"

    def apply(self, s):
        s.need(self.keys)
        return _rest(s, self.keys)


class SeqToMap(Transform):
    """Names columns by position; further ones are dropped."""

    def __init__(self, *keys: str):
        self.keys, self.name = keys[0] if len(keys) == 1 and isinstance(keys[0], (list, tuple)) else keys, "SeqToMap"

    def apply(self, s):
        own = [c for c in s.df.columns if c not in (s.id_col, s.batch_col)]
        if len(own) < len(self.keys):
            raise ValueError(f"{len(own)} columns for {len(self.keys)} names")
        fixed = [c for c in (s.id_col, s.batch_col) if c and c in s.df.columns]
        df = s.df.select(*fixed, *[F.col(a).alias(b) for a, b in zip(own, self.keys)])
        out = s.with_df(df)
        return out.__class__(**{**out.__dict__, "specs": {b: s.specs[a] for a, b in zip(own, self.keys) if a in s.specs}})


class PopKeys(Transform):
    """Takes keys away, by name (which must be there) or by a predicate on names."""

    def __init__(self, keys: Callable[[str], bool] | Sequence[str], return_popped: bool = False):
        self.keys, self.return_popped, self.name = keys, return_popped, "PopKeys"

    def apply(self, s):
        if not callable(self.keys):
            s.need(self.keys)
        gone = _picked(s, self.keys)
        rest = s.with_df(s.df.drop(*gone))
        return (rest, _rest(s, gone)) if self.return_popped else rest


class FilterKeys(Transform):
    """Keeps keys, by name (unknown ones don't matter) or by a predicate."""

    def __init__(self, keys: Callable[[str], bool] | Sequence[str], return_popped: bool = False):
        self.keys, self.return_popped, self.name = keys, return_popped, "FilterKeys"

    def apply(self, s):
        kept = _picked(s, self.keys)
        out = _rest(s, kept)
        return (out, s.with_df(s.df.drop(*kept))) if self.return_popped else out


class RenameKeys(Transform):
    """Renames one after another: an existing target is overwritten, later names see earlier ones."""

    def __init__(self, keys: dict[str, str]):
        self.keys, self.name = dict(keys), "RenameKeys"

    def apply(self, s):
        for old, new in self.keys.items():
            s.need([old])
            if old == new:
                continue
            specs = {k: v for k, v in s.specs.items() if k not in (old, new)}
            if old in s.specs:
                specs[new] = s.specs[old]
            df: DataFrame = s.df.drop(new).withColumnRenamed(old, new)
            s = s.__class__(**{**s.__dict__, "df": df, "specs": specs})
        return s
