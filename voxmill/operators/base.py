"""Samples and the transform protocol."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import AbstractParameter, ConstantParameter, Draws, as_parameter
from ..functions.spec import RAGGED, TensorSpec


@dataclass(frozen=True)
class Samples:
    """A DataFrame of samples, one a row, with what is known about its columns.

    ``specs`` has the shape of each tensor key.  Draws of batch scope depend on
    ``batch_col``; without one, all samples are one batch.
    """

    df: DataFrame
    specs: dict[str, TensorSpec] = field(default_factory=dict)
    id_col: str = "sample_id"
    batch_col: str | None = None
    seed: int = 0
    epoch: int = 0
    used: tuple[str, ...] = ()

    def spec(self, key: str) -> TensorSpec:
        self.need([key])
        if key not in self.specs:
            raise KeyError(f"{key} is no tensor of known shape")
        return self.specs[key]

    def need(self, keys: Sequence[str]) -> None:
        missing = [k for k in keys if k not in self.df.columns]
        if missing:
            raise KeyError(f"no such key: {', '.join(missing)}")

    def with_column(self, key: str, value: Column, spec: TensorSpec | None = None) -> Samples:
        specs = dict(self.specs)
        if spec is not None:
            specs[key] = spec
        return replace(self, df=self.df.withColumn(key, value), specs=specs)

    def with_df(self, df: DataFrame) -> Samples:
        return replace(self, df=df, specs={k: v for k, v in self.specs.items() if k in df.columns})

    def op(self, name: str) -> tuple[Samples, str]:
        """A name for the draws of the next operator: repeated names are numbered."""
        n = self.used.count(name)
        return replace(self, used=(*self.used, name)), name if not n else f"{name}.{n}"

    def scope(self, kind: str):
        """The column, or number, that draws of a kind depend on."""
        if kind == "sample":
            return F.col(self.id_col)
        return F.col(self.batch_col) if self.batch_col else 0

    def draws(self, op: str, kind: str = "batch") -> Draws:
        return Draws(self.seed, self.epoch, self.scope(kind), op)


class Transform(ABC):
    """Adds to the plan of samples; no data is touched before an action."""

    name: str

    @abstractmethod
    def apply(self, s: Samples) -> Samples: ...

    def __call__(self, s: Samples) -> Samples:
        return self.apply(s)


class KeyedTransform(Transform):
    """Changes each of ``keys``; a draw is shared by all keys."""

    def __init__(self, keys: Sequence[str] = ("data",), name: str | None = None):
        self.keys = (keys,) if isinstance(keys, str) else tuple(keys)
        self.name = name or type(self).__name__

    def apply(self, s: Samples) -> Samples:
        s.need(self.keys)
        s, op = s.op(self.name)
        for key in self.keys:
            s = self.change(s, key, op)
        return s

    def change(self, s: Samples, key: str, op: str) -> Samples:
        raise NotImplementedError


AbstractTransform = Transform


def sampled(value, draws: Draws, first: int = 0) -> Column | None:
    """A parameter, a constant or a tuple's member as a column; None stays None."""
    return as_parameter(value).column(draws, first)


def constant(value):
    """The value itself if it isn't drawn, else None."""
    return value if not isinstance(value, AbstractParameter) else value.value if isinstance(value, ConstantParameter) else None


def values(s: Samples, key: str) -> Column:
    """The flat values, ragged or not."""
    return F.col(f"{key}.data") if s.spec(key).ragged else F.col(key)


def with_values(s: Samples, key: str, new: Column) -> Samples:
    spec = s.spec(key)
    if spec.ragged:
        new = F.when(F.col(key).isNotNull(), F.struct(F.col(f"{key}.shape").alias("shape"), new.alias("data")))
    return s.with_column(key, new, spec)


def elementwise(s: Samples, key: str, fn: Callable[..., Column]) -> Samples:
    """fn(x) or fn(x, position) on each value, as doubles."""
    x = values(s, key).cast("array<double>")
    return with_values(s, key, F.transform(x, fn))


def _swapped(fn: Callable, c: int, v: Column) -> Column:
    return fn(v, c)


def per_channel(s: Samples, key: str, fn: Callable[[Column, int], Column]) -> Samples:
    """fn(values of a channel, its number) for each channel, put together again."""
    spec = s.spec(key)
    n = spec.size // spec.channels
    x = F.col(key).cast("array<double>")
    parts = [bound(F.slice(x, c * n + 1, n), partial(_swapped, fn, c)) for c in range(spec.channels)]
    return s.with_column(key, parts[0] if len(parts) == 1 else F.concat(*parts), spec)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being evaluated once for all its uses inside lambdas.

    It also keeps a Python function that makes the value out of the lambda, where it couldn't run.
    """
    return F.transform(F.array(value), use)[0]


def over_batch(s: Samples, **facts: Column) -> Samples:
    """Adds aggregates over each sample's batch as columns.

    Without batches all samples are one: the aggregates are then taken by a
    small job, as a window would bring all samples to one task.
    """
    if s.batch_col:
        w = Window.partitionBy(s.batch_col)
        return s.with_df(s.df.withColumns({k: c.over(w) for k, c in facts.items()}))
    row = s.df.agg(*[c.alias(k) for k, c in facts.items()]).first()
    return s.with_df(s.df.withColumns({k: F.lit(row[k]) for k in facts}))


#: Maps beyond this size go to the Arrow kernel, as their literals would swell the plan.
MAP_LITERALS = 4096
_RAGGED_TYPE = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.DoubleType()))])


def integers(values: np.ndarray) -> Column:
    """A constant array; one expression to parse in place of a call to the JVM for each value."""
    return F.expr(f"array({', '.join(str(int(v)) for v in values.ravel())})")


def gather(s: Samples, key: str, index: np.ndarray) -> Samples:
    """out[j] = x[index[j]], the output having the index's shape."""
    spec = TensorSpec(index.shape)
    if index.size <= MAP_LITERALS:
        x, flat = F.col(key), integers(index)
        out = F.when(x.isNotNull(), bound(x, lambda v: F.transform(flat, lambda i: F.get(v, i))))
        return s.with_column(key, out, spec)
    return kernel(s, key, lambda x: x.reshape(len(x), -1)[:, index.ravel()].reshape(len(x), *index.shape), spec)


def to_list_array(x: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of x as lists; null where not valid."""
    n = int(np.prod(x.shape[1:]))
    sizes = np.where(valid, n, 0)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = pa.array(np.ascontiguousarray(x).ravel(), pa.float64())
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~valid) if not valid.all() else None)


def mapped(df: DataFrame, key: str, kind: T.DataType, fn: Callable[..., pa.Array], *params: Column, to: str | None = None) -> DataFrame:
    """df with column ``to``, by default ``key`` itself, made by fn(values of key, *params) on Arrow batches."""
    to = to or key
    names = [f"__p{i}" for i in range(len(params))]
    given = df.withColumns(dict(zip(names, params))) if params else df
    fields = [T.StructField(f.name, kind if f.name == to else f.dataType) for f in df.schema.fields]
    if to not in df.columns:
        fields.append(T.StructField(to, kind))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            extra = [columns.pop(n) for n in names]
            columns[to] = fn(columns[key], *extra)
            yield pa.RecordBatch.from_pydict(columns)

    # A node of its own, not a function in a projection: those don't run where the optimiser merges lambdas into their arguments.
    return given.mapInArrow(over, T.StructType(fields))


def lists_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list array without nulls, and where each list ends."""
    return a.flatten().to_numpy(zero_copy_only=False), np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False)) if len(a) else np.empty(0, int)


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def kernel(s: Samples, key: str, fn: Callable[..., np.ndarray], out: TensorSpec, *params: Column) -> Samples:
    """fn(batch [N, C, ...], *params [N, ...]) as one Arrow call per batch of rows.

    With a ragged input or output, fn gets the samples of one shape and equal
    parameters together.  Null samples stay null.
    """
    spec = s.spec(key)
    kind = _RAGGED_TYPE if out.ragged else T.ArrayType(T.DoubleType())

    def numbers(a: pa.Array, valid: np.ndarray) -> np.ndarray:
        a = a.filter(pa.array(valid))
        if pa.types.is_list(a.type):
            return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
        return a.to_numpy(zero_copy_only=False)

    def grouped(x: pa.Array, given: list[np.ndarray]) -> list[np.ndarray]:
        """fn's result for each valid sample; equal shapes and parameters are one call."""
        if spec.ragged:
            shapes, at = lists_of(x.field("shape"))
            shapes = [tuple(p.tolist()) for p in np.split(shapes, at[:-1])] if len(at) else []
            values, ends = lists_of(x.field("data"))
        else:
            (values, ends), shapes = lists_of(x), [spec.fixed] * len(x)
        rows = np.split(values.astype(float, copy=False), ends[:-1]) if len(ends) else []
        groups: dict[tuple, list[int]] = {}
        for n, shape in enumerate(shapes):
            groups.setdefault((shape, *(np.ascontiguousarray(g[n]).tobytes() for g in given)), []).append(n)
        result: list = [None] * len(rows)
        for (shape, *_), members in groups.items():
            made = fn(np.stack([rows[n] for n in members]).reshape(len(members), *shape), *[g[members] for g in given])
            for n, y in zip(members, made):
                result[n] = np.asarray(y, float)
        return result

    def run(x: pa.Array, *extra: pa.Array) -> pa.Array:
        valid = x.is_valid().to_numpy(zero_copy_only=False)
        given = [numbers(p, valid) for p in extra]
        if spec.ragged or out.ragged:
            made = grouped(x.filter(pa.array(valid)), given)
            flat = list_array([y.ravel() for y in made], pa.float64())
            if out.ragged:
                shapes = list_array([np.array(y.shape, np.int32) for y in made], pa.int32())
                flat = pa.StructArray.from_arrays([shapes, flat], names=["shape", "data"])
            place = np.where(valid, np.cumsum(valid) - 1, 0)
            return flat.take(pa.array(place, pa.int64(), mask=~valid))
        data = x.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, *spec.fixed)
        if not len(data):
            return pa.nulls(len(x), pa.list_(pa.float64()))
        return to_list_array(np.asarray(fn(data, *given), float), valid)

    return replace(s, df=mapped(s.df, key, kind, run, *params), specs={**s.specs, key: out})


class BaseTransform(KeyedTransform):
    """augment(x, **parameters) on the values of each key, as Column to Column or, with ``batch``, on numpy batches.

    Parameters that are drawn are drawn once a batch and shared by all keys;
    ``scope`` "sample" draws for each sample.
    """

    def __init__(self, augment: Callable, keys: Sequence[str] = ("data",), name: str | None = None, batch: bool = False, scope: str = "batch", **params):
        super().__init__(keys, name)
        self.augment, self.batch, self.scope, self.params = augment, batch, scope, params

    def register_sampler(self, name: str, sampler) -> None:
        """Makes ``name`` a parameter of augment that is drawn; a name that is taken raises."""
        if name in self.params:
            raise NameError(f"{name} is a parameter already")
        self.params[name] = as_parameter(sampler)

    def drawn(self, s: Samples, op: str) -> dict[str, Column]:
        draws, out, first = s.draws(op, self.scope), {}, 0
        for k, v in self.params.items():
            out[k] = sampled(v, draws, first)
            first += as_parameter(v).width
        return out

    def change(self, s, key, op):
        given = self.drawn(s, op)
        if not self.batch:
            x = values(s, key).cast("array<double>")
            return with_values(s, key, bound(x, lambda v: self.augment(v, **given)))
        names, augment = list(given), self.augment

        def run(x: np.ndarray, *columns: np.ndarray) -> np.ndarray:
            if all((c == c[0]).all() for c in columns):
                return augment(x, **{n: c[0] for n, c in zip(names, columns)})
            return np.concatenate([augment(x[i : i + 1], **{n: c[i] for n, c in zip(names, columns)}) for i in range(len(x))])

        return kernel(s, key, run, s.spec(key), *given.values())


#: Draws don't depend on the key here, so seeding for each key is what every transform does.
BaseTransformSeeded = BaseTransform


class PerSampleTransform(BaseTransform):
    """augment gets one sample; the output keeps the input's element type with ``keep_type``."""

    def __init__(self, augment, keys=("data",), name=None, keep_type: bool = False, **params):
        super().__init__(lambda x, **p: np.stack([augment(y, **p) for y in x]), keys, name, batch=True, **params)
        self.keep_type = keep_type

    def change(self, s, key, op):
        kind = s.df.schema[key].dataType
        out = super().change(s, key, op)
        return out.with_column(key, F.col(key).cast(kind), out.spec(key)) if self.keep_type else out


class PerChannelTransform(BaseTransform):
    """augment gets each channel apart with ``per_channel``, else the whole sample."""

    def __init__(self, augment, per_channel: bool = False, keys=("data",), name=None, **params):
        super().__init__(augment, keys, name, **params)
        self.per_channel = per_channel

    def change(self, s, key, op):
        if not self.per_channel:
            return super().change(s, key, op)
        given = self.drawn(s, op)
        return per_channel(s, key, lambda x, c: self.augment(x, **given))


class UDFTransform(Transform):
    """A plain function: Samples to Samples, or DataFrame to DataFrame with ``frame``."""

    def __init__(self, fn: Callable, frame: bool = False, name: str | None = None):
        self.fn, self.frame, self.name = fn, frame, name or getattr(fn, "__name__", "function")

    def apply(self, s):
        return s.with_df(self.fn(s.df)) if self.frame else self.fn(s)


class BatchTransform(Transform):
    """fn(pandas frame of one batch) to such a frame, for work that couples the samples of a batch.

    A batch is one group in one task; batches are as large as the loader makes them.
    """

    def __init__(self, fn: Callable, schema: str | T.StructType, specs: dict[str, TensorSpec] | None = None, name: str | None = None):
        self.fn, self.schema, self.specs, self.name = fn, schema, specs or {}, name or "batch"

    def apply(self, s):
        if s.batch_col is None:
            raise ValueError("samples have no batches; load them first")
        df = s.df.groupBy(s.batch_col).applyInPandas(lambda pdf: self.fn(pdf), self.schema)
        out = s.with_df(df)
        return replace(out, specs={**out.specs, **self.specs})


__all__ = [
    "RAGGED", "AbstractTransform", "BaseTransform", "BaseTransformSeeded", "BatchTransform", "KeyedTransform", "PerChannelTransform",
    "PerSampleTransform", "Samples", "Transform", "UDFTransform", "bound", "constant", "elementwise", "gather", "integers", "kernel", "list_array", "lists_of", "mapped", "over_batch", "per_channel", "sampled", "values", "with_values",
]
