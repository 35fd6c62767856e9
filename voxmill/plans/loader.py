"""The loader: order, sample stage, batches, batch stage, device stage."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spec import TensorSpec
from ..operators.base import Samples, Transform
from ..operators.compose import Compose
from ..sources.dataset import Dataset
from .index import shuffled_index


def default_transform_call(samples, transform: Callable):
    """Samples go as they are, a mapping as keywords, a list or tuple as arguments, anything else alone."""
    if isinstance(samples, Mapping):
        return transform(**samples)
    if isinstance(samples, (list, tuple)):
        return transform(*samples)
    return transform(samples)


def change_pseudo_batch_dim(spec: TensorSpec, add: bool) -> TensorSpec:
    """Adds or strips a first axis of one; rows are samples already, so only shapes change."""
    if add:
        return TensorSpec((1, *spec.fixed))
    if spec.fixed[0] != 1:
        raise ValueError("the first axis isn't one")
    return TensorSpec(spec.fixed[1:])


class SampleTransformer:
    """A dataset whose samples pass through transforms, each sample being a batch of its own."""

    def __init__(self, dataset: Dataset, transforms: Callable | None = None, pseudo_batch_dim: bool = False, transform_call: Callable = default_transform_call):
        self.dataset, self.transforms, self.pseudo, self.call = dataset, transforms, pseudo_batch_dim, transform_call

    def samples(self, seed: int = 0, epoch: int = 0) -> Samples:
        s = self.dataset.samples(seed, epoch)
        if self.transforms is None:
            return s
        t = Compose(*self.transforms) if isinstance(self.transforms, (list, tuple)) else self.transforms
        s = replace(s, batch_col=s.id_col)
        return replace(self.call(s, t), batch_col=None, used=())

    def __getitem__(self, index: int):
        s = self.samples()
        rows = s.df.where(F.col(s.id_col) == index).take(1)
        if not rows:
            raise IndexError(index)
        return rows[0]

    def __len__(self):
        n = len(self.dataset)
        return n


def collate(s: Samples, position: str = "pos", keys: Sequence[str] | None = None) -> DataFrame:
    """One row a batch: each key as the list of its values in order; tensors must agree in shape."""
    keys = [k for k in (keys or s.df.columns) if k not in (s.batch_col, position)]
    for k in keys:
        if k in s.specs and s.specs[k].ragged:
            raise ValueError(f"{k} has samples of several shapes")
    held = F.sort_array(F.collect_list(F.struct(position, *keys)))
    df = s.df.groupBy(s.batch_col).agg(held.alias("__b"), F.count(F.lit(1)).alias("batch_length"))
    return df.select(s.batch_col, "batch_length", *[F.col(f"__b.{k}").alias(k) for k in keys])


#: A sample type that numpy_collate and the default can't put together.
_NO_COLLATE = (T.MapType, T.BinaryType)


def numpy_collate(s: Samples, position: str = "pos") -> DataFrame:
    """Like collate; raises TypeError for columns that have no array form."""
    bad = [f.name for f in s.df.schema.fields if isinstance(f.dataType, _NO_COLLATE)]
    if bad:
        raise TypeError(f"can't collate {', '.join(bad)}")
    return collate(s, position)


def do_nothing_collate(s: Samples, position: str = "pos") -> DataFrame:
    return s.df


class BatchTransformer:
    """Batches through transforms; ``auto_convert`` casts tensors back to doubles."""

    def __init__(self, collate_fn: Callable | None = None, transforms: Callable | None = None, auto_convert: bool = True, transform_call: Callable = default_transform_call):
        self.collate_fn, self.transforms, self.auto_convert, self.call = collate_fn or collate, transforms, auto_convert, transform_call

    def transformed(self, s: Samples) -> Samples:
        if self.transforms is not None:
            t = Compose(*self.transforms) if isinstance(self.transforms, (list, tuple)) else self.transforms
            s = self.call(s, t)
        if self.auto_convert:
            for k, spec in s.specs.items():
                if k in s.df.columns and not spec.ragged and s.df.schema[k].dataType == T.ArrayType(T.FloatType()):
                    s = s.with_column(k, F.col(k).cast("array<double>"), spec)
        return s

    def __call__(self, s: Samples) -> DataFrame:
        return self.collate_fn(self.transformed(s))


class DataLoader:
    """A plan over a dataset: samples in order, in batches, transformed.

    Order is the dataset's, a hash shuffle of seed and epoch, or that of a
    ``sampler`` (ids, or a table (pos, sample)); a ``batch_sampler`` lists the
    ids of every batch.  ``samples`` stays a lazy plan, one row a sample, with
    ``batch_id`` and ``pos``; ``batches`` collates; iterating brings one batch
    after another to the driver.  Worker settings are taken for compatibility:
    Spark schedules tasks.
    """

    def __init__(
        self, dataset: Dataset, batch_size: int = 1, shuffle: bool = False, batch_transforms=None, gpu_transforms=None, sample_transforms=None,
        pseudo_batch_dim: bool = False, device=None, sampler=None, batch_sampler=None, num_workers: int = 0, collate_fn: Callable | None = None,
        drop_last=False, auto_convert=True, transform_call=default_transform_call, seed: int = 0, **worker_settings,
    ):
        unknown = set(worker_settings) - {"pin_memory", "timeout", "worker_init_fn", "multiprocessing_context", "to_gpu_trafo", "prefetch_factor", "persistent_workers"}
        if unknown:
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
        if batch_sampler is not None and (batch_size != 1 or shuffle or sampler is not None or drop_last):
            raise ValueError("a batch sampler excludes batch size, shuffle, sampler and drop_last")
        given = sorted(k for k, v in worker_settings.items() if v)
        if given:
            warnings.warn(f"Spark schedules tasks and seeds draws by sample; without effect: {', '.join(given)}", RuntimeWarning, stacklevel=2)
        if sampler is not None and shuffle:
            raise ValueError("a sampler excludes shuffle")
        if batch_size < 1:
            raise ValueError("batches have one sample or more")
        if gpu_transforms is not None:
            warnings.warn("no devices here; these transforms follow the batch transforms", RuntimeWarning, stacklevel=2)
        self.dataset, self.batch_size, self.shuffle, self.drop_last, self.seed, self.epoch = dataset, batch_size, shuffle, drop_last, seed, 0
        self.sampler, self.batch_sampler = sampler, batch_sampler
        self.sample_stage = self.get_sample_transformer(dataset, sample_transforms, pseudo_batch_dim, transform_call)
        stages = [t for t in (batch_transforms, gpu_transforms) if t is not None]
        flat = [x for t in stages for x in (t if isinstance(t, (list, tuple)) else [t])]
        self.batch_stage = self.get_batch_transformer(collate_fn, flat or None, auto_convert, transform_call)

    def get_batch_transformer(self, collate_fn: Callable | None = None, transforms=None, auto_convert: bool = True, transform_call: Callable = default_transform_call) -> BatchTransformer:
        """What collates and transforms batches; a subclass may make another."""
        return BatchTransformer(collate_fn, transforms, auto_convert, transform_call)

    def get_sample_transformer(self, dataset: Dataset, transforms=None, pseudo_batch_dim: bool = False, transform_call: Callable = default_transform_call) -> SampleTransformer:
        """What transforms samples; a subclass may make another."""
        return SampleTransformer(dataset, transforms, pseudo_batch_dim, transform_call)

    def set_epoch(self, epoch: int) -> DataLoader:
        """Shuffles and draws of later plans depend on it."""
        self.epoch = epoch
        return self

    def _ordered(self, s: Samples) -> DataFrame:
        spark, size = s.df.sparkSession, self.batch_size
        if self.batch_sampler is not None or self.sampler is not None:
            if isinstance(self.sampler, DataFrame):
                index = self.sampler.select("pos", F.col("sample").alias("__at"), F.floor(F.col("pos") / size).cast("long").alias("batch_id"))
            else:
                batches = self.batch_sampler if self.batch_sampler is not None else [list(self.sampler)[i : i + size] for i in range(0, len(list(self.sampler)), size)]
                flat = [(b, i) for b, ids in enumerate(batches) for i in ids]
                index = spark.createDataFrame([(p, int(i), b) for p, (b, i) in enumerate(flat)], "pos long, __at long, batch_id long")
            return s.df.join(index, F.col(s.id_col) == F.col("__at")).drop("__at")
        if self.shuffle:
            df = shuffled_index(s.df, s.id_col, "pos", self.seed, self.epoch)
        else:  # ids are dense: a batch is a division away, nothing is shuffled
            df = s.df.withColumn("pos", F.col(s.id_col).cast("long"))
        return df.withColumn("batch_id", F.floor(F.col("pos") / size).cast("long"))

    def samples(self) -> Samples:
        """The plan up to the last transform, one row a sample."""
        s = self.sample_stage.samples(self.seed, self.epoch)
        df = self._ordered(s)
        if self.drop_last:
            n = self.dataset.df.count()
            df = df.where(F.col("batch_id") < n // self.batch_size)
        return self.batch_stage.transformed(replace(s, df=df, batch_col="batch_id"))

    def batches(self) -> DataFrame:
        """One row a batch."""
        return self.batch_stage.collate_fn(self.samples())

    def __len__(self) -> int:
        if self.batch_sampler is not None:
            return len(list(self.batch_sampler))
        n = self.sampler.count() if isinstance(self.sampler, DataFrame) else len(list(self.sampler)) if self.sampler is not None else len(self.dataset)
        return n // self.batch_size if self.drop_last else -(-n // self.batch_size)

    def __iter__(self) -> Iterator[pd.DataFrame]:
        """Batches in order, each a pandas frame; the driver holds one partition at a time."""
        held, now = [], None
        for row in self.samples().df.orderBy("batch_id", "pos").toLocalIterator(prefetchPartitions=True):
            if now is not None and row["batch_id"] != now:
                yield pd.DataFrame([r.asDict() for r in held])
                held = []
            now = row["batch_id"]
            held.append(row)
        if held:
            yield pd.DataFrame([r.asDict() for r in held])


def apply_stage(df: DataFrame, transform: Transform, specs: dict[str, TensorSpec], **kw) -> DataFrame:
    return transform(Samples(df, specs, **kw)).df
