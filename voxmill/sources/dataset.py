"""Datasets: where samples come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spec import TensorSpec
from ..operators.base import Samples
from ..plans.index import dense_index


class Dataset:
    """Samples in the order of an integer ``id_col`` that starts at 0 and has no gaps."""

    def __init__(self, df: DataFrame, specs: dict[str, TensorSpec] | None = None, id_col: str = "sample_id"):
        if id_col not in df.columns:
            raise KeyError(id_col)
        self.df, self.specs, self.id_col = df, specs or {}, id_col

    @classmethod
    def of(cls, spark: SparkSession, rows: Sequence, schema=None, specs=None) -> Dataset:
        """A sequence in memory: dicts, or values, which become column ``value``."""
        rows = [r if isinstance(r, dict) else {"value": r} for r in rows]
        data = [{"sample_id": i, **r} for i, r in enumerate(rows)]
        return cls(spark.createDataFrame(data, schema), specs)

    @classmethod
    def indexed(cls, df: DataFrame, order: str, specs=None, id_col: str = "sample_id") -> Dataset:
        """Numbers the rows of any table by an integer column."""
        return cls(dense_index(df, order, id_col), specs, id_col)

    def samples(self, seed: int = 0, epoch: int = 0) -> Samples:
        return Samples(self.df, dict(self.specs), self.id_col, None, seed, epoch)

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, index: int) -> Row:
        """One sample; the filter reaches the scan.  Negative indices count from the end."""
        if index < 0:
            index += len(self)
        rows = self.df.where(F.col(self.id_col) == index).take(1) if index >= 0 else []
        if not rows:
            raise IndexError(index)
        return rows[0]

    def __iter__(self) -> Iterator[Row]:
        return self.df.orderBy(self.id_col).toLocalIterator(prefetchPartitions=True)

    def get_subset(self, indices: Sequence[int]) -> Dataset:
        """The samples at ``indices``, in that order, repeats included.

        Whether all are there is checked by one count on the ids alone.
        """
        spark = self.df.sparkSession
        wanted = spark.createDataFrame([(p, int(i)) for p, i in enumerate(indices)], "__pos long, __at long")
        distinct = len({int(i) for i in indices})
        here = self.df.select(self.id_col).join(F.broadcast(wanted.select("__at").distinct()), F.col(self.id_col) == F.col("__at"), "left_semi")
        if here.count() < distinct:
            raise IndexError("an index is out of range")
        return self.subset(wanted.withColumnsRenamed({"__pos": "pos", "__at": "sample"}))

    def subset(self, index: DataFrame) -> Dataset:
        """By a table (pos, sample), of any size."""
        i = index.select(F.col("pos").alias("__pos"), F.col("sample").alias("__at"))
        df = self.df.join(i, F.col(self.id_col) == F.col("__at")).drop("__at", self.id_col).withColumnRenamed("__pos", self.id_col)
        return Dataset(df.select(self.id_col, *[c for c in self.df.columns if c != self.id_col]), self.specs, self.id_col)


def load_paths(
    spark: SparkSession, paths: Sequence[str | Path], load_fn: Callable, schema: str | T.StructType, mode: str = "append", num_workers: int | None = 0, **load_kwargs
) -> DataFrame:
    """load_fn(path, **kwargs) on executors: a dict a path, or with ``extend`` a list of dicts; ids follow the paths' order.

    ``num_workers`` sets the number of tasks; None or 0 leaves it to Spark.
    """
    if mode.lower() not in ("append", "extend"):
        raise TypeError(f"unknown mode {mode}")
    extend = mode.lower() == "extend"
    rows = [(i, str(p)) for i, p in enumerate(sorted(paths, key=str))]
    df = spark.createDataFrame(rows, "__path long, path string")
    df = df.repartition(num_workers or max(1, min(len(rows), spark.sparkContext.defaultParallelism)), "__path")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = T.StructType([T.StructField("__path", T.LongType()), T.StructField("__item", T.LongType()), *fields.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, path in zip(pdf["__path"], pdf["path"]):
                got = load_fn(path, **load_kwargs)
                items = list(got) if extend else [got]
                if items:
                    yield pd.DataFrame([{"__path": at, "__item": k, **x} for k, x in enumerate(items)], columns=out.names)

    return df.mapInPandas(run, out)


class AsyncDataset(Dataset):
    """Files of a directory, or a list of paths, loaded by a function and kept.

    Loaded once, in parallel, and cached; ids number the samples in path order.
    """

    def __init__(
        self, spark: SparkSession, data_path: str | Path | Sequence, load_fn: Callable, schema: str | T.StructType, mode: str = "append",
        num_workers: int | None = 0, verbose: bool = False, specs: dict[str, TensorSpec] | None = None, **load_kwargs,
    ):
        if isinstance(data_path, (list, tuple)):
            paths = list(data_path)
        else:
            if not Path(data_path).is_dir():
                raise AssertionError(f"{data_path} is no directory")
            paths = [p for p in Path(data_path).iterdir()]
        loaded = load_paths(spark, paths, load_fn, schema, mode, num_workers, **load_kwargs).cache()
        sizes = {r[0]: r[1] for r in loaded.groupBy("__path").count().collect()}  # one number a file
        starts, n = [], 0
        for k in range(len(paths)):
            starts.append((k, n))
            n += sizes.get(k, 0)
        offsets = spark.createDataFrame(starts or [(0, 0)], "__path long, __start long")
        df = loaded.join(F.broadcast(offsets), "__path").withColumn("sample_id", F.col("__start") + F.col("__item"))
        super().__init__(df.drop("__path", "__item", "__start"), specs)
        self.paths, self.n, self.loaded = paths, n, loaded

    def __len__(self) -> int:
        return self.n

    def close(self) -> None:
        self.loaded.unpersist()


def images(spark: SparkSession, sf_dir: str, shape: Sequence[int] = (1, 8, 8), key: str = "data") -> Samples:
    """The embeddings table as images of 64 values, ids kept."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias(key), "label")
    return Samples(df, {key: TensorSpec(tuple(shape))})


__all__ = ["AsyncDataset", "Dataset", "images", "load_paths", "replace"]
