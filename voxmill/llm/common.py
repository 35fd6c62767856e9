"""What several operators share: tables, checkpoints, hashes, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sides up to this many rows, and bytes, may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: A key is hot that holds more than one in so many of all rows; so there are fewer hot keys than this.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset and
    everything runs in one process, as in tests, a temporary one is made, which
    goes when the process ends; on a cluster this raises.
    """
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not set_to:
        set_to = sc.getCheckpointDir()
    if not set_to:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        set_to = "file://" + folder
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(set_to)
    return set_to


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage, in storage that outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _scratch.append(path)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at path to its end."""
    fs, p = _fs(spark, os.path.join(path, "_SUCCESS"))
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes the checkpoints and scratch tables that were made within, at the end.

    For work whose result is written within; plans that aren't are of no use after.
    """

    def checkpoints() -> set[str]:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            return set()
        fs, p = _fs(spark, folder)
        return {str(x.getPath().toString()) for x in fs.listStatus(p)} if fs.exists(p) else set()

    shared_dir(spark)
    before, n = checkpoints(), len(_scratch)
    try:
        yield
    finally:
        for path in [*(checkpoints() - before), *_scratch[n:]]:
            delete(spark, path)
        del _scratch[n:]


def crc_remainder(col: str, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod``; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values only."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _width(kind: T.DataType, c: Column) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(16).cast("long"), lambda n, x: n + _width(kind.elementType, x))
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, c[f.name]) for f in kind.fields), F.lit(8))
    return F.lit(16)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; reads no further than it must."""
    wide = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(8)).cast("long")
    n, b = df.select(wide.alias("b")).limit(rows + 1).agg(F.count("b"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and b <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it was counted to be small, else unmarked.

    The count runs df's plan; cut it first where that is long.
    """
    return F.broadcast(df) if fits(df, rows) else df


def join_hot(left: DataFrame, right: DataFrame, key: str, share: str) -> DataFrame:
    """left joined to right on ``key``, which right has once, with its share of left's rows in column ``share``.

    Keys of more than one in ``HOT`` rows are fewer than HOT, so their side is
    broadcast and their rows stay where they are; the others are shuffled.
    Both sides are read twice.
    """
    hot = F.col(share) * HOT > 1
    some = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(right.where(~hot), key)
    return left.join(some, key).unionByName(rest).drop(share)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b), as (node, root).

    Alternates large-star and small-star steps until no edge changes; root is
    the smallest node of its component.  Each step is a shuffle on nodes with
    partial aggregation; no task holds a component, and nodes with a large share
    of the edges aren't shuffled.  Nodes without an edge are not listed.  Null
    ends and loops are ignored.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def joined(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
        return join_hot(left, right, "u", "share") if n > BROADCAST_ROWS else left.join(right, "u").drop("share")

    for _ in range(max_rounds):
        before, n = e, max(e.count(), 1)
        of_all = F.count(F.lit(1)) / F.lit(n)
        # large star: link each node's larger neighbours to its least neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), (of_all / 2).alias("share"))
        large = joined(both.where("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        large = cut(large) if n > BROADCAST_ROWS else large
        # small star: link each node and its smaller neighbours to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"), of_all.alias("share"))
        e = cut(
            joined(large, low, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        same = e.exceptAll(before).isEmpty() and before.exceptAll(e).isEmpty()
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
