"""Dense numbering of rows without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
RANGES = 256
#: Rows of a bucket that are few, whatever the others hold.
EVEN = 50_000


def _number(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 0: rows are ranked within buckets, whose order is that of the rows, and buckets are added up."""
    d = df.withColumn("__bucket", bucket)
    sizes = d.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    starts = sizes.select("__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    out = d.withColumn("__rank", rank).join(F.broadcast(starts), "__bucket")
    return out.withColumn(name, (F.col("__start") + F.col("__rank")).cast("long")).drop("__bucket", "__rank", "__start")


def _longs(values: list[int]) -> Column:
    """A constant array; one expression to parse in place of a call to the JVM for each value."""
    return F.expr(f"cast(array({', '.join(f'{v}BD' if abs(v) >= 1 << 62 else f'{v}L' for v in values)}) as array<bigint>)")


def _ranked(df: DataFrame, bucket: Column, sizes: dict[int, int], order: str, name: str) -> DataFrame:
    """Row numbers from 0, by the counted sizes of buckets."""
    starts, n = [], 0
    for k in range(max(sizes, default=0) + 1):
        starts.append(n)
        n += sizes.get(k, 0)
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(F.col(order).asc_nulls_last())) - 1
    start = F.get(_longs(starts), F.col("__bucket"))
    return df.withColumn("__bucket", bucket.cast("int")).withColumn(name, (start + rank).cast("long")).drop("__bucket")


def dense_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers rows by an integer column, nulls last.

    Buckets are equal ranges of it, of which one job counts the rows.  Where one
    holds many more than its part, as with an outlying id, ranges between
    quantiles take their place.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    x, nulls = F.col(order).cast("decimal(20,0)"), F.col(order).isNull()

    def count(bucket: Column) -> dict[int, int]:
        return {r[0]: r[1] for r in df.groupBy(bucket.cast("int").alias("b")).count().collect()}  # a row a bucket

    if low is None:
        bucket = F.lit(0)
        return _ranked(df, bucket, {0: 0}, order, name)
    width = (high - low) // BUCKETS + 1
    if -(1 << 62) < low and high < 1 << 62:
        x = F.col(order).cast("long")
    bucket = F.when(nulls, BUCKETS).otherwise(F.floor((x - low) / width))
    sizes = count(bucket)
    held = [n for k, n in sizes.items() if k != BUCKETS]
    if max(held) <= max(EVEN, 8 * sum(held) // BUCKETS):
        return _ranked(df, bucket, sizes, order, name)
    bounds = sorted(set(df.agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 20 * RANGES)).first()[0]))
    above = lambda held: F.size(F.filter(held, lambda b: b < F.col(order).cast("long")))
    step = 16  # first among every 16th bound, then between two of these
    coarse, fine = bounds[step - 1 :: step], F.array(*[_longs(bounds[k : k + step - 1]) for k in range(0, len(bounds) + 1, step)])
    first = above(_longs(coarse)) if coarse else F.lit(0)
    bucket = F.when(nulls, RANGES).otherwise(first * step + above(F.get(fine, first)))
    return _ranked(df, bucket, count(bucket), order, name)


def shuffled_index(df: DataFrame, id_col: str, name: str, seed: int, epoch: int) -> DataFrame:
    """Numbers rows in the order of a hash of seed, epoch and id; buckets are prefixes of the hash."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(id_col).cast("string")))
    d = df.withColumn("__hash", h)
    bucket = F.conv(F.substring("__hash", 1, 3), 16, 10).cast("long") % F.lit(1 << 12) / F.lit((1 << 12) // BUCKETS)
    return _number(d, F.floor(bucket), [F.col("__hash"), F.col(id_col)], name).drop("__hash")
