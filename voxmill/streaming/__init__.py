"""Transforms on streams.

Transforms that keep to a row work on ``readStream`` plans as they are.  What
couples the samples of a batch (a step, a range over a batch) runs on each
micro-batch, whose id is the step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.spec import TensorSpec
from ..operators.base import Samples


def transform_stream(stream: DataFrame, transform: Callable[[Samples], Samples], specs: dict[str, TensorSpec], id_col: str = "sample_id", seed: int = 0, batch_size: int = 32) -> DataFrame:
    """A stream through a transform of rows.  Batches, for draws, are runs of ``batch_size`` ids."""
    df = stream.withColumn("batch_id", F.floor(F.col(id_col) / batch_size).cast("long"))
    return transform(Samples(df, specs, id_col, "batch_id", seed)).df


def transform_batches(
    stream: DataFrame, transform: Callable[[Samples], Samples], specs: dict[str, TensorSpec], sink: Callable[[DataFrame, int], None], id_col: str = "sample_id", seed: int = 0
) -> DataStreamWriter:
    """A writer that transforms every micro-batch as one batch, its id being batch and step, and gives it to the sink.

    A micro-batch that is run again after a failure draws the same and has the same id, so an idempotent sink sees it once.
    """

    def run(df: DataFrame, number: int) -> None:
        s = Samples(df.withColumn("batch_id", F.lit(number).cast("long")), specs, id_col, "batch_id", seed)
        sink(transform(s).df, number)

    return stream.writeStream.foreachBatch(run)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of values by time window and key, for data up to ``late`` late."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
