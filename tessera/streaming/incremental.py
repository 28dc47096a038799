"""Models that grow with a stream: each micro-batch adds its sums once.

State is a small table of sums for each batch id in a folder, overwritten when a batch is repeated, so that a batch
counts once however often it is tried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.base import value


class StreamingMoments:
    """Count, mean and population variance of columns over all batches of a stream."""

    def __init__(self, columns: Sequence[str], state: str):
        self.columns, self.state = list(columns), state

    def update(self, batch: DataFrame, batch_id: int) -> None:
        sums = [x for i, c in enumerate(self.columns) for x in (F.count(value(c)).alias(f"n{i}"), F.sum(value(c)).alias(f"s{i}"), F.sum(value(c) ** 2).alias(f"q{i}"))]
        batch.agg(*sums).write.mode("overwrite").parquet(f"{self.state}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def result(self, spark: SparkSession) -> DataFrame:
        """column, n, mean and var of what has arrived."""
        rows = spark.read.parquet(self.state)
        one = [F.struct(F.lit(c).alias("column"), F.sum(f"n{i}").alias("n"), F.sum(f"s{i}").alias("s"), F.sum(f"q{i}").alias("q")) for i, c in enumerate(self.columns)]
        out = rows.agg(*[o.alias(f"o{i}") for i, o in enumerate(one)]).select(F.explode(F.array(*[f"o{i}" for i in range(len(one))])).alias("o"))
        mean = F.try_divide(F.col("o.s"), F.col("o.n"))
        return out.select("o.column", "o.n", mean.alias("mean"), (F.try_divide(F.col("o.q"), F.col("o.n")) - mean**2).alias("var"))


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of `value` in tumbling windows; rows later than the watermark are left out of a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")
