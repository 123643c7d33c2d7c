"""Key counts of a stream, for the join's counts to be kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, key, n) of a stream; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def maintain_counts(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's key counts to ``path``; a batch written again after a
    failure replaces itself, so sums over the folder stay exact."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
