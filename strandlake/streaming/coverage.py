"""Structured Streaming: read counts by time window, and coverage of a growing set of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """(window_start, key, n) over event time with a watermark; the same plan serves batch and stream."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def coverage_deltas(events: DataFrame, chrom: str, pos: str, size: int) -> DataFrame:
    """(chrom, pos, delta) sums of the events that a sweep turns into coverage, kept up to date by the stream."""
    steps = F.array(F.struct(F.col(pos).alias("pos"), F.lit(1).cast("long").alias("d")), F.struct((F.col(pos) + size).alias("pos"), F.lit(-1).cast("long").alias("d")))
    return events.select(F.col(chrom).alias("chrom"), F.explode(steps).alias("e")).groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta"))


def drain(spark: SparkSession, stream: DataFrame, mode: str, checkpoint: str, sink: str) -> DataFrame:
    """What a stream yields when all that is there has been read, as a table of files or in memory."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", sink).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(sink)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/latest")

    writer.foreachBatch(store).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{sink}/latest")
