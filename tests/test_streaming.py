"""The streaming plans give what the batch plans give."""

from pyspark.sql import functions as F

from strandlake.operators import tracks
from strandlake.streaming import coverage


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_windowed_counts(spark, tmp_path):
    events = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 37).cast("timestamp").alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = coverage.drain(spark, coverage.windowed_counts(stream, late="10 hours"), "complete", str(tmp_path / "cp"), str(tmp_path / "out"))
    assert rows(got) == rows(coverage.windowed_counts(events))


def test_streamed_coverage(spark, tmp_path):
    events = spark.range(100).select(F.concat(F.lit("c"), F.col("id") % 2).alias("chrom"), (F.col("id") * 7 % 90).alias("pos"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    deltas = coverage.drain(spark, coverage.coverage_deltas(stream, "chrom", "pos", 10), "complete", str(tmp_path / "cp"), str(tmp_path / "out"))
    same = tracks.sweep(coverage.coverage_deltas(events, "chrom", "pos", 10), ["delta"])
    assert rows(tracks.sweep(deltas, ["delta"])) == rows(same)
