"""Signal tracks: piecewise-constant functions over integer coordinates, by chromosome.

A track is a table of runs (chrom, start, end, values...).  Everything is built
on one primitive, ``sweep``: events with deltas become runs by a prefix sum.
Work follows the runs, never the bases, and several tracks are aligned by
sweeping their events together instead of joining ranges.

The prefix sum has two levels: sums within bins of the coordinate, and sums of
the bins before.  One chromosome with most of the events is spread over its bins
and never sorted as a whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Coordinates in a bin of the two-level prefix sum.
BIN = 1 << 18


def sweep(events: DataFrame, deltas: Sequence[str], bin_width: int = BIN, merged: bool = False) -> DataFrame:
    """Runs (chrom, start, end, <deltas>) from events (chrom, pos, <deltas>).

    A run reaches from one event to the next of its chromosome; its values are
    the sums of all deltas up to its start.  The stretch after a chromosome's
    last event is no run.  Events may repeat and come in any order; null deltas
    count as zero, rows without chrom or pos are dropped.  With ``merged``, places
    where nothing changes are left out before the prefix sum, except zero, so
    neighbouring runs differ and need no compaction.
    """
    points = events.where("chrom is not null and pos is not null").groupBy("chrom", F.col("pos").cast("long").alias("pos")).agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in deltas])
    if merged:
        changes = F.col("pos") == 0
        for d in deltas:
            changes = changes | (F.col(d) != 0)
        points = points.where(changes)
    points = points.withColumn("_bin", F.floor(F.col("pos") / F.lit(bin_width)))
    bins = points.groupBy("chrom", "_bin").agg(F.min("pos").alias("_first"), *[F.sum(d).alias(f"_{d}") for d in deltas])
    before = Window.partitionBy("chrom").orderBy("_bin")
    sums = [F.coalesce(F.sum(f"_{d}").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{d}") for d in deltas]
    offsets = bins.select(F.col("chrom").alias("_chrom"), F.col("_bin").alias("_at"), F.lead("_first").over(before).alias("_next"), *sums)
    inside = Window.partitionBy("chrom", "_bin").orderBy("pos")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = points.select("chrom", "_bin", "pos", F.lead("pos").over(inside).alias("_end"), *[F.sum(d).over(running).alias(d) for d in deltas])
    joined = local.join(offsets, (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_at")))
    end = F.coalesce("_end", "_next")
    return joined.where(end.isNotNull()).select("chrom", F.col("pos").alias("start"), end.alias("end"), *[(F.col(d) + F.col(f"_{d}")).alias(d) for d in deltas])


def events_of(track: DataFrame, value: str, name: str) -> DataFrame:
    """Events (chrom, pos, name) that a sweep turns back into the track."""
    steps = F.array(F.struct(F.col("start").alias("pos"), F.col(value).alias("d")), F.struct(F.col("end").alias("pos"), (-F.col(value)).alias("d")))
    return track.where("end > start").select("chrom", F.explode(steps).alias("e")).select("chrom", "e.pos", F.col("e.d").alias(name))


def align(tracks: dict[str, DataFrame], value: str = "value", bin_width: int = BIN) -> DataFrame:
    """Runs on the union of the tracks' breakpoints, a column for each track, zero where it has no run.

    Runs without length are dropped; those of one track do not overlap.  A run
    carries its value from its start to where the track's next run or gap begins,
    so values of any size, infinities and NaN come out as they went in.
    """
    names = list(tracks)
    parts = []
    for name, track in tracks.items():
        steps = F.array(
            F.struct(F.col("start").cast("long").alias("pos"), F.col(value).cast("double").alias("v"), F.lit(False).alias("ends")),
            F.struct(F.col("end").cast("long").alias("pos"), F.lit(0.0).alias("v"), F.lit(True).alias("ends")),
        )
        own = track.where("end > start and chrom is not null").select("chrom", F.explode(steps).alias("e")).select("chrom", "e.*")
        parts.append(own.select("chrom", "pos", *[(f if n == name else F.lit(None).cast(kind)).alias(f"{n}{suffix}") for n in names for f, kind, suffix in ((F.when(~F.col("ends"), F.col("v")), "double", ""), (F.when(F.col("ends"), True), "boolean", "_ends"))]))
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    begun = [F.coalesce(F.max(n), F.when(F.max(f"{n}_ends"), 0.0)).alias(n) for n in names]
    points = events.groupBy("chrom", "pos").agg(*begun).withColumn("_bin", F.floor(F.col("pos") / F.lit(bin_width)))
    last = [F.max(F.when(F.col(n).isNotNull(), F.struct("pos", F.col(n).alias("v")))).alias(f"_{n}") for n in names]
    bins = points.groupBy("chrom", "_bin").agg(F.min("pos").alias("_first"), *last)
    before = Window.partitionBy("chrom").orderBy("_bin")
    carried = [F.max(f"_{n}").over(before.rowsBetween(Window.unboundedPreceding, -1)).getField("v").alias(f"_{n}") for n in names]
    offsets = bins.select(F.col("chrom").alias("_chrom"), F.col("_bin").alias("_at"), F.lead("_first").over(before).alias("_next"), *carried)
    inside = Window.partitionBy("chrom", "_bin").orderBy("pos")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = points.select("chrom", "_bin", "pos", F.lead("pos").over(inside).alias("_end"), *[F.last(n, ignorenulls=True).over(running).alias(n) for n in names])
    joined = local.join(offsets, (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_at")))
    end = F.coalesce("_end", "_next")
    return joined.where(end.isNotNull()).select("chrom", F.col("pos").alias("start"), end.alias("end"), *[F.coalesce(n, f"_{n}", F.lit(0.0)).alias(n) for n in names])


def compact(track: DataFrame, values: Sequence[str] = ("value",), bin_width: int = BIN) -> DataFrame:
    """The same function with adjacent runs of equal values merged.

    Merging works within bins; of each bin only the first and the last run go
    into the pass over the whole chromosome that joins what meets at borders.
    """
    columns = ["chrom", "start", "end", *values]
    track = track.where("end > start").withColumn("_bin", F.floor(F.col("start") / F.lit(bin_width)))
    local = _merge(track, ["chrom", "_bin"], values)
    order = Window.partitionBy("chrom", "_bin").orderBy("start")
    marked = local.withColumn("_edge", F.lag("end").over(order).isNull() | F.lead("end").over(order).isNull())
    return marked.where("not _edge").select(*columns).unionByName(_merge(marked.where("_edge"), ["chrom"], values).select(*columns))


def _merge(track: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(order))
    starts = F.when(same & (F.col("start") == F.lag("end").over(order)), 0).otherwise(1)
    numbered = track.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(v).alias(v) for v in values]).drop("_run")


def compare(a: DataFrame, b: DataFrame, method, value: str = "value") -> DataFrame:
    """A track (chrom, start, end, value) of ``method(a, b)`` over the aligned runs of two tracks."""
    both = align({"a": a.withColumnRenamed(value, "value"), "b": b.withColumnRenamed(value, "value")})
    return compact(both.select("chrom", "start", "end", method(F.col("a"), F.col("b")).alias("value")))


def coverage(intervals: DataFrame, weight: Column | None = None, lengths: DataFrame | None = None, bin_width: int = BIN) -> DataFrame:
    """Coverage runs (chrom, start, end, value) of intervals (chrom, start, end), from zero to the last end.

    Starts below zero count from zero; intervals without length do not count.
    The leading stretch without coverage is a run of value zero.  With ``lengths``
    (chrom, length) no run reaches beyond its chromosome's end, and chromosomes that
    are not there, or have no length above zero, have no runs; of several lengths the
    largest counts.  The length is swept with the intervals, so nothing is joined on chromosomes.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    clipped = intervals.select("chrom", F.greatest(F.col("start"), F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end"), w.alias("w")).where("end > start")
    events = events_of(clipped, "w", "value").unionByName(clipped.select("chrom").distinct().select("chrom", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("value")))
    if lengths is None:
        return sweep(events, ["value"], bin_width, merged=True)
    ends = lengths.groupBy("chrom").agg(F.max("length").cast("long").alias("end")).where("end > 0").select("chrom", F.lit(0).cast("long").alias("start"), "end", F.col("end").alias("limit"))
    runs = sweep(events.unionByName(events_of(ends, "limit", "limit"), allowMissingColumns=True), ["value", "limit"], bin_width, merged=True)
    return runs.where("limit > 0 and not (value = 0 and end = limit)").drop("limit")
