"""Reads and fragments: 5' ends, duplicates, shifts, extension, statistics, samples.

Reads are (chrom, pos, strand) with pos the 5' end; fragments are (chrom, left,
right) with an optional count.  Duplicates are held as counts from the first
aggregation on, so a position with very many reads is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import binomial_max_duplicates

#: Fragment counts are held in sixteen bits.
COUNT_MODULUS = 65_536
#: Reads of one place that are numbered in one row at most.
SLICE = 4_096


def five_prime(bed: DataFrame) -> DataFrame:
    """(chrom, pos, strand, length) of BED rows (chrom, start, end, strand); invalid rows are dropped.

    '.' and '?' are the unknown strand, which counts as forward; any other sign
    than these, '+' and '-' is an error.
    """
    known = F.when(F.col("strand").isin("+", "-"), F.col("strand")).when(F.col("strand").isin(".", "?") | F.col("strand").isNull(), F.lit("+"))
    strand = F.coalesce(known, F.raise_error(F.concat(F.lit("not a strand: "), F.col("strand"))).cast("string"))
    pos = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    return bed.where("chrom is not null and chrom != '' and start >= 0").select("chrom", pos.cast("long").alias("pos"), strand.alias("strand"), (F.col("end") - F.col("start")).cast("long").alias("length"))


def fragments_of(pairs: DataFrame) -> DataFrame:
    """(chrom, left, right, n) with left <= right; counts are reduced modulo 65536, no count is one."""
    n = F.pmod(F.col("count").cast("long"), F.lit(COUNT_MODULUS)) if "count" in pairs.columns else F.lit(1).cast("long")
    left, right = F.least("left", "right").cast("long"), F.greatest("left", "right").cast("long")
    return pairs.where("chrom is not null and chrom != ''").select("chrom", left.alias("left"), right.alias("right"), n.alias("n"))


def collapse(reads: DataFrame, keys: tuple[str, ...] = ("chrom", "pos", "strand")) -> DataFrame:
    """One row for each place, with how many reads lie there (or the sum of ``n``)."""
    n = F.sum("n") if "n" in reads.columns else F.count("*")
    return reads.groupBy(*keys).agg(n.cast("long").alias("n"))


def filter_duplicates(reads: DataFrame, keep: int | str, genome_size: float | None = None, keys: tuple[str, ...] = ("chrom", "pos", "strand")) -> DataFrame:
    """At most ``keep`` reads a place, as counts; 'all' keeps every read, 'auto' takes the binomial limit."""
    places = collapse(reads, keys)
    if keep == "all":
        return places
    return places.withColumn("n", F.least("n", F.lit(duplicate_limit(places, keep, genome_size)).cast("long")))


def duplicate_limit(places: DataFrame, keep: int | str, genome_size: float | None = None) -> int:
    """Reads that a place keeps: a number as it is, 'auto' by the binomial limit of the reads of all places."""
    if keep != "auto":
        return int(keep)
    if not genome_size:
        raise ValueError("the automatic limit needs a genome size")
    return binomial_max_duplicates(int(places.agg(F.sum("n")).first()[0] or 0), genome_size)


def duplicate_statistics(reads: DataFrame, keep: int, keys: tuple[str, ...] = ("chrom", "pos", "strand")) -> DataFrame:
    """One row: total, kept, redundant_rate (two decimals)."""
    places = collapse(reads, keys)
    total, kept = F.sum("n"), F.sum(F.least("n", F.lit(keep).cast("long")))
    return places.agg(F.coalesce(total, F.lit(0)).alias("total"), F.coalesce(kept, F.lit(0)).alias("kept"), F.round(1 - kept / total, 2).alias("redundant_rate"))


def tag_size(reads: DataFrame) -> DataFrame:
    """One row: the mean length of the reads, in whole bases."""
    return reads.agg(F.floor(F.avg("length")).alias("tag_size"))


def extend(reads: DataFrame, size: int, shift: int = 0) -> DataFrame:
    """Intervals (chrom, start, end, n) of reads extended from their shifted 5' ends in reading direction.

    A positive shift moves towards 3', a negative one towards 5'.
    """
    forward = F.col("strand") != "-"
    at = F.when(forward, F.col("pos") + shift).otherwise(F.col("pos") - shift)
    start = F.when(forward, at).otherwise(at - size)
    n = F.col("n") if "n" in reads.columns else F.lit(1).cast("long")
    return reads.select("chrom", start.alias("start"), (start + size).alias("end"), n.alias("n"))


def sample(reads: DataFrame, fraction: float, seed: int, keys: tuple[str, ...] = ("chrom", "pos", "strand")) -> DataFrame:
    """A seeded share of the reads: each is drawn by a hash of the seed, its place and its number there.

    The same reads come out however the input is partitioned.  A place's reads
    are numbered in slices of bounded length.
    """
    places = collapse(reads, keys).where("n > 0")
    sliced = places.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLICE)))).withColumn("_low", F.col("_s") * SLICE)
    each = sliced.withColumn("_i", F.explode(F.sequence(F.col("_low") + 1, F.least("n", F.col("_low") + SLICE))))
    hashed = F.pmod(F.xxhash64(F.lit(seed), *keys, "_i"), F.lit(1 << 30))
    return each.where(hashed < int(fraction * (1 << 30))).groupBy(*keys).agg(F.count("*").alias("n"))
