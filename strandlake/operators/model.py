"""Fragment-length model: the offset at which forward and reverse reads agree best."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import stored
from .regions import islands, overlapping
from .tracks import coverage

#: Bins of a tile whose strands are correlated at once, and bits of a count that one transform takes.
TILE, LIMB = 1 << 16, 12


def _agreement(forward: np.ndarray, reverse: np.ndarray, span: int) -> np.ndarray:
    """At each offset 1 to ``span``, the sum over places of ``forward[i] * reverse[i + offset]``, in whole numbers.

    One fast Fourier correlation a pair of limbs: counts are cut into limbs of
    ``LIMB`` bits, so the transform's error stays far below a half and rounding
    makes the sums exact.
    """
    size, reach = 1 << int(len(forward) + len(reverse)).bit_length(), min(span, len(reverse) - 1)
    limbs = lambda counts: [np.fft.rfft((counts >> k & (1 << LIMB) - 1).astype(float), size) for k in range(0, max(1, int(counts.max()).bit_length()), LIMB)]
    sums = np.zeros(span, dtype=np.int64)
    for i, one in enumerate(limbs(forward)):
        for j, other in enumerate(limbs(reverse)):
            both = np.fft.irfft(np.conj(one) * other, size)[1 : reach + 1]
            sums[:reach] += np.rint(both).astype(np.int64) << LIMB * (i + j)
    return sums


def strand_agreement(reads: DataFrame, longest: int, bin_width: int = 1, tile: int = TILE) -> DataFrame:
    """(offset, pairs): how many forward and reverse 5' ends lie each offset apart, weighted by their counts.

    Positions are brought to bins and counted first.  A chromosome is cut into
    tiles; a forward end lies in its own, a reverse end also in the tile before where
    a forward end of that one may reach it, so each pair is counted once.  Within a
    tile the counts are correlated, so the work follows the tiles that hold reads,
    not the pairs of reads: a place with any number of reads costs as much as one.
    Rows without chrom, pos or strand do not count; offsets without pairs have no row.
    """
    n = F.col("n") if "n" in reads.columns else F.lit(1).cast("long")
    span = -(-longest // bin_width)
    if span < 1:
        raise ValueError("the longest offset is at least one")
    width = max(tile, span)
    placed = reads.where("chrom is not null and pos is not null and strand is not null")
    ends = placed.select("chrom", F.floor(F.col("pos") / bin_width).alias("at"), (F.col("strand") == "-").alias("back"), n.cast("long").alias("n")).groupBy("chrom", "at", "back").agg(F.sum("n").alias("n"))
    own = F.floor(F.col("at") / F.lit(width))
    tiles = F.when(F.col("back") & (F.col("at") - own * width < span), F.array(own - 1, own)).otherwise(F.array(own))
    spread = ends.where("n > 0").withColumn("tile", F.explode(tiles))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        at, n, back = pdf["at"].to_numpy(), pdf["n"].to_numpy(), pdf["back"].to_numpy(dtype=bool)
        if back.all() or not back.any():
            return pd.DataFrame({"step": [], "pairs": []}).astype("int64")
        low = at.min()
        sides = []
        for mine in (~back, back):
            counts = np.zeros(at[mine].max() - low + 1, dtype=np.int64)
            counts[at[mine] - low] = n[mine]
            sides.append(counts)
        sums = _agreement(*sides, span)
        return pd.DataFrame({"step": np.flatnonzero(sums) + 1, "pairs": sums[sums != 0]})

    found = spread.groupBy("chrom", "tile").applyInPandas(work, "step long, pairs long")
    return found.groupBy((F.col("step") * bin_width).alias("offset")).agg(F.sum("pairs").alias("pairs"))


def fragment_length(reads: DataFrame, longest: int = 600, bin_width: int = 1) -> DataFrame:
    """One row: d, the offset with most pairs (the smallest of several), and how many."""
    best = F.max(F.struct("pairs", (-F.col("offset")).alias("low")))
    return strand_agreement(reads, longest, bin_width).agg(best.alias("m")).select((-F.col("m.low")).alias("d"), F.col("m.pairs").alias("pairs"))


def strand_peaks(reads: DataFrame, genome_size: float, fold_range: tuple[float, float] = (5, 50), band: int = 300) -> DataFrame:
    """(chrom, strand, center) of each strand's enriched stretches.

    Reads of one strand are counted in windows of ``2 * band`` around each base; a
    stretch is where the count is at least the low end of the fold range times
    what the genome has on average, and it is taken where its highest count is
    not above the high end.  Its center is its middle.
    """
    reads = reads.where("chrom is not null and pos is not null and strand is not null")
    n = F.col("n") if "n" in reads.columns else F.lit(1).cast("long")
    width = 2 * band
    around = reads.select(F.concat_ws("\t", "strand", "chrom").alias("chrom"), (F.col("pos") - band).alias("start"), (F.col("pos") + band).alias("end"), n.alias("n"))
    totals = reads.groupBy("strand").agg(F.sum(n).alias("total"))
    runs = coverage(around, F.col("n")).withColumn("strand", F.substring_index("chrom", "\t", 1))
    folds = runs.join(F.broadcast(totals), "strand").withColumn("fold", F.col("value") / (F.col("total") * width / F.lit(float(genome_size)))).where(F.col("fold") >= fold_range[0])
    folds = stored(folds, "strand-folds")
    ends = (F.min("start") + F.max("end")).alias("ends")
    found = islands(folds, 0).groupBy("chrom", "strand", "region").agg(F.max("fold").alias("top"), ends).where(F.col("top") <= fold_range[1])
    return found.select(F.substring_index("chrom", "\t", -1).alias("chrom"), "strand", F.floor(F.col("ends") / 2).alias("center"))


def paired_peaks(reads: DataFrame, genome_size: float, fold_range: tuple[float, float] = (5, 50), band: int = 300) -> DataFrame:
    """(chrom, middle) of forward stretches with the nearest reverse one at most ``2 * band`` to their right."""
    if len(fold_range) != 2:
        raise ValueError("the fold range has a low and a high end")
    peaks = stored(strand_peaks(reads, genome_size, fold_range, band), "strand-peaks")
    span = 2 * band
    cell = F.floor(F.col("center") / span)
    forward = peaks.where("strand != '-'").select("chrom", F.col("center").alias("a"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    reverse = peaks.where("strand = '-'").select("chrom", F.col("center").alias("b"), cell.alias("cell"))
    near = forward.join(reverse, ["chrom", "cell"]).where(f"b > a and b - a <= {span}")
    return near.groupBy("chrom", "a").agg(F.min("b").alias("b")).select("chrom", F.floor((F.col("a") + F.col("b")) / 2).alias("middle"))


def model_length(reads: DataFrame, genome_size: float, fold_range: tuple[float, float] = (5, 50), band: int = 300, smoothing: int = 10) -> DataFrame:
    """One row: d, the offset at which reads around paired peaks agree best, and how many pairs there are.

    Forward and reverse 5' ends within ``band`` of a pair's middle are set
    against each other; the counts by offset are summed over neighbours up to
    ``smoothing`` away, and of several best offsets the smallest is d.  Without
    pairs d is null.
    """
    pairs = stored(paired_peaks(reads, genome_size, fold_range, band), "paired-peaks").withColumn("start", F.col("middle") - band).withColumn("end", F.col("middle") + band).withColumn("pair", F.concat_ws(":", "chrom", "middle"))
    inside = overlapping(reads, pairs.select("chrom", "start", "end", "pair"))
    around = inside.select(F.col("pair").alias("chrom"), (F.col("pos") - F.col("start")).alias("pos"), "strand", (F.col("n") if "n" in reads.columns else F.lit(1).cast("long")).alias("n"))
    offsets = strand_agreement(around, 2 * band)
    spread = offsets.withColumn("at", F.explode(F.sequence(F.col("offset") - smoothing, F.col("offset") + smoothing))).where("at > 0").groupBy("at").agg(F.sum("pairs").alias("pairs"))
    best = spread.agg(F.max(F.struct("pairs", (-F.col("at")).alias("low"))).alias("m"))
    return best.select((-F.col("m.low")).alias("d"), F.lit(pairs.count()).cast("long").alias("n_pairs"))
