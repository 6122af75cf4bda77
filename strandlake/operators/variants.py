"""Variants inside regions: base counts by position and the likelihood of three genotypes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bam import aligned_bases
from .regions import overlapping

#: Alignments with any of these flags are left out: unmapped, secondary, failed, duplicate, supplementary.
SKIPPED = 0x4 | 0x100 | 0x200 | 0x400 | 0x800


def reads_in(alignments: DataFrame) -> Column:
    """How many reads an alignment stands for: its ``n``, or one."""
    return (F.col("n") if "n" in alignments.columns else F.lit(1)).cast("long").alias("n")


def base_counts(alignments: DataFrame, regions: DataFrame, least_mapq: int = 20, least_quality: int = 20) -> DataFrame:
    """(chrom, pos, ref, base, n, error) of the bases inside regions, by position.

    ``error`` sums the error probabilities of the bases' qualities.  Counts are
    partial in each batch and on each task, so a deep position is a few rows.
    Alignments with a column ``n`` stand for so many reads alike.
    """
    used = alignments.where((F.col("flag").bitwiseAND(SKIPPED) == 0) & (F.col("mapq") >= least_mapq) & F.col("md").isNotNull())
    schema = "chrom string, pos long, base string, quality int, ref string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for r in batch.to_pylist():
                for p, b, q, ref in aligned_bases(r["pos"], r["cigar"], r["seq"], r["quals"], r["md"]):
                    if q >= least_quality:
                        counts[r["chrom"], p, b, q, ref] += r["n"]
            columns = [*(list(zip(*counts)) or [[]] * 5), list(counts.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["chrom", "pos", "base", "quality", "ref", "n"])

    bases = used.select("chrom", "pos", "cigar", "seq", "quals", "md", reads_in(used)).mapInArrow(run, schema)
    counted = bases.groupBy("chrom", "pos", "ref", "base").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.lit(10.0), -F.col("quality") / 10)).alias("error"))
    inside = overlapping(counted, regions.select("chrom", "start", "end"))
    return inside.select("chrom", "pos", "ref", "base", "n", "error").distinct()


def call_variants(counts: DataFrame, least_depth: int = 4, least_score: float = 2.0) -> DataFrame:
    """(chrom, pos, ref, alt, genotype, depth, alt_n, score) where another base than the reference is likelier.

    The most frequent other base stands against the reference as homozygous or
    heterozygous; score is the log10 likelihood ratio over no variant.
    """
    alt = F.max(F.when(F.col("base") != F.col("ref"), F.struct("n", "base")))
    sites = counts.groupBy("chrom", "pos", "ref").agg(F.sum("n").alias("depth"), F.sum("error").alias("error"), alt.alias("m"), F.sum(F.when(F.col("base") == F.col("ref"), F.col("n")).otherwise(0)).alias("ref_n"))
    sites = sites.where(F.col("m").isNotNull() & (F.col("depth") >= least_depth)).withColumn("alt_n", F.col("m.n"))
    e = F.greatest(F.col("error") / F.col("depth"), F.lit(1e-6))
    log = lambda p, k: F.col(k) * F.log10(p)
    none = log(1 - e, "ref_n") + log(e / 3, "alt_n")
    het = (F.col("ref_n") + F.col("alt_n")) * F.log10(F.lit(0.5) * (1 - e) + e / 6)
    hom = log(e / 3, "ref_n") + log(1 - e, "alt_n")
    scored = sites.withColumn("het", het - none).withColumn("hom", hom - none)
    genotype = F.when(F.col("hom") > F.col("het"), "1/1").otherwise("0/1")
    return scored.select("chrom", "pos", "ref", F.col("m.base").alias("alt"), genotype.alias("genotype"), "depth", "alt_n", F.greatest("het", "hom").alias("score")).where(F.col("score") >= least_score)
