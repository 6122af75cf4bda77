"""The standard tables read as genomic data: line items as reads, fragments and alignments, events as signals.

All coordinates and counts are whole numbers, so that results do not depend on
the order of sums.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, pos, strand, length, treated, count) of line items; pos is the ship day since 1995."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_returnflag").alias("chrom"),
        day.alias("pos"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"),
        F.col("l_quantity").cast("long").alias("length"),
        (F.col("l_linenumber") % 2 == 1).alias("treated"),
        F.col("l_linenumber").cast("long").alias("count"),
    )


def reads(spark: SparkSession, sf_dir: str, treated: bool | None = None) -> DataFrame:
    """(chrom, pos, strand, length) of all items, or of one side."""
    found = items(spark, sf_dir)
    return (found if treated is None else found.where(F.col("treated") == treated)).select("chrom", "pos", "strand", "length")


def fragments(spark: SparkSession, sf_dir: str, treated: bool | None = None) -> DataFrame:
    """(chrom, left, right, count)."""
    found = items(spark, sf_dir)
    found = found if treated is None else found.where(F.col("treated") == treated)
    return found.select("chrom", F.col("pos").alias("left"), (F.col("pos") + F.col("length")).alias("right"), "count")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, pos, ts) of events; pos is the minute since 2024."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp_ltz")) - F.unix_seconds(F.to_timestamp_ltz(F.lit("2024-01-01 00:00:00")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("chrom"), F.floor(seconds / 60).alias("pos"), "ts", "event_type")


#: Letters of an alignment made of a line item, and of how many places one has a variant.
LETTERS, EVERY = 60, 97


def _drawn(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


@functools.lru_cache(maxsize=1 << 16)
def base(chrom: str, pos: int) -> str:
    """The made genome's letter at a place."""
    return "ACGT"[_drawn(f"{chrom}:{pos}") % 4]


@functools.lru_cache(maxsize=1 << 16)
def variant(chrom: str, pos: int) -> tuple[str, str, bool] | None:
    """(reference, alternative, whether every read has it) of the variant that begins at a place."""
    h = _drawn(f"{chrom}!{pos}")
    if h % EVERY:
        return None
    h //= EVERY
    kind, size, always, here = h % 3, 1 + h // 3 % 6, h // 18 % 2 == 0, base(chrom, pos)
    if kind == 0:
        return here, "ACGT"[("ACGT".index(here) + 1 + h // 36 % 3) % 4], always
    more = "".join(base(chrom, pos + 1 + i) for i in range(size))
    return (here, here + more[::-1], always) if kind == 1 else (here + more, here, always)


def aligned(chrom: str, pos: int, carries: bool) -> tuple[int, str, str, str]:
    """(end, cigar, seq, md) of a read over ``LETTERS`` of the genome from a place, with every read's variants or, if it ``carries`` them, all."""
    seq, steps, md, same, p = "", [], "", 0, pos
    while p < pos + LETTERS:
        ref, alt, always = variant(chrom, p) or (base(chrom, p), base(chrom, p), True)
        if not (always or carries) or p + len(ref) > pos + LETTERS:
            ref = alt = base(chrom, p)
        seq += alt
        same, md = (same + 1, md) if ref[0] == alt[0] else (0, md + f"{same}{ref[0]}")
        steps += "M" + "I" * (len(alt) - len(ref)) + "D" * (len(ref) - len(alt))
        if len(ref) > len(alt):
            same, md = 0, md + f"{same}^{ref[1:]}"
        p += len(ref)
    cigar, k = "", 0
    while k < len(steps):
        n = next((i for i in range(k, len(steps)) if steps[i] != steps[k]), len(steps)) - k
        cigar, k = cigar + f"{n}{steps[k]}", k + n
    return p, cigar, seq, md + str(same)


def alignments(spark: SparkSession, sf_dir: str, treated: bool) -> DataFrame:
    """Alignments (name, flag, chrom, pos, end, mapq, cigar, seq, quals, md, n) of line items; of the treated ones those of even quantities carry all variants, of the others none but those that every read has.

    Items of a place that carry the same give the same alignment, which is made once; ``n`` tells of how many items.
    """
    rows = items(spark, sf_dir).where(F.col("treated") == treated).where("chrom is not null and pos is not null")
    carries = F.coalesce(F.col("length") % 2 == 0, F.lit(False)) if treated else F.lit(False)
    alike = rows.groupBy("chrom", "pos", carries.alias("carries")).agg(F.count("*").alias("n"))

    def run(batches):
        for pdf in batches:
            made = [aligned(c, int(p), bool(x)) for c, p, x in zip(pdf["chrom"], pdf["pos"], pdf["carries"])]
            end, cigar, seq, md = zip(*made) if made else ([],) * 4
            yield pd.DataFrame({"name": "", "flag": 0, "chrom": pdf["chrom"], "pos": pdf["pos"], "end": list(end), "mapq": 60, "cigar": list(cigar), "seq": list(seq), "quals": [[40] * len(x) for x in seq], "md": list(md), "n": pdf["n"]})

    return alike.mapInPandas(run, "name string, flag int, chrom string, pos long, end long, mapq int, cigar string, seq string, quals array<int>, md string, n long")
