"""Sinks: the text layouts of peaks, summits and tracks.

Text peaks are zero-based and half-open; tables of the spreadsheet kind have
one-based starts and summits.  Numbers print with six significant digits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window


def _six_digits(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"{v:.6g}")


def six_digits(column: Column | str) -> Column:
    """A number in six significant digits without trailing zeros."""
    return F.pandas_udf(_six_digits, StringType())(column)


def _row(*columns) -> Column:
    return F.concat_ws("\t", *[c if isinstance(c, Column) else F.lit(c) for c in columns]).alias("value")


def _score(q: str = "q") -> Column:
    return F.floor(F.col(q) * 10).cast("long").cast("string")


def narrow_peak(peaks: DataFrame) -> DataFrame:
    """Ten columns: place, name, score, strand, fold enrichment, p, q, summit offset."""
    return _ordered(peaks).select(_row(F.col("chrom"), F.col("start"), F.col("end"), F.col("name"), _score(), ".", six_digits("fe"), six_digits("p"), six_digits("q"), (F.col("summit") - F.col("start")).cast("string")))


def broad_peak(peaks: DataFrame) -> DataFrame:
    """Nine columns, as the narrow layout without the summit."""
    return _ordered(peaks).select(_row(F.col("chrom"), F.col("start"), F.col("end"), F.col("name"), _score(), ".", six_digits("fe"), six_digits("p"), six_digits("q")))


def gapped_peak(peaks: DataFrame) -> DataFrame:
    """Twelve BED columns with the blocks, then fold enrichment, p and q."""
    numbers = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return _ordered(peaks).select(
        _row(F.col("chrom"), F.col("start"), F.col("end"), F.col("name"), _score(), ".", "0", "0", "0", F.col("block_count"), numbers("block_sizes"), numbers("block_starts"), six_digits("fe"), six_digits("p"), six_digits("q"))
    )


def summits(peaks: DataFrame) -> DataFrame:
    """Five columns: the summit's base, name, q."""
    return _ordered(peaks).select(_row(F.col("chrom"), F.col("summit"), F.col("summit") + 1, F.col("name"), six_digits("q")))


def peak_table(peaks: DataFrame) -> DataFrame:
    """The spreadsheet rows, one-based, with a summit column where the peaks have one."""
    middle = [(F.col("summit") + 1).cast("string")] if "summit" in peaks.columns else []  # which broad peaks have not
    return _ordered(peaks).select(_row(F.col("chrom"), F.col("start") + 1, F.col("end"), F.col("end") - F.col("start"), *middle, six_digits("pileup"), six_digits("p"), six_digits("fe"), six_digits("q"), F.col("name")))


def bedgraph(track: DataFrame, value: str = "value", single: bool = False) -> DataFrame:
    """Four columns, values with five decimals; with ``single`` the values are those of single precision."""
    number = F.col(value).cast("float").cast("double") if single else F.col(value).cast("double")
    return _ordered(track).select(_row(F.col("chrom"), F.col("start"), F.col("end"), F.format_string("%.5f", number)))


def bed_reads(reads: DataFrame, length: int) -> DataFrame:
    """Six columns of reads, forward strand first, then by position."""
    start = F.when(F.col("strand") == "-", F.col("pos") - length).otherwise(F.col("pos"))
    return reads.orderBy("chrom", F.col("strand") == "-", "pos").select(_row(F.col("chrom"), start, start + length, ".", ".", F.col("strand")))


def table_columns(broad: bool = False) -> str:
    """The line of column names of the spreadsheet rows."""
    return "\t".join(["chr", "start", "end", "length", *([] if broad else ["abs_summit"]), "pileup", "-log10(pvalue)", "fold_enrichment", "-log10(qvalue)", "name"])


def track_line(name: str, description: str) -> str:
    """The heading that region files carry even where they are empty."""
    return f'track name="{name}" description="{description}" visibility=1'


def with_heading(lines: DataFrame, heading: list[str]) -> DataFrame:
    """The heading's lines in a partition of their own before the others, so that they are there where there are no others."""
    spark = lines.sparkSession
    return spark.createDataFrame([(x,) for x in heading], "value string").coalesce(1).union(lines)


#: The line above a table of cutoffs (fixed value).
CUTOFF_COLUMNS = "pscore\tqscore\tnpeaks\tlpeaks\tavelpeak"


def cutoff_table(found: DataFrame) -> DataFrame:
    """Five columns, the highest cutoff first, scores and the mean length with two decimals."""
    two = lambda c: F.format_string("%.2f", c)
    return found.orderBy(F.desc("pscore")).select(_row(two("pscore"), two("qscore"), F.col("npeaks").cast("string"), F.col("lpeaks").cast("string"), two("avelpeak")))


def condition_regions(found: DataFrame, kind: str, name: str) -> DataFrame:
    """The regions of one kind of difference: a heading, then place, numbered name and score with five decimals."""
    rows = _ordered(found.where(F.col("kind") == kind))
    number = F.row_number().over(Window.partitionBy("chrom").orderBy("start", "end"))
    lines = rows.select("chrom", "start", "end", number.alias("number"), "score").orderBy("chrom", "start", "end")
    named = F.concat(F.lit(f"{name}_{kind}_"), F.col("chrom"), F.lit("_"), F.col("number"))
    return with_heading(lines.select(_row(F.col("chrom"), F.col("start"), F.col("end"), named, F.format_string("%.5f", F.col("score").cast("double")))), [track_line(name, f"regions of kind {kind}")])


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("chrom", "start", "end")


def write(lines: DataFrame, path: str) -> None:
    """The lines as text parts in order."""
    lines.write.mode("overwrite").text(path)
