"""Readers of interval text formats; gzip comes with Spark's text sources.

Lines that are blank, comments, ``track`` or ``browser`` lines are skipped.  A
line that does not parse goes to ``_bad`` where ``keep_bad`` asks for it, and is
dropped otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIP = r"^\s*$|^#|^track(\s|$)|^browser(\s|$)"
LAYOUTS = {
    "bed": (("chrom", "string"), ("start", "long"), ("end", "long"), ("name", "string"), ("score", "string"), ("strand", "string")),
    "bedpe": (("chrom", "string"), ("left", "long"), ("right", "long")),
    "frag": (("chrom", "string"), ("left", "long"), ("right", "long"), ("barcode", "string"), ("count", "long")),
    "bedgraph": (("chrom", "string"), ("start", "long"), ("end", "long"), ("value", "double")),
}
#: Columns that must be there for a line to count.
NEEDED = {"bed": 3, "bedpe": 3, "frag": 5, "bedgraph": 4}


def _fields(line: Column, kind: str) -> Column:
    """The fields of a line: at any white space in bedGraph, at tabs after trimming the right side elsewhere."""
    return F.split(F.trim(line), r"\s+") if kind == "bedgraph" else F.split(F.regexp_replace(line, r"\s+$", ""), "\t")


def read_lines(lines: DataFrame, kind: str, keep_bad: bool = False) -> DataFrame:
    """Rows of a layout from a table with a text column ``value``."""
    layout = LAYOUTS[kind]
    rows = lines.where(~F.col("value").rlike(SKIP)).select(F.col("value").alias("_line"), _fields(F.col("value"), kind).alias("_f"))
    columns = [F.expr(f"try_cast(get(_f, {i}) as {t})").alias(n) for i, (n, t) in enumerate(layout)]
    parsed = rows.select("_line", F.size("_f").alias("_n"), *columns)
    must = [F.col(n).isNotNull() for n, t in layout[: NEEDED[kind]]]
    good = F.col("_n") >= NEEDED[kind]
    for m in must:
        good = good & m
    names = [n for n, _ in layout]
    if keep_bad:
        return parsed.select(*[F.when(good, F.col(n)).alias(n) for n in names], F.when(~good, F.col("_line")).alias("_bad"))
    return parsed.where(good).select(*names)


def read(spark: SparkSession, paths: str | list[str], kind: str, keep_bad: bool = False) -> DataFrame:
    """Rows of text files of a known kind; several paths are replicates read as one."""
    return read_lines(spark.read.text(paths), kind, keep_bad)


def sniff(spark: SparkSession, path: str) -> str:
    """The kind of a file, from its first lines that count."""
    head = [r[0] for r in spark.read.text(path).where(~F.col("value").rlike(SKIP)).limit(20).collect()]
    if not head:
        return "bed"
    tabs = [line.rstrip().split("\t") for line in head]
    number = lambda x: x.lstrip("-").isdigit()
    if all(len(f) == 5 and number(f[1]) and number(f[2]) and number(f[4]) for f in tabs):
        return "frag"
    if all(len(f) == 3 and number(f[1]) and number(f[2]) for f in tabs):
        return "bedpe"
    if all(len(line.split()) == 4 for line in head) and not all(len(f) == 4 and f[3] in "+-." for f in tabs):
        return "bedgraph"
    return "bed"
