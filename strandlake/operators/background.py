"""Treatment coverage with its local background: the wide sweep behind enrichment scores.

One sweep carries treatment and control windows together, so no range join is
needed.  Counts are summed as whole numbers and weighted afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reads import extend
from .tracks import BIN, compact, sweep


@dataclass(frozen=True)
class Background:
    """How the local rate is taken: window widths, genome size, scaling."""

    genome_size: float
    fragment: int
    small: int = 1_000
    large: int = 10_000
    scale_to: str = "small"
    local: bool = True
    shift: int = 0
    clamp: bool = True


def scales(treat_total: float, control_total: float, scale_to: str) -> tuple[float, float]:
    """Multipliers of treatment and control that bring them to one depth."""
    if not treat_total or not control_total:
        return 1.0, 1.0
    treat_larger = treat_total > control_total
    if scale_to == "small":
        return (control_total / treat_total, 1.0) if treat_larger else (1.0, treat_total / control_total)
    return (1.0, treat_total / control_total) if treat_larger else (control_total / treat_total, 1.0)


def _steps(rows: DataFrame, start, end, name: str, names: list[str], clamp: bool = True) -> DataFrame:
    """Events of intervals that add ``n`` to the column ``name``."""
    low = F.greatest(start, F.lit(0).cast("long")) if clamp else start
    zero = F.lit(0).cast("long")
    at = F.array(F.struct(low.alias("pos"), F.col("n").alias("d")), F.struct(end.alias("pos"), (-F.col("n")).alias("d")))
    return rows.where(end > low).select("chrom", F.explode(at).alias("e")).select("chrom", "e.pos", *[(F.col("e.d") if n == name else zero).alias(n) for n in names])


def _windows(ends: DataFrame, widths: dict[str, int], names: list[str], clamp: bool) -> DataFrame:
    """Events of the windows around 5' ends (chrom, pos, n), one column for each width."""
    parts = None
    for name, width in widths.items():
        half = width // 2
        part = _steps(ends, F.col("pos") - half, F.col("pos") + (width - half), name, names, clamp)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _finish(events: DataFrame, treat_end: DataFrame, names: list[str], widths: dict[str, int], how: Background, treat_scale: float, control_scale: float, base: float, share: float, bin_width: int) -> DataFrame:
    runs = sweep(events, names, bin_width)
    rates = [F.col(n) * F.lit(share * how.fragment / w * control_scale) for n, w in widths.items()] if how.local else []
    rate = F.greatest(F.lit(base), *rates) if rates else F.lit(base)
    scored = runs.select("chrom", "start", "end", (F.col("treat") * F.lit(treat_scale)).alias("treat"), rate.cast("double").alias("lambda"))
    last = treat_end.select(F.col("chrom").alias("_chrom"), "last")
    inside = scored.join(last, F.col("chrom") == F.col("_chrom")).where(F.col("start") < F.col("last")).select("chrom", "start", F.least("end", "last").alias("end"), "treat", "lambda")
    return compact(inside, ("treat", "lambda"), bin_width)


def enrich_reads(treat: DataFrame, control: DataFrame | None, how: Background, bin_width: int = BIN) -> DataFrame:
    """Runs (chrom, start, end, treat, lambda) of reads (chrom, pos, strand, n) after duplicate filtering.

    The local rate is the largest of the background and the control's coverage
    in windows of the fragment length, ``small`` and ``large`` around its 5'
    ends, each brought to the fragment length.  Without a control, treatment
    stands in for it and only the large window counts.  A track starts at zero
    and ends with the last treated base of its chromosome.
    """
    whole = F.coalesce(F.sum("n"), F.lit(0))
    treat_total = float(treat.agg(whole).first()[0])
    control_total = float(control.agg(whole).first()[0]) if control is not None else treat_total
    treat_scale, control_scale = scales(treat_total, control_total, how.scale_to) if control is not None else (1.0, 1.0)
    widths = {"d": how.fragment, "small": how.small, "large": how.large} if control is not None else {"large": how.large}
    names = ["treat", *widths]
    pieces = extend(treat, how.fragment, how.shift)
    events = _steps(pieces, F.col("start"), F.col("end"), "treat", names)
    ends = (control if control is not None else treat).select("chrom", "pos", "n")
    zero = F.lit(0).cast("long")
    events = events.unionByName(_windows(ends, widths, names, True)).unionByName(treat.select("chrom").distinct().select("chrom", zero.alias("pos"), *[zero.alias(n) for n in names]))
    treat_end = pieces.groupBy("chrom").agg(F.max("end").alias("last"))
    base = control_total * how.fragment / how.genome_size * control_scale
    return _finish(events, treat_end, names, widths, how, treat_scale, control_scale, base, 1.0, bin_width)


def enrich_fragments(treat: DataFrame, control: DataFrame | None, how: Background, bin_width: int = BIN) -> DataFrame:
    """The same for fragments (chrom, left, right, n): whole fragments are the treatment, and both ends of the
    control's fragments count half in every window.  ``clamp=False`` leaves windows that begin below zero there.
    """
    whole = F.coalesce(F.sum("n"), F.lit(0))
    treat_total = float(treat.agg(whole).first()[0])
    control_total = float(control.agg(whole).first()[0]) if control is not None else treat_total
    treat_scale, control_scale = scales(treat_total, control_total, how.scale_to) if control is not None else (1.0, 1.0)
    widths = {"d": how.fragment, "small": how.small, "large": how.large} if control is not None else {"large": how.large}
    names = ["treat", *widths]
    events = _steps(treat, F.col("left"), F.col("right"), "treat", names)
    source = control if control is not None else treat
    ends = source.select("chrom", F.explode(F.array("left", "right")).alias("pos"), "n")
    zero = F.lit(0).cast("long")
    events = events.unionByName(_windows(ends, widths, names, how.clamp)).unionByName(treat.select("chrom").distinct().select("chrom", zero.alias("pos"), *[zero.alias(n) for n in names]))
    treat_end = treat.groupBy("chrom").agg(F.max("right").alias("last"))
    base = control_total * how.fragment / how.genome_size * control_scale
    return _finish(events, treat_end, names, widths, how, treat_scale, control_scale, base, 0.5, bin_width)


def mean_fragment(fragments: DataFrame) -> float:
    """The mean length of the fragments, weighted by their counts."""
    total, n = fragments.agg(F.sum((F.col("right") - F.col("left")) * F.col("n")), F.sum("n")).first()
    return float(total) / float(n) if n else 0.0
