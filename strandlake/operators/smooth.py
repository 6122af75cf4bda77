"""Sub-summits: a smoothed first derivative's falling zero crossings, from the runs of a track.

The smoothed slope at a base is a sum over the steps of the signal that lie in the
window: a step ``d`` at ``b`` adds ``d * (h(h+1) - (b-i)(b-i-1)) / 2`` at base
``i``, where ``h`` is half the window, and nothing from ``h`` bases away on.
Between the places where steps come and go the slope is a parabola in ``i`` whose
coefficients are sums of ``d``, ``d*b`` and ``d*b*b``, which one sweep gives, so its
sign is known at every base without a row for each base.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import stored
from .regions import overlapping
from .tracks import BIN, sweep

#: Bases that coverage is smoothed over at least.
NARROWEST = 51
#: Heights are taken in millionths, so that sums are whole numbers and do not depend on their order.
MILLION = 1_000_000
WHOLE = "decimal(38,0)"


def savitzky_golay_slope(signal: np.ndarray, window: int) -> np.ndarray:
    """First derivative of the least-squares parabola over a centred window; ends are padded by their values.

    For a parabola over evenly spaced points the slope at the centre is the
    offsets' dot product with the signal over the offsets' sum of squares.
    """
    signal = np.asarray(signal, np.float64)
    window = max(3, window | 1)
    half = window // 2
    offsets = np.arange(-half, half + 1, dtype=np.float64)
    padded = np.concatenate((np.full(half, signal[0]), signal, np.full(half, signal[-1])))
    return np.correlate(padded, offsets / (offsets @ offsets), mode="valid")


def maxima(signal: np.ndarray, window: int = 51) -> np.ndarray:
    """Positions where the smoothed slope turns from rising to not rising."""
    if len(signal) < 3:
        return np.array([int(np.argmax(signal))] if len(signal) else [], np.int64)
    slope = savitzky_golay_slope(signal, window)
    slope[np.abs(slope) < 1e-12] = 0
    sign = np.sign(slope)
    turns = np.flatnonzero((sign[:-1] > 0) & (sign[1:] <= 0))
    return turns + (sign[turns + 1] == 0)


def peak_runs(peaks: DataFrame, track: DataFrame) -> DataFrame:
    """(chrom, s, e, v): the runs of a track within each peak; ``chrom`` is the peak (chrom, ps, pe, name), ``v`` in millionths.

    Peaks and runs meet in bins of the coordinate, each pair in the first bin that both touch.
    """
    width = 1 << 14
    cover = lambda d, low, high: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    left = cover(peaks.where("end > start").select("chrom", F.col("start").cast("long").alias("ps"), F.col("end").cast("long").alias("pe"), "name").distinct(), "ps", "pe")
    right = cover(track.where("end > start and value is not null").select(F.col("chrom").alias("_chrom"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").cast("double").alias("value")), "start", "end").withColumnRenamed("_bin", "_at")
    inside = left.join(right, (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_at"))).where("start < pe and end > ps")
    inside = inside.where(F.col("_bin") == F.floor(F.greatest("start", "ps") / width))
    return inside.select(F.struct("chrom", "ps", "pe", "name").alias("chrom"), F.greatest("start", "ps").alias("s"), F.least("end", "pe").alias("e"), F.round(F.col("value") * MILLION).cast(WHOLE).alias("v"))


def slope_runs(runs: DataFrame, window: int, bin_width: int = BIN) -> DataFrame:
    """(chrom, start, end, a0, a1, a2, here, ahead): stretches of bases in which the smoothed slope is one parabola.

    Of ``peak_runs``.  ``a0``, ``a1`` and ``a2`` are the sums of d, d*b and d*b*b over the steps of the
    window, b counted from the peak's start; they hold at both ends of a stretch.
    ``here`` and ``ahead`` are the height at its bases and at the one after each.
    A signal goes on at its ends as it is there.
    """
    half = max(3, window | 1) // 2
    ends = F.array(F.struct(F.col("s").alias("b"), F.col("v").alias("d")), F.struct(F.col("e").alias("b"), (-F.col("v")).cast(WHOLE).alias("d")))
    steps = runs.select("chrom", F.explode(ends).alias("x")).groupBy("chrom", F.col("x.b").alias("b")).agg(F.sum("x.d").cast(WHOLE).alias("d")).where("d != 0")
    offset = (F.col("b") - F.col("chrom.ps")).cast(WHOLE)
    sums = [F.col("d"), (F.col("d") * offset).cast(WHOLE), (F.col("d") * offset * offset).cast(WHOLE)]
    none = F.lit(0).cast(WHOLE)

    def event(at: Column, sign: int, slope: bool, here: bool, ahead: bool) -> Column:
        parts = [(c * sign).cast(WHOLE) if slope else none for c in sums] + [F.col("d") if x else none for x in (here, ahead)]
        return F.struct(at.alias("pos"), *[c.alias(n) for c, n in zip(parts, NAMES)])

    inner = (F.col("b") > F.col("chrom.ps")) & (F.col("b") < F.col("chrom.pe"))
    level = F.array(event(F.col("b"), 1, False, True, False), event(F.col("b") - 1, 1, False, False, True))
    slope = F.array(event(F.col("b") - half - 1, 1, True, False, False), event(F.col("b") + half, -1, True, False, False))
    events = steps.select("chrom", F.explode(F.when(inner, F.concat(level, slope)).otherwise(level)).alias("e")).select("chrom", "e.*")
    return sweep(events, NAMES, bin_width)


NAMES = ["a0", "a1", "a2", "here", "ahead"]


def turns(runs: DataFrame, window: int, bin_width: int = BIN) -> DataFrame:
    """(chrom, summit, height) where the smoothed slope of each peak turns from rising to not rising.

    Of ``peak_runs``.  Bases near a parabola's roots are tried, with whole numbers.
    """
    half = max(3, window | 1) // 2
    parts = slope_runs(runs, window, bin_width)
    low, high = F.greatest("start", "chrom.ps"), F.least(F.col("end"), F.col("chrom.pe") - 1)
    parts = parts.where("a0 != 0 or a1 != 0 or a2 != 0").withColumn("low", low).withColumn("size", high - low).where("size > 0")
    moved = (F.col("low") - F.col("chrom.ps")).cast("decimal(12,0)")
    parts = parts.withColumn("b2", (F.col("a2") - F.col("a1") * (2 * moved) + F.col("a0") * moved * moved).cast(WHOLE)).withColumn("b1", (F.col("a1") - F.col("a0") * moved).cast(WHOLE))
    # Twice the slope, but for a factor above zero, at u bases from ``low``: exact.
    twice = lambda u: (F.col("a0") * (F.lit(half * (half + 1)) - u * u - u) + F.col("b1") * (2 * u + 1) - F.col("b2")).cast(WHOLE)
    a, b, c = -F.col("a0").cast("double"), (2 * F.col("b1") - F.col("a0")).cast("double"), twice(F.lit(0).cast("decimal(12,0)")).cast("double")
    spread = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    roots = F.when(a != 0, F.array((-b - spread) / (2 * a), (-b + spread) / (2 * a))).when(b != 0, F.array(-c / b)).otherwise(F.array().cast("array<double>"))
    near = F.flatten(F.transform(roots, lambda r: F.transform(F.array(*[F.lit(k) for k in (-2, -1, 0, 1)]), lambda k: (F.floor(r) + k).cast("long"))))
    tried = parts.withColumn("u", F.explode(F.array_distinct(F.filter(near, lambda u: (u >= 0) & (u < F.col("size"))))))
    u = F.col("u").cast("decimal(12,0)")
    found = tried.where(twice(u) > 0).withColumn("_next", twice(u + 1)).where("_next <= 0")
    summit = F.col("low") + F.col("u") + F.when(F.col("_next") == 0, 1).otherwise(0)
    height = F.when(summit < F.col("end"), F.col("here")).otherwise(F.col("ahead"))
    return found.select("chrom", summit.alias("summit"), height.alias("height"))


def letters(number: Column) -> Column:
    """a, b, ..., z, aa, ab, ... for 1, 2, ..., 26, 27, 28, ...; up to five letters."""
    text, left = F.lit(""), number.cast("long")
    for _ in range(5):
        text = F.concat(F.when(left > 0, F.chr(F.pmod(left - 1, F.lit(26)) + 97)).otherwise(""), text)
        left = F.when(left > 0, F.floor((left - 1) / 26)).otherwise(F.lit(0))
    return text


def sub_summits(peaks: DataFrame, track: DataFrame, window: int = 51, least_share: float = 0.0, bin_width: int = BIN) -> DataFrame:
    """(chrom, start, end, name, summit, height) for each maximum inside each peak.

    A peak with several gets the letters a, b, ... after its name (aa follows z),
    one without any its first highest base.  ``track`` (chrom, start, end, value)
    has runs that do not overlap, no values below zero, and is zero between them; heights are
    taken in millionths.  Work follows the runs and is spread over bins of the
    coordinate, whatever a peak's length.  Peaks that no run touches are left out.
    """
    runs = stored(peak_runs(peaks, track), "peak-runs")
    best = runs.groupBy("chrom").agg(F.max(F.struct("v", (-F.col("s")).alias("low"))).alias("top"))
    best = best.select(F.col("chrom").alias("_peak"), F.greatest(F.col("top.v"), F.lit(0).cast(WHOLE)).alias("_v"), F.when(F.col("top.v") > 0, -F.col("top.low")).otherwise(F.col("chrom.ps")).alias("_at"))
    long = runs.where(F.col("chrom.pe") - F.col("chrom.ps") >= 3)
    every = best.join(turns(long, window, bin_width), F.col("chrom") == F.col("_peak"), "left")
    summit, height = F.coalesce("summit", "_at"), F.coalesce("height", "_v")
    kept = every.select(F.col("_peak.chrom").alias("chrom"), F.col("_peak.ps").alias("start"), F.col("_peak.pe").alias("end"), F.col("_peak.name").alias("name"), summit.alias("summit"), height.alias("height"), "_v")
    kept = kept.where(F.col("height").cast("double") >= least_share * F.col("_v").cast("double"))
    peak = ["chrom", "start", "end", "name"]
    order = Window.partitionBy(*peak).orderBy("summit")
    several = F.count("*").over(Window.partitionBy(*peak)) > 1
    name = F.when(several, F.concat("name", letters(F.row_number().over(order)))).otherwise(F.col("name"))
    return kept.select("chrom", "start", "end", name.alias("name"), "summit", (F.col("height").cast("double") / MILLION).alias("height"))


def at_summits(peaks: DataFrame, scored: DataFrame, window: int) -> DataFrame:
    """Named peaks (chrom, start, end, name) by their sub-summits: (chrom, start, end, summit, pileup, p, fe, q, name), a row for each.

    The treatment's coverage is smoothed over ``window`` bases, the fragment
    length; pileup, p, fe and q are those of the scored run at the summit.
    """
    tops = sub_summits(peaks, scored.select("chrom", "start", "end", F.col("treat").alias("value")), window)
    points = tops.select("chrom", F.col("summit").alias("pos"), F.col("start").alias("_start"), F.col("end").alias("_end"), "name")
    hit = overlapping(points, scored.select("chrom", "start", "end", F.col("treat").alias("pileup"), "p", "fe", "q"))
    return hit.select("chrom", F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("pos").alias("summit"), "pileup", "p", "fe", "q", "name")
