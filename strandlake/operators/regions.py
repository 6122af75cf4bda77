"""Regions: gaps and islands over scored runs, summits, broad and gapped regions, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import symmetric_log_likelihood_ratio
from ..plans.scratch import stored
from .tracks import BIN, align


def _before(rows: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the largest ``value`` among the rows of earlier bins, from one row a bin."""
    order = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*by, "_bin").agg(F.max(value).alias("_v")).withColumn(name, F.max("_v").over(order)).drop("_v")
    return rows.join(bins, [*by, "_bin"])


def islands(runs: DataFrame, max_gap: int, by: Sequence[str] = ("chrom",), bin_width: int = BIN) -> DataFrame:
    """Adds ``region``, the start of the island that a run belongs to.

    Runs of one key, none of them null, belong together while the gap between
    them is at most ``max_gap``.  What lies before a run is taken in two levels,
    within its bin of the coordinate and from one row for each bin before, so a
    key with most of the runs is spread over its bins.
    """
    binned = _before(runs.withColumn("_bin", F.floor(F.col("start") / F.lit(bin_width))), by, F.col("end"), "_far")
    order = Window.partitionBy(*by, "_bin").orderBy("start", "end")
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    opened = binned.withColumn("_reach", reach)
    opened = opened.withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col("start") - F.col("_reach") > max_gap), F.col("start")))
    opened = _before(opened, by, F.col("_opens"), "_open")
    own = F.max("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return opened.withColumn("region", F.coalesce(own, "_open")).drop("_bin", "_far", "_reach", "_opens", "_open")


def narrow_peaks(scored: DataFrame, cutoff: float, max_gap: int, min_length: int, score: str = "q") -> DataFrame:
    """(chrom, start, end, summit, pileup, p, fe, q) of regions above a cutoff.

    A region's summit is the middle of its run of highest pileup, of several the
    middle one; its other attributes are those at the summit.  Regions shorter
    than ``min_length`` are dropped.
    """
    strong = islands(scored.where(F.col(score) > cutoff), max_gap)
    best = Window.partitionBy("chrom", "region")
    marked = strong.withColumn("_top", F.max("treat").over(best))
    top = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("treat").alias("pileup"), "p", "fe", "q")
    regions = marked.groupBy("chrom", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.when(F.col("treat") == F.col("_top"), top))).alias("tops"))
    middle = F.element_at("tops", F.floor((F.size("tops") + 1) / 2).cast("int"))
    picked = regions.where(F.col("end") - F.col("start") >= min_length).withColumn("m", middle)
    return picked.select("chrom", "start", "end", F.floor((F.col("m.s") + F.col("m.e")) / 2).alias("summit"), "m.pileup", "m.p", "m.fe", "m.q")


def broad_peaks(scored: DataFrame, strong: float, weak: float, gap: int, weak_gap: int, min_length: int, score: str = "q") -> DataFrame:
    """(chrom, start, end, pileup, p, fe, q, blocks) of weak regions with the strong ones inside as blocks.

    The attributes are means by length over the runs above the weak cutoff.
    """
    low = islands(scored.where(F.col(score) > weak), weak_gap)
    length = F.col("end") - F.col("start")
    mean = lambda c: (F.sum(F.col(c) * length) / F.sum(length)).alias(c)
    wide = low.groupBy("chrom", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("treat") * length).alias("_t"), F.sum(length).alias("_n"), mean("p"), mean("fe"), mean("q"))
    wide = wide.where(F.col("end") - F.col("start") >= min_length).withColumn("pileup", F.col("_t") / F.col("_n"))
    core = islands(low.where(F.col(score) > strong).withColumnRenamed("region", "outer"), gap, ("chrom", "outer"))
    inner = core.groupBy("chrom", "outer", "region").agg(F.min("start").alias("s"), F.max("end").alias("e")).where(F.col("e") - F.col("s") >= min_length)
    blocks = inner.groupBy(F.col("chrom").alias("_chrom"), F.col("outer").alias("_outer")).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("blocks"))
    joined = wide.join(blocks, (F.col("chrom") == F.col("_chrom")) & (F.col("region") == F.col("_outer")), "left")
    return joined.select("chrom", "start", "end", "pileup", "p", "fe", "q", "blocks")


def gapped_peaks(broad: DataFrame) -> DataFrame:
    """Adds block_count, block_sizes, block_starts, always reaching from a region's start to its end.

    Where the strong blocks do not touch an end, a block of one base stands there.
    A region without strong blocks has its two ends only.
    """
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    own = F.coalesce("blocks", empty)
    head = F.struct(F.col("start").alias("s"), (F.col("start") + 1).alias("e"))
    tail = F.struct((F.col("end") - 1).alias("s"), F.col("end").alias("e"))
    starts = F.size(own) > 0
    first, last = F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(-1))
    full = F.concat(F.when(starts & (first["s"] == F.col("start")), empty).otherwise(F.array(head)), own, F.when(starts & (last["e"] == F.col("end")), empty).otherwise(F.array(tail)))
    return broad.withColumn("_b", full).select(
        *broad.columns, F.size("_b").alias("block_count"), F.transform("_b", lambda b: b["e"] - b["s"]).alias("block_sizes"), F.transform("_b", lambda b: b["s"] - F.col("start")).alias("block_starts")
    )


def named(peaks: DataFrame, name: str, bin_width: int = BIN) -> DataFrame:
    """Adds ``name``: numbered in order of chromosome and start.

    Numbers come from counts by chromosome and bin of the coordinate, and an
    order within each bin.
    """
    binned = peaks.withColumn("_bin", F.floor(F.col("start") / F.lit(bin_width)))
    sizes = binned.groupBy("chrom", "_bin").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = sizes.groupBy("chrom").agg(F.sum("_n").alias("_all"))
    before = whole.select(F.col("chrom").alias("_c"), F.coalesce(F.sum("_all").over(Window.partitionBy().orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    sizes = sizes.select("chrom", "_bin", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_inside")).join(before, F.col("chrom") == F.col("_c")).drop("_c")
    rank = F.row_number().over(Window.partitionBy("chrom", "_bin").orderBy("start", "end"))
    ranked = binned.withColumn("_r", rank).join(sizes, ["chrom", "_bin"])
    number = (F.col("_before") + F.col("_inside") + F.col("_r")).cast("string")
    return ranked.withColumn("name", F.concat(F.lit(f"{name}_peak_"), number)).drop("_r", "_bin", "_inside", "_before")


def threshold_regions(track: DataFrame, cutoff: float, max_gap: int, min_length: int, value: str = "value") -> DataFrame:
    """(chrom, start, end, summit, score) of a plain track's regions at or above a cutoff."""
    high = islands(track.where(F.col(value) >= cutoff), max_gap)
    found = high.groupBy("chrom", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.struct(F.col(value).alias("v"), (-F.col("start")).alias("s"), F.col("end").alias("e"))).alias("m"))
    return found.where(F.col("end") - F.col("start") >= min_length).select("chrom", "start", "end", F.floor((F.col("m.e") - F.col("m.s")) / 2).alias("summit"), F.col("m.v").alias("score"))


def _levels(start: np.ndarray, end: np.ndarray, level: np.ndarray, max_gap: int, min_length: int) -> list[tuple[int, int, int, int | None, int | None]]:
    """(level, regions, bases, start, end) of one bin's runs, in order of place: at each level above zero the islands of the runs that reach it.

    The first and the last island of the bin may go on in others, so each is a
    row of its own with its start and end; of the rest the number and the bases are told
    of those of ``min_length`` and more.  Runs are taken away from the lowest level on, which tells what
    lies beside each when it comes back, and then put back from the highest on.
    """
    size = len(start)
    rising = np.argsort(level, kind="stable").tolist()
    starts, ends, levels = start.tolist(), end.tolist(), level.tolist()
    left, right = list(range(-1, size - 1)), [*range(1, size), -1]
    for i in rising:
        if left[i] >= 0:
            right[left[i]] = right[i]
        if right[i] >= 0:
            left[right[i]] = left[i]
    root, begins, stops = list(range(size)), starts[:], ends[:]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    regions = bases = 0
    first = last = -1
    out = []

    def count(i: int, sign: int) -> None:
        nonlocal regions, bases
        if stops[i] - begins[i] >= min_length:
            regions, bases = regions + sign, bases + sign * (stops[i] - begins[i])

    def join(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            count(i, -1)
            count(j, -1)
            root[j] = i
            begins[i], stops[i] = min(begins[i], begins[j]), max(stops[i], stops[j])
            count(i, 1)

    def tell(at: int) -> None:
        edges = {find(first), find(last)}
        inner = [(regions, bases)]
        for i in edges:
            long = stops[i] - begins[i] >= min_length
            inner.append((-1, begins[i] - stops[i]) if long else (0, 0))
            out.append((at, 0, 0, begins[i], stops[i]))
        if sum(n for n, _ in inner):
            out.append((at, sum(n for n, _ in inner), sum(b for _, b in inner), None, None))

    at = levels[rising[-1]] if size else 0
    for i in reversed(rising):
        while at > levels[i]:
            tell(at)
            at -= 1
        count(i, 1)
        if left[i] >= 0 and starts[i] - ends[left[i]] <= max_gap:
            join(left[i], i)
        if right[i] >= 0 and starts[right[i]] - ends[i] <= max_gap:
            join(i, right[i])
        first = i if first < 0 else min(first, i)
        last = max(last, i)
    while size and at > 0:
        tell(at)
        at -= 1
    return out


def cutoff_analysis(scored: DataFrame, cutoffs: Sequence[float], max_gap: int, min_length: int, score: str = "p", bin_width: int = BIN) -> DataFrame:
    """(cutoff, regions, bases, mean_length) at each of the given cutoffs, however many; cutoffs without a region have no row.

    Runs of a chromosome do not overlap.  All cutoffs come from one pass over each bin's runs,
    which are put together from the highest score on; of a bin only the first and
    the last region at a cutoff meet those of other bins.  So rows that move
    are runs once, and three for each bin and cutoff.
    """
    steps = np.array(sorted({float(c) for c in cutoffs}))
    if not len(steps):
        raise ValueError("there are no cutoffs")
    high = scored.where(F.col(score) > F.lit(float(steps[0]))).where("chrom is not null and end > start")
    binned = high.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(score).cast("double").alias("score"), F.floor(F.col("start") / F.lit(bin_width)).alias("_bin"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        chrom = pdf["chrom"].iloc[0]
        pdf = pdf.sort_values("start")
        found = _levels(pdf["start"].to_numpy(), pdf["end"].to_numpy(), np.searchsorted(steps, pdf["score"].to_numpy(), "left"), max_gap, min_length)
        out = pd.DataFrame(found, columns=["level", "regions", "bases", "start", "end"]).astype({"start": "Int64", "end": "Int64"})
        return pd.DataFrame({"cutoff": steps[out["level"].to_numpy(np.int64) - 1], "chrom": chrom, "regions": out["regions"], "bases": out["bases"], "start": out["start"], "end": out["end"]})

    parts = stored(binned.groupBy("chrom", "_bin").applyInPandas(work, "cutoff double, chrom string, regions long, bases long, start long, end long"), "cutoff-parts")
    edges = islands(parts.where("start is not null").select("cutoff", "chrom", "start", "end"), max_gap, ("cutoff", "chrom"), bin_width)
    edges = edges.groupBy("cutoff", "chrom", "region").agg((F.max("end") - F.min("start")).alias("bases")).where(F.col("bases") >= min_length)
    every = parts.where("start is null").select("cutoff", "regions", "bases").unionByName(edges.select("cutoff", F.lit(1).cast("long").alias("regions"), "bases"))
    found = every.groupBy("cutoff").agg(F.sum("regions").alias("regions"), F.sum("bases").alias("bases"))
    return found.withColumn("mean_length", F.col("bases") / F.col("regions"))


def condition_differences(treat1: DataFrame, control1: DataFrame, treat2: DataFrame, control2: DataFrame, cutoff: float, max_gap: int, min_length: int, value: str = "value") -> DataFrame:
    """(kind, chrom, start, end, score) of regions common to two conditions or stronger in one.

    Runs where either condition stands out from its control by the cutoff are
    told apart by the log10 likelihood ratio of the two treatments.
    """
    # Every step reads what is before it twice, so tracks and runs are stored: each track is made once.
    tracks = {n: stored(t.withColumnRenamed(value, "value"), "condition-track") for n, t in (("t1", treat1), ("c1", control1), ("t2", treat2), ("c2", control2))}
    runs = align(tracks)
    ratio: Column = symmetric_log_likelihood_ratio(F.col("t1"), F.col("t2"))
    stands = lambda n: symmetric_log_likelihood_ratio(F.col(f"t{n}"), F.col(f"c{n}")) >= cutoff
    kind = F.when(ratio >= cutoff, F.when(stands(1), F.lit("cond1"))).when(ratio <= -cutoff, F.when(stands(2), F.lit("cond2"))).when(stands(1) & stands(2), F.lit("common"))
    marked = stored(runs.withColumn("kind", kind).withColumn("ratio", ratio).where("kind is not null"), "condition-runs")
    told = islands(marked, max_gap, ("kind", "chrom"))
    found = told.groupBy("kind", "chrom", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.abs("ratio")).alias("score"))
    return found.where(F.col("end") - F.col("start") >= min_length).select("kind", "chrom", "start", "end", "score")


def overlapping(points: DataFrame, regions: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Each (chrom, pos, ...) point with every region (chrom, start, end, region) that holds it.

    Regions are spread over the coordinate bins that they touch, and the join is
    an equality of chromosome and bin with the exact test after it.
    """
    spread = regions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))).withColumnRenamed("chrom", "_chrom")
    binned = points.withColumn("_at", F.floor(F.col("pos") / width))
    return binned.join(spread, (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_bin"))).where("pos >= start and pos < end").drop("_chrom", "_bin", "_at")


def refine_summits(regions: DataFrame, reads: DataFrame, half_window: int) -> DataFrame:
    """(chrom, start, end, summit, score): of each region the base where most read windows meet.

    Reads count within ``half_window`` of their 5' end; of equal bases the middle
    of the first stretch is taken.  Regions without reads are left out.
    """
    marked = regions.select("chrom", "start", "end", F.concat_ws(":", "chrom", "start", "end").alias("region"))
    inside = overlapping(reads, marked)
    steps = F.array(F.struct((F.col("pos") - half_window).alias("pos"), F.col("n").alias("d")), F.struct((F.col("pos") + half_window).alias("pos"), (-F.col("n")).alias("d")))
    events = inside.select("region", "chrom", "start", "end", F.explode(steps).alias("e")).groupBy("region", "chrom", "start", "end", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy("region").orderBy("pos")
    runs = events.select("region", "chrom", "start", "end", "pos", F.lead("pos").over(order).alias("next"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("score")).where("next is not null")
    best = runs.groupBy("chrom", "start", "end").agg(F.max(F.struct("score", (-F.col("pos")).alias("low"), "next")).alias("m"))
    summit = F.floor((F.col("m.next") - F.col("m.low")) / 2)
    return best.select("chrom", "start", "end", F.least(F.greatest(summit, F.col("start")), F.col("end") - 1).alias("summit"), F.col("m.score").alias("score"))


def cutoff_scores(scored: DataFrame, cutoffs: Sequence[float], max_gap: int, min_length: int) -> DataFrame:
    """(pscore, qscore, npeaks, lpeaks, avelpeak): what each cutoff of p would call, and the least q of the runs above it.

    As ``cutoff_analysis``; q comes from the distinct scores, of which each stretch
    between two cutoffs sends its least q on.
    """
    steps = np.array(sorted({float(c) for c in cutoffs}))
    found = cutoff_analysis(scored, cutoffs, max_gap, min_length)

    @F.pandas_udf("long")
    def level(p: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(steps, p.to_numpy(), "left"))

    least = scored.where(F.col("p") > F.lit(float(steps[0]))).select("p", "q").distinct().groupBy(level(F.col("p").cast("double")).alias("level")).agg(F.min("q").alias("least"))
    ranks = scored.sparkSession.createDataFrame([(k + 1, float(c)) for k, c in enumerate(steps)], "level long, cutoff double")  # one row a cutoff
    above = Window.partitionBy().orderBy(F.desc("level"))
    told = ranks.join(least, "level", "left").select("cutoff", F.min("least").over(above).alias("qscore"))
    return found.join(told, "cutoff").select(F.col("cutoff").alias("pscore"), "qscore", F.col("regions").alias("npeaks"), F.col("bases").alias("lpeaks"), F.col("mean_length").alias("avelpeak"))
