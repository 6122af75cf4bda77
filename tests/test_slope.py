"""Sub-summits from runs against the kernel laid out base by base."""

import numpy as np
import pytest

from strandlake.operators import smooth

PEAKS = "chrom string, start long, end long, name string"
RUNS = "chrom string, start long, end long, value double"


def by_base(peaks, runs, window, least_share=0.0):
    out = []
    for chrom, start, end, name in sorted(set(peaks)):
        mine = [(max(s, start), min(e, end), v) for c, s, e, v in runs if c == chrom and s < end and e > start]
        if not mine:
            continue
        signal = np.zeros(end - start)
        for s, e, v in mine:
            signal[s - start : e - start] = v
        found = smooth.maxima(signal, window)
        found = found[signal[found] >= least_share * signal.max()] if len(found) else np.array([int(np.argmax(signal))])
        out += [(chrom, start, end, start + int(i), float(signal[i])) for i in found]
    return sorted(out)


def made(seed, halves=False):
    rng = np.random.default_rng(seed)
    peaks, runs = [], []
    for chrom in ("a", "b"):
        at = int(rng.integers(0, 5))
        while at < 3000:
            size = int(rng.integers(1, 40))
            if rng.random() < 0.85:
                value = float(rng.integers(0, 9)) / (2 if halves else 1)
                runs.append((chrom, at, at + size, value))
            at += size
        edges = np.unique(rng.integers(0, 3100, 16)).tolist()
        peaks += [(chrom, s, e, f"p{s}") for s, e in zip(edges, edges[1:])]
    return peaks, runs


@pytest.mark.parametrize("window,bin_width,halves", [(5, 1 << 18, False), (51, 64, True), (8, 7, True), (201, 100, False)])
def test_slope_over_runs_equals_bases(spark, window, bin_width, halves):
    peaks, runs = made(window, halves)
    found = smooth.sub_summits(spark.createDataFrame(peaks, PEAKS), spark.createDataFrame(runs, RUNS), window, 0.3, bin_width)
    got = sorted((r["chrom"], r["start"], r["end"], r["summit"], r["height"]) for r in found.collect())
    assert got == by_base(peaks, runs, window, 0.3)


def test_short_flat_and_repeated_peaks(spark):
    peaks = [("a", 0, 2, "two"), ("a", 10, 30, "flat"), ("a", 10, 30, "flat"), ("a", 40, 60, "zero"), ("a", 90, 95, "none"), ("a", 100, 101, "one")]
    runs = [("a", 0, 1, 1.0), ("a", 1, 2, 3.0), ("a", 5, 35, 4.0), ("a", 40, 60, 0.0), ("a", 100, 101, 2.0)]
    got = sorted((r["name"], r["summit"], r["height"]) for r in smooth.sub_summits(spark.createDataFrame(peaks, PEAKS), spark.createDataFrame(runs, RUNS), 5).collect())
    assert got == [("flat", 10, 4.0), ("one", 100, 2.0), ("two", 1, 3.0), ("zero", 40, 0.0)]
    assert smooth.sub_summits(spark.createDataFrame([], PEAKS), spark.createDataFrame([], RUNS), 5).count() == 0


def test_a_peak_of_a_hundred_million_bases(spark):
    size, every = 100_000_000, 1_000_000
    starts = spark.range(0, size // every).selectExpr("'a' as chrom", f"id * {every} + 1000 as start", f"id * {every} + 1200 as end", "double(5 + id % 3) as value")
    peak = spark.createDataFrame([("a", 0, size, "p")], PEAKS)
    got = [r["summit"] for r in smooth.sub_summits(peak, starts, 51).orderBy("summit").collect()]
    assert len(got) == 100 and all(0 <= s - k * every - 1000 < 200 for k, s in enumerate(got))
    names = [r["name"] for r in smooth.sub_summits(peak, starts, 51).orderBy("summit").collect()]
    assert names[:2] == ["pa", "pb"] and names[25:28] == ["pz", "paa", "pab"]
