"""Cutoff analysis against islands one cutoff at a time, fitted fragment lengths, and length components in bins."""

import numpy as np
import pytest

from strandlake.operators import regions, states
from strandlake.plans.openregions import digested_signal


def one_cutoff(runs, cutoff, max_gap, min_length):
    found = []
    for chrom in sorted({r[0] for r in runs}):
        inside = sorted((s, e) for c, s, e, v in runs if c == chrom and v is not None and v > cutoff)
        for s, e in inside:
            if found and found[-1][0] == chrom and s - found[-1][2] <= max_gap:
                found[-1][2] = e
            else:
                found.append([chrom, s, e])
    return [e - s for _, s, e in found if e - s >= min_length]


@pytest.mark.parametrize("max_gap,min_length,bin_width", [(0, 1, 50), (3, 6, 64), (10, 1, 1 << 18), (5, 20, 1)])
def test_all_cutoffs_equal_one_at_a_time(spark, max_gap, min_length, bin_width):
    rng = np.random.default_rng(max_gap + 1)
    runs = []
    for chrom in ("a", "b"):
        at = 0
        for _ in range(150):
            at += int(rng.integers(0, 6))
            size = int(rng.integers(1, 12)) if rng.random() < 0.98 else 200
            runs.append((chrom, at, at + size, None if rng.random() < 0.03 else float(rng.integers(0, 40)) / 4))
            at += size
    cutoffs = [k / 100 for k in range(1000)] + [5.0, 5.0]
    df = spark.createDataFrame(runs, "chrom string, start long, end long, p double").repartition(3)
    got = {r["cutoff"]: (r["regions"], r["bases"], r["mean_length"]) for r in regions.cutoff_analysis(df, cutoffs, max_gap, min_length, bin_width=bin_width).collect()}
    want = {}
    for c in sorted(set(cutoffs)):
        if lengths := one_cutoff(runs, c, max_gap, min_length):
            want[c] = (len(lengths), sum(lengths), sum(lengths) / len(lengths))
    assert got == want


def test_cutoffs_of_nothing(spark):
    df = spark.createDataFrame([], "chrom string, start long, end long, p double")
    assert regions.cutoff_analysis(df, [1.0, 2.0], 3, 4).count() == 0
    with pytest.raises(ValueError):
        regions.cutoff_analysis(df, [], 3, 4)


def test_planted_length_components_come_back(spark):
    rng = np.random.default_rng(5)
    planted = [(60.0, 15.0, 0.5), (190.0, 25.0, 0.3), (390.0, 30.0, 0.15), (590.0, 35.0, 0.05)]
    sizes = np.concatenate([rng.normal(m, s, int(60_000 * w)) for m, s, w in planted]).round().clip(1).astype(int)
    values, n = np.unique(sizes, return_counts=True)
    rows = [("c", 100, 100 + int(v), int(k)) for v, k in zip(values, n)]
    df = spark.createDataFrame(rows, "chrom string, left long, right long, n long")
    found = states.length_mixture(df, [(50.0, 20.0), (200.0, 20.0), (400.0, 20.0), (600.0, 20.0)])
    for got, want in zip(found, planted):
        assert got[0] == pytest.approx(want[0], abs=4) and got[1] == pytest.approx(want[1], abs=4) and got[2] == pytest.approx(want[2], abs=0.01)
    wide = states.length_mixture(df, [(50.0, 20.0), (200.0, 20.0), (400.0, 20.0), (600.0, 20.0)], lengths=400)
    assert [m for m, _, _ in wide] == pytest.approx([m for m, _, _ in found], abs=1)
    assert states.length_mixture(df.limit(0), [(50.0, 20.0), (200.0, 20.0)]) == [(50.0, 20.0, 0.5), (200.0, 20.0, 0.5)]


def test_shares_weigh_the_components(spark):
    df = spark.createDataFrame([("c", 0, 125, 1)], "chrom string, left long, right long, n long")
    even = states.digested(df, [(100.0, 20.0), (150.0, 20.0)]).first()
    odd = states.digested(df, [(100.0, 20.0, 0.8), (150.0, 20.0, 0.2)]).first()
    assert even["w0"] == pytest.approx(0.5) and odd["w0"] == pytest.approx(0.8) and odd["w1"] == pytest.approx(0.2)


@pytest.mark.parametrize("step", [1, 7, 10])
def test_bins_by_changes_equal_bases(spark, step):
    rng = np.random.default_rng(step)
    rows = [("c" if rng.random() < 0.7 else "d", int(s), int(s + rng.integers(1, 90)), int(rng.integers(1, 4))) for s in rng.integers(-40, 600, 120)]
    df = spark.createDataFrame(rows, "chrom string, left long, right long, n long")
    parts = [(10.0, 8.0), (50.0, 12.0)]
    want: dict = {}
    for r in states.digested(df, parts).collect():
        for base in range(r["left"], r["right"]):
            sums = want.setdefault((r["chrom"], base // step), [0, 0])
            for i in range(2):
                sums[i] += round(r[f"w{i}"] * 1_000_000) * r["n"]
    got = {(r["chrom"], r["bin"]): [r["s0"], r["s1"]] for r in digested_signal(df, parts, step).collect()}
    assert got.keys() == want.keys()
    for key, sums in want.items():
        assert got[key] == pytest.approx([s / (1_000_000 * step) for s in sums], abs=1e-12)
