"""Sweeps, alignment, compaction and coverage against base-by-base arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import arithmetic, tracks


def dense(rows, length, columns=("value",)):
    out = {c: np.zeros(length) for c in columns}
    for r in rows:
        for c in columns:
            out[c][r["start"] : r["end"]] = r[c]
    return out if len(columns) > 1 else out[columns[0]]


def random_intervals(seed, n=200, span=500):
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, span, n)
    return [("c%d" % (i % 2), int(s), int(s + rng.integers(0, 40)), int(rng.integers(1, 4))) for i, s in enumerate(starts)]


@pytest.mark.parametrize("width", [7, 64, 1 << 18])
def test_sweep_adds_up_whatever_the_bins(spark, width):
    rows = random_intervals(1)
    df = spark.createDataFrame(rows, "chrom string, start long, end long, w long")
    events = tracks.events_of(df, "w", "value")
    got = tracks.sweep(events, ["value"], width).collect()
    for chrom in ("c0", "c1"):
        want = np.zeros(600)
        for c, s, e, w in rows:
            if c == chrom:
                want[s:e] += w
        assert (dense([r for r in got if r["chrom"] == chrom], 600) == want).all()
    ordered = sorted((r["chrom"], r["start"], r["end"]) for r in got)
    assert all(a[0] != b[0] or a[2] == b[1] for a, b in zip(ordered, ordered[1:]))


def test_coverage_starts_at_zero_clamps_and_merges(spark):
    df = spark.createDataFrame([("a", -5, 3), ("a", 3, 6), ("a", 10, 12), ("a", 8, 8)], "chrom string, start long, end long")
    got = sorted((r["start"], r["end"], r["value"]) for r in tracks.coverage(df).collect())
    assert got == [(0, 6, 1), (6, 10, 0), (10, 12, 1)]


@pytest.mark.parametrize("width", [3, 1 << 18])
def test_coverage_ends_with_its_chromosome(spark, width):
    rng = np.random.default_rng(5)
    rows = [(c, int(s), int(s + n)) for c in "abcd" for s, n in zip(rng.integers(-9, 60, 40), rng.integers(0, 12, 40))]
    rows += [("e", 70, 80), ("f", 3, 50), (None, 1, 2)]
    sizes = [("a", 40), ("b", 1), ("b", 25), ("c", 500), ("d", 0), ("e", 60), ("f", 50), (None, 9)]
    df, lengths = spark.createDataFrame(rows, "chrom string, start long, end long"), spark.createDataFrame(sizes, "chrom string, length long")
    got = tracks.coverage(df, lengths=lengths, bin_width=width).collect()
    limit = {c: max(n for d, n in sizes if d == c) for c, _ in sizes}
    for c in "abcdef":
        runs = sorted((r["start"], r["end"], r["value"]) for r in got if r["chrom"] == c)
        own = [(max(0, s), min(e, limit[c])) for d, s, e in rows if d == c]
        last = max((e for s, e in own if e > s), default=0)
        bases = [sum(s <= x < e for s, e in own) for x in range(last)]
        assert [v for s, e, v in runs for _ in range(s, e)] == bases
        assert all(x[1] == y[0] and x[2] != y[2] for x, y in zip(runs, runs[1:])) and (not runs or runs[0][0] == 0)
    assert {r["chrom"] for r in got} == set("abcf")


def test_coverage_of_nothing(spark):
    assert tracks.coverage(spark.createDataFrame([], "chrom string, start long, end long")).count() == 0


def test_align_takes_all_breakpoints(spark):
    a = spark.createDataFrame([("x", 0, 10, 1.5), ("x", 10, 20, 2.0)], "chrom string, start long, end long, value double")
    b = spark.createDataFrame([("x", 5, 15, 7.25), ("x", 15, 15, 3.0)], "chrom string, start long, end long, value double")
    got = sorted((r["start"], r["end"], r["a"], r["b"]) for r in tracks.align({"a": a, "b": b}).collect())
    assert got == [(0, 5, 1.5, 0.0), (5, 10, 1.5, 7.25), (10, 15, 2.0, 7.25), (15, 20, 2.0, 0.0)]


@pytest.mark.parametrize("width", [4, 1 << 18])
def test_compact_merges_equal_neighbours_across_bins(spark, width):
    rows = [("x", 0, 3, 1.0), ("x", 3, 9, 1.0), ("x", 9, 10, 2.0), ("x", 11, 12, 2.0), ("x", 12, 12, 5.0), ("x", 12, 15, None), ("x", 15, 16, None)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, value double")
    got = sorted((r["start"], r["end"], r["value"]) for r in tracks.compact(df, bin_width=width).collect())
    assert got == [(0, 9, 1.0), (9, 10, 2.0), (11, 12, 2.0), (12, 16, None)]


@pytest.mark.parametrize("method,expected", [("subtract", -1.0), ("max", 4.0), ("min", 3.0), ("mean", 3.5), ("divide", 0.75), ("multiply", 12.0), ("fe", 0.8)])
def test_arithmetic(spark, method, expected):
    a = spark.createDataFrame([("x", 0, 10, 3.0)], "chrom string, start long, end long, value double")
    b = a.withColumn("value", F.lit(4.0))
    assert arithmetic.compare(a, b, method).collect()[0]["value"] == pytest.approx(expected)


def test_arithmetic_rejects_unknown_methods(spark):
    a = spark.createDataFrame([("x", 0, 10, 3.0)], "chrom string, start long, end long, value double")
    with pytest.raises(ValueError):
        arithmetic.compare(a, a, "nonsense")


def test_alignment_keeps_every_value(spark):
    inf = float("inf")
    a = spark.createDataFrame([("c", 0, 10, inf), ("c", 10, 20, 3e-11), ("c", 30, 40, 1e300), ("d", 5, 6, -inf)], "chrom string, start long, end long, value double")
    b = spark.createDataFrame([("c", 5, 35, inf), ("c", 35, 36, 2.5)], "chrom string, start long, end long, value double")
    for width in (1 << 18, 7):
        got = sorted((r["chrom"], r["start"], r["end"], r["a"], r["b"]) for r in tracks.align({"a": a, "b": b}, bin_width=width).collect())
        assert got == [("c", 0, 5, inf, 0.0), ("c", 5, 10, inf, inf), ("c", 10, 20, 3e-11, inf), ("c", 20, 30, 0.0, inf), ("c", 30, 35, 1e300, inf), ("c", 35, 36, 1e300, 2.5), ("c", 36, 40, 1e300, 0.0), ("d", 5, 6, -inf, 0.0)]


def test_islands_and_names_do_not_depend_on_bins(spark):
    import random

    from strandlake.operators import regions

    rng = random.Random(4)
    rows = [(rng.choice("cd"), s, s + rng.randint(1, 60)) for s in (rng.randrange(4000) for _ in range(150))]
    df = spark.createDataFrame(rows, "chrom string, start long, end long")
    want = sorted((r["chrom"], r["start"], r["end"], r["region"]) for r in regions.islands(df, 5, bin_width=1 << 18).collect())
    reach = {}
    for c, s, e in sorted(rows):
        far, region = reach.get(c, (None, None))
        region = s if far is None or s - far > 5 else region
        reach[c] = (e if far is None else max(far, e), region)
        assert (c, s, e, region) in want
    for width in (16, 100, 1000):
        assert sorted((r["chrom"], r["start"], r["end"], r["region"]) for r in regions.islands(df, 5, bin_width=width).collect()) == want
    names = [sorted((r["name"], r["chrom"], r["start"], r["end"]) for r in regions.named(df.distinct(), "n", width).collect()) for width in (64, 1 << 18)]
    assert names[0] == names[1] and len({n for n, *_ in names[0]}) == len(names[0])
