"""Peak calls whose results are known."""

from dataclasses import replace

import pytest

from strandlake.operators import background, reads, regions, scoring
from strandlake.plans.callpeak import PeakOptions, call_broad, call_narrow, for_fragments, scored_track

TREAT = [(7656, "-"), (7809, "-"), (7823, "-"), (7880, "-"), (7902, "+"), (7908, "-"), (7932, "+"), (7935, "-"), (7976, "+"), (8000, "-"), (8144, "+"), (8494, "-")]
CONTROL = [(1460, "+"), (4544, "-"), (11834, "-"), (13775, "+"), (19765, "+")]
FRAGMENTS = [(10, 50, 1), (17, 57, 70000), (24, 64, -5), (31, 71, 0), (38, 78, 65535), (45, 85, 65536), (52, 92, 32768), (59, 99, 100)]
OPTIONS = PeakOptions(48200.0, name="t")


@pytest.fixture
def few(spark):
    bed = lambda rows: reads.five_prime(spark.createDataFrame([("chr1", s, s + 200, k) for s, k in rows], "chrom string, start long, end long, strand string"))
    return bed(TREAT), bed(CONTROL)


@pytest.fixture
def counted(spark):
    rows = spark.createDataFrame([("chrM", *f) for f in FRAGMENTS], "chrom string, left long, right long, count long")
    return reads.collapse(reads.fragments_of(rows), ("chrom", "left", "right"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def near(row, **want):
    for name, value in want.items():
        assert row[name] == pytest.approx(value, rel=5e-6), name


def test_pileup_and_background(few):
    treat, control = (reads.collapse(x) for x in few)
    got = background.enrich_reads(treat, control, background.Background(48200.0, 200))
    rows = sorted(got.collect(), key=lambda r: r["start"])
    lam = {r["start"]: round(r["lambda"], 5) for r in rows}
    assert (lam[0], lam[960], lam[1360], lam[1560], lam[1960], lam[6460], lam[7034]) == (0.04, 0.2, 1.0, 0.2, 0.04, 0.02075, 0.04)
    assert {r["start"]: round(r["treat"], 5) for r in rows}[8000] == 3.75
    assert rows[0]["start"] == 0 and rows[-1]["end"] == 8694


def test_narrow(few):
    near(one(call_narrow(*few, OPTIONS)), start=7823, end=8176, summit=8004, pileup=3.75, p=6.98586, fe=4.56731, q=3.04664)


def test_narrow_without_local_rates(few):
    near(one(call_narrow(*few, replace(OPTIONS, local=False))), p=8.11961, fe=4.65346, q=4.18039)


def test_narrow_scaled_to_the_larger(few):
    near(one(call_narrow(*few, replace(OPTIONS, scale_to="large"))), start=7809, end=8200, pileup=9, p=16.7749, fe=9.12409, q=12.8357)


def test_shift_leaves_no_peak(few):
    assert call_narrow(*few, replace(OPTIONS, shift=-100)).count() == 0


def test_broad_and_gapped(few):
    row = one(call_broad(*few, OPTIONS))
    near(row, start=7823, end=8176, fe=3.16632, p=4.57517, q=2.3035)
    assert (row["block_count"], row["block_sizes"], row["block_starts"], row["name"]) == (1, [353], [0], "t_peak_1")


def test_counted_fragments(counted):
    options = for_fragments(OPTIONS, counted)
    assert options.fragment == 40
    near(one(call_narrow(counted, counted, options, True)), start=24, end=78, summit=54, pileup=168298, p=14098.4, fe=1.99879, q=14096.4)
    near(one(call_broad(counted, counted, options, True)), start=24, end=78, pileup=121331, p=5157.59, fe=1.47527, q=5156.75)


def test_windows_below_zero_on_request(counted):
    got = background.enrich_fragments(counted, counted, background.Background(48200.0, 40, clamp=False))
    assert min(r["start"] for r in got.collect()) == -4990


def test_without_control_the_large_window_counts(few):
    got = scored_track(few[0], None, OPTIONS)
    assert max(r["lambda"] for r in got.collect()) == pytest.approx(12 * 200 / 10000)


def test_no_reads_no_peaks(spark, few):
    assert call_narrow(few[0].limit(0), few[1], OPTIONS).count() == 0


def test_q_table_is_monotone(few):
    rows = sorted(scoring.q_table(scored_track(*few, OPTIONS).drop("q")).collect(), key=lambda r: -r["p"])
    qs = [r["q"] for r in rows]
    assert qs == sorted(qs, reverse=True) and sum(r["bases"] for r in rows) == 8694


def test_duplicates_and_rates(spark):
    rows = [("c", 5, "+", 10)] * 4 + [("c", 9, "-", 20)]
    df = spark.createDataFrame(rows, "chrom string, pos long, strand string, length long")
    assert {r["pos"]: r["n"] for r in reads.filter_duplicates(df, 2).collect()} == {5: 2, 9: 1}
    assert {r["pos"]: r["n"] for r in reads.filter_duplicates(df, "all").collect()} == {5: 4, 9: 1}
    assert {r["pos"]: r["n"] for r in reads.filter_duplicates(df, "auto", 48200.0).collect()} == {5: 1, 9: 1}
    assert tuple(reads.duplicate_statistics(df, 1).first()) == (5, 2, 0.6)
    assert reads.tag_size(df).first()[0] == 12
    drawn = reads.sample(df, 0.5, 3).collect()
    assert drawn == reads.sample(df.repartition(3), 0.5, 3).collect() or sum(r["n"] for r in drawn) <= 5


def test_strands(spark):
    df = spark.createDataFrame([("c", 1, 5, "."), ("c", 1, 5, "-"), ("c", -1, 5, "+"), ("", 1, 5, "+")], "chrom string, start long, end long, strand string")
    assert sorted((r["pos"], r["strand"]) for r in reads.five_prime(df).collect()) == [(1, "+"), (5, "-")]
    with pytest.raises(Exception, match="not a strand"):
        reads.five_prime(spark.createDataFrame([("c", 1, 5, "x")], df.schema)).collect()


def test_gapped_ends_get_caps(spark):
    df = spark.createDataFrame([("c", 0, 100, 1.0, [(10, 20)]), ("c", 200, 300, 1.0, None), ("c", 400, 500, 1.0, [(400, 450), (460, 500)])], "chrom string, start long, end long, q double, blocks array<struct<s:long,e:long>>")
    got = {r["start"]: (r["block_sizes"], r["block_starts"]) for r in regions.gapped_peaks(df).collect()}
    assert got == {0: ([1, 10, 1], [0, 10, 99]), 200: ([1, 1], [0, 99]), 400: ([50, 40], [0, 60])}


def test_islands_and_gaps(spark):
    df = spark.createDataFrame([("c", 0, 5, 2.0), ("c", 8, 9, 3.0), ("c", 20, 22, 1.0)], "chrom string, start long, end long, value double")
    got = sorted((r["start"], r["end"], r["summit"], r["score"]) for r in regions.threshold_regions(df, 1.0, 3, 3).collect())
    assert got == [(0, 9, 8, 3.0)]


def test_refined_summit(spark):
    marked = spark.createDataFrame([("c", 0, 100)], "chrom string, start long, end long")
    ends = spark.createDataFrame([("c", 40, 2), ("c", 44, 2), ("c", 90, 1)], "chrom string, pos long, n long")
    row = regions.refine_summits(marked, ends, 10).first()
    assert (row["summit"], row["score"]) == (42, 4)


def test_condition_differences(spark):
    track = lambda *v: spark.createDataFrame([("c", 100 * i, 100 * i + 100, float(x)) for i, x in enumerate(v)], "chrom string, start long, end long, value double")
    got = regions.condition_differences(track(80, 1, 60), track(1, 1, 1), track(1, 90, 60), track(1, 1, 1), 3.0, 5, 50)
    assert sorted((r["kind"], r["start"], r["end"]) for r in got.collect()) == [("common", 200, 300), ("cond1", 0, 100), ("cond2", 100, 200)]
