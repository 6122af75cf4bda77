"""Whole files of calls whose text is known, line by line."""

from dataclasses import replace

import pytest
from test_peaks import CONTROL, FRAGMENTS, OPTIONS, TREAT

from strandlake.operators import reads
from strandlake.plans import callpeak
from strandlake.plans.callpeak import PeakOptions, call_broad, call_narrow, for_fragments, signal_tracks, table_header
from strandlake.sources import ordered, writers

# What stands in the files of each call, fields divided by spaces.
USUAL = "chr1 7823 8176 t_peak_1 30 . 4.56731 6.98586 3.04664 181"
USUAL_TABLE = "chr1 7824 8176 353 8005 3.75 6.98586 4.56731 3.04664 t_peak_1"
READS = {
    "default": ({"band_width": 300, "fold_range": (3, 20), "per_million": True}, USUAL, USUAL_TABLE),  # which change no peak
    "automatic duplicates": ({"keep_duplicates": "auto"}, USUAL, USUAL_TABLE),
    "hundredth": ({"q_cutoff": 0.01}, "chr1 7908 8108 t_peak_1 30 . 4.56731 6.98586 3.04664 96", "chr1 7909 8108 200 8005 3.75 6.98586 4.56731 3.04664 t_peak_1"),
    "no local rate": ({"local": False}, "chr1 7823 8176 t_peak_1 41 . 4.65346 8.11961 4.18039 181", "chr1 7824 8176 353 8005 3.75 8.11961 4.65346 4.18039 t_peak_1"),
    "narrow windows": ({"small_local": 500, "large_local": 2000}, "chr1 7823 8176 t_peak_1 41 . 4.65346 8.11961 4.18039 181", None),
    "to the larger": ({"scale_to": "large"}, "chr1 7809 8200 t_peak_1 128 . 9.12409 16.7749 12.8357 195", "chr1 7810 8200 391 8005 9 16.7749 9.12409 12.8357 t_peak_1"),
    "sub-summits": ({"call_summits": True}, "chr1 7823 8176 t_peak_1 30 . 4.16667 6.98586 3.04664 186", None),
    "shifted": ({"shift": -100}, None, None),
}
COUNTED = "chrM 24 78 t_peak_1 140963 . 1.99879 14098.4 14096.4 30"
PAIRS = {
    "default": ({}, COUNTED),
    "narrow windows": ({"small_local": 500, "large_local": 2000}, COUNTED),
    "no local rate": ({"local": False}, "chrM 17 92 t_peak_1 4454540 . 1195.73 445456 445454 37"),
    "sub-summits": ({"call_summits": True}, "chrM 24 78 t_peak_1 140963 . 1.99879 14098.4 14096.4 31"),
}
PILEUP = """chr1 0 7656 0.00000
chr1 7656 7809 0.41667
chr1 7809 7823 0.83333
chr1 7823 7856 1.25000
chr1 7856 7880 0.83333
chr1 7880 7902 1.25000
chr1 7902 7908 1.66667
chr1 7908 7932 2.08333
chr1 7932 7935 2.50000
chr1 7935 7976 2.91667
chr1 7976 8000 3.33333
chr1 8000 8009 3.75000
chr1 8009 8023 3.33333
chr1 8023 8080 2.91667
chr1 8080 8102 2.50000
chr1 8102 8108 2.08333
chr1 8108 8132 1.66667
chr1 8132 8135 1.25000
chr1 8135 8144 0.83333
chr1 8144 8176 1.25000
chr1 8176 8200 0.83333
chr1 8200 8344 0.41667
chr1 8344 8494 0.00000
chr1 8494 8694 0.41667"""
BACKGROUND = """chr1 0 960 0.04000
chr1 960 1360 0.20000
chr1 1360 1560 1.00000
chr1 1560 1960 0.20000
chr1 1960 4244 0.04000
chr1 4244 4644 0.20000
chr1 4644 4844 1.00000
chr1 4844 5244 0.20000
chr1 5244 6460 0.04000
chr1 6460 7034 0.02075
chr1 7034 8694 0.04000"""
COUNTED_PILEUP = """chrM 0 10 0.00000
chrM 10 17 1.00000
chrM 17 24 4465.00000
chrM 24 38 69996.00000
chrM 38 50 135531.00000
chrM 50 52 135530.00000
chrM 52 57 168298.00000
chrM 57 59 163834.00000
chrM 59 64 163934.00000
chrM 64 78 98403.00000
chrM 78 92 32868.00000
chrM 92 99 100.00000"""
COUNTED_BACKGROUND = """chrM -4976 -4962 139.99200
chrM -4962 -4950 271.06201
chrM -4950 -4948 271.06403
chrM -4948 -4943 336.60001
chrM -4943 -4941 345.52802
chrM -4941 -4936 345.72803
chrM -4936 -4922 476.79001
chrM -4922 -4908 607.86005
chrM -4908 -4901 673.39606
chrM -4901 -476 673.59601
chrM -476 -462 1399.91992
chrM -462 -450 2710.61987
chrM -450 -448 2710.63989
chrM -448 -443 3366.00000
chrM -443 -441 3455.28003
chrM -441 -436 3457.28003
chrM -436 -422 4767.89990
chrM -422 -408 6078.60010
chrM -408 -401 6733.95996
chrM -401 4 6735.95996
chrM 4 18 34998.00000
chrM 18 32 67765.50000
chrM 32 39 84149.50000
chrM 39 70 84199.50000
chrM 70 77 84199.00000
chrM 77 84 81967.00000
chrM 84 98 49201.50000
chrM 98 99 16434.00000"""
HEADER = """# ARGUMENTS LIST:
# name = t
# format = BED
# ChIP-seq file = ['treat.bed']
# control file = ['ctrl.bed']
# effective genome size = 4.82e+04
# band width = 300
# model fold = [5, 50]
# qvalue cutoff = 5.00e-02
# The maximum gap between significant sites is assigned as the read length/tag size.
# The minimum length of peaks is assigned as the predicted fragment length "d".
# Larger dataset will be scaled towards smaller dataset.
# Range for calculating regional lambda is: 1000 bps and 10000 bps
# Broad region calling is off
# Paired-End mode is off

# tag size is determined as 200 bps
# total tags in treatment: 12
# tags after filtering in treatment: 12
# maximum duplicate tags at the same position in treatment = 1
# Redundant rate in treatment: 0.00
# total tags in control: 5
# tags after filtering in control: 5
# maximum duplicate tags at the same position in control = 1
# Redundant rate in control: 0.00
# d = 200"""


@pytest.fixture(scope="module")
def few(spark):
    bed = lambda rows: reads.five_prime(spark.createDataFrame([("chr1", s, s + 200, k) for s, k in rows], "chrom string, start long, end long, strand string"))
    return bed(TREAT), bed(CONTROL)


@pytest.fixture(scope="module")
def counted(spark):
    rows = spark.createDataFrame([("chrM", *f) for f in FRAGMENTS], "chrom string, left long, right long, count long")
    return reads.collapse(reads.fragments_of(rows), ("chrom", "left", "right"))


def text(lines):
    return [r["value"].replace("\t", " ") for r in lines.collect()]


@pytest.mark.parametrize("variant", READS)
def test_files_of_reads(few, variant):
    options, peak, table = READS[variant]
    found = call_narrow(*few, replace(OPTIONS, **options)).cache()
    assert text(writers.narrow_peak(found)) == ([peak] if peak else [])
    if peak:
        fields = peak.split()
        summit = int(fields[1]) + int(fields[9])
        assert text(writers.summits(found)) == [f"chr1 {summit} {summit + 1} t_peak_1 {fields[8]}"]
    if table:
        assert text(writers.peak_table(found)) == [table]


@pytest.mark.parametrize("variant", PAIRS)
def test_files_of_counted_fragments(counted, variant):
    options, peak = PAIRS[variant]
    found = call_narrow(counted, counted, for_fragments(replace(OPTIONS, **options), counted), True).cache()
    assert text(writers.narrow_peak(found)) == [peak]
    fields = peak.split()
    summit = int(fields[1]) + int(fields[9])
    assert text(writers.summits(found)) == [f"chrM {summit} {summit + 1} t_peak_1 {fields[8]}"]


def test_broad_files(few, counted):
    found = call_broad(*few, OPTIONS).cache()
    for lines, known in ((writers.broad_peak(found), "chr1 7823 8176 t_peak_1 23 . 3.16632 4.57517"), (writers.gapped_peak(found), "chr1 7823 8176 t_peak_1 23 . 0 0 0 1 353 0 3.16632 4.57517")):
        front, _, q = text(lines)[0].rpartition(" ")
        assert front == known and float(q) == pytest.approx(2.3035, abs=1.01e-5)  # known from sums in single precision
    found = call_broad(counted, counted, for_fragments(OPTIONS, counted), True).cache()
    assert text(writers.broad_peak(found)) == ["chrM 24 78 t_peak_1 51567 . 1.47527 5157.59 5156.75"]
    assert text(writers.gapped_peak(found)) == ["chrM 24 78 t_peak_1 51567 . 0 0 0 1 54 0 1.47527 5157.59 5156.75"]
    assert text(writers.peak_table(found)) == ["chrM 25 78 54 121331 5157.59 1.47527 5156.75 t_peak_1"]
    assert writers.table_columns(broad=True).split("\t") == ["chr", "start", "end", "length", "pileup", "-log10(pvalue)", "fold_enrichment", "-log10(qvalue)", "name"]


def test_signal_files(few, counted):
    treat, background = signal_tracks(*few, OPTIONS)
    assert text(writers.bedgraph(treat, single=True)) == PILEUP.split("\n")
    assert text(writers.bedgraph(background, single=True)) == BACKGROUND.split("\n")
    treat, _ = signal_tracks(counted, counted, for_fragments(OPTIONS, counted), True)
    assert text(writers.bedgraph(treat, single=True)) == COUNTED_PILEUP.split("\n")
    _, background = signal_tracks(counted, counted, replace(for_fragments(OPTIONS, counted), clamp=False), True)
    first, *others = text(writers.bedgraph(background, single=True))
    assert first == "chrM -4990 -4976 139.75021"  # known to be written from 0
    split = lambda lines: [(x.rpartition(" ")[0], float(x.rpartition(" ")[2])) for x in lines]
    got, known = split(others), split(COUNTED_BACKGROUND.split("\n"))
    assert [x for x, _ in got] == [x for x, _ in known] and [v for _, v in got] == pytest.approx([v for _, v in known], rel=2e-7)  # known from sums in single precision


def test_signal_per_million(few):
    treat, background = signal_tracks(*few, replace(OPTIONS, per_million=True))
    assert max(r["value"] for r in treat.collect()) == pytest.approx(3.75 * 1e6 / 5) and max(r["value"] for r in background.collect()) == pytest.approx(1e6 / 5)


def test_table_headers(few, counted):
    assert table_header(*few, OPTIONS, files=("treat.bed", "ctrl.bed")) == HEADER.split("\n")
    all_ = table_header(*few, replace(OPTIONS, keep_duplicates="all", local=False), files=("treat.bed", "ctrl.bed"))
    assert all_ == [x for x in HEADER.split("\n") if not any(w in x for w in ("filtering", "maximum duplicate", "Redundant"))] + ["# local lambda is disabled!"]
    paired = table_header(counted, counted, for_fragments(OPTIONS, counted), True, tag="FRAG", files=("treat.frag", "ctrl.frag"))
    assert paired[-5:] == ["", "# fragment size is determined as 40 bps", "# total fragments in treatment: 168399", "# total fragments in control: 168399", "# d = 40"]
    assert writers.table_columns().split("\t") == ["chr", "start", "end", "length", "abs_summit", "pileup", "-log10(pvalue)", "fold_enrichment", "-log10(qvalue)", "name"]


def test_all_files_of_a_call(few, tmp_path):
    lines = lambda path: "".join(open(p).read() for p in ordered.parts(path)).splitlines()
    made = callpeak.write_call(*few, replace(OPTIONS, name="t"), str(tmp_path), files=("treat.bed", "ctrl.bed"), signals=True, cutoffs=callpeak.CUTOFFS)
    by = {p.rpartition("/t_")[2]: lines(p) for p in made}
    found = call_narrow(*few, replace(OPTIONS, name="t"))
    scored = callpeak.scored_track(*few, OPTIONS)
    assert by["peaks.narrowPeak"] == [r[0] for r in writers.narrow_peak(found).collect()] and by["summits.bed"] == [r[0] for r in writers.summits(found).collect()]
    assert by["peaks.xls"][:-1] == [*table_header(*few, replace(OPTIONS, name="t"), files=("treat.bed", "ctrl.bed")), writers.table_columns()]
    assert [x.replace("\t", " ") for x in by["treat_pileup.bdg"]] == PILEUP.split("\n")
    table = [x.split("\t") for x in by["cutoff_analysis.txt"]]
    assert table[0] == writers.CUTOFF_COLUMNS.split("\t") and len(table) > 2
    rows = scored.collect()
    for p, q, n, bases, mean in table[1:]:
        above = [r for r in rows if r["p"] > float(p)]
        assert q == f"{min(r['q'] for r in above):.2f}" and int(n) >= 1 and mean == f"{int(bases) / int(n):.2f}"
    assert [float(x[0]) for x in table[1:]] == sorted((float(x[0]) for x in table[1:]), reverse=True)


def test_files_of_a_call_without_peaks(few, tmp_path):
    lines = lambda path: "".join(open(p).read() for p in ordered.parts(path)).splitlines()
    made = callpeak.write_call(*few, replace(OPTIONS, name="t", q_cutoff=1e-9, broad_cutoff=1e-8), str(tmp_path), broad=True, cutoffs=[50.0])
    assert [len(lines(p)) for p in made[1:]] == [0, 0, 1] and lines(made[0])[-1] == writers.table_columns(broad=True)


def test_a_fold_range_has_two_ends():
    with pytest.raises(ValueError, match="low and a high"):
        PeakOptions(48200.0, fold_range=(5,))
    assert callpeak.PeakOptions(48200.0).fold_range == (5, 50)
