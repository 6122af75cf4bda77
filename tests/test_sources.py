"""Text layouts, both ways."""

import gzip

from strandlake.sources import readers, writers


def test_bed_skips_and_quarantines(spark, tmp_path):
    path = tmp_path / "a.bed"
    path.write_text("# note\ntrack name=x\n\nchr1\t1\t5\tr\t0\t+\nchr1\tx\t9\tr\t0\t-\nchr2\t7\t9\n")
    good = readers.read(spark, str(path), "bed")
    assert sorted((r["chrom"], r["start"], r["end"], r["strand"]) for r in good.collect()) == [("chr1", 1, 5, "+"), ("chr2", 7, 9, None)]
    bad = [r["_bad"] for r in readers.read(spark, str(path), "bed", keep_bad=True).collect() if r["_bad"]]
    assert bad == ["chr1\tx\t9\tr\t0\t-"]


def test_gzip_frag_and_sniffing(spark, tmp_path):
    with gzip.open(tmp_path / "a.frag.gz", "wt") as out:
        out.write("chrM\t10\t50\tBC\t1\nchrM\t17\t57\tBC\t70000\n")
    (tmp_path / "b.bdg").write_text("chr1 0 10 inf\nchr1\t10\t5\t-1.5\n")
    (tmp_path / "c.bedpe").write_text("chr1\t5\t90\n")
    (tmp_path / "d.bed").write_text("chr1\t1\t5\tr\t0\t+\n")
    kinds = [readers.sniff(spark, str(tmp_path / n)) for n in ("a.frag.gz", "b.bdg", "c.bedpe", "d.bed")]
    assert kinds == ["frag", "bedgraph", "bedpe", "bed"]
    assert [r["count"] for r in readers.read(spark, str(tmp_path / "a.frag.gz"), "frag").collect()] == [1, 70000]
    values = sorted(r["value"] for r in readers.read(spark, str(tmp_path / "b.bdg"), "bedgraph").collect())
    assert values == [-1.5, float("inf")]


def test_peak_lines(spark):
    schema = "chrom string, start long, end long, name string, summit long, pileup double, p double, fe double, q double, block_count int, block_sizes array<long>, block_starts array<long>"
    df = spark.createDataFrame([("chr1", 7823, 8176, "x_peak_1", 8004, 3.75, 6.985859, 4.567307, 3.046639, 1, [353], [0])], schema)
    line = lambda made: made.first()[0].split("\t")
    assert line(writers.narrow_peak(df)) == ["chr1", "7823", "8176", "x_peak_1", "30", ".", "4.56731", "6.98586", "3.04664", "181"]
    assert line(writers.broad_peak(df))[-1] == "3.04664" and len(line(writers.broad_peak(df))) == 9
    assert line(writers.gapped_peak(df))[5:12] == [".", "0", "0", "0", "1", "353", "0"]
    assert line(writers.summits(df)) == ["chr1", "8004", "8005", "x_peak_1", "3.04664"]
    assert line(writers.peak_table(df)) == ["chr1", "7824", "8176", "353", "8005", "3.75", "6.98586", "4.56731", "3.04664", "x_peak_1"]


def test_tracks_and_reads(spark):
    track = spark.createDataFrame([("c", 0, 5, 1 / 3)], "chrom string, start long, end long, value double")
    assert writers.bedgraph(track).first()[0] == "c\t0\t5\t0.33333"
    ends = spark.createDataFrame([("c", 300, "+"), ("c", 300, "-"), ("c", 100, "+")], "chrom string, pos long, strand string")
    assert [r[0].split("\t")[1] + r[0][-1] for r in writers.bed_reads(ends, 50).collect()] == ["100+", "300+", "250-"]
    assert writers.track_line("n", "d") == 'track name="n" description="d" visibility=1'


def test_headings_stand_before_the_rows(spark, tmp_path):
    from strandlake.sources import writers

    found = spark.createDataFrame([("cond1", "c", 5, 9, 3.25), ("common", "c", 1, 2, 9.0), ("cond1", "b", 7, 8, 4.0)], "kind string, chrom string, start long, end long, score double")
    for kind, rows in (("cond1", ["b\t7\t8\tx_cond1_b_1\t4.00000", "c\t5\t9\tx_cond1_c_1\t3.25000"]), ("cond2", [])):
        lines = writers.condition_regions(found, kind, "x")
        assert [r["value"] for r in lines.collect()] == [writers.track_line("x", f"regions of kind {kind}"), *rows]
        writers.write(lines, f"{tmp_path}/{kind}")
        text = "".join(p.read_text() for p in sorted((tmp_path / kind).glob("part-*")))
        assert text.splitlines()[0].startswith("track") and text.splitlines()[1:] == rows
