"""BGZF files read by ranges of bytes: every split size gives the rows of one task."""

import random
import struct

import pytest
from test_variants import block, record

from strandlake.sources import bam, bgzf, readers


def blocks_of(data, rng, most):
    out, at = b"", 0
    while at < len(data):
        n = rng.randint(1, most)
        out += block(data[at : at + n])
        at += n
        if rng.random() < 0.05:
            out += block(b"")
    return out + block(b"")


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("bgzf")
    text = b"@HD\tVN:1.6\tSO:coordinate\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2)
    for name in (b"chr1\0", b"chr2\0"):
        head += struct.pack("<i", len(name)) + name + struct.pack("<i", 100_000)
    places = sorted((rng.randint(0, 1), rng.randint(0, 90_000)) for _ in range(700))
    rows = []
    for i, (ref, pos) in enumerate(places):
        n = 20_000 if i in (100, 400) else rng.randint(1, 120)
        rows.append(record(f"read{i}", 0, ref, pos, 60, [(n, "M")], "".join(rng.choice("ACGT") for _ in range(n)), [rng.randint(0, 40) for _ in range(n)], str(n)))
    (folder / "a.bam").write_bytes(blocks_of(head + b"".join(rows), rng, 3000))
    (folder / "empty.bam").write_bytes(blocks_of(head, rng, 40))
    told = [f"chr{i % 3}\t{i}\t{i + rng.randint(1, 50)}\t{'x' * rng.randint(0, 200)}" for i in range(900)]
    (folder / "a.bed.gz").write_bytes(blocks_of("\n".join(told).encode() + b"\n", rng, 900))
    (folder / "unended.bed.gz").write_bytes(blocks_of("\n".join(told[:50]).encode(), rng, 90))
    return folder, told


def spans(path, split):
    size = path.stat().st_size
    return [(k, min(size, k + split)) for k in range(0, size, split)]


@pytest.mark.parametrize("split", [211, 1000, 4096, 1 << 20])
def test_alignments_do_not_depend_on_the_split(made, split):
    path = made[0] / "a.bam"
    whole = list(bam.records(path.read_bytes()))
    assert len(whole) == 700 and [x for b, e in spans(path, split) for x in bgzf.alignments(str(path), b, e)] == whole


@pytest.mark.parametrize("split", [17, 100, 1000, 1 << 20])
def test_lines_do_not_depend_on_the_split(made, split):
    for name, told in (("a.bed.gz", made[1]), ("unended.bed.gz", made[1][:50])):
        path = made[0] / name
        assert [x for b, e in spans(path, split) for x in bgzf.lines(str(path), b, e)] == told


def test_reads_of_spark(spark, made):
    path = str(made[0] / "a.bam")
    got, want = (sorted(map(str, df.collect())) for df in (bgzf.read(spark, path, split=5000), bam.read(spark, path)))
    assert got == want and bgzf.read(spark, path, split=5000).rdd.getNumPartitions() > 10
    assert bgzf.read(spark, str(made[0] / "empty.bam")).count() == 0
    rows = readers.read_lines(bgzf.read(spark, f"file://{made[0]}/a.bed.gz", "text", 700), "bed")
    assert sorted(r["start"] for r in rows.collect()) == list(range(900))


def test_filters_leave_out_ranges(spark, made):
    path = str(made[0] / "a.bam")
    reader = bgzf.Reader([path], 2000, "bam")
    list(reader.pushFilters([bgzf.EqualTo(("chrom",), "chr2"), bgzf.GreaterThanOrEqual(("pos",), 80_000)]))
    left, whole = reader.partitions(), bgzf.Reader([path], 2000, "bam").partitions()
    assert 0 < len(left) < len(whole) / 2
    wanted = {r[0] for r in bam.records((made[0] / "a.bam").read_bytes()) if r[2] == "chr2" and r[3] >= 80_000}
    assert wanted and wanted <= {r[0] for x in left for r in bgzf.alignments(x.path, x.begin, x.end)}
    df = bgzf.read(spark, path, split=2000).where("chrom = 'chr2' and pos >= 80000")
    assert {r["name"] for r in df.collect()} == wanted
