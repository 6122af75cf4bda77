"""BAM decoding and variants in regions."""

import struct
import zlib

import pytest

from strandlake.operators import variants
from strandlake.sources import bam


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, mapq, cigar, seq, quals, md):
    steps = b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(op)) for n, op in cigar)
    codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    tags = b"NMC\1XBBc\2\0\0\0\1\2MDZ" + md.encode() + b"\0"
    data = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + steps + packed + bytes(quals) + tags
    return struct.pack("<i", len(data)) + data


@pytest.fixture
def path(tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    rows = [record(f"r{i}", 0, 0, 100, 60, [(2, "S"), (4, "M"), (1, "I"), (4, "M"), (2, "D"), (2, "M")], "NN" + "ACGT" + "A" + ("CTAC" if i % 2 else "CTGC") + "GG", [40] * 13, "6A1^TT2" if i % 2 == 0 else "8^TT2") for i in range(10)]
    rows.append(record("dup", 0x400, 0, 100, 60, [(4, "M")], "TTTT", [40] * 4, "0A0C0G1"))
    data = head + b"".join(rows)
    cut = len(head) + 37
    target = tmp_path / "a.bam"
    target.write_bytes(block(data[:cut]) + block(data[cut:]) + block(b""))
    return str(target)


def test_records(spark, path):
    rows = bam.read(spark, path).collect()
    assert len(rows) == 11
    first = rows[0]
    assert (first["chrom"], first["pos"], first["end"], first["cigar"], first["md"]) == ("chr1", 100, 112, "2S4M1I4M2D2M", "6A1^TT2")
    assert first["seq"] == "NNACGTACTGCGG"


def test_bases_on_the_reference():
    got = bam.aligned_bases(100, "2S4M1I4M2D2M", "NNACGTACTGCGG", list(range(13)), "6A1^TT2")
    assert [(p, b, r) for p, b, _, r in got] == [(100, "A", "A"), (101, "C", "C"), (102, "G", "G"), (103, "T", "T"), (104, "C", "C"), (105, "T", "T"), (106, "G", "A"), (107, "C", "C"), (110, "G", "G"), (111, "G", "G")]


def test_heterozygous_site_is_called_inside_regions_only(spark, path):
    alignments = bam.read(spark, path)
    inside = spark.createDataFrame([("chr1", 104, 200)], "chrom string, start long, end long")
    found = variants.call_variants(variants.base_counts(alignments, inside)).collect()
    assert [(r["pos"], r["ref"], r["alt"], r["genotype"], r["depth"], r["alt_n"]) for r in found] == [(106, "A", "G", "0/1", 10, 5)]
    outside = spark.createDataFrame([("chr1", 0, 104)], "chrom string, start long, end long")
    assert variants.call_variants(variants.base_counts(alignments, outside)).count() == 0


def test_counted_alignments_and_batches_tell_what_each_read_tells(spark, path):
    from pyspark.sql import functions as F

    each = bam.read(spark, path)
    assert each.count() == 11
    alike = each.groupBy(*[c for c in each.columns if c != "name"]).agg(F.count("*").alias("n"))
    inside = spark.createDataFrame([("chr1", 0, 200)], "chrom string, start long, end long")
    got, want = ({(r["pos"], r["ref"], r["base"]): (r["n"], round(r["error"], 12)) for r in variants.base_counts(x, inside).collect()} for x in (alike, each))
    assert got == want and got[106, "A", "G"] == (5, 0.0005) and got[100, "A", "A"] == (10, 0.001)


def test_base_query_scans_the_table_once(spark):
    from strandlake.plans import queries

    plan = queries.callvar_bases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan
