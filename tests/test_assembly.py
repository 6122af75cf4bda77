"""Variants by local assembly: planted ones are found, with their genotypes."""

import random

import pytest

from strandlake.operators import assembly

SCHEMA = "name string, flag int, chrom string, pos long, end long, mapq int, cigar string, seq string, quals array<int>, md string"


def cost(a, b):
    """The cheapest alignment of two strings by trying all, for short ones."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j, kind):
        if i == len(a) and j == len(b):
            return 0
        found = []
        if i < len(a) and j < len(b):
            found.append(assembly.MISMATCH * (a[i] != b[j]) + go(i + 1, j + 1, 0))
        if i < len(a):
            found.append(assembly.EXTEND + assembly.OPEN * (kind != 1) + go(i + 1, j, 1))
        if j < len(b):
            found.append(assembly.EXTEND + assembly.OPEN * (kind != 2) + go(i, j + 1, 2))
        return min(found)

    return go(0, 0, 0)


def test_alignment_is_the_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randint(0, 9))) for _ in range(2))
        got, total, kind = assembly.aligned(a, b), 0, 0
        assert "".join(x for x, _ in got) == a and "".join(y for _, y in got) == b
        for x, y in got:
            now = 0 if x and y else 1 if x else 2
            total += assembly.MISMATCH * (x != y) if not now else assembly.EXTEND + assembly.OPEN * (kind != now)
            kind = now
        assert total == cost(a, b)


def test_differences_stand_leftmost():
    assert assembly.differences("GATTTTC", "GATTTC", 100) == [(101, "AT", "A")]
    assert assembly.differences("GATTC", "GATTTTC", 100) == [(101, "A", "ATT")]
    assert assembly.differences("GACGT", "GAGGT", 5) == [(7, "C", "G")]


def aligned_read(genome, edits, name, pos, n, chrom="chr1"):
    """A read of ``n`` reference bases from ``pos`` with edits {position: (reference, alternative)}, as CIGAR and MD."""
    seq, steps, md, same, p = "", [], "", 0, pos

    def step(count, op):
        if steps and steps[-1][1] == op:
            steps[-1][0] += count
        else:
            steps.append([count, op])

    while p < pos + n:
        ref, alt = edits.get(p, (genome[p], genome[p]))
        if p + len(ref) > pos + n:
            ref, alt = genome[p], genome[p]
        seq += alt
        step(1, "M")
        if ref[0] == alt[0]:
            same += 1
        else:
            md, same = md + f"{same}{ref[0]}", 0
        if len(alt) > len(ref):
            step(len(alt) - len(ref), "I")
        if len(ref) > len(alt):
            step(len(ref) - len(alt), "D")
            md, same = md + f"{same}^{ref[1:]}", 0
        p += len(ref)
    return (name, 0, chrom, pos, p, 60, "".join(f"{n}{op}" for n, op in steps), seq, [40] * len(seq), md + str(same))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    edits = {}
    for p in range(150, 2900, 130):
        kind = rng.choice(("snv", "insertion", "deletion"))
        if kind == "snv":
            edits[p] = genome[p], rng.choice([c for c in "ACGT" if c != genome[p]])
        else:
            n = rng.randint(1, 12)
            # Only places where the variant stands leftmost already.
            new = "".join(rng.choice("ACGT") for _ in range(n))
            text = new if kind == "insertion" else genome[p + 1 : p + 1 + n]
            if text[-1] == genome[p]:
                continue
            edits[p] = (genome[p], genome[p] + new) if kind == "insertion" else (genome[p : p + 1 + n], genome[p])
    return genome, edits, {p for k, p in enumerate(edits) if k % 3 == 0}


def reads_of(planted, treated, seed, depth=40):
    genome, edits, whole = planted
    rng, out = random.Random(seed), []
    for i in range(3000 * depth // 100):
        pos = rng.randint(0, 2890)
        mine = {p: e for p, e in edits.items() if p in whole or (treated and i % 2)}
        row = aligned_read(genome, mine, f"r{i}", pos, 100)
        if rng.random() < 0.3:  # an error of sequencing
            k = rng.randrange(len(row[7]))
            seq = row[7][:k] + rng.choice("ACGT") + row[7][k + 1 :]
            row = (*row[:7], seq, *row[8:9], row[9] if seq == row[7] else None)
        out.append(row)
    return [r for r in out if r[9]]


def test_planted_variants_are_found(spark, planted):
    genome, edits, whole = planted
    treat, control = (spark.createDataFrame(reads_of(planted, t, s), SCHEMA) for t, s in ((True, 1), (False, 2)))
    regions = spark.createDataFrame([("chr1", 100, 1500), ("chr1", 1500, 2950), ("chr2", 0, 500)], "chrom string, start long, end long")
    got = {(r["pos"], r["ref"], r["alt"]): r for r in assembly.call_assembled(treat, regions, control).collect()}
    want = {(p, a, b) for p, (a, b) in edits.items()}
    assert {r["kind"] for r in got.values()} == {"snv", "insertion", "deletion"}
    assert set(got) == want
    for (p, _, _), r in got.items():
        assert r["genotype"] == ("1/1" if p in whole else "0/1") and r["control_genotype"] == ("1/1" if p in whole else "0/0"), p
    alone = {(r["pos"], r["ref"], r["alt"]) for r in assembly.call_assembled(treat, regions).collect()}
    assert alone == want
    inside = {r["pos"] for r in assembly.call_assembled(treat, regions.limit(1)).collect()}
    assert inside == {p for p in edits if 100 <= p < 1500}


def test_reference_under_a_read():
    assert assembly.reference_bases(100, "2S4M1I4M2D2M", "NNACGTACTGCGG", "6A1^TT2") == [(100, "A"), (101, "C"), (102, "G"), (103, "T"), (104, "C"), (105, "T"), (106, "A"), (107, "C"), (108, "T"), (109, "T"), (110, "G"), (111, "G")]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SCHEMA)
    regions = spark.createDataFrame([("chr1", 0, 100)], "chrom string, start long, end long")
    assert assembly.call_assembled(none, regions, none).count() == 0


def test_query_finds_the_planted_variants(spark):
    from strandlake.plans import adapter, queries

    data = "/root/testdata/sf0.01"
    got = {(r["chrom"], r["pos"], r["ref"], r["alt"]): r for r in queries.callvar_assembly(spark, data).collect()}
    places = {r["chrom"]: (r["low"], r["high"]) for r in adapter.items(spark, data).where("treated").groupBy("chrom").agg({"pos": "min"}).withColumnRenamed("min(pos)", "low").join(adapter.items(spark, data).where("treated").groupBy("chrom").agg({"pos": "max"}).withColumnRenamed("max(pos)", "high"), "chrom").collect()}
    want = {}
    for chrom, (low, high) in places.items():
        # Inside the covered stretch, and with no other variant within reach of the k-mers.
        held = [p for p in range(low - 60, high + 60) if adapter.variant(chrom, p)]
        for p in held:
            ref, alt, always = adapter.variant(chrom, p)
            if low + 70 < p < high - 70 and all(abs(p - q) > 40 for q in held if q != p):
                begin = p - 30
                before = "".join(adapter.base(chrom, i) for i in range(begin, p))
                after = "".join(adapter.base(chrom, i) for i in range(p + len(ref), p + len(ref) + 30))
                for pos, a, b in assembly.differences(before + ref + after, before + alt + after, begin):
                    want[chrom, pos, a, b] = always
    found = [w for w in want if w in got]
    assert len(want) > 20 and len(found) >= 0.95 * len(want)
    for w in found:
        assert got[w]["genotype"] == ("1/1" if want[w] else "0/1") and got[w]["control_genotype"] == ("1/1" if want[w] else "0/0")
    bases = {(r["chrom"], r["pos"], r["ref"], r["alt"]) for r in queries.callvar_bases(spark, data).collect()}
    assert {w for w in want if len(w[2]) == len(w[3]) == 1} <= bases


def test_alignments_with_counts_stand_for_reads_alike(spark, planted):
    from pyspark.sql import functions as F

    rows = [r for r in reads_of(planted, True, 3, 10) for _ in range(1 + r[3] % 3)]
    each = spark.createDataFrame(rows, SCHEMA)
    alike = each.groupBy(*[c for c in each.columns if c != "name"]).agg(F.count("*").alias("n")).withColumn("name", F.lit(""))
    assert alike.count() < len(rows)
    regions = spark.createDataFrame([("chr1", 100, 2950)], "chrom string, start long, end long")
    got, want = (sorted(assembly.call_assembled(x, regions, x).collect()) for x in (alike, each))
    assert want and got == want


def test_each_alignment_of_line_items_is_made_once(spark):
    from pyspark.sql import functions as F

    from strandlake.plans import adapter

    data = "/root/testdata/sf0.01"
    for treated in (True, False):
        found = adapter.alignments(spark, data, treated).select("chrom", "pos", "end", "cigar", "seq", "md", "n").collect()
        want = {}
        for r in adapter.items(spark, data).where("treated" if treated else "not treated").groupBy("chrom", "pos", (F.col("length") % 2).alias("odd")).count().collect():
            key = r["chrom"], r["pos"], *adapter.aligned(r["chrom"], r["pos"], treated and r["odd"] == 0)
            want[key] = want.get(key, 0) + r["count"]
        got = {}
        for r in found:
            got[tuple(r)[:6]] = got.get(tuple(r)[:6], 0) + r["n"]
        assert got == want and len(found) <= (2 if treated else 1) * len({(r["chrom"], r["pos"]) for r in found})
