"""Variants by local assembly: a graph of k-mers over each region, its bubbles against the reference, and what supports them.

Reads are never gathered by region.  Their k-mers are counted by region with
partial sums on each task, so a region of any depth is a bounded number of
distinct k-mers, of which those that too few reads show are dropped before the
graph is built.  The reference comes from the reads themselves, by CIGAR and MD.

In the graph every path that leaves the reference and comes back to it is a
bubble; paths that never come back are tips and are left out.  A bubble's two
sides are aligned with affine gaps and each difference is a variant; its support
are the k-mers that only one side has, in treatment and control.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median_low

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .variants import SKIPPED, reads_in

#: Letters of a k-mer, reads that must show it, k-mers of a bubble's side at most, bubbles that may leave one place.
K, LEAST, LONGEST, BRANCHES = 21, 3, 250, 64
#: Costs of the alignment of a bubble's sides.
MISMATCH, OPEN, EXTEND = 4, 6, 1
#: Coordinates of a bin when reads are joined to regions.
WIDTH = 1 << 12


def reference_bases(pos: int, cigar: str, seq: str, md: str) -> list[tuple[int, str]]:
    """(position, reference base) under a read, deleted bases included."""
    placed, at, read_at, gone = [], pos, 0, []
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            placed += [(at + i, seq[read_at + i]) for i in range(n)]
        if op == "D":
            gone += range(at, at + n)
        if op in "MDN=X":
            at += n
        if op in "MIS=X":
            read_at += n
    out, k, deleted = [], 0, iter(gone)
    for same, lost, other in re.findall(r"(\d+)|\^([A-Z]+)|([A-Z])", md):
        if same:
            out += placed[k : k + int(same)]
            k += int(same)
        elif lost:
            out += [(p, b) for b, p in zip(lost, deleted)]
        else:
            out.append((placed[k][0], other))
            k += 1
    return out


def _usable(alignments: DataFrame, least_mapq: int) -> DataFrame:
    return alignments.where((F.col("flag").bitwiseAND(SKIPPED) == 0) & (F.col("mapq") >= least_mapq) & F.col("md").isNotNull() & F.col("chrom").isNotNull())


def _in_regions(alignments: DataFrame, regions: DataFrame) -> DataFrame:
    """Alignments with each region (start, stop) that they touch, by bins of the coordinate."""
    spread = lambda df, low, high: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / WIDTH), F.floor((F.col(high) - 1) / WIDTH))))
    marked = spread(regions.where("end > start").select("chrom", F.col("start").alias("first"), F.col("end").alias("stop")).distinct(), "first", "stop")
    met = spread(alignments.where("end > pos"), "pos", "end").join(marked, ["chrom", "_bin"]).where("pos < stop and end > first")
    # A pair that meets in several bins counts in the first of them.
    return met.where(F.col("_bin") == F.floor(F.greatest("pos", "first") / WIDTH)).drop("_bin")


def kmer_counts(treat: DataFrame, control: DataFrame | None, regions: DataFrame, k: int = K, least: int = LEAST, least_mapq: int = 20) -> DataFrame:
    """(chrom, first, stop, kmer, n, m): how many treatment and control reads of each region show a k-mer; rare ones are left out."""
    sides = [(treat, 1, 0)] + ([(control, 0, 1)] if control is not None else [])
    parts = []
    for side, n, m in sides:
        reads = _in_regions(_usable(side, least_mapq).select("chrom", "pos", "end", "seq", reads_in(side)), regions).where(F.length("seq") >= k)
        # Reads alike in a region are one row with a count before they are cut up.
        alike = reads.groupBy("chrom", "first", "stop", "seq").agg(F.sum("n").alias("c"))
        cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substring("seq", i, F.lit(k))))
        parts.append(alike.select("chrom", "first", "stop", F.explode(cut).alias("kmer"), (F.col("c") * n).alias("n"), (F.col("c") * m).alias("m")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy("chrom", "first", "stop", "kmer").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where((F.col("n") + F.col("m") >= least) & ~F.col("kmer").contains("N"))


def references(treat: DataFrame, control: DataFrame | None, regions: DataFrame, margin: int = 2 * K, least_mapq: int = 20) -> DataFrame:
    """(chrom, first, stop, letters): the reference (p, b) under each region and ``margin`` bases around it, where reads lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(r["chrom"], r["first"], r["stop"], p, b) for r in batch.to_pylist() for p, b in reference_bases(r["pos"], r["cigar"], r["seq"], r["md"]) if r["first"] - margin <= p < r["stop"] + margin}
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["chrom", "first", "stop", "p", "b"])

    both = [_usable(x, least_mapq).select("chrom", "pos", "end", "cigar", "seq", "md") for x in (treat, control) if x is not None]
    every = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    bases = _in_regions(every.distinct(), regions).mapInArrow(run, "chrom string, first long, stop long, p long, b string")
    one = bases.groupBy("chrom", "first", "stop", "p").agg(F.min("b").alias("b"))
    letters = F.array_sort(F.collect_list(F.struct("p", "b")))
    return one.groupBy("chrom", "first", "stop").agg(letters.alias("letters"))


def aligned(a: str, b: str) -> list[tuple[str, str]]:
    """The columns of the cheapest global alignment of two strings with affine gaps, '' for a gap."""
    n, m, far = len(a), len(b), 10**9
    best = np.full((3, n + 1, m + 1), far)  # both letters, a letter of ``a`` alone, a letter of ``b`` alone
    best[0, 0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                best[0, i, j] = best[:, i - 1, j - 1].min() + MISMATCH * (a[i - 1] != b[j - 1])
            if i:
                best[1, i, j] = min(best[1, i - 1, j], min(best[0, i - 1, j], best[2, i - 1, j]) + OPEN) + EXTEND
            if j:
                best[2, i, j] = min(best[2, i, j - 1], min(best[0, i, j - 1], best[1, i, j - 1]) + OPEN) + EXTEND
    out, i, j, kind = [], n, m, int(best[:, n, m].argmin())
    while i or j:
        if kind == 0:
            out.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
            kind = int(best[:, i, j].argmin()) if i or j else 0
        else:
            here, (k, l) = best[kind, i, j] - EXTEND, (i - 1, j) if kind == 1 else (i, j - 1)
            out.append((a[i - 1], "") if kind == 1 else ("", b[j - 1]))
            if best[kind, k, l] != here:
                kind = next(x for x in (0, 1, 2) if x != kind and best[x, k, l] + OPEN == here)
            i, j = k, l
    return out[::-1]


def differences(ref: str, alt: str, at: int) -> list[tuple[int, str, str]]:
    """(position, reference, alternative) of each difference; insertions and deletions stand leftmost and begin with the base before them."""
    head = 0
    while head < min(len(ref), len(alt)) and ref[head] == alt[head]:
        head += 1
    tail = 0
    while tail < min(len(ref), len(alt)) - head and ref[-1 - tail] == alt[-1 - tail]:
        tail += 1
    inner, other = ref[head : len(ref) - tail], alt[head : len(alt) - tail]
    columns = [(x, y) for x, y in zip(inner, other)] if len(inner) == len(other) else [(x, "") for x in inner] if not other else [("", y) for y in other] if not inner else aligned(inner, other)
    out, place, k = [], head, 0
    while k < len(columns):
        x, y = columns[k]
        if x and y:
            if x != y:
                out.append((at + place, x, y))
            place, k = place + 1, k + 1
            continue
        run = k
        while run < len(columns) and bool(columns[run][0]) == bool(x) and not (columns[run][0] and columns[run][1]):
            run += 1
        lost, new = "".join(c[0] for c in columns[k:run]), "".join(c[1] for c in columns[k:run])
        left, text = place, lost or new
        while left > 1 and ref[left - 1] == text[-1]:
            text, left = text[-1] + text[:-1], left - 1
        before = ref[left - 1]
        out.append((at + left - 1, before + text, before) if lost else (at + left - 1, before, before + text))
        place, k = place + len(lost), run
    return out


def bubbles(reference: str, kmers: set[str], k: int) -> list[tuple[int, int, str]]:
    """(i, j, text): each path of k-mers from the reference's at i to its own at j that is not the reference, as the text of all its letters."""
    places: dict[str, int] = {}
    for i in range(len(reference) - k + 1):
        word = reference[i : i + k]
        places[word] = -1 if word in places else i
    out = []
    for i in range(len(reference) - k):
        if places.get(reference[i : i + k], -1) != i:
            continue
        open_ = [reference[i : i + k] + c for c in "ACGT" if c != reference[i + k] and reference[i + 1 : i + k] + c in kmers]
        for text in open_:
            found = 0
            walks = [text]
            while walks and found < BRANCHES:
                walk = walks.pop()
                j = places.get(walk[-k:])
                if j is not None:
                    if j > i:
                        out.append((i, j, walk))
                        found += 1
                    continue
                if len(walk) - k < LONGEST:
                    walks += [walk + c for c in "ACGT" if walk[1 - k :] + c in kmers]
    return out


def _support(words: list[str], counts: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """The middle number of reads, in treatment and control, that show each of some k-mers."""
    found = [counts.get(w, (0, 0)) for w in words]
    return (median_low([x[0] for x in found]), median_low([x[1] for x in found])) if found else (0, 0)


def genotype(ref_n: int, alt_n: int, error: float = 0.01) -> tuple[str, float]:
    """(genotype, log10 likelihood ratio of it over no variant) of two numbers of reads."""
    same, other = np.log10(1 - error), np.log10(error)
    none, het, hom = ref_n * same + alt_n * other, (ref_n + alt_n) * np.log10(0.5), ref_n * other + alt_n * same
    name, best = max((("0/0", none), ("0/1", het), ("1/1", hom)), key=lambda x: x[1])
    return name, float(best - none)


CALLS = "chrom string, pos long, ref string, alt string, kind string, genotype string, depth long, alt_n long, score double, control_depth long, control_alt_n long, control_genotype string"


def call_assembled(treat: DataFrame, regions: DataFrame, control: DataFrame | None = None, k: int = K, least: int = LEAST, least_score: float = 2.0, least_mapq: int = 20) -> DataFrame:
    """``CALLS``: substitutions, insertions and deletions inside regions (chrom, start, end) of alignments (``bam.SCHEMA``).

    A deletion or insertion begins with the base before it.  ``depth`` and
    ``alt_n`` come from the k-mers that tell a bubble's sides apart; the score
    is the treatment's log10 likelihood ratio of its genotype over no variant, and
    a variant is called where it is at least ``least_score``.  Alignments without
    MD, unmapped or poorly mapped take no part; regions without reads have no calls.
    Those with a column ``n`` stand for so many reads alike.
    """
    counted = kmer_counts(treat, control, regions, k, least, least_mapq)
    grounds = references(treat, control, regions, 2 * k, least_mapq)

    def run(key, words: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        chrom, first, stop = key
        out: dict[tuple, tuple] = {}
        if len(words) and len(ground):
            letters = {x["p"]: x["b"] for x in ground["letters"].iloc[0]}
            begin = min(letters)
            reference = "".join(letters.get(p, "N") for p in range(begin, max(letters) + 1))
            counts = {w: (n, m) for w, n, m in zip(words["kmer"], words["n"].tolist(), words["m"].tolist())}
            known = {reference[i : i + k] for i in range(len(reference) - k + 1)}
            for i, j, text in bubbles(reference, set(counts), k):
                ref = reference[i : j + k]
                cut = lambda s: [s[x : x + k] for x in range(1, len(s) - k)]
                alt_n, alt_m = _support([w for w in cut(text) if w not in known], counts)
                own = set(cut(text))
                ref_n, ref_m = _support([w for w in cut(ref) if w not in own], counts)
                name, score = genotype(ref_n, alt_n)
                if name == "0/0" or score < least_score:
                    continue
                for pos, a, b in differences(ref, text, begin + i):
                    if first <= pos < stop and "N" not in a:
                        kind = "snv" if len(a) == len(b) else "deletion" if len(a) > len(b) else "insertion"
                        row = (chrom, pos, a, b, kind, name, ref_n + alt_n, alt_n, score, ref_m + alt_m, alt_m, genotype(ref_m, alt_m)[0])
                        if (pos, a, b) not in out or out[pos, a, b][8] < score:
                            out[pos, a, b] = row
        return pd.DataFrame(list(out.values()), columns=[c.split()[0] for c in CALLS.split(", ")])

    by = ["chrom", "first", "stop"]
    return counted.groupBy(*by).cogroup(grounds.groupBy(*by)).applyInPandas(lambda key, a, b: run(key, a, b), CALLS)
