"""SimHash near-dedup: pigeonhole blocks, then a verified Hamming distance.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its
word shingles.  Documents with the same fingerprint form a class; classes link
at ``max_bits`` or fewer differing bits, and a component is what links reach.

Candidates.  The 64 bits are cut into ``BLOCKS`` blocks; two fingerprints that
differ in at most ``max_bits`` bits agree on ``BLOCKS - max_bits`` blocks, so a
join on every choice of that many blocks loses no link.  Within one block key
the differing bits lie outside the agreed blocks.

Hot keys.  A key with more than ``HOT`` fingerprints is not compared pairwise.
Its members go the exact linear way instead: two fingerprints are within four
bits precisely if some value is within two bits of both, so members are grouped
on the values within two bits of them, and every group is linked to its
smallest member.  Everything emitted is linear in the number of fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_class, map_texts, small_batches, stored, words

BITS = 64


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words; fewer words: of the whole sequence."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    flat = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([digest(flat, seed)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    begin = starts[: len(found) - size + 1]
    end = (starts + lengths - 1)[size - 1 :]
    return np.fromiter((digest(flat[a:b], seed) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))


def bit_counts(digests: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each run of big-endian hashes (n, 8 bytes); the highest bit first.

    Eight bits are counted at once, a byte each, so runs are added up in parts
    of 255 hashes at most.
    """
    ends = np.r_[starts[1:], len(digests)]
    parts = np.concatenate([np.arange(a, b, 255) for a, b in zip(starts, ends)]) if (ends - starts).max(initial=0) > 255 else starts
    lanes = np.unpackbits(digests, axis=1).view(np.uint64)
    counts = np.add.reduceat(lanes, parts, axis=0).view(np.uint8).astype(np.int32)
    return counts if len(parts) == len(starts) else np.add.reduceat(counts, np.searchsorted(parts, starts), axis=0)


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash; a bit is set if over half the hashes set it."""
    hashes = shingle_hashes(text, size, seed)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += bit_counts(part, np.zeros(1, np.int64))[0]
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


#: Above so many fingerprints under one block key the exact linear way takes over.
HOT = 1024


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp long) of every row, and further columns of it, named own_ and their name; null and empty texts have fingerprint zero."""

    def work(texts: list[str]) -> list[np.ndarray]:
        return [np.array([fingerprint(t, size, seed) for t in texts], np.uint64).view(np.int64)]

    also = also or {}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(f"own_{n}") for n, c in also.items()])
    return map_texts(rows, work, "fp long", keep=("doc_id", *[f"own_{n}" for n in also]))


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """One mask for each choice of the blocks that a close pair may agree on."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - max_bits)]


def blocks_for(count: int, max_bits: int) -> int:
    """Blocks such that a key of evenly spread fingerprints has about 64 of them at most."""
    blocks = max_bits + 2
    while blocks < BITS and count >> int(BITS * (blocks - max_bits) / blocks) > 64:
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class _Forest:
    """Union-find that keeps of many links a spanning forest, each of them a link that was found."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def link(self, a: int, b: int) -> None:
        one, two = self.root(a), self.root(b)
        if one != two:
            self.up[max(one, two)] = min(one, two)
            self.found.append((a, b))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(np.array(self.found, np.int64).reshape(-1, 2), columns=["a", "b"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _linked(key: np.ndarray, fp: np.ndarray, max_bits: int, forest: _Forest) -> None:
    """Link the close pairs inside each run of equal keys; runs are short."""
    at = np.arange(len(key) - 1)
    shift = 1
    while len(at := at[at + shift < len(key)]):
        at = at[key[at] == key[at + shift]]
        near = at[_popcount(fp[at] ^ fp[at + shift]) <= max_bits]
        for a, b in zip(fp[near].tolist(), fp[near + shift].tolist()):
            forest.link(a, b)
        shift += 1


def _block_links(max_bits: int, hot: int):
    """Over rows sorted by key: links of ordinary keys, and the members of hot ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        in_hot: int | None = None

        def work(key: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
            if not len(key):
                return
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            heavy = np.repeat((sizes > hot) | (key[starts] == in_hot if in_hot is not None else False), sizes)
            if heavy.any():
                yield pd.DataFrame({"a": fp[heavy], "b": pd.array([None] * int(heavy.sum()), "Int64")})
            forest = _Forest()
            _linked(key[~heavy], fp[~heavy], max_bits, forest)
            if forest.found:
                yield forest.frame()

        for pdf in batches:
            key = np.concatenate((held_key, pdf["key"].to_numpy(np.int64)))
            fp = np.concatenate((held_fp, pdf["fp"].to_numpy(np.int64)))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from work(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
            if len(key) and in_hot is not None and key[0] != in_hot:
                in_hot = None
            if len(key) > hot:  # goes on into the next batch, and is hot whatever follows
                in_hot = int(key[0])
                yield pd.DataFrame({"a": fp, "b": pd.array([None] * len(fp), "Int64")})
                key, fp = key[:0], fp[:0]
            held_key, held_fp = key, fp
        yield from work(held_key, held_fp)

    return run


def midpoints(fp: np.ndarray, radius: int) -> np.ndarray:
    """Every value within ``radius`` bits of each fingerprint, a row for each."""
    flips = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in itertools.combinations(range(BITS), r)]
    return fp.view(np.uint64)[:, None] ^ np.array(flips, np.uint64)[None, :]


def _midpoint_rows(radius: int):
    """Chunk by chunk: links through values that fingerprints share, and one member for each value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = np.sort(pdf["fp"].to_numpy(np.int64))
            for at in range(0, len(whole), 512):
                fp = whole[at : at + 512]
                points = midpoints(fp, radius)
                owner = np.repeat(fp, points.shape[1])
                flat = points.ravel().view(np.int64)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                first = np.r_[True, flat[1:] != flat[:-1]]
                lead = owner[np.flatnonzero(first)[np.cumsum(first) - 1]]
                forest = _Forest()
                for a, b in set(zip(owner[~first].tolist(), lead[~first].tolist())):
                    forest.link(a, b)
                inner = forest.frame()
                yield pd.DataFrame({"point": np.r_[flat[first], inner["a"]], "fp": np.r_[owner[first], inner["b"]], "inner": np.r_[np.zeros(int(first.sum()), bool), np.ones(len(inner), bool)]})

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = 4, hot: int = HOT) -> DataFrame:
    """Links (a, b) that span every component of distinct fingerprints ``fp``.

    Exact at any size: a pair within ``max_bits`` bits is always connected by
    the links returned, though not every such pair is returned itself.  Where
    ``max_bits`` is odd, links through hot keys reach one bit further.
    """
    masks = [_signed(m) for m in block_masks(blocks_for(distinct.count(), max_bits), max_bits)]
    keys = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(masks)])).alias("key"))
    dealt = keys.repartition("key").sortWithinPartitions("key")
    small_batches(distinct.sparkSession, rows=32_768)
    found = stored(dealt.mapInPandas(_block_links(max_bits, hot), "a long, b long"), "block-links")
    small_batches(distinct.sparkSession)
    links = found.where(F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    heavy = found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    if found.where(F.col("b").isNull()).isEmpty():
        return links
    rows = stored(heavy.mapInPandas(_midpoint_rows((max_bits + 1) // 2), "point long, fp long, inner boolean"), "midpoints")
    outer = rows.where(~F.col("inner")).select("point", "fp")
    lead = outer.groupBy("point").agg(F.min("fp").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    across = outer.join(lead, "point").where("fp != lead").select(F.col("fp").alias("a"), F.col("lead").alias("b")).distinct()
    return links.unionByName(rows.where("inner").select(F.col("point").alias("a"), F.col("fp").alias("b"))).unionByName(across)


def near_duplicates(docs: DataFrame, size: int = 4, seed: int = 42, max_bits: int = 4, hot: int = HOT, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp, component_id, group) for each row of ``docs`` (doc_id, text, and any other columns).

    component_id is the smallest doc_id reachable through links, the row's own
    included; ``group`` is the same for the rows of one component and no others.
    ``also`` names further columns of each row.  Null and empty texts share
    fingerprint zero and link like any other.  Rows that repeat a doc_id each get
    a row.  An empty table gives no rows.  A null id gets the component of its
    fingerprint's class, null where that holds no other id.
    """
    from .graph import components

    prints = stored(fingerprints(docs, size, seed, also), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-classes")
    # a class is named by its smallest doc_id (none counts as the largest) and its fingerprint, so the least name reachable holds the answer
    name = F.struct(F.col("least").isNull().alias("none"), "least", "fp")
    names = lambda end: classes.select(F.col("fp").alias(end), name.alias(f"{end}_name"))
    links = fingerprint_links(classes.select("fp"), max_bits, hot).join(names("a"), "a").join(names("b"), "b")
    roots = components(links.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))).select(F.col("node.fp").alias("fp"), "root")
    named = classes.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", name).alias("root"))
    named = stored(named.select("fp", "n", F.col("root.least").alias("component_id"), F.col("root.fp").alias("group")), "fingerprint-components")
    total = classes.agg(F.sum("n")).first()[0] or 0
    return by_class(prints, named, "fp", "n", total).select("doc_id", "fp", "component_id", "group", *[F.col(f"own_{n}").alias(n) for n in also or {}])


def fingerprint_hex(fp):
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
