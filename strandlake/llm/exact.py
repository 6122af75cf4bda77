"""Exact dedup through a minimal perfect hash over historical distinct digests.

The digests of what came before are cut into shards by their leading bits; each
shard is a minimal perfect hash (levels of collision-free bit positions, ranked)
whose slots hold the full 32-byte digest, the locator of the winning row and
the size of its group.  A new digest is looked up in its shard's slot and counts
as a member only where all its bytes equal the slot's.  Nonmembers are grouped
among themselves.

Rows are collapsed to distinct digests, with partial sums on the map side, before
anything is shuffled by digest, so a text that makes up a third of all rows is
one row in its shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_class, lower_ascii, shards_for, small_batches, stored

WORD = np.uint64(0x9E3779B97F4A7C15)
#: Bit positions offered for each key at a level.
GAMMA = 2
#: Distinct digests that one shard holds at about.
PER_SHARD = 20_000


def _level_hash(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    """A position below ``size``, drawn anew for each level from two words of the digest."""
    with np.errstate(over="ignore"):
        x = low ^ (high * np.uint64(2 * level + 1)) ^ (WORD * np.uint64(level + 1))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
    return flat[:, 1].copy(), flat[:, 2].copy()


class PerfectHash:
    """Sends n distinct 32-byte digests to the slots 0..n-1, one to one.

    Any other digest gets some slot or -1; the caller compares what lies there.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in (y.astype(np.int64) for y in levels)]

    @classmethod
    def build(cls, digests: list[bytes]) -> PerfectHash:
        return cls.build_words(*_halves(digests))

    @classmethod
    def build_words(cls, low: np.ndarray, high: np.ndarray) -> PerfectHash:
        """The hash of keys given as two words each, which are distinct in the first or the second."""
        levels = []
        while len(low):
            size = max(64, GAMMA * len(low))
            at = _level_hash(low, high, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = ~alone[at]
            low, high = low[left], high[left]
        return cls(levels)

    def slots(self, digests: list[bytes]) -> np.ndarray:
        return self.slots_of(*_halves(digests)) if digests else np.empty(0, np.int64)

    def slots_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slots of keys given as two words each."""
        out = np.full(len(low), -1, np.int64)
        open_ = np.arange(len(low))
        for k, bits in enumerate(self.levels):
            at = _level_hash(low[open_], high[open_], k, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *(len(x) for x in self.levels)], "<u4").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes = np.frombuffer(raw, "<u4", n, 4)
        at, levels = 4 + 4 * n, []
        for size in sizes.tolist():
            wide = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, wide, at))[:size].astype(bool))
            at += wide
        return cls(levels)


INDEX = "shard long, hash binary, digests binary, locators array<long>, sizes array<long>"


def text_digest(text: Column) -> Column:
    """SHA-256 of the A-Z lower-cased text, null as ''."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))).cast("binary"), 256))


def digests(docs: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, digest) of every row, and further columns of it, named own_ and their name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), *[c.alias(f"own_{n}") for n, c in (also or {}).items()])


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, locator, size): of equal digests the largest doc_id wins."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("locator"), F.count("*").alias("size"))


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards))


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """The sharded perfect-hash index of (digest, locator, size) rows; one row a shard."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf["digest"].tolist()
        table = PerfectHash.build(found)
        order = np.argsort(table.slots(found))
        return pd.DataFrame(
            {
                "shard": [key[0]],
                "hash": [table.to_bytes()],
                "digests": [b"".join(found[i] for i in order)],
                "locators": [[None if pd.isna(x) else int(x) for x in pdf["locator"].iloc[order]]],
                "sizes": [pdf["size"].to_numpy()[order].tolist()],
            }
        )

    return distinct.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(run, INDEX)


def look_up(index: DataFrame, distinct: DataFrame, shards: int) -> DataFrame:
    """Every digest of the index and of ``distinct`` once: (digest, locator, size, member).

    ``member`` is null for a historical digest that ``distinct`` does not repeat,
    true for one that it does (the larger locator wins, the sizes add up) and
    false for a new one.
    """

    def run(key, slots: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        fresh = new["digest"].tolist()
        locators = [None if pd.isna(x) else int(x) for x in new["locator"]]
        sizes = new["size"].astype("int64").tolist()
        out: list[tuple] = []
        if len(slots):
            table = PerfectHash.from_bytes(slots["hash"].iloc[0])
            held, winner = slots["digests"].iloc[0], list(slots["locators"].iloc[0])
            size, seen = list(slots["sizes"].iloc[0]), [None] * len(slots["sizes"].iloc[0])
        else:
            table, held, winner, size, seen = PerfectHash([]), b"", [], [], []
        for d, who, n, at in zip(fresh, locators, sizes, table.slots(fresh).tolist()):
            if at >= 0 and held[32 * at : 32 * at + 32] == d:
                known = [x for x in (winner[at], who) if x is not None and not pd.isna(x)]
                winner[at], size[at], seen[at] = max(known, default=None), size[at] + n, True
            else:
                out.append((d, who, n, False))
        for at in range(len(size)):
            who = winner[at]
            out.append((held[32 * at : 32 * at + 32], None if who is None or pd.isna(who) else int(who), int(size[at]), seen[at]))
        frame = pd.DataFrame(out, columns=["digest", "locator", "size", "member"])
        return frame.astype({"locator": "Int64", "member": "boolean"})

    new = distinct.withColumn("shard", _shard(shards))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(run, "digest binary, locator long, size long, member boolean")


def exact_duplicates(docs: DataFrame, history: DataFrame | None = None, per_shard: int = PER_SHARD, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for each row of ``docs``, and the columns of it that ``also`` names.

    ``history`` (doc_id, text) is what came before; without one, the rows that
    arrived first (those with ids up to the median, about) are the history of the
    rest, and every row is returned.  Texts are equal when identical after A-Z
    lower-casing; null counts as ''.  Of equal texts the largest doc_id stays.
    Rows that repeat a doc_id and its text are all kept or all dropped; a null
    id stays only where its group holds no other.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession, rows=10_000)
    rows = stored(digests(docs, also), "digests")
    if history is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        early = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False))
        split = stored(rows.groupBy("digest", early.alias("early")).agg(F.max("doc_id").alias("locator"), F.count("*").alias("size")), "distinct-digests")
        past, new = split.where("early").drop("early"), split.where("not early").drop("early")
    else:
        past, new = (stored(distinct_digests(x), "distinct-digests") for x in (digests(history), rows))
    # A shard holds both sides' digests, so the larger side says how many there are.
    shards = shards_for(max(past.count(), new.count()), per_shard)
    index = stored(build_index(past, shards), "digest-index")
    classes = stored(look_up(index, new, shards), "digest-classes")
    out = by_class(rows, classes, "digest", "size", rows.count())
    kept = F.col("doc_id").eqNullSafe(F.col("locator")).alias("kept")
    return out.select("doc_id", "digest", F.col("locator").alias("keep_id"), F.col("size").alias("group_size"), kept, *[F.col(f"own_{n}").alias(n) for n in also or {}])
