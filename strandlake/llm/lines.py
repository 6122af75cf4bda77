"""Fuzzy line dedup: MinHash bands, then verified edit similarity.

Every line of enough words is normalised (lower-cased, ASCII marks made spaces,
single spaces), named by a digest and given ``BANDS`` hashes, each of ``ROWS``
minima over the line's distinct longer words.  Lines of one digest are equal; two lines
that agree on a band are a candidate, and every candidate pair is verified by the
edit similarity of the lines themselves before anything is joined.  Of each
connected group of lines one occurrence stays: the first line of the smallest
doc_id.

Two lines whose words are alike by J (common over all distinct words) share a
band with probability 1 - (1 - J ** ROWS) ** BANDS.

Only what is not joined yet is verified.  First each line meets the next one
under its keys, in one order for all keys, which joins nearly all that is alike
with as many pairs as lines.  Then, only where lines under one key still lie in
different groups, those outside the key's largest group meet all lines of other
groups.  They meet within tasks, in blocks of bounded size, and two lines only
under the first key that they share; what leaves a task is a link, never a pair
that was looked at.  So no link between groups is lost, however many lines a key has.

Only digests and bands are shuffled by line; the lines' texts travel for the few
that share a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_class, long_ids, small_batches, stored
from .graph import components

#: Shorter lines are never dropped.
MIN_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Lines of one key that meet others in one block, about.
SHARE = 1024
#: Pairs that a task gathers before it verifies them.
POOL = 8192
#: Pairs that are measured at once, fewest and most; words of 64 rows to which that pays, and words of masks at most.
FEWEST, MOST, WIDEST, MASKS = 48, 1024, 32, 4_000_000
#: Heads that a line is compared with before it becomes one, those next to it.
ASKED = 2
#: ASCII marks and control characters become spaces; line ends stay.
SPACED = bytes(c if c in b"\n0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))
#: Words of so many bytes say little, and are left out where as many others are there.
SHORT, FEW = 3, 5
#: How far two lists of words are moved on, the nearest first, to find the words that both have.
STEPS = sorted(((x, y) for x in range(4) for y in range(4) if x or y), key=sum)
#: Low bits of a line's short name that hold its length, this value for all longer ones.
LONG = 4095
#: Lines that a task remembers having given the bands of.
SEEN = 1_000_000
#: Bits of the filter of lines whose texts are needed, at most (a power of two).
FILTER = 1 << 28
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def normalised_lines(text: str) -> list[list[bytes]]:
    """The words of each line."""
    return [line.split() for line in text.lower().encode("utf-8", "surrogatepass").translate(SPACED).split(b"\n")]


def word_hashes(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a buffer from its first sixteen bytes, its last eight and its length.

    The buffer has 24 bytes more after the last word.
    """
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        x = (eights[starts] & _MASKS[np.minimum(lengths, 8)]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= (eights[starts + 8] & _MASKS[np.clip(lengths - 8, 0, 8)]) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= np.where(lengths > 16, eights[np.maximum(starts + lengths - 8, 0)], np.uint64(0)) * np.uint64(0x165667B19E3779F9)
        x ^= lengths.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def line_bands(lines: list[bytes]) -> np.ndarray:
    """A row of ``BANDS`` hashes for each line (words single-spaced, one at least), as signed integers."""
    out = np.zeros((len(lines), BANDS), np.int32)
    for at in range(0, len(lines), 1024):
        raw = b"\n".join(lines[at : at + 1024])
        text = np.frombuffer(raw, np.uint8)
        stops = np.r_[np.flatnonzero((text == 32) | (text == 10)), len(text)]
        starts = np.r_[0, stops[:-1] + 1]
        lengths = stops - starts
        line = np.r_[0, np.cumsum(text[stops[:-1]] == 10)]
        long = np.bincount(line, lengths > SHORT)
        used = (lengths > SHORT) | (long < FEW)[line]
        first = np.flatnonzero(np.diff(line[used], prepend=-1))
        digests = word_hashes(raw + bytes(24), starts[used], lengths[used])
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                mixed = np.zeros(len(first), np.uint64)
                for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                    mixed = (mixed ^ np.minimum.reduceat(digests * factor, first)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                out[at : at + 1024, band] = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def short_name(digest: bytes, line: bytes) -> int:
    """A signed 64-bit name whose low bits are the line's length; unlike lines may share it, which verification tells apart."""
    length = min(LONG, len(line.decode("utf-8", "surrogatepass")))
    return int.from_bytes(digest[:8], "big", signed=True) & ~LONG | length


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as one integer's bits."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        cross = (((same & up) + up) ^ up) | same
        grows, falls = down | ~(cross | up) & full, up & cross
        score += 1 if grows & top else -1 if falls & top else 0
        grows, falls = (grows << 1 | 1) & full, falls << 1 & full
        up, down = falls | ~(same | down | grows) & full, grows & (same | down)
    return score


def pair_counts(a: str, hashes: int = 1024) -> np.ndarray:
    """How often each of so many hashes (a power of two) of neighbouring characters occurs; an edit changes four counts by one at most."""
    c = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.bincount((c[:-1] * 31 + c[1:]) & (hashes - 1), minlength=hashes)


def aligned_cost(a: list[str], b: list[str]) -> int:
    """Edits in characters, at most, from one list of words to another: after unlike words it goes on at the next two that both have."""
    i = j = cost = 0
    size = lambda words: sum(map(len, words)) + len(words)
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for x, y in STEPS:
            if a[i + x : i + x + 2] == b[j + y : j + y + 2] and i + x < len(a) and j + y < len(b):
                cost += max(size(a[i : i + x]), size(b[j : j + y]))
                i, j = i + x, j + y
                break
        else:
            break
    return cost + max(size(a[i:]), size(b[j:]))


def _common_start(a: str, b: str) -> int:
    """How many characters both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def told_within(a: str, b: str, allowed: int) -> tuple[int | None, str, str]:
    """A number of edits that tells, without a table of edits, whether ``allowed`` are enough (then it is at least the distance), or None; and what both texts do not begin and end with."""
    if abs(len(a) - len(b)) > allowed:
        return allowed + 1, a, b
    low = _common_start(a, b)
    a, b = a[low:], b[low:]
    high = _common_start(a[::-1], b[::-1])
    a, b = a[: len(a) - high], b[: len(b) - high]
    if (most := max(len(a), len(b))) <= allowed:
        return most, a, b
    if (cost := aligned_cost(a.split(" "), b.split(" "))) <= allowed:
        return cost, a, b
    if min(len(a), len(b)) > 64 and np.abs(pair_counts(a) - pair_counts(b)).sum() > 4 * allowed:
        return allowed + 1, a, b
    return None, a, b


def edits_within(a: str, b: str, allowed: int) -> int | None:
    """A number of edits from one text to the other that is ``allowed`` at most, or None where it takes more."""
    cost, a, b = told_within(a, b, allowed)
    if cost is None:
        cost = edit_distance(a, b)
    return cost if cost <= allowed else None


def allowed_edits(a: str, b: str, similarity: float) -> int:
    """Most edits at which 1 - distance / longer length reaches ``similarity``."""
    return int((1 - similarity) * max(len(a), len(b)) + 1e-9)


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length reaches ``similarity``."""
    return edits_within(a, b, allowed_edits(a, b, similarity)) is not None


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs, a column of all their tables at a time as words of 64 bits.

    The shorter texts are the tables' rows, all of as many words: both texts of
    a pair end in as many equal marks as fill the last one, which changes no distance.
    """
    a, b = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)))
    width = max(1, -(-max(map(len, a)) // 64))
    order = sorted(range(len(a)), key=lambda i: len(a[i]) - len(b[i]))  # the most columns first, once all have equally many rows
    code = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.zeros((len(a), 64 * width), np.uint32)
    columns = np.zeros((len(a), 64 * width + max(len(y) - len(x) for x, y in zip(a, b))), np.uint32)
    for place, i in enumerate(order):
        rows[place, : len(a[i])] = code(a[i]) + 1
        columns[place, : len(b[i])] = code(b[i]) + 1
    kinds, ids = np.unique(np.concatenate((rows, columns), axis=1), return_inverse=True)
    if width * len(kinds) * len(a) > MASKS and len(a) > 1:
        half = len(a) // 2
        return np.concatenate((distances(a[:half], b[:half]), distances(a[half:], b[half:])))
    ids = np.ascontiguousarray(ids.reshape(len(a), -1).T) * len(a) + np.arange(len(a))
    masks = np.zeros((width, len(kinds) * len(a)), np.uint64)
    for i in range(64 * width):
        masks[i // 64, ids[i]] |= np.uint64(1 << i % 64)
    ids = ids[64 * width :]
    ends = np.array([64 * width + len(b[i]) - len(a[i]) for i in order])
    left = np.searchsorted(-ends, -np.arange(len(ids)), side="left")
    up, down = np.full((width, len(a)), ~np.uint64(0)), np.zeros((width, len(a)), np.uint64)
    score = np.full(len(a), 64 * width, np.int64)
    one, top = np.uint64(1), np.uint64(63)
    for j, n in enumerate(left.tolist()):
        at, grows, falls = ids[j, :n], one, np.uint64(0)
        for w in range(width):
            same, vp, vn = masks[w].take(at), up[w, :n], down[w, :n]
            across = same | vn
            same |= falls
            cross = same & vp
            cross += vp
            cross ^= vp
            cross |= same
            more = ~(cross | vp)
            more |= vn
            cross &= vp
            over, under = more >> top, cross >> top
            more <<= one
            more |= grows
            cross <<= one
            cross |= falls
            np.bitwise_and(more, across, out=vn)
            across |= more
            np.invert(across, out=across)
            np.bitwise_or(cross, across, out=vp)
            grows, falls = over, under
        score[:n] += grows.astype(np.int64) - falls.astype(np.int64)
    out = np.empty(len(a), np.int64)
    out[order] = score
    return out


def similar_pairs(a: list[str], b: list[str], similarity: float = SIMILARITY) -> np.ndarray:
    """For each pair whether it is ``similar``; those that nothing cheaper tells are measured many at once."""
    keep = np.zeros(len(a), bool)
    left: dict[int, list[tuple[int, str, str, int]]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        allowed = allowed_edits(x, y, similarity)
        told, x, y = told_within(x, y, allowed)
        if told is None:
            left.setdefault(-(-min(len(x), len(y)) // 64), []).append((i, x, y, allowed))
        else:
            keep[i] = told <= allowed
    for width, rest in left.items():
        for at in range(0, len(rest), MOST):
            part = rest[at : at + MOST]
            if len(part) < FEWEST or width > WIDEST:
                found = [edit_distance(x, y) for _, x, y, _ in part]
            else:
                found = distances([r[1] for r in part], [r[2] for r in part]).tolist()
            for (i, _, _, allowed), cost in zip(part, found):
                keep[i] = cost <= allowed
    return keep


def _similar_rows(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            keep = similar_pairs(rows.column("line_a").to_pylist(), rows.column("line_b").to_pylist(), similarity)
            yield from rows.select(["a", "b"]).filter(pa.array(keep)).to_batches()
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= POOL or sum(x.nbytes for x in held) > 32 << 20:
                yield from flush()
        if held:
            yield from flush()

    return run


def _long_enough(text: str, min_words: int) -> list[tuple[int, list[bytes]]]:
    return [(k, words) for k, words in enumerate(normalised_lines(text)) if len(words) >= min_words]


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, line_no, name, short, bands) for each line of enough words; bands are null where the task has given them already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            found = [(row, k, b" ".join(line)) for row, text in enumerate(batch.column("text").to_pylist()) if text for k, line in _long_enough(text, min_words)]
            rows = pa.array([f[0] for f in found], pa.int64())
            names = [hashlib.md5(f[2]).digest() for f in found]
            shorts = [short_name(n, f[2]) for n, f in zip(names, found)]
            new = []
            for i, x in enumerate(names):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            given = np.zeros(len(found), bool)
            given[new] = True
            bands = line_bands([found[i][2] for i in new])
            ends = pa.array(np.r_[0, np.cumsum(given) * BANDS].astype(np.int32), mask=np.r_[~given, False])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("text_key").take(rows),
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array(names, pa.binary()),
                    pa.array(shorts, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(bands.ravel(), pa.int32())),
                ],
                names=["doc_id", "text_key", "line_no", "name", "short", "bands"],
            )

    small_batches(docs.sparkSession)
    keyed = long_ids(docs).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, line_no int, name binary, short long, bands array<int>")


def _neighbours(similarity: float):
    """Over rows sorted by key and short name: of keys with several lines each line ``a`` and the next one ``b``, where there is one and lengths allow that they are alike, else itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_short, goes_on = np.empty(0, np.int64), np.empty(0, np.int64), False

        def work(key: np.ndarray, short: np.ndarray, more: bool) -> pa.RecordBatch:
            """The rows but the last, or with it where no ``more`` follow."""
            after = np.r_[key[1:] == key[:-1], False]
            several = after | np.r_[goes_on, after[:-1]]
            following = np.r_[short[1:], short[-1]]
            length, next_length = short & LONG, following & LONG
            most = np.maximum(length, next_length)
            near = after & ((abs(length - next_length) <= ((1 - similarity) * most + 1e-9).astype(np.int64)) | (most == LONG))
            if more:
                several[-1] = False
            return pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (key, short, np.where(near, following, short))], names=["key", "a", "b"])

        for batch in batches:
            key = np.concatenate((held_key, batch.column("key").to_numpy()))
            short = np.concatenate((held_short, batch.column("short").to_numpy()))
            if not len(key):
                continue
            new = np.r_[True, (key[1:] != key[:-1]) | (short[1:] != short[:-1])]
            key, short = key[new], short[new]
            yield work(key, short, True)
            if len(key) > 1:
                goes_on = bool(key[-1] == key[-2])
            held_key, held_short = key[-1:], short[-1:]
        if len(held_key):
            yield work(held_key, held_short, False)

    return run


class Held:
    """Lines that other lines are compared with, and how far each is from another at least."""

    HASHES = 512

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.counts = np.empty((16, self.HASHES), np.int16)

    @classmethod
    def counted(cls, line: str) -> np.ndarray:
        """Counts of a line; larger ones stand at the limit, which makes no difference larger."""
        return np.minimum(pair_counts(line, cls.HASHES), 16_000).astype(np.int16)

    def add(self, row: tuple, counts: np.ndarray) -> None:
        if len(self.rows) == len(self.counts):
            self.counts = np.concatenate((self.counts, np.empty_like(self.counts)))
        self.counts[len(self.rows)] = counts
        self.rows.append(row)

    def least_edits(self, counts: np.ndarray) -> np.ndarray:
        """A number of edits to each held line that its true number is not below."""
        return -(-np.abs(self.counts[: len(self.rows)] - counts).sum(axis=1, dtype=np.int32) // 4)


ROW = ["line_id", "line", "part", "reach"]


def _grouped(rows: DataFrame, group: list[str], work, schema: str) -> DataFrame:
    """What ``work(held, row, counts)`` yields for the rows marked ``is_row`` of each group, in order; the others are held before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, Held()
        for pdf in batches:
            out = []
            for *place, is_row, own, line, part, reach in pdf.itertuples(index=False, name=None):
                if at != place:
                    at, held = place, Held()
                counts = Held.counted(line)
                if is_row:
                    out += work(held, (own, line, part, reach), counts)
                else:
                    held.add((own, line, part, reach), counts)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    ordered = rows.select(*group, "is_row", *ROW)
    # few bytes but much work: a number of partitions that is given is not made smaller
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartition(parts, *group).sortWithinPartitions(*group, "is_row", "line_id").mapInPandas(run, schema)


def _leading(similarity: float):
    """For a line: the first of the held lines next to it that it is like, and at how many edits at most; a line like none of them is held itself."""

    def work(held: Held, row: tuple, counts: np.ndarray) -> list[tuple]:
        own, line, _, _ = row
        least = held.least_edits(counts)
        for i in np.argsort(least, kind="stable")[:ASKED].tolist():
            head, text, _, _ = held.rows[i]
            allowed = allowed_edits(line, text, similarity)
            if least[i] <= allowed and (cost := edits_within(line, text, allowed)) is not None:
                return [(own, line, head, cost)]
        held.add(row, counts)
        return [(own, line, own, 0)]

    return work


def _plain(df: DataFrame, part="0", reach="0") -> DataFrame:
    return df.select("key", "line_id", "line", F.expr(part).cast("long").alias("part"), F.expr(reach).cast("int").alias("reach"))


def heads_of(members: DataFrame, similarity: float = SIMILARITY, most: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(line_id, head, cost) for each line of hot keys (key, line_id, line), and further links (a, b) between heads.

    A line goes by one of its keys, the least.  A key's lines are dealt to shares
    of about ``most``; in each, line after line takes the nearest head that it is like,
    at ``cost`` edits at most, or becomes a head.  The heads of a key are dealt
    and grouped again in the same way while they fill more than one share.
    """
    first = Window.partitionBy("line_id").orderBy("key")
    left = stored(members.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "line-hot")
    found, links, schema = None, None, "line_id long, line string, head long, cost int"
    while True:
        sizes = left.groupBy("key").agg(F.ceil(F.count("*") / most).alias("shares"))
        dealt = _plain(left).join(sizes, "key").withColumn("share", F.pmod(F.xxhash64("line_id", F.lit(3)), F.col("shares"))).withColumn("is_row", F.lit(True))
        done = stored(_grouped(dealt, ["key", "share", "shares"], _leading(similarity), schema), "line-heads").join(left.select("line_id", "key"), "line_id")
        if found is None:
            found = done.select("line_id", "head", "cost")
        else:
            more = done.select(F.col("line_id").alias("a"), F.col("head").alias("b"))
            links = more if links is None else links.unionByName(more)
        several = sizes.where("shares > 1").select("key")
        after = stored(done.where("line_id = head").join(several, "key").select("key", "line_id", "line"), "line-hot")
        if after.isEmpty() or after.count() == left.join(several, "key").count():
            break
        left = after
    return found, links if links is not None else found.select(F.col("line_id").alias("a"), F.col("head").alias("b")).limit(0)


class _Asking:
    """Lines (line_id, part, line, bands) of a block that ask."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        self.ids, self.parts, self.lengths = (np.array(x, np.int64) for x in zip(*((r[0], r[1], len(r[2])) for r in rows)))
        self.bands = np.array([r[3] for r in rows], np.int32) if rows[0][3] is not None else None

    def __len__(self) -> int:
        return len(self.rows)

    def met_by(self, own: int, part: int, line: str, bands: list[int] | None, asks: bool, key: int, similarity: float) -> list[tuple]:
        """Those of other parts that could be like a line and meet it under this key."""
        allowed = ((1 - similarity) * np.maximum(self.lengths, len(line)) + 1e-9).astype(np.int64)
        meets = (self.parts != part) & (abs(self.lengths - len(line)) <= allowed)
        if asks:
            meets &= self.ids < own
        found = np.flatnonzero(meets)
        if len(found) and self.bands is not None:
            found = found[(self.bands[found] == np.array(bands, np.int32)).argmax(axis=1) == key >> 32]
        return [self.rows[i] for i in found.tolist()]


def _meetings(similarity: float):
    """Links (a, b) of lines of different parts that are alike, over rows sorted by key, chunk and share: those that ask come first in each block, and then those that are asked.

    Two lines of several common keys, by their bands, meet in the first, and two
    that both ask meet once.  Parts that the task has linked are not asked again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asking, pool, linked = None, [], [], set()  # a block's lines that ask are put in arrays when the first row follows

        def flush() -> pa.RecordBatch:
            left = [p for p in pool if (p[0][1], p[1][1]) not in linked]
            alike = [left[i] for i in np.flatnonzero(similar_pairs([x[2] for x, _ in left], [y[2] for _, y in left], similarity))] if left else []
            pool.clear()
            first = {(x[1], y[1]): (x[0], y[0]) for x, y in alike}
            linked.update(first)
            if len(linked) > SEEN:
                linked.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in first.values()], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = ("key", "chunk", "share", "is_row", "asks", "line_id", "part", "line", "bands")
            for *block, is_row, asks, own, part, line, bands in zip(*(batch.column(c).to_pylist() for c in columns)):
                if block != at:
                    at, asking = block, []
                if not is_row:
                    asking.append((own, part, line, bands))
                    continue
                if len(asking) and isinstance(asking, list):
                    asking = _Asking(asking)
                if len(asking):
                    pool += [(x, (own, part, line)) for x in asking.met_by(own, part, line, bands, asks, block[0], similarity)]
                if len(pool) >= POOL:
                    yield flush()
        yield flush()

    return run


def border_links(members: DataFrame, lines: DataFrame, groups: DataFrame, similarity: float = SIMILARITY, share: int = SHARE) -> DataFrame:
    """Links (a, b) between lines of a key that ``groups`` (node, root) has not joined yet, at least one for any two groups that are linked.

    ``members`` has (key, line_id), and the line where ``lines`` has only its
    line_id; ``bands`` of ``lines`` tell under which keys it stands.  Of a key
    whose lines are in one group nothing is asked.  Elsewhere the lines outside the
    key's largest group meet those of all other groups, ``share`` with ``share``.
    """
    if "line" not in lines.columns:
        lines = lines.select("line_id").join(members.select("line_id", "line").dropDuplicates(["line_id"]), "line_id")
    if "bands" not in lines.columns:
        lines = lines.withColumn("bands", F.lit(None).cast("array<int>"))
    of = lines.select("line_id").join(groups.withColumnsRenamed({"node": "line_id", "root": "part"}), "line_id", "left").withColumn("part", F.coalesce("part", "line_id"))
    known = stored(members.select("key", "line_id").join(of, "line_id"), "line-members")
    parts = known.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = parts.groupBy("key").agg(F.max_by("part", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).where(F.col("all") > F.col("most"))
    shares = lambda n: F.ceil(n / share)
    asked = known.join(split, "key").select("key", "line_id", "part", (F.col("part") != F.col("main")).alias("asks"), shares(F.col("all") - F.col("most")).alias("chunks"), shares(F.col("all")).alias("shares"))
    asked = asked.join(lines.select("line_id", "line", "bands"), "line_id")
    place = lambda n, seed: F.pmod(F.xxhash64("line_id", F.lit(seed)), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_row = F.transform(every("chunks"), lambda c: F.struct(c.alias("chunk"), place("shares", 2).alias("share"), F.lit(True).alias("is_row")))
    as_asking = F.transform(every("shares"), lambda c: F.struct(place("chunks", 1).alias("chunk"), c.alias("share"), F.lit(False).alias("is_row")))
    dealt = asked.select("key", "line_id", "part", "asks", "line", "bands", F.explode(F.when(F.col("asks"), F.concat(as_row, as_asking)).otherwise(as_row)).alias("at"))
    dealt = dealt.select("key", "at.chunk", "at.share", "at.is_row", "asks", "line_id", "part", "line", "bands")
    # few bytes but much work: a number of partitions that is given is not made smaller
    count = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ["key", "chunk", "share"]
    return dealt.repartition(count, *block).sortWithinPartitions(*block, "is_row").mapInArrow(_meetings(similarity), "a long, b long")


def _slots(short: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a filter of so many bits (a power of two) that a short name falls on."""
    return ((short.astype(np.uint64) >> np.uint64(12)) & np.uint64(bits - 1)).astype(np.int64)


def _filter_of(needed: DataFrame) -> np.ndarray:
    """A bit for each short name of ``needed`` (short), in bytes: sixteen times as many bits as names, ``FILTER`` at most, so others mostly fall on none."""
    rows = needed.count()
    bits = min(FILTER, max(1 << 12, 1 << (16 * rows).bit_length()))
    size = max(1 << 12, bits // 64)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(size, np.uint8)
        part[_slots(pdf["short"].to_numpy(np.int64), bits) % size] = 1
        return pd.DataFrame({"slice": [key[0]], "found": [np.packbits(part, bitorder="little").tobytes()]})

    slot = F.shiftrightunsigned("short", 12).bitwiseAND(F.lit(bits - 1))
    found = needed.withColumn("slice", F.floor(slot / size)).groupBy("slice").applyInPandas(fill, "slice long, found binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in found:
        out[r["slice"] * size // 8 : (r["slice"] + 1) * size // 8] = np.frombuffer(r["found"], np.uint8)
    return out


def _texts(docs: DataFrame, needed: DataFrame, min_words: int) -> DataFrame:
    """(name, line, bands) of all lines whose short name is in ``needed``, from another scan of the documents: some more of others, and some repeated.

    What is needed goes to the tasks as a filter of bounded size, so hardly any line is shuffled in vain.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            found = [b" ".join(words) for text in batch.column("text").to_pylist() if text for _, words in _long_enough(text, min_words)]
            names = [hashlib.md5(x).digest() for x in found]
            # the bits of a short name above its length are those of the digest
            slots = _slots(np.frombuffer(b"".join(x[:8] for x in names), ">i8").astype(np.int64), len(held) * 8)
            new = []
            for i in np.flatnonzero(held[slots >> 3] >> (slots & 7) & 1).tolist():
                if names[i] not in seen:
                    seen.add(names[i])
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            bands = line_bands([found[i] for i in new])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in new], pa.binary()),
                    pa.array([found[i].decode("utf-8", "surrogatepass") for i in new], pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel(), pa.int32())),
                ],
                names=["name", "line", "bands"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "name binary, line string, bands array<int>")


def line_groups(docs: DataFrame, found: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hot: int = SHARE) -> DataFrame:
    """(name, place, n, root) for each distinct line of the occurrences ``found``: its first place, how often it occurs, and its group."""
    spark = docs.sparkSession
    place = F.struct("doc_id", "text_key", "line_no")
    names = found.groupBy("name").agg(F.min("short").alias("short"), F.min(place).alias("place"), F.count("*").alias("n"))
    names = stored(names.withColumn("line_id", F.monotonically_increasing_id()), "line-names")
    bands = found.where(F.col("bands").isNotNull()).select("short", F.posexplode("bands").alias("band", "hash"))
    keys = bands.select(F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("hash").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"), "short")
    small_batches(spark, rows=32_768)
    alike = stored(keys.repartition("key").sortWithinPartitions("key", "short").mapInArrow(_neighbours(similarity), "key long, a long, b long"), "line-candidates")
    small_batches(spark)
    needed = stored(alike.select(F.col("a").alias("short")).distinct(), "line-needed")
    wanted = names.join(needed, "short").select("line_id", "short", "name")
    text = stored(_texts(docs, needed, min_words).join(wanted, "name").dropDuplicates(["line_id"]).select("line_id", "short", "line", "bands"), "line-texts")
    side = lambda x: text.select(F.col("short").alias(f"short_{x}"), F.col("line_id").alias(x), F.col("line").alias(f"line_{x}"))
    pairs = alike.where("a != b").select(F.col("a").alias("short_a"), F.col("b").alias("short_b")).distinct().join(side("a"), "short_a").join(side("b"), "short_b")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = pairs.select("a", "b", "line_a", "line_b").repartition(parts, "a", "b").mapInArrow(_similar_rows(similarity), "a long, b long")
    roots = components(near)
    members = alike.select("key", F.col("a").alias("short")).join(text.select("short", "line_id"), "short")
    late = stored(border_links(members, text, roots, similarity, hot), "line-late")
    if not late.isEmpty():
        root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        lifted = late.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        joined = components(lifted).select(F.col("node").alias("root"), F.col("root").alias("to"))
        roots = roots.join(joined, "root", "full").select(F.coalesce("node", "root").alias("node"), F.coalesce("to", "root").alias("root")).unionByName(joined.select(F.col("root").alias("node"), F.col("to").alias("root"))).distinct()
    roots = roots.withColumnsRenamed({"node": "line_id"})
    return names.join(roots, "line_id", "left").select("name", "place", "n", F.coalesce("root", "line_id").alias("root"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hot: int = SHARE) -> DataFrame:
    """(doc_id, text_key, dropped array<int>) for each document with lines to drop.

    A document is a doc_id and a text (``text_key`` is the text's hash); rows that
    repeat both are one document and lose the same lines.  Null and empty texts
    have no lines of enough words.  Of a hot key ``hot`` lines meet as many at a time.
    """
    found = stored(occurrences(docs, min_words), "line-occurrences")
    place = F.struct("doc_id", "text_key", "line_no")
    grouped = line_groups(docs, found, min_words, similarity, hot)
    first = grouped.groupBy("root").agg(F.min("place").alias("stays"), F.sum("n").alias("all")).where(F.col("all") > 1)
    by_name = stored(grouped.join(first, "root").select("name", "n", "stays"), "line-staying")
    total = by_name.agg(F.sum("n")).first()[0] or 0
    drop = by_class(found, by_name, "name", "n", total).where(~place.eqNullSafe(F.col("stays")))
    return drop.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines, n_dropped.

    All other columns are as they were, whatever their names, but that columns
    n_lines and n_dropped are replaced; a null text stays null and has no lines.
    Lines end at a newline; those with fewer than ``min_words`` words always stay.
    """
    gone = stored(repeats(docs, min_words, similarity), "dropped-lines").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "dropped")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    joined = rows.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("gone_id")) & F.col("key").eqNullSafe(F.col("gone_key")), "left")
    whole = F.col("row").getField("text")
    lines = F.split(whole, "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("dropped"), i)), "\n")
    text = F.when(F.col("dropped").isNull(), whole).otherwise(left)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept],
        F.when(whole.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).alias("n_dropped"),
    )
