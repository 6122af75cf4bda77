"""Splittable readers of BGZF files: BAM alignments and compressed lines, by ranges of bytes.

A BGZF file is a row of small gzip members (blocks) that state their size, so a
reader can begin at any byte: it finds the next block's start, by its magic
bytes, its size field and the block that must follow it, and from there the
first record.  A BAM record has no mark of its own; its start is found as the
first place from which a chain of plausible records runs.  A record, or a line, belongs to the
range in which the block of its first byte begins, whatever it reaches into, so
every split size gives the same rows.

Files are opened through ``pyarrow.fs`` by path or URI, a block at a time.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import bam

MAGIC = b"\x1f\x8b\x08\x04"
#: Bytes read at once while looking for a block, and at most in a block.
STEP = 1 << 16
#: Records that must follow one another for a place to count as a record's start.
CHAIN = 4
SPLIT = 64 << 20


class Blocks:
    """The blocks of a file."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at)

    def length(self, at: int) -> int | None:
        """The size of the block at a place, or None where none begins."""
        head = self._read(at, 18)
        if len(head) < 18 or head[:4] != MAGIC:
            return None
        extra = struct.unpack_from("<H", head, 10)[0]
        fields, k = self._read(at + 12, extra), 0
        while k + 6 <= len(fields):
            n = struct.unpack_from("<H", fields, k + 2)[0]
            if fields[k : k + 2] == b"BC" and n == 2:
                return struct.unpack_from("<H", fields, k + 4)[0] + 1
            k += 4 + n
        return None

    def first(self, at: int) -> int:
        """The start of the first block at or after a place; the file's size where there is none."""
        while at < self.size:
            held = self._read(at, STEP + len(MAGIC) - 1)
            k = held.find(MAGIC)
            while k >= 0:
                n = self.length(at + k)
                if n and at + k + n <= self.size and (at + k + n == self.size or self.length(at + k + n)):
                    return at + k
                k = held.find(MAGIC, k + 1)
            at += STEP
        return self.size

    def from_(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(start, contents) of each block from one on."""
        while at < self.size:
            n = self.length(at)
            if not n:
                raise ValueError(f"no BGZF block at byte {at}")
            raw = self._read(at, n)
            extra = struct.unpack_from("<H", raw, 10)[0]
            yield at, zlib.decompress(raw[12 + extra : n - 8], -15)
            at += n


class Window:
    """The contents of blocks in a row, of which what was used is let go; knows in which block each byte began."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.blocks, self.held, self.at = blocks, bytearray(), 0
        self.begun: list[tuple[int, int]] = []  # (place in ``held``, block start)
        self.over = False

    def has(self, n: int) -> bool:
        """Whether ``n`` bytes lie ahead, after reading on."""
        while len(self.held) - self.at < n and not self.over:
            more = next(self.blocks, None)
            if more is None:
                self.over = True
            elif more[1]:
                self.begun.append((len(self.held), more[0]))
                self.held += more[1]
        return len(self.held) - self.at >= n

    def block(self) -> int:
        """The start of the block that holds the next byte."""
        return next(start for place, start in reversed(self.begun) if place <= self.at)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 4 * STEP:
            last = next(i for i in range(len(self.begun) - 1, -1, -1) if self.begun[i][0] <= self.at)
            self.begun = [(place - self.at, start) for place, start in self.begun[last:]]
            del self.held[: self.at]
            self.at = 0


def _header(path: str) -> tuple[list[str], list[int], bool, tuple[int, int]]:
    """(names, lengths, whether sorted by place, (block, bytes into it) of the first record)."""
    window = Window(Blocks(path).from_(0))

    def take(n: int) -> bytes:
        if not window.has(n):
            raise ValueError("the header of a BAM file ends too soon")
        out = bytes(window.held[window.at : window.at + n])
        window.skip(n)
        return out

    number = lambda: struct.unpack("<i", take(4))[0]
    if take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    ordered = b"SO:coordinate" in take(number()).split(b"\n")[0]
    names, lengths = [], []
    for _ in range(number()):
        names.append(take(number())[:-1].decode())
        lengths.append(number())
    if not window.has(1):
        return names, lengths, ordered, (-1, 0)
    place, start = next(x for x in reversed(window.begun) if x[0] <= window.at)
    return names, lengths, ordered, (start, window.at - place)


def _plausible(held, at: int, lengths: list[int]) -> int | None:
    """The size of the record that may begin at a place, or None."""
    size, ref, pos, name, _, _, operations, _, bases, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", held, at)
    known = lambda r, p: r == -1 and p >= -1 or 0 <= r < len(lengths) and -1 <= p <= lengths[r]
    if size < 32 or size > 1 << 28 or name < 1 or bases < 0 or not known(ref, pos) or not known(next_ref, next_pos):
        return None
    return size + 4 if 32 + name + 4 * operations + (bases + 1) // 2 + bases <= size else None


def _synchronised(window: Window, lengths: list[int]) -> bool:
    """Move to the first record's start; False where there is none."""
    while window.has(36):
        ahead, found = 0, 0
        while found < CHAIN and window.has(ahead + 36):
            n = _plausible(window.held, window.at + ahead, lengths)
            if n is None or not window.has(ahead + 37):
                break
            name = window.held[window.at + ahead + 12]
            if not window.has(ahead + 36 + name) or window.held[window.at + ahead + 35 + name] or not all(33 <= c <= 126 for c in window.held[window.at + ahead + 36 : window.at + ahead + 35 + name]):
                break
            ahead, found = ahead + n, found + 1
            if not window.has(ahead):
                found = 0
                break
        if found == CHAIN or found and not window.has(ahead + 1):
            return True
        window.skip(1)
    return False


def alignments(path: str, begin: int, end: int, header=None) -> Iterator[tuple]:
    """The alignments of a range of bytes, as rows of ``bam.SCHEMA``."""
    names, lengths, _, (block, inside) = header or _header(path)
    blocks = Blocks(path)
    start = blocks.first(begin)
    if start >= end or block < 0 or block >= end:
        return
    if block >= start:  # the records begin in this range
        window = Window(blocks.from_(block))
        window.has(inside + 1)
        window.skip(inside)
    else:
        window = Window(blocks.from_(start))
        if not _synchronised(window, lengths):
            return
    while window.has(4) and window.block() < end:
        n = struct.unpack_from("<i", window.held, window.at)[0]
        if not window.has(4 + n):
            raise ValueError("a record ends too soon")
        data = bytes(window.held[window.at + 4 : window.at + 4 + n])
        window.skip(4 + n)
        yield bam.parsed(data, names)


def lines(path: str, begin: int, end: int) -> Iterator[str]:
    """The lines of a range of bytes; one that begins just where a block begins goes with the block before."""
    blocks = Blocks(path)
    start = blocks.first(begin)
    if start >= end:
        return
    window = Window(blocks.from_(start))

    def line() -> bytes | None:
        n = 1 << 12
        while True:
            full = window.has(n)
            cut = window.held.find(b"\n", window.at)
            if cut >= 0 or not full:
                stop = cut + 1 if cut >= 0 else len(window.held)
                out = bytes(window.held[window.at : stop])
                window.skip(len(out))
                return out.removesuffix(b"\n").removesuffix(b"\r") if out else None
            n *= 2

    if start > 0 and line() is None:
        return
    while window.has(1) and (window.block() < end or _begins(window, end)):
        past = window.block() >= end
        yield line().decode()
        if past:
            return


def _begins(window: Window, end: int) -> bool:
    """Whether the next byte is the first of the first block from ``end`` on."""
    first = next((place for place, start in window.begun if start >= end), None)
    return first == window.at


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _files(paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of files, those of folders included."""
    from pyarrow import fs

    out = []
    for path in paths:
        system, inner = fs.FileSystem.from_uri(path)
        info = system.get_file_info(inner)
        found = [info] if info.is_file else sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda x: x.path)
        head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        out += [(head + x.path, x.size) for x in found if x.is_file and not x.base_name.startswith((".", "_"))]
    return out


class Reader(DataSourceReader):
    """Ranges of the files; for alignments in order of place, only those that the pushed filters leave."""

    def __init__(self, paths: list[str], split: int, kind: str):
        self.paths, self.split, self.kind = paths, split, kind
        self.chrom: str | None = None
        self.low, self.high = None, None

    def pushFilters(self, filters):
        """Takes note of a chromosome and a range of ``pos``, and leaves all filters to Spark as well."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, EqualTo) and column == ("chrom",):
                self.chrom = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column == ("pos",):
                self.low = f.value if self.low is None else max(self.low, f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and column == ("pos",):
                self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def partitions(self):
        out = []
        for path, size in _files(self.paths):
            ranges = [Range(path, k, min(size, k + self.split)) for k in range(0, size, self.split)]
            if self.kind == "bam" and self.chrom is not None:
                header = _header(path)
                if header[2]:
                    ranges = self._left(path, header, ranges)
            out += ranges
        return out or [Range("", 0, 0)]

    def _left(self, path: str, header, ranges: list[Range]) -> list[Range]:
        """The ranges that may hold the chromosome's places, by the first record of each: a linear index made while planning."""
        if self.chrom not in header[0]:
            return []
        number = {name: i for i, name in enumerate(header[0])}
        far = (len(header[0]), 0)
        firsts = []
        for r in ranges:
            row = next(alignments(path, r.begin, r.end, header), None)
            firsts.append(None if row is None else (number.get(row[2], len(number)), row[3]))
        out, after = [], far
        low, high = (number[self.chrom], -1 if self.low is None else self.low), (number[self.chrom], 1 << 40 if self.high is None else self.high)
        for r, first in reversed(list(zip(ranges, firsts))):
            if first is not None:
                if first <= high and after >= low:
                    out.append(r)
                after = first
        return out[::-1]

    def read(self, partition):
        if not partition.path:
            return
        rows = alignments(partition.path, partition.begin, partition.end) if self.kind == "bam" else ((x,) for x in lines(partition.path, partition.begin, partition.end))
        types = bam.TYPES if self.kind == "bam" else pa.schema([("value", pa.string())])
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == bam.BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)


class BgzfSource(DataSource):
    """``spark.read.format("bgzf")`` with the options paths (a JSON list), kind (bam or text) and split (bytes)."""

    @classmethod
    def name(cls):
        return "bgzf"

    def schema(self):
        return bam.SCHEMA if self.options.get("kind") == "bam" else "value string"

    def reader(self, schema):
        return Reader(json.loads(self.options["paths"]), int(self.options.get("split", SPLIT)), self.options.get("kind", "text"))


def read(spark: SparkSession, paths: str | list[str], kind: str = "bam", split: int = SPLIT) -> DataFrame:
    """Alignments (``bam.SCHEMA``) or lines (value) of BGZF files or folders, a task for each ``split`` bytes.

    Filters on ``chrom`` and ``pos`` leave out ranges of a BAM file that is in
    order of place; the session's setting that lets Python sources see filters
    is switched on for it.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BgzfSource)
    return spark.read.format("bgzf").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("kind", kind).option("split", split).load()
