"""Reader of BAM alignments: BGZF blocks, the binary records, and the tags that variants need.

``read`` takes a file as one cell of Spark's binary source, which suits small
files in any store that Spark reads; ``bgzf.read`` splits files of any size.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, flag int, chrom string, pos long, end long, mapq int, cigar string, seq string, quals array<int>, md string"
# The letters of the binary encoding.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
TYPES = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("end", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("quals", pa.list_(pa.int32())), ("md", pa.string())])
#: Records handed on at once.
BATCH = 4096


def inflate(raw: bytes) -> Iterator[bytes]:
    """The contents of each BGZF block in turn."""
    at = 0
    while at < len(raw):
        if raw[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = struct.unpack_from("<H", raw, at + 10)[0]
        size, field = None, at + 12
        while field < at + 12 + extra:
            a, b, length = raw[field], raw[field + 1], struct.unpack_from("<H", raw, field + 2)[0]
            if (a, b) == (66, 67):
                size = struct.unpack_from("<H", raw, field + 4)[0] + 1
            field += 4 + length
        if size is None:
            raise ValueError("a block without its size")
        yield zlib.decompress(raw[at + 12 + extra : at + size - 8], -15)
        at += size


class _Stream:
    """Bytes drawn from blocks as they are needed."""

    def __init__(self, raw: bytes):
        self.blocks, self.held = inflate(raw), b""

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            more = next(self.blocks, None)
            if more is None:
                return b""
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out


def _tag(data: bytes, wanted: bytes) -> str | None:
    """A text tag of a record."""
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    at = 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            if name == wanted:
                return data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + sizes[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            at += sizes[kind]
    return None


def records(raw: bytes) -> Iterator[tuple]:
    """The alignments of a file, as rows of ``SCHEMA``."""
    stream = _Stream(raw)
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        names.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        stream.take(4)
    while head := stream.take(4):
        yield parsed(stream.take(struct.unpack("<i", head)[0]), names)


def parsed(data: bytes, names: list[str]) -> tuple:
    """One record's bytes, after its size, as a row of ``SCHEMA``."""
    ref, pos, name_size, mapq, _, operations, flag, size = struct.unpack_from("<iiBBHHHi", data)
    at = 32
    name = data[at : at + name_size - 1].decode()
    at += name_size
    steps = [(x >> 4, OPERATIONS[x & 15]) for x in struct.unpack_from(f"<{operations}I", data, at)]
    at += 4 * operations
    packed = data[at : at + (size + 1) // 2]
    at += (size + 1) // 2
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:size]
    quals = list(data[at : at + size])
    at += size
    end = pos + sum(n for n, op in steps if op in "MDN=X")
    return name, flag, names[ref] if ref >= 0 else None, pos, end, mapq, "".join(f"{n}{op}" for n, op in steps), seq, quals, _tag(data[at:], b"MD")


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments (``SCHEMA``) of BAM files, zero-based and half-open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                rows: list[tuple] = []
                for row in records(raw):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), TYPES)], schema=TYPES)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), TYPES)], schema=TYPES)

    files = spark.read.format("binaryFile").load(paths).select("content")
    return files.mapInArrow(run, SCHEMA)


def aligned_bases(pos: int, cigar: str, seq: str, quals: list[int], md: str | None) -> list[tuple[int, str, int, str]]:
    """(position, base, quality, reference base) of each base that lies on the reference, by CIGAR and MD."""
    placed, at, read_at = [], pos, 0
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            placed += [(at + i, seq[read_at + i], quals[read_at + i]) for i in range(n)]
        if op in "MDN=X":
            at += n
        if op in "MIS=X":
            read_at += n
    if md is None:
        return []
    reference: list[str | None] = []
    for same, gone, other in re.findall(r"(\d+)|\^([A-Z]+)|([A-Z])", md):
        reference += [None] * int(same) if same else list(other) if other else []
    return [(p, b, q, r or b) for (p, b, q), r in zip(placed, reference)]
