"""Alignment of two tokenizers over a corpus, and how usual each linked pair of ids is.

Both tokenizers encode the same bytes, a space and the text.  Where a token of
one overlaps a token of the other the two are linked; where tokens of both end
at one byte a group ends.  A single space between characters other than white
space is always such a place (neither tokenizer has a token that reaches across
it), so texts are aligned piece by piece and a worker remembers the pieces it
has met.

The number of documents that hold a pair is found in three scans of the texts:

1. the distinct pairs, which are cut into shards; a minimal perfect hash over
   each shard gives every pair a slot, and the slots hold the pairs themselves;
2. dense vectors of counts indexed by slot, one a task and shard, summed up a
   tree of two levels;
3. the documents are aligned again and the counts looked up, each checked
   against the pair in its slot.

A worker holds the shards of one round at most (``HELD`` times ``PER_SHARD``
pairs); more pairs than that take further scans, so memory does not grow with
the number of pairs.  Only shards of one round, and the highest count of each id
of the first vocabulary, pass through the driver.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD as MEMORY
from .common import forget, free_name, map_texts, shards_for, small_batches, stored, tokenizer_path
from .exact import PerfectHash

#: Single spaces between other characters: both tokenizers have a token's end before each.
PLACE = re.compile(r"(?<=\S) (?=\S)")
#: Where white space follows white space, or ends a text, not every space is such a place.
WIDE = re.compile(r"\s\s|\s\Z")
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pairs of a shard, about, and shards that a worker holds at once.
PER_SHARD = 1 << 18
HELD = 16
#: Pieces that a worker remembers before it begins anew.
PIECES = 400_000
#: Pieces that are encoded in a row, and tokens whose bytes are compared at once.
JOINED, SPELLED = 1024, 1 << 17
#: Distinct pairs that a task gathers before it hands them on.
GATHERED = 1 << 20


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces_of(text: str) -> list[str]:
    """A space and ``text``, cut before each place, every piece without its first space; none for the empty text."""
    if not text:
        return []
    return PLACE.split(text) if WIDE.search(text) or text[0].isspace() else text.split(" ")


class Aligned:
    """Pieces aligned: by piece the numbers of tokens, groups and links, and all links as pair codes in order; pieces that do not come back byte by byte have none."""

    def __init__(self, good: np.ndarray, numbers: np.ndarray, links: np.ndarray, written: list[bytes] | None):
        self.good, self.numbers, self.links, self.written = good, numbers, links, written
        self.starts = np.cumsum(numbers[:, 3]) - numbers[:, 3]


class Aligner:
    """Two tokenizers with the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.fast = self._by_rank(first)
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_letters()
        self.bytes_a = [bytes(letters[c] for c in self.first.id_to_token(i) or "" if c in letters) for i in range(self.first.get_vocab_size(with_added_tokens=True))]
        self.bytes_b = [self._piece(self.second.id_to_piece(i)) for i in range(self.second.get_piece_size())]
        self.width = len(self.bytes_b)
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b)]
        self.letters = [np.frombuffer(b"".join(t), np.uint8) for t in (self.bytes_a, self.bytes_b)]
        self.begins = [np.cumsum(n) - n for n in self.sizes]
        written = [[str(i).encode() for i in range(len(t))] for t in (self.bytes_a, self.bytes_b)]
        self.inside, self.last = ([np.array([x + end for x in t], object) for t, end in zip(written, ends)] for ends in ((b",", b","), (b"|", b";")))

    def _by_rank(self, first: str):
        """The first vocabulary as a rank encoding, which gives the same ids sooner, if its merges stand in the order of their ids; else None."""
        import json

        import public_tokenizers
        import tiktoken

        with open(first) as file:
            told = json.load(file)
        model, split, vocabulary = told["model"], told["pre_tokenizer"] or {}, told["model"]["vocab"]
        merges = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model.get("merges", [])]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token) and token not in {t["content"] for t in told["added_tokens"]}}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and told["normalizer"] is None
        if not plain or merges != sorted(merges) or len(ranks) != 256 + len(merges) or any(model.get(x) for x in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        return tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _first_ids(self, pieces: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.fast.encode_ordinary(" " + p) for p in pieces]
        return [e.ids for e in self.first.encode_batch([" " + p for p in pieces], add_special_tokens=False)]

    def _first_joined(self, pieces: list[str]) -> np.ndarray | None:
        """The first vocabulary's ids of all pieces in a row, many pieces at once; those that are empty, or begin or end in white space, can not stand in a row and come alone."""
        if not self.fast:
            return None
        alone = [i for i, p in enumerate(pieces) if not p or p[0].isspace() or p[-1].isspace()]
        rows: list[str] = []
        for low, high in zip([0, *(i + 1 for i in alone)], [*alone, len(pieces)]):
            rows += [" " + " ".join(pieces[at : min(high, at + JOINED)]) for at in range(low, high, JOINED)]
            rows += [" " + p for p in pieces[high : high + 1]]
        return np.fromiter(itertools.chain.from_iterable(map(self.fast.encode_ordinary, rows)), np.int64)

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def align(self, pieces: list[str], write: bool = False) -> Aligned:
        """Pieces without their first space, aligned; with ``write`` their groups too, each ended by ``;``."""
        ids_b = self.second.encode(pieces, num_threads=1)
        good = np.ones(len(pieces), bool)
        sizes = self._sizes(pieces)
        b, n_b = self._flat(ids_b)
        a = self._first_joined(pieces)
        if a is not None:  # a token's end at each piece's end is asked for below
            counts = [np.diff(np.searchsorted(np.cumsum(self.sizes[0][a]), np.cumsum(sizes), "right"), prepend=0), n_b]
        if a is None or not self._same(a, b, counts, sizes, pieces):
            ids_a = self._first_ids(pieces)
            a, n_a = self._flat(ids_a)
            counts = [n_a, n_b]
            whole = self._same(a, b, counts, sizes, pieces)
        else:
            whole = True
        if not whole:
            for i, piece in enumerate(pieces):
                raw = (" " + piece).encode()
                good[i] = b"".join([self.bytes_a[x] for x in ids_a[i]]) == raw == b"".join([self.bytes_b[x] for x in ids_b[i]])
            keep = np.flatnonzero(good).tolist()
            (a, n_a), (b, n_b), sizes = self._flat([ids_a[i] for i in keep]), self._flat([ids_b[i] for i in keep]), sizes[good]
            counts = [n_a, n_b]
        numbers, written = np.zeros((len(pieces), 4), np.int64), [b""] * len(pieces)
        if not len(sizes):
            return Aligned(good, numbers, np.empty(0, np.int64), written)
        ends_a, ends_b, tops = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]), np.cumsum(sizes)
        common = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]
        every = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        every = every[np.concatenate((every[1:] != every[:-1], [True]))]
        links = a[np.searchsorted(ends_a, every)] * self.width + b[np.searchsorted(ends_b, every)]
        cut = lambda ends: np.diff(np.concatenate(([0], np.searchsorted(ends, tops, "right"))))
        numbers[good] = np.stack((counts[0], counts[1], cut(common), cut(every)), axis=1)
        if write:
            group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
            words = np.empty(len(a) + len(b), object)
            place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
            place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
            for place, ids, ends, group, side in ((place_a, a, ends_a, group_a, 0), (place_b, b, ends_b, group_b, 1)):
                last = common[group] == ends
                words[place[last]], words[place[~last]] = self.last[side][ids[last]], self.inside[side][ids[~last]]
            words, stops = words.tolist(), np.cumsum(counts[0] + counts[1]).tolist()
            for i, begin, end in zip(np.flatnonzero(good).tolist(), [0, *stops], stops):
                written[i] = b"".join(words[begin:end])
        return Aligned(good, numbers, links, written)

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids in one array, and their numbers by piece."""
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    @staticmethod
    def _sizes(pieces: list[str]) -> np.ndarray:
        """The pieces' bytes with their first space."""
        return np.array([len(p) if p.isascii() else len(p.encode()) for p in pieces], np.int64) + 1

    def _same(self, a: np.ndarray, b: np.ndarray, counts: list[np.ndarray], sizes: np.ndarray, pieces: list[str]) -> bool:
        """Whether both sides give back every piece: all bytes in a row are the same, and so is where each piece ends."""
        tops = np.cumsum(sizes)
        raw = np.frombuffer("".join([" " + p for p in pieces]).encode(), np.uint8)
        for side, (ids, n) in enumerate(((a, counts[0]), (b, counts[1]))):
            ends = np.concatenate(([0], np.cumsum(self.sizes[side][ids])))
            if (ends[np.cumsum(n)] != tops).any() or ends[-1] != len(raw):
                return False
            for low in range(0, len(ids), SPELLED):
                own, begin = ids[low : low + SPELLED], ends[low]
                lengths = self.sizes[side][own]
                at = np.repeat(self.begins[side][own] - (ends[low : low + len(own)] - begin), lengths) + np.arange(lengths.sum())
                if (self.letters[side][at] != raw[begin : begin + len(at)]).any():
                    return False
        return True


@functools.lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    """The aligner of this process."""
    return Aligner(first, second)


class Remembered:
    """Numbers of the pieces that a worker has met, in rows that grow; forgotten altogether when there are too many.

    ``make(pieces)`` gives for new pieces an array of numbers with a row each, and a list of values of
    differing lengths in one array with the lengths, or None.
    """

    def __init__(self, make):
        self.make = make
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: np.ndarray | None = None
        self.flat = np.empty(0, np.int64)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.written: list[bytes] = []

    def of(self, cut: list[list[str]]) -> None:
        """Make sure that every piece of a batch is known."""
        if len(self.known) > PIECES:
            self._clear()
        new = list(set().union(*cut).difference(self.known))
        if not new:
            return
        rows, flat, lengths, written = self.make(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.rows = rows if self.rows is None else np.concatenate((self.rows, rows))
        self.starts = np.concatenate((self.starts, np.cumsum(lengths) - lengths + len(self.flat)))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, flat))
        self.written += written

    def gathered(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all pieces ``ids`` in a row, and for each the number of its place in ``ids``."""
        n = self.lengths[ids]
        whose = np.repeat(np.arange(len(ids)), n)
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())], whose


def _memory(name: str, make) -> Remembered:
    """What this worker remembers for the job ``name``; of other jobs it forgets all."""
    if "crosstok" not in MEMORY or MEMORY["crosstok"][0] != name:
        MEMORY["crosstok"] = name, Remembered(make)
    return MEMORY["crosstok"][1]


class Slots:
    """The shards of one round: which slot of one dense vector belongs to a pair."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], shards: int):
        self.shards, self.parts, self.before, size = shards, {}, {}, 0
        for shard, raw, keys in sorted(rows):
            self.parts[shard] = PerfectHash.from_bytes(raw), np.frombuffer(keys, "<i8")
            self.before[shard] = size
            size += len(keys) // 8
        self.size = size

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The slot of each code whose shard is of this round and whose slot holds it, else -1."""
        out = np.full(len(codes), -1, np.int64)
        own = _shard_of(codes, self.shards)
        for shard in np.unique(own).tolist():
            if shard in self.parts:
                table, keys = self.parts[shard]
                at = np.flatnonzero(own == shard)
                slots = table.slots_of(*_words(codes[at]))
                held = (slots >= 0) & (keys[slots] == codes[at])
                out[at[held]] = slots[held] + self.before[shard]
        return out


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of each code, as the perfect hash takes them."""
    low = codes.astype(np.uint64)
    return low, low * np.uint64(0x9E3779B9) + np.uint64(1)


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return ((codes % 2147483647 * 2654435761) >> 20) % shards


def _shard(shards: int):
    return F.expr(f"shiftright(code % 2147483647L * 2654435761L, 20) % {shards}L")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def _scan(docs: DataFrame, run, schema: str) -> DataFrame:
    """``run(lists of texts)`` over each partition, its tables as rows."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("crosstok")
        yield from run([t or "" for t in b.column(0).to_pylist()] for b in batches)

    return _texts(docs).mapInArrow(work, schema)


def distinct_pairs(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(code) of every pair of ids that any piece of a text links; a task hands on what it has gathered without repeats."""

    own_name = uuid.uuid4().hex

    def make(pieces):
        found = aligner(first, second).align(pieces)
        return np.empty((len(pieces), 0), np.int64), found.links, found.numbers[:, 3], []

    def run(batches):
        # What a piece's links are is remembered from task to task, what has been told only within the task.
        memory, told = _memory(own_name, make), set()
        gathered: list[np.ndarray] = []

        def handed() -> pa.RecordBatch:
            codes = np.unique(np.concatenate(gathered))
            gathered.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64())], names=["code"])

        for texts in batches:
            new = list(set().union(*map(pieces_of, texts)) - told)
            if new:
                told.update(new)
                memory.of([new])
                gathered.append(np.unique(memory.gathered(np.array([memory.known[p] for p in new]))[0]))
            if len(told) > PIECES:
                told.clear()
            if sum(map(len, gathered)) > GATHERED:
                yield handed()
        if gathered:
            yield handed()

    return _scan(docs, run, "code long").distinct()


def perfect_hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, hash, keys): of each shard of distinct codes its minimal perfect hash and the codes in order of slot."""

    def run(key, rows):
        codes = rows.column("code").to_numpy()
        table = PerfectHash.build_words(*_words(codes))
        keys = np.empty(len(codes), "<i8")
        keys[table.slots_of(*_words(codes))] = codes
        return pa.table({"shard": [key[0].as_py()], "hash": [table.to_bytes()], "keys": [keys.tobytes()]}, schema=pa.schema([("shard", pa.int64()), ("hash", pa.binary()), ("keys", pa.binary())]))

    return pairs.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(run, "shard long, hash binary, keys binary")


def _summed(vectors: DataFrame, by: list[str]) -> DataFrame:
    """One vector for each group, the sum of its vectors."""

    def run(key, rows):
        total = None
        for raw in rows.column("counts"):
            own = np.frombuffer(raw.as_buffer(), "<i8")
            total = own.copy() if total is None else total + own
        return pa.table({"shard": [key[0].as_py()], "counts": [total.tobytes()]}, schema=pa.schema([("shard", pa.int64()), ("counts", pa.binary())]))

    return vectors.groupBy(*by).applyInArrow(run, "shard long, counts binary")


def count_vectors(docs: DataFrame, tables: DataFrame, shards: int, lowest: int, highest: int, first: str, second: str) -> DataFrame:
    """(shard, counts): for the shards from ``lowest`` to before ``highest``, in how many documents each slot's pair is linked."""
    spark = docs.sparkSession
    rows = [(r["shard"], bytes(r["hash"]), bytes(r["keys"])) for r in tables.where(F.col("shard").between(lowest, highest - 1)).collect()]
    shared = spark.sparkContext.broadcast(rows)
    groups = 4 * spark.sparkContext.defaultParallelism
    fan = max(1, math.isqrt(groups))

    own_name = uuid.uuid4().hex

    def run(batches):
        slots = Slots(shared.value, shards)
        counts = np.zeros(slots.size, np.int64)

        def make(pieces):
            found = aligner(first, second).align(pieces)
            at = slots.find(found.links)
            inside, ends = np.concatenate(([0], np.cumsum(at >= 0))), np.concatenate((found.starts, [len(at)]))
            return found.good[:, None].astype(np.int64), at[at >= 0], np.diff(inside[ends]), []

        memory = _memory(own_name, make)
        for texts in batches:
            cut = [pieces_of(t) for t in texts]
            memory.of(cut)
            each = [list(map(memory.known.__getitem__, set(pieces))) for pieces in cut]
            ids = np.fromiter(itertools.chain.from_iterable(each), np.int64)
            doc = np.repeat(np.arange(len(each)), list(map(len, each)))
            if len(ids):
                bad = np.unique(doc[memory.rows[ids, 0] == 0])
                ids, doc = (x[~np.isin(doc, bad)] for x in (ids, doc)) if len(bad) else (ids, doc)
                at, whose = memory.gathered(ids)
                # Each document counts once for a pair.
                once = np.sort(doc[whose] * max(1, slots.size) + at)
                once = once[np.concatenate(([True], once[1:] != once[:-1]))[: len(once)]]
                counts += np.bincount(once % max(1, slots.size), minlength=slots.size) if len(once) else 0
        part = int.from_bytes(hashlib.blake2b(counts.tobytes(), digest_size=4).digest(), "little") % fan
        for shard, begin in slots.before.items():
            own = counts[begin : begin + len(slots.parts[shard][1])]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["shard", "part", "counts"])

    found = _scan(docs.coalesce(groups), run, "shard long, part int, counts binary")
    return _summed(_summed(found, ["shard", "part"]), ["shard"])


def pair_counts(docs: DataFrame, first: str | None = None, second: str | None = None, per_shard: int = PER_SHARD, held: int = HELD) -> tuple[DataFrame, int]:
    """The table (shard, hash, keys, counts) of all pairs, and the number of its shards."""
    first, second = first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)
    pairs = stored(distinct_pairs(docs, first, second), "token-pairs")
    shards = shards_for(pairs.count(), per_shard)
    tables = stored(perfect_hashes(pairs, shards), "pair-hashes")
    counts = None
    for lowest in range(0, shards, held):
        own = stored(count_vectors(docs, tables, shards, lowest, min(shards, lowest + held), first, second), "pair-counts")
        counts = own if counts is None else counts.unionByName(own)
    return tables.join(counts, "shard", "left"), shards


def counted_pairs(table: DataFrame, width: int) -> DataFrame:
    """(a, b, n) of the table of all pairs."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                codes = np.frombuffer(keys.as_buffer(), "<i8")
                n = np.frombuffer(counts.as_buffer(), "<i8") if counts.is_valid else np.zeros(len(codes), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes // width), pa.array(codes % width), pa.array(n)], names=["a", "b", "n"])

    return table.select("keys", "counts").mapInArrow(run, "a long, b long, n long")


COLUMNS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, first: str | None = None, second: str | None = None, per_shard: int = PER_SHARD, held: int = HELD) -> DataFrame:
    """(doc_id, ``COLUMNS``) for each row of ``docs`` (doc_id, text, and any others).

    ``n_best`` counts the links whose pair is held by as many documents as any
    pair of its first id, ``count_sum`` adds up the counts over the links, and
    the digest is of the groups as ``a1,a2|b1;a3|b2``.  A text that is null or
    empty, or that a tokenizer does not give back byte by byte, has zeros and
    an empty digest and counts nowhere.  Every row is a document, so a repeated
    row counts again; an empty table gives no rows.
    """
    first, second = first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)
    spark = docs.sparkSession
    table, shards = pair_counts(docs, first, second, per_shard, held)
    table = stored(table, "counted-pairs")
    width = aligner(first, second).width
    tops = {r["a"]: r["n"] for r in counted_pairs(table, width).groupBy("a").agg(F.max("n").alias("n")).collect()}
    highest = np.zeros(max(tops, default=0) + 1, np.int64)
    highest[list(tops)] = list(tops.values())
    shared_tops = spark.sparkContext.broadcast(highest)
    found = None
    rounds = range(0, shards, held)
    for lowest in rounds:
        rows = [(r["shard"], bytes(r["hash"]), bytes(r["keys"]), bytes(r["counts"]) if r["counts"] is not None else None) for r in table.where(F.col("shard").between(lowest, lowest + held - 1)).collect()]
        own = _looked_up(docs, spark.sparkContext.broadcast(rows), shared_tops, shards, width, first, second, len(rounds) > 1)
        if len(rounds) > 1:
            own = stored(own, "pair-lookups")
        found = own if found is None else found.unionByName(own)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    if len(rounds) == 1:
        return found.select("doc_id", *names)
    # Rows alike in id and text are alike in all columns: each round has every one of them once.
    same = [F.first(c).alias(c) if c not in ("n_best", "count_sum") else (F.sum(c) / F.count("*") * len(rounds)).cast("long").alias(c) for c in names]
    whole = found.groupBy("doc_id", "text_hash").agg(*same, (F.count("*") / len(rounds)).cast("int").alias("copies"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", *names)


def _looked_up(docs: DataFrame, shared, shared_tops, shards: int, width: int, first: str, second: str, hashed: bool) -> DataFrame:
    """``COLUMNS`` of each text, its counts those of the pairs in the shared shards."""

    own_name = uuid.uuid4().hex

    def work(texts: list[str]) -> list[tuple]:
        if "crosstok" not in MEMORY or MEMORY["crosstok"][0] != own_name:
            slots = Slots([r[:3] for r in shared.value], shards)
            counts = np.concatenate([np.frombuffer(r[3], "<i8") if r[3] is not None else np.zeros(len(r[2]) // 8, np.int64) for r in sorted(shared.value)] or [np.empty(0, np.int64)])
            tops = shared_tops.value

            def make(pieces):
                found = aligner(first, second).align(pieces, write=True)
                at = slots.find(found.links)
                n = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(at), np.int64)
                best = (at >= 0) & (n == tops[found.links // width])
                both = np.zeros((2, len(at) + 1), np.int64)
                both[0, 1:], both[1, 1:] = np.cumsum(best), np.cumsum(n)
                ends = np.concatenate((found.starts, [len(at)]))
                rows = np.concatenate((found.numbers, np.diff(both[:, ends]).T, ~found.good[:, None]), axis=1)
                return rows, np.empty(0, np.int64), np.zeros(len(pieces), np.int64), found.written

            MEMORY["crosstok"] = own_name, Remembered(make)
        memory = MEMORY["crosstok"][1]
        cut = [pieces_of(t) for t in texts]
        memory.of(cut)
        each = [list(map(memory.known.__getitem__, pieces)) for pieces in cut]
        filled = [k for k, ids in enumerate(each) if ids]
        totals = np.zeros((len(cut), 7), np.int64)
        if filled:
            starts = np.cumsum([0, *(len(each[k]) for k in filled[:-1])])
            totals[filled] = np.add.reduceat(memory.rows[np.fromiter(itertools.chain.from_iterable(each), np.int64)], starts, axis=0)
        rows = []
        for ids, total in zip(each, totals.tolist()):
            if total[6] or not ids:
                rows.append((0, 0, 0, 0, 0, 0, ""))
            else:
                rows.append((*total[:6], hashlib.sha256(b"".join(map(memory.written.__getitem__, ids))[:-1]).hexdigest()))
        return list(zip(*rows))

    name = free_name(["doc_id", "text"], "text_hash")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if hashed:
        own = own.withColumn(name, F.sha2(F.coalesce("text", F.lit("")), 256))
    return map_texts(own, work, COLUMNS, ["doc_id", name] if hashed else ["doc_id"], holds="crosstok")
