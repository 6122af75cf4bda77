"""Packing by minimum bin slack.

Documents become token ids ended by an end id; a document longer than a window
is cut into whole windows and a rest.  The rests are dealt into shards of bounded
size, and each shard fills one window after another: the longest rest left opens
the window, and a subset-sum dynamic programme over the multiset of remaining
lengths (a big-integer bitset with a bit for each reachable total, a length's
count split in powers of two) picks the multiset that comes closest to the
capacity left; counts are backtracked from the bitsets.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, long_ids, map_texts, shards_for, stored, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2
#: Rests that one shard packs; its only waste is its last windows.
PER_SHARD = 40_000
#: Words whose ids a worker remembers, and their bytes, twice over: those of late, and those before.
REMEMBERED, REMEMBERED_BYTES = 600_000, 48 << 20
#: Longer words are forgotten after their batch.
LONGEST = 64
# The ASCII characters that are neither white space, letters nor digits.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


class WordEncoder:
    """Ids of texts under a tokenizer that never merges across white space.

    The vocabulary's normaliser lower-cases, and its splitter treats ASCII white
    space as a boundary, so a text's ids are those of its lower-cased words one
    after the other; a word is encoded once and remembered.  Marks after the
    last ASCII letter or digit of a word are a token run of their own, so such a
    word is put together from the two.  Words of letters alone are one run each
    and are encoded many at a time: each ends at its only id with a word's end.
    The tokenizer's added tokens (as ``<|endoftext|>``) are looked for in the raw
    text first, as the tokenizer does, and what lies between them is encoded apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        # without added tokens: a lower-cased word may look like one that the raw text does not hold
        self.plain = Tokenizer.from_str(json.dumps({**parts, "added_tokens": []}))
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.added = {t.content: np.array([i], np.uint32) for i, t in self.model.get_added_tokens_decoder().items()}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.size = 0
        self.late: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.plain.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone."""
        out = []
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, cuts = ids.tobytes(), (4 * np.r_[0, stops]).tolist()
                out += [raw[i:j] for i, j in zip(cuts, cuts[1:])]
            else:
                out += self._one_by_one(part)
        return out

    def _unseen(self, words: set[bytes]) -> set[bytes]:
        """Those of the words that are not remembered; those of before count as of late again."""
        missing = words.difference(self.late)
        before = self.before
        old = {w for w in missing if w in before}
        self.late.update((w, before[w]) for w in old)
        self.size += sum(len(w) + len(before[w]) for w in old)
        return missing - old

    def _learn(self, words: set[bytes]) -> list[bytes]:
        """Make sure that ``late`` has all of the words; returns those that it must not keep."""
        if len(self.late) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.before, self.late, self.size = self.late, {}, 0
        late, joined = self.late, []
        parts = self._unseen(words)
        for w in list(parts):
            core = w.rstrip(MARKS)
            if core and len(core) < len(w) and core[-1] in ALNUM:
                joined.append((w, core, w[len(core) :]))
        parts.difference_update(w for w, _, _ in joined)
        parts |= self._unseen({x for j in joined for x in j[1:]})
        letters, others = [], []
        for w in parts:
            text = w.decode("utf-8", "surrogatepass")
            (letters if text.lower().isalpha() else others).append((w, text))
        for kind, encode in ((letters, self._together), (others, self._one_by_one)):
            late.update(zip([w for w, _ in kind], encode([t for _, t in kind])))
        for w, core, marks in joined:
            late[w] = late[core] + late[marks]
        new = [*parts, *(w for w, _, _ in joined)]
        self.size += sum(len(w) + len(late[w]) for w in new)
        return [w for w in new if len(w) > LONGEST]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        if self.splits and any(map(self.splits.search, texts)):
            parts = [self.splits.split(t) for t in texts]
            flat = iter(self._encode([p for found in parts for p in found[::2]]))
            return [np.concatenate([self.added[p] if k % 2 else next(flat) for k, p in enumerate(found)]) for found in parts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        passing = self._learn(set().union(*split))
        late = self.late
        out = [np.frombuffer(b"".join(map(late.__getitem__, found)), np.uint32) for found in split]
        for w in passing:
            self.size -= len(w) + len(late.pop(w))
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    held = HELD.get("packing")
    if held is None or held[0] != path:
        held = HELD["packing"] = (path, WordEncoder(path))
    return held[1]


def fill(alive: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths whose total comes closest to ``capacity`` from below.

    ``alive`` holds the lengths left in ascending order, ``counts`` how many there
    are of each length.  Longer lengths are offered first; the programme ends
    early once the capacity itself is reached.
    """
    full, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    reach, steps = 1, []
    for k in range(bisect_right(alive, capacity) - 1, -1, -1):
        length = alive[k]
        left, take = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def windows(lengths: list[int], window: int = WINDOW) -> Iterator[list[int]]:
    """Each yield is one window, as positions in ``lengths``; every position lies in one.

    Lengths are 1 to ``window``; of equal lengths the earlier position goes first.
    """
    at: list[list[int]] = [[] for _ in range(window + 1)]
    for i in reversed(range(len(lengths))):
        at[lengths[i]].append(i)
    counts = [len(x) for x in at]
    alive = [k for k in range(1, window + 1) if counts[k]]

    def draw(length: int, n: int) -> list[int]:
        counts[length] -= n
        if not counts[length]:
            del alive[bisect_left(alive, length)]
        return [at[length].pop() for _ in range(n)]

    while alive:
        longest = alive[-1]
        picked = draw(longest, 1)
        if longest < window:
            for length, n in fill(alive, counts, window - longest).items():
                picked += draw(length, n)
        yield picked


def pieces(docs: DataFrame, payload: Callable | None, payload_schema: str, window: int, end_id: int, path: str) -> DataFrame:
    """(doc_id, start, length, doc_tokens, payload column) for each piece of each document."""
    made = payload or (lambda ids: ids.tolist())

    def work(texts: list[str]) -> list[list]:
        found = []
        for ids in encoder(path).encode(texts):
            whole = np.append(ids, np.uint32(end_id))
            found.append([(at, min(window, len(whole) - at), len(whole), made(whole[at : at + window])) for at in range(0, len(whole), window)])
        return [found]

    name = payload_schema.split()[0]
    cut = map_texts(long_ids(docs), work, f"piece array<struct<start:long,length:long,doc_tokens:long,{name}:{payload_schema.split(None, 1)[1]}>>", holds="packing")
    return cut.select("doc_id", F.explode("piece").alias("piece")).select("doc_id", "piece.*")


def pack(
    docs: DataFrame,
    payload: Callable | None = None,
    payload_schema: str = "ids array<long>",
    window: int = WINDOW,
    end_id: int = END_ID,
    path: str | None = None,
    per_shard: int = PER_SHARD,
) -> DataFrame:
    """Pieces of all documents of ``docs`` (doc_id, text, and any others) with their place.

    Columns: doc_id, start, length, doc_tokens, the payload (by default the ids
    of the piece; ``payload(ids)`` derives another where ids would be too wide),
    sequence_id and offset.  A sequence holds at most ``window`` ids, gapless
    from offset 0.  A null or empty text is the end id alone; repeated rows and
    null ids are packed like any other; an empty table gives no rows.
    """
    path = path or tokenizer_path(VOCABULARY)
    name = payload_schema.split()[0]
    found = stored(pieces(docs, payload, payload_schema, window, end_id, path).withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    rests = found.where(F.col("length") < window)
    shards = shards_for(rests.count(), per_shard)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece_id", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for k, picked in enumerate(windows(lengths.tolist(), window)):
            sequence[picked] = (k << 24 | int(key[0])) * 2
            offset[picked] = np.cumsum(lengths[picked]) - lengths[picked]
        return pd.DataFrame({"piece_id": pdf["piece_id"], "sequence_id": sequence, "offset": offset})

    dealt = rests.select("piece_id", "length", F.pmod(F.xxhash64("piece_id"), F.lit(shards)).alias("shard"))
    placed = dealt.groupBy("shard").applyInPandas(run, "piece_id long, sequence_id long, offset long")
    columns = ["doc_id", "start", "length", "doc_tokens", name, "sequence_id", "offset"]
    whole = found.where(F.col("length") == window).select(*columns[:5], (F.col("piece_id") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rests.join(placed, "piece_id").select(*columns).unionByName(whole)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
