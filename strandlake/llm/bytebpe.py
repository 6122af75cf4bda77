"""Byte-level BPE encoding and decoding with the tiktoken library.

A long text is cut at places where no match of the splitting pattern can reach
across, so that each part is encoded by itself and the ids are those of the
whole: before a single space that follows a character other than white space
and is followed by one.  There every match that began earlier has ended (no
alternative takes white space after other characters), and the space opens the
next match whatever went before.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import long_ids, map_texts, tokenizer_path

SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Characters after which a text is cut at the next safe place.
PART = 32_768
RANKS = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The rank file as a tiktoken encoding without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in order, cut at the first safe place after each ``size`` characters."""
    begin = 0
    while len(text) - begin > size:
        cut = SAFE.search(text, begin + size)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def encode(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a whole text; the empty text has none."""
    model = encoding(path, pattern)
    if len(text) <= PART:
        return model.encode_ordinary(text)
    return [i for part in parts(text) for i in model.encode_ordinary(part)]


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The raw bytes of the ids, which need not be valid UTF-8."""
    return encoding(path, pattern).decode_bytes(ids)


def encode_decode(docs: DataFrame, derive=None, schema: str = "ids array<int>, decoded binary", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, columns of ``schema``) for each row of ``docs`` (doc_id, text, and any others).

    The default columns are the ids and the bytes that decoding them gives.
    ``derive(ids, decoded)`` returns other columns, in the order of ``schema``,
    where those would be too wide to keep.  A null text counts as empty, which
    has no ids; repeated rows each get a row.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = path or tokenizer_path(RANKS)

    def work(texts: list[str]) -> list[tuple]:
        out = []
        for text in texts:
            ids = encode(text, path, pattern)
            decoded = decode(ids, path, pattern)
            out.append(derive(ids, decoded) if derive else (ids, decoded))
        return list(zip(*out))

    return map_texts(long_ids(docs), work, schema)


def digests(ids: list[int], decoded: bytes) -> tuple[int, str, str]:
    """(n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the bytes)."""
    import hashlib

    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()
