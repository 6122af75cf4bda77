"""Alignment of two tokenizers against one that encodes whole texts and compares all ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm import crosstok, queries
from strandlake.llm.common import tokenizer_path

TEXTS = [
    None, "", " ", "a", "Hello world, hello  world!", "Tabs\tand\nlines \n and \r\n more", "naïve café — 東京 😀 <|endoftext|> <s> </s> <0x41>", "▁ is a letter here", "x" * 3000, "don't we'll 1234 12.5%",
    "  leading", "trailing  ", "　wide space   lines", "ﬁne ① Å é", "\0null", "Hello world, hello  world!",
]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(tokenizer_path(crosstok.FIRST))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(crosstok.SECOND))
    letters = crosstok.byte_letters()
    found = []
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        raw_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        raw_b = [bytes([second.piece_to_id(second.id_to_piece(i)) - 3]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            found.append(None)
            continue
        spans = []
        for ids, raw in ((a, raw_a), (b, raw_b)):
            at, own = 0, []
            for i, r in zip(ids, raw):
                own.append((at, at + len(r), i))
                at += len(r)
            spans.append(own)
        owners = [[k for k, (s, e, _) in enumerate(own) for _ in range(s, e)] for own in spans]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(*owners)))]
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        begin, groups = 0, []
        for end in ends:
            groups.append("|".join(",".join(str(i) for _, i in dict.fromkeys((k, own[k][2]) for k in o[begin:end])) for own, o in zip(spans, owners)))
            begin = end
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(p for x in found if x for p in set(x[3]))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((x[0], x[1], x[2], len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(x[4].encode()).hexdigest()))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted(((r["doc_id"], *[r[n] for n in NAMES]) for r in df.collect()), key=str)


def test_letters_cover_every_byte():
    assert sorted(crosstok.byte_letters().values()) == list(range(256))


@pytest.mark.parametrize("per_shard,held", [(crosstok.PER_SHARD, crosstok.HELD), (40, 3)])
def test_align(spark, per_shard, held):
    df = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "a", 7, "x", "y"), (3, "a", 7, "x", "y")], "doc_id long, text string, n_a int, text_hash string, code string").repartition(3)
    want = brute([*TEXTS, "a", "a"])
    got = rows_of(crosstok.align(df, per_shard=per_shard, held=held))
    assert got == sorted([(i, *w) for i, w in zip([*range(len(TEXTS)), None, 3], want)], key=str)
    assert sum(w[0] > 0 for w in want) >= 12 and want[7] == want[0]


def test_empty_table(spark):
    assert crosstok.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_whole_encodings(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted([(r["doc_id"], *w) for r, w in zip(rows, brute([r["text"] for r in rows]))], key=str) if sum(len(r["text"] or "") for r in rows) < 1_000_000 else None
    got = rows_of(queries.op13_crosstok(spark, folder))
    assert want is None or got == want


def test_rank_encoding_gives_the_tokenizers_ids():
    model = crosstok.aligner(tokenizer_path(crosstok.FIRST), tokenizer_path(crosstok.SECOND))
    import random

    rng = random.Random(5)
    letters = "".join(chr(c) for c in [*range(0x20, 0x7F), *range(0xA0, 0x250), 0x301, 0x660, 0x661, 0xB2, 0x2167, 0x3000, 0x2003, 0x85, 0x200B, 0x4E2D, 0x1F600, 0x1E9E, 0x10400, 0x16A0, 0x1F1E6, 9, 10, 13])
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(20_000)] + [t for t in TEXTS if t]
    assert model.fast is not None
    assert model._first_ids(pieces) == [e.ids for e in model.first.encode_batch([" " + p for p in pieces], add_special_tokens=False)]


def test_pieces_are_encoded_in_rows_and_as_if_alone():
    aligner = crosstok.Aligner(tokenizer_path(crosstok.FIRST), tokenizer_path(crosstok.SECOND))
    rng = random.Random(5)
    pieces = ["".join(rng.choices("abcde'sXY12,.-é東😀\u0301\u200b\n\x1c▁<0x41>", k=rng.randrange(1, 12))) for _ in range(3000)]
    pieces = sorted({p for p in pieces if not p[0].isspace() and not p[-1].isspace()})
    fast, calls = aligner.fast, []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return fast.encode_ordinary(text)

    usual = [p for p in pieces if aligner.align([p]).good[0]]
    assert len(usual) > 1000
    aligner.fast = Counted()
    found = aligner.align(usual, write=True)
    assert found.good.all() and len(calls) <= len(usual) // crosstok.JOINED + 1
    alone = [aligner.align([p], write=True) for p in usual]
    assert found.written == [x.written[0] for x in alone] and (found.numbers == np.concatenate([x.numbers for x in alone])).all()
    assert (found.links == np.concatenate([x.links for x in alone])).all()
    mixed = aligner.align([*pieces, "", " odd", "odd\n"])
    assert mixed.good.tolist() == [bool(aligner.align([p]).good[0]) for p in [*pieces, "", " odd", "odd\n"]]


def test_slots_hold_their_pairs():
    import numpy as np

    from strandlake.llm.exact import PerfectHash

    codes = np.unique(np.random.default_rng(0).integers(0, 1 << 31, 5000))
    table = PerfectHash.build_words(*crosstok._words(codes))
    keys = np.empty(len(codes), "<i8")
    keys[table.slots_of(*crosstok._words(codes))] = codes
    slots = crosstok.Slots([(0, table.to_bytes(), keys.tobytes())], 1)
    assert sorted(slots.find(codes).tolist()) == list(range(len(codes)))
    assert (slots.find(codes + (1 << 33)) == -1).all()
