"""Operators on texts: byte BPE, packing, personal data, toxicity, language model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bytebpe, gru, lm, packing, pii, tagger, toxicity
from strandlake.llm.common import lower_ascii, tokenizer_path, words

SCHEMA = "doc_id long, text string, lang string, score double, text_key long"
ODD = [None, "", " \n\t", "a", "É" * 40, "x" * 70_000, "The end. it's 3.14 ok?!  ÀÉ  İ", "ab\x0bcd ﷽ 👍🏽 naïve\r\n", "the the the", "the the the", "I said: you're so 12,000%."]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "en", 0.5, 7) for i, t in enumerate(ODD)] + [(1, "", "en", 0.5, 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_words_and_lower_case(spark):
    text = "AÉ b\tC\x0bd\x0c\r\ne f\u2003g"
    assert words(text) == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    assert spark.range(1).select(lower_ascii(F.lit("AbÉ"))).first()[0] == "abÉ"


# byte BPE


def test_encoding_equals_the_library_and_round_trips(odd, none):
    model = bytebpe.encoding(tokenizer_path(bytebpe.RANKS), public_tokenizers.PATTERN)
    rows = bytebpe.encode_decode(odd).collect()
    assert len(rows) == len(ODD) + 1
    want = Counter((r["doc_id"], tuple(model.encode_ordinary(r["text"] or ""))) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert all(bytes(r["decoded"]).decode() in {t or "" for t in ODD} for r in rows)
    assert bytebpe.encode_decode(none).count() == 0


def test_parts_never_change_the_ids():
    model = bytebpe.encoding(tokenizer_path(bytebpe.RANKS), public_tokenizers.PATTERN)
    rng = np.random.default_rng(0)
    for _ in range(60):
        text = "".join(rng.choice(list(" \n\tab'sé1!.  "), 400))
        found = list(bytebpe.parts(text, 20))
        assert "".join(found) == text
        assert [i for p in found for i in model.encode_ordinary(p)] == model.encode_ordinary(text)


# packing


def test_word_encoder_equals_the_tokenizer():
    own = packing.WordEncoder(tokenizer_path(packing.VOCABULARY))
    texts = [t or "" for t in ODD] + ["don't we've 'll a.b. c., (d) e” f.” ,,. ǅ ß. 1́. Å."]
    assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in own.model.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_knows_added_tokens():
    own = packing.WordEncoder(tokenizer_path(packing.VOCABULARY))
    rng = np.random.default_rng(26)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "a", " ", "Bc", "<|", "|>", "endoftext", "1,", "é", "\n", "'s"]
    texts = ["a<|endoftext|>", "<|endoftext|>", "<|startoftext|><|endoftext|> x", *("".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(1500))]
    assert own.encode(["a<|endoftext|>"])[0].tolist() == [320, 49407]
    assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in own.model.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_forgets_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 2000)
    own = packing.WordEncoder(tokenizer_path(packing.VOCABULARY))
    for k in range(40):
        texts = [f"word{k} {'x' * 5000}{k} more words of batch {k}, and {'Q9' * 300}!!"]
        assert own.encode(texts)[0].tolist() == own.model.encode(texts[0], add_special_tokens=False).ids
        assert own.size < 6000 and max(map(len, own.late), default=0) <= packing.LONGEST


def test_a_word_of_a_megabyte_is_encoded():
    own = packing.WordEncoder(tokenizer_path(packing.VOCABULARY))
    ids = own.encode(["ab9" * 350_000, "b" * 1_000_000])
    assert all(len(x) for x in ids) and not own.late


def test_fill_is_as_good_as_trying_everything():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 30, 9).tolist()
        counts = [lengths.count(k) for k in range(64)]
        capacity = int(rng.integers(1, 63))
        chosen = packing.fill([k for k in range(64) if counts[k]], counts, capacity)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)


def test_packing_places_every_id_once(odd, none):
    rows = packing.pack(odd, window=64, per_shard=7).collect()
    own = packing.encoder(tokenizer_path(packing.VOCABULARY))
    texts = Counter((r["doc_id"], tuple([*own.encode([r["text"] or ""])[0].tolist(), 2])) for r in odd.collect())
    pieces = {}
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 64
        pieces.setdefault((r["doc_id"], r["start"], r["doc_tokens"]), []).append(r["ids"])
    whole = Counter()
    for (doc, start, n), found in pieces.items():
        if start == 0:
            for k in range(len(found)):
                ids, at = [], 0
                while at < n:
                    ids += sorted(pieces[doc, at, n])[k] if len(found) > 1 else pieces[doc, at, n][0]
                    at = len(ids)
                whole[doc, tuple(ids)] += 1
    assert whole == texts
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("draw,least", [(lambda rng: rng.integers(1, 3000, 3000), 0.98), (lambda rng: np.minimum(rng.lognormal(6, 1, 6000) + 1, 4095), 0.999)])
def test_packing_wastes_little(draw, least):
    lengths = draw(np.random.default_rng(2)).astype(int).tolist()
    found = list(packing.windows(lengths, 4096))
    assert sorted(i for w in found for i in w) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in w) for w in found) <= 4096
    assert sum(lengths) / (4096 * len(found)) > least


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in (("card", pii.CARD, 16, 19), ("phone", pii.PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        text = "".join(rng.choice(list("a1@.+- (é9.2@"), 60))
        assert pii.base_spans(text) == brute(text), text
    plain = "x a.b+c@d-e.co.uk, 10.0.0.255 256.1.1.1, 4539578763621486, 4539-5787-6362-1486, +1 (406) 555-0113."
    assert pii.base_spans(plain) == brute(plain) and len(pii.base_spans(plain)) == 5


def test_base_spans_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@" * 50_000):
        pii.base_spans(text)


def test_network_gradients():
    rng = np.random.default_rng(4)
    net = tagger.Tagger(5, hidden=4, width=3)
    net.p = {k: v.astype(np.float64) + rng.normal(size=v.shape) * 0.1 for k, v in net.p.items()}
    ids, gold = rng.integers(0, tagger.SYMBOLS, (2, 7)), rng.integers(0, 5, (2, 7))
    _, grads = net.loss(ids, gold)
    for name, v in net.p.items():
        flat = v.reshape(-1)
        for i in rng.integers(0, flat.size, 3):
            kept = flat[i]
            flat[i] = kept + 1e-3
            up = net.loss(ids, gold)[0]
            flat[i] = kept - 1e-3
            down = net.loss(ids, gold)[0]
            flat[i] = kept
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-3)


def test_best_path_beats_every_other():
    import itertools

    rng = np.random.default_rng(5)
    net = tagger.Tagger(3)
    net.p["step"] = rng.normal(size=(3, 3))
    e = rng.normal(size=(5, 3))
    value = lambda p: sum(e[t, s] for t, s in enumerate(p)) + sum(net.p["step"][a, b] for a, b in zip(p, p[1:]))
    assert value(net.best_path(e)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=5))))


@pytest.fixture(scope="module")
def finder():
    return pii.train(["plain words that are here before and after anything of note in the running text of a page"] * 3, count=900, steps=200)


def test_model_learns_and_adds_what_the_patterns_lose(finder):
    ids, gold = pii.examples(["other words with different letters standing around it all the way"], 150, seed=77)
    scores = finder.emissions(ids)[0]
    assert np.mean([(finder.best_path(s) == g).mean() for s, g in zip(scores, gold)]) > 0.97
    text = "so call +1 (208) 555-1177 4284896609045836 today, thanks to all of you who were here"
    (base, added), (clean, more) = pii.find([text, "nothing at all in version 3.2 of 1999, token = \"e3b3ed3cc8548923d6\""], finder)
    assert {k for k, _, _ in base} == {"card"} or not base
    assert any(text[a:b] == "+1 (208) 555-1177" for k, a, b in added + base)
    assert not clean and not more


def test_added_spans_never_overlap_base_ones(finder):
    text = " ".join(pii._make(k, __import__("random").Random(i)) for i, k in enumerate(pii.KINDS * 10))
    base, added = pii.find([text], finder)[0]
    assert not any(a < d and c < b for _, a, b in base for _, c, d in added)


def test_long_stretches_are_decoded_like_short_ones(finder, monkeypatch):
    rng = np.random.default_rng(27)
    text = " ".join(pii._make(str(rng.choice(pii.KINDS)), __import__("random").Random(i)) + " word" * int(rng.integers(0, 30)) for i in range(120))
    whole = pii.find([text, "nothing", text[:500]], finder)
    monkeypatch.setattr(pii, "GROUP", 3)
    assert pii.find([text, "nothing", text[:500]], finder) == whole


def test_megabytes_of_digits_take_bounded_memory(finder):
    import tracemalloc

    tracemalloc.start()
    pii.find(["7 " * 150_000], finder)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20


def test_model_finds_forms_put_into_real_documents(spark):
    import random

    rng = random.Random(28)
    texts = [t for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if len(t := r["text"] or "") > 400 and not pii.TRIGGER.search(t)]
    model = pii.train(texts[0::2][:300], count=1500, steps=260)
    put = found = right = total = 0
    for text in texts[1::2][:150]:
        at = text.index(" ", rng.randrange(50, len(text) - 200))
        form = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"  # the fixed pattern asks for a plus sign
        (base, added), (none, clean) = pii.find([text[:at] + " " + form + text[at:], text], model)
        assert not base and not none
        put += 1
        hit = [(a, b) for _, a, b in added if a < at + 1 + len(form) and b > at + 1]
        found += any((a, b) == (at + 1, at + 1 + len(form)) for a, b in hit)
        total += len(added) + len(clean)
        right += len(hit)
    assert put == 150 and found >= 0.9 * put and right >= 0.9 * total


def test_personal_data_table(odd, none, finder):
    rows = pii.personal_data(odd, finder).collect()
    assert len(rows) == len(ODD) + 1 and all(not r["base"] for r in rows)
    assert pii.personal_data(none, finder).count() == 0
    done = pii.redacted(odd.withColumn("text", F.concat("text", F.lit(" me@x.org 10.1.2.3"))), finder)
    assert done.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in done.collect()}
    assert texts[0] is None and texts[2].endswith("[EMAIL] [IP]")
    assert pii.redact("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


# toxicity


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(6)
    draw = lambda low, high: "".join(rng.choice(list("abcd"), rng.integers(low, high)))
    entries = sorted({draw(3, 12) for _ in range(25)})
    stems = sorted({draw(4, 8) for _ in range(6)})
    trie = toxicity.Trie(entries, stems)
    for _ in range(1500):
        token = draw(1, 13)
        ok = [d for e in entries if (d := lev(token, e)) <= toxicity.edits_for(len(e), False)]
        near = [d for s in stems if (d := min(lev(token[:n], s) for n in range(len(token) + 1))) <= toxicity.edits_for(len(s), True)]
        word, stem = trie.match(token)
        assert word == min(ok, default=None) and stem == min(near, default=None), token


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    plain = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    bad = ["wretched", "rotten", "vermin"]
    rows = []
    for i in range(400):
        text, toxic = rng.choice(plain, 40).tolist(), i % 4 == 0
        if toxic:
            for at in rng.integers(0, 40, 3):
                text[at] = str(rng.choice([*bad, "zorq" + rng.choice(["a", "ent", "isch", "os", "um", "ite"])]))
        rows.append((i, " ".join(text), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_words_stems_and_misspellings(labelled, odd, none):
    model = toxicity.fit(labelled.where("doc_id % 5 != 0"))
    assert {"wretched", "rotten", "vermin"} <= set(model.words) and "zorq" in model.stems
    rows = {r["doc_id"]: r for r in toxicity.score(labelled, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labelled.collect()}
    assert np.mean([rows[i]["predicted"] == truth[i] for i in truth if i % 5 == 0]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert model.kind("wretchd") == 3 and model.kind("rotten,") == 1 and model.kind("zorqxyz") == 2 and model.kind("kitten") == 0
    direct, quoted, clean = model.score(["you wretched rotten vermin", 'he said "wretched rotten vermin" once', "a b c"])
    assert direct > quoted and direct > 0.5 and clean < 0.3
    assert toxicity.score(odd, model).count() == len(ODD) + 1 and toxicity.score(none, model).count() == 0
    kept = toxicity.with_scores(odd, model)
    assert kept.columns == [*odd.columns, "score_", "predicted"] and kept.where("text is null").count() == 1 and {r["score"] for r in kept.collect()} == {0.5}


def test_lexicon_keeps_what_tells_most():
    rows = [("aa", 40, 30.0), ("zz", 90, 80.0), ("mm", 60, 50.0), ("zz*", 95, 85.0), ("zza*", 200, 60.0)]
    words, stems = toxicity.choose(rows)
    assert words == ["zz", "mm", "aa"] and stems == ["zza"]


def test_gain_in_sql_equals_the_formula(spark):
    rows = [("a", 40, 3), ("b", 4, 0), ("c", 90, 5), ("d", 30, 0), ("e*", 100, 0), ("f", 3, 0), ("g", 50, 60)]
    got = {r["entry"]: r["gain"] for r in toxicity.telling(spark.createDataFrame(rows, "entry string, p long, n long"), 100, 1000).collect()}
    want = {e: g for e, p, n in rows if p >= toxicity.SUPPORT and p / 100 > toxicity.RATIO * (n + 0.5) / 1000 and (g := toxicity.gain(p, n, 100, 1000)) > toxicity.GAIN}
    assert got == pytest.approx(want) and {"a", "c", "d", "e*"} <= set(got)


def test_states_are_bounded(monkeypatch):
    rng = np.random.default_rng(29)
    trie = toxicity.Trie(["abcdefgh", "hgfedcba", "abababab"], ["cccccc"])
    tokens = ["".join(rng.choice(list("abcdefghxy"), 9)) for _ in range(3000)]
    want = [trie.match(t) for t in tokens]
    monkeypatch.setattr(toxicity, "STATES", 50)
    small = toxicity.Trie(["abcdefgh", "hgfedcba", "abababab"], ["cccccc"])
    assert [small.match(t) for t in tokens] == want and len(small.sets) < 100


def test_samples_hold_distinct_rows(spark):
    from strandlake.llm.common import bounded_sample

    df = spark.range(4000).selectExpr("if(id < 2000, 0, id) as k", "cast(id % 3 as string) as t")
    few = [tuple(r) for r in bounded_sample(df, ["k", "t"], 100).collect()]
    assert len(few) == 100 == len(set(few)) and len(bounded_sample(df.limit(0), ["k"], 5).collect()) == 0
    assert len(bounded_sample(df, ["k", "t"], 10_000).collect()) == 2003


def test_toxicity_without_labels(labelled, odd):
    model = toxicity.fit(labelled.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd, model).collect()} == {0}


# language model


def test_network_gradients_of_the_language_model(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    rng = np.random.default_rng(8)
    net = gru.Gru(np.array([50, 30, 20, 10, 5, 5, 3, 2.0]), 3, hidden=5)
    net.p = {k: v.astype(np.float64) + rng.normal(size=v.shape) * 0.3 for k, v in net.p.items()}
    y = rng.integers(0, 8, (6, 3)).astype(np.int32)
    y[4:, 2] = -1
    on = np.ones((6, 3))
    on[0] = on[3, 1] = 0
    before = np.concatenate((np.zeros((1, 3), np.int32), np.maximum(y[:-1], 0)))
    loss = lambda: net.window_loss(before, y, on, np.zeros((3, 5)))
    _, grads, _ = loss()
    for name, v in net.p.items():
        flat = v.reshape(-1)
        for i in rng.integers(0, flat.size, 3):
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = loss()[0]
            flat[i] = kept - 1e-5
            down = loss()[0]
            flat[i] = kept
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-5)


def test_gates_lie_one_after_the_other():
    rng = np.random.default_rng(8)
    net = gru.Gru(np.arange(40, 0, -1), 5, hidden=6)
    net.p["u"] = rng.normal(size=(6, 18)).astype(np.float32)
    assert (gru._columns(gru._gates(net.p["u"])) == net.p["u"]).all()
    x, h = rng.normal(size=(3, 7, 4, 6)).astype(np.float32), rng.normal(size=(4, 6)).astype(np.float32)
    goes_on = rng.random((7, 4)) < 0.7
    kept: list = []
    found = net.states(x, goes_on, h, kept)
    assert kept[1].shape == (2, 7, 4, 6) and all(g.flags.c_contiguous for g in kept[1])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for t in range(7):
        h = h * goes_on[t][:, None]
        a = h @ net.p["u"]
        z, r = sigmoid(a[:, :6] + x[0, t]), sigmoid(a[:, 6:12] + x[1, t])
        h = z * h + (1 - z) * np.tanh(r * a[:, 12:] + x[2, t])
        assert found[t] == pytest.approx(h, abs=1e-5)
        assert kept[1][:, t] == pytest.approx(np.stack((z, r)), abs=1e-5)


def test_log_likelihood_does_not_depend_on_lanes_and_windows():
    rng = np.random.default_rng(9)
    net = gru.Gru(rng.integers(1, 50, 40).astype(float), 7, hidden=6)
    texts = [rng.integers(0, 40, n).astype(np.int32) for n in (1, 5, 130, 64, 33, 2)]
    one = np.concatenate([net.log_likelihoods([t]) for t in texts])
    assert net.log_likelihoods(texts, width=3, window=16) == pytest.approx(one, rel=1e-5)
    alone = np.array([net.outputs(np.zeros((1, 6), np.float32), np.array([y], np.int32))[0][0] for y in range(40)])
    assert np.exp(alone).sum() == pytest.approx(1, abs=1e-3)


def test_language_model_scores(spark, none):
    rng = np.random.default_rng(10)
    vocabularies = [[f"{p}{i}" for i in range(40)] for p in "ab"]
    texts = [" ".join(rng.choice(vocabularies[i % 2], 50)) + (f" rare{i}" if i % 9 == 0 else "") for i in range(300)]
    rows = [(i, t, "en", 0.1, 5) for i, t in enumerate(texts)] + [(1000, None, "en", 0.1, 5), (1001, "Unseen WORDS a1", "en", 0.1, 5), (None, "a1", "en", 0.1, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = F.pmod(F.col("doc_id"), F.lit(7)) == 2
    got = lm.score(df, ~held).collect()
    train = [lm.tokens(t or "") for i, t, *_ in rows if i is not None and i % 7 != 2]
    c = Counter(w for t in train for w in t)
    total, kinds = sum(c.values()), len(c)
    assert len(got) == len(rows)
    text_of = {i: t or "" for i, t, *_ in rows}
    for r in got:
        tokens = lm.tokens(text_of[r["doc_id"]])
        want = sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(want) and r["score"] < 0
    apart = [r for r in got if not r["learns"] and r["doc_id"] is not None]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)
    assert lm.score(none, F.lit(True)).count() == 0
    assert {r["n_known"] for r in lm.score(df.limit(5), F.lit(False)).collect()} == {0}


def test_memory_follows_the_outputs_and_not_the_longest_text():
    import tracemalloc

    rng = np.random.default_rng(30)
    net = gru.Gru(rng.integers(1, 50, 2500).astype(float), 50)
    texts = [rng.integers(0, 2500, n).astype(np.int32) for n in (60_000, *[40] * 300)]
    tracemalloc.start()
    found = net.log_likelihoods(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 301 and (found < 0).all() and peak < 60 << 20


def test_texts_are_dealt_by_row(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 400)
    rows = [(None, f"w{i % 7} w{i % 5} w{i % 3}", "en", 0.0, 0) for i in range(300)] + [(None, "w1 " * 20_000, "en", 0.0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lm.score(df, F.lit(True)).collect()
    assert len(got) == 301 and max(r["n_tokens"] for r in got) == 20_001 and all(r["score"] < 0 for r in got)


def test_tail_words_are_joined_to_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 6)
    monkeypatch.setattr(lm, "MODEL_WORDS", 3)
    rows = [(i, " ".join(f"w{j}" for j in range(12 - i % 6)), "en", 0.0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lm.score(df, F.lit(True)).collect()
    c = Counter(w for _, t, *_ in rows for w in lm.tokens(t))
    total, kinds = sum(c.values()), len(c)
    for r in got:
        tokens = lm.tokens(dict((i, t) for i, t, *_ in rows)[r["doc_id"]])
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens))
        assert r["n_known"] == len(tokens)


def test_endings_agree_with_sql(spark):
    found = ["a", "ab", "abc", "abcd", "é", "", "xyzé"]
    df = spark.createDataFrame([(w.encode(),) for w in found], "word binary")
    got = [r[0] for r in df.select(F.crc32(F.substring("word", -3, 3)) % lm.BUCKETS).collect()]
    assert got == [zlib.crc32(w.encode()[-3:]) % lm.BUCKETS for w in found]
