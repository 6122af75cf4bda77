"""Operators on groups: exact and near duplicates, lines, embeddings, urls, components."""

import collections
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import common, embeddings, exact, graph, lines, queries, simhash, urltemplates

SCHEMA = "doc_id long, text string, lang string, digest string, fp long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# components


@pytest.mark.parametrize("seed,n,m", [(0, 30, 20), (1, 200, 150), (2, 50, 300), (3, 5, 0)])
def test_components(spark, seed, n, m):
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, x)) for x in rng.integers(0, n, (m, 2))]
    df = spark.createDataFrame(links + [(1, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    want = {k: v for k, v in roots(range(n), links).items() if any(k in x and x[0] != x[1] for x in links)}
    assert got == want


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, i) for i in range(1001, 1300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(path + hub, "a long, b long")).collect()}
    assert set(got.values()) == {100, 1000} and len(got) == 61 + 300


# exact


def test_perfect_hash_is_one_to_one_and_byte_checked():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    table_ = exact.PerfectHash.from_bytes(exact.PerfectHash.build(digests).to_bytes())
    assert sorted(table_.slots(digests)) == list(range(5000))
    assert exact.PerfectHash.build([]).slots(digests[:3]).tolist() == [-1, -1, -1]


def test_exact_duplicates(spark):
    texts = ["Same Text", "same text", "É", "é", None, "", "alone", "SAME TEXT", "x" * 100_000, "x" * 100_000]
    rows = list(enumerate(texts)) + [(3, "é"), (None, "alone"), (None, "nobody")]
    got = exact.exact_duplicates(table(spark, rows), per_shard=2).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate({c: c + 32 for c in range(65, 91)})].append(i)
    want = Counter()
    for key, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in got) == want
    assert exact.exact_duplicates(table(spark, [])).count() == 0


def test_exact_against_a_history(spark):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(table(spark, [(5, "a"), (6, "b"), (7, "B")]), table(spark, [(9, "A"), (8, "c")])).collect()}
    assert got == {5: (9, 2), 6: (7, 2), 7: (7, 2)}


@pytest.mark.parametrize("ids,history", [([None] * 300, None), ([-(1 << 60), *range(299)], None), (range(300), [(1, "text 1")])])
def test_shards_follow_the_larger_side(spark, monkeypatch, ids, history):
    sizes, look_up = [], exact.look_up

    def spied(index, distinct, shards):
        sizes.append(max(r["count"] for r in distinct.withColumn("shard", exact._shard(shards)).groupBy("shard").count().collect()))
        return look_up(index, distinct, shards)

    monkeypatch.setattr(exact, "look_up", spied)
    got = exact.exact_duplicates(table(spark, [(i, f"text {k}") for k, i in enumerate(ids)]), history and table(spark, history), per_shard=40).collect()
    assert len(got) == 300 and all(r["kept"] for r in got) and max(sizes) <= 80


def test_hot_classes_join_like_any_other(spark):
    from strandlake.llm.common import by_class, stored

    rows = spark.range(3000).selectExpr("id", "if(id < 2000, 7, id) as k")
    classes = stored(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")), "test-classes")
    got = sorted(tuple(r) for r in by_class(rows, classes, "k", "n", 3000).select("id", "k", "n", "least").collect())
    assert got == [(i, 7, 2000, 0) for i in range(2000)] + [(i, i, 1, i) for i in range(2000, 3000)]


def test_exact_duplicates_carry_columns(spark):
    got = exact.exact_duplicates(table(spark, [(1, "a"), (2, "A")]), also={"size": F.length("text"), "lang2": F.col("lang")})
    assert sorted((r["doc_id"], r["kept"], r["size"], r["lang2"]) for r in got.collect()) == [(1, False, 1, "en"), (2, True, 1, "en")]


# SimHash


def brute_print(text, size=4):
    found = [w.encode() for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).split()] if text else []
    parts = [b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts_with_near_copies(seed):
    rng = np.random.default_rng(seed)
    found = [None, "", "one", "two words", "a b c d"]
    for _ in range(12):
        base = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(120)]
        found.append(" ".join(base))
        for k in range(6):
            copy = list(base)
            copy[int(rng.integers(0, 120))] = "zz"
            found.append(" ".join(copy))
    return found


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_simhash_components(spark, hot):
    texts = texts_with_near_copies(11)
    rows = list(enumerate(texts)) + [(2, "one")]
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    got = simhash.near_duplicates(table(spark, rows), hot=hot).collect()
    assert len(got) == len(rows)
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(prints, links)
    assert len(links) > 12
    for r in got:
        assert r["fp"] & (1 << 64) - 1 == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    groups = defaultdict(set)
    for r in got:
        groups[r["group"]].add(r["component_id"])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_groups_of_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (None, "other words stand here now"), (4, ""), (None, None)]
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(table(spark, rows)).collect())
    assert got == Counter({(None, None): 3, (4, 4): 1, (None, 4): 1})
    assert len({r["group"] for r in simhash.near_duplicates(table(spark, rows)).collect()}) == 3


def test_hot_balls_stay_linear_and_exact(spark):
    rng = np.random.default_rng(12)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(df, 4, hot=16).collect()]
    mask = (1 << 64) - 1
    brute = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 4]
    assert roots(signed, links) == roots(signed, brute)
    assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in links)


def test_fingerprint_text(spark):
    assert [r[0] for r in spark.createDataFrame([(-1,), (10,)], "fp long").select(simhash.fingerprint_hex("fp")).collect()] == ["f" * 16, "0" * 15 + "a"]


# lines


def test_edit_distance():
    rng = np.random.default_rng(13)
    for _ in range(800):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 14))) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        assert lines.edit_distance(a, b) == row[-1]
        assert lines.similar(a, b, 0.7) == (row[-1] <= int(0.3 * max(len(a), len(b)) + 1e-9))


def test_repeated_lines_go_but_one(spark):
    rng = np.random.default_rng(14)
    line = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(60))
    shared, own = line(), [line() for _ in range(6)]
    near = shared.split()
    near[30] = "different"
    rows = [
        (0, f"{own[0]}\n{shared}\nshort one\n{own[1]}"),
        (1, f"{shared.upper()}!\n\n{own[2]}\nshort one"),
        (2, f"{own[3]}\n{shared}\n{shared}"),
        (3, None), (4, ""), (5, own[4]), (None, own[5]),
    ]
    df = table(spark, rows)
    done = lines.without_repeats(df)
    assert done.columns == [*df.columns, "n_lines", "n_dropped"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in done.collect()}
    assert got[0] == (rows[0][1], 4, 0)
    assert got[1] == (f"\n{own[2]}\nshort one", 4, 1)
    assert got[2] == (own[3], 3, 2)
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5][2] == 0 and got[None][2] == 0
    assert lines.without_repeats(table(spark, [])).count() == 0


def test_columns_of_any_name_pass_the_line_operator(spark):
    text = "one line that has enough words to count as one\nanother"
    rows = [(1, text, 5, "k", "d", "t", 9, 8), (2, text, 6, "k", "d", "t", 9, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _key string, _dropped string, _text_key string, n_lines int, `gone_id` int")
    done = lines.without_repeats(df)
    assert done.columns == ["doc_id", "text", "_id", "_key", "_dropped", "_text_key", "gone_id", "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["text"], r["_id"], r["n_lines"], r["n_dropped"]) for r in done.collect()} == {1: (text, 5, 2, 0), 2: ("another", 6, 2, 1)}


def test_near_lines_are_verified(spark):
    rng = np.random.default_rng(15)
    base = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    copies = []
    for k in range(8):
        w = list(base)
        w[50 * k] = "changed"
        copies.append(" ".join(w))
    shuffled = " ".join(reversed(base))
    got = {r["doc_id"]: r["n_dropped"] for r in lines.without_repeats(table(spark, list(enumerate([" ".join(base), *copies, shuffled])))).collect()}
    assert got[0] == 0 and sum(got[i] for i in range(1, 9)) >= 5
    assert got[9] == 0  # the same words in another order are another line


def test_near_lines_of_few_words_are_found(spark):
    rng = np.random.default_rng(16)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    pairs = []
    while len(pairs) < 150:
        base = [word() for _ in range(rng.integers(10, 41))]
        other = list(base)
        for at in rng.choice(len(base), max(1, len(base) // 8), replace=False):
            other[at] = word()
        if lines.similar(" ".join(base), " ".join(other)):
            pairs.append((" ".join(base), " ".join(other)))
    got = lines.without_repeats(table(spark, [(i, x) for i, x in enumerate(x for p in pairs for x in p)])).collect()
    assert all(r["n_dropped"] == 0 for r in got if r["doc_id"] % 2 == 0)
    assert sum(r["n_dropped"] for r in got) >= 143


def test_bounds_of_similarity_are_exact():
    rng = np.random.default_rng(17)
    for _ in range(300):
        base = ["".join(rng.choice(list("abcde"), rng.integers(1, 7))) for _ in range(30)]
        other = [w if rng.random() < 0.75 else "".join(rng.choice(list("abcde"), rng.integers(1, 7))) for w in base if rng.random() < 0.97]
        a, b = " ".join(base), " ".join(other)
        distance = lines.edit_distance(a, b)
        assert lines.aligned_cost(base, other) >= distance
        assert np.abs(lines.pair_counts(a) - lines.pair_counts(b)).sum() <= 4 * distance
        assert lines.similar(a, b) == (distance <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_unlike_lines_in_front_hide_no_similar_ones(spark):
    rng = np.random.default_rng(18)
    base = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(30)]
    moved = [" ".join(rng.permutation(base)) for _ in range(5)]
    swapped = " ".join([base[1], base[0], *base[2:]])
    rows = [*enumerate(moved), (5, " ".join(base)), (6, swapped)]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.without_repeats(table(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}
    got = {r["doc_id"]: [*r["dropped"]] for r in lines.repeats(table(spark, rows), hot=2).collect()}
    assert got == {6: [0]}


@pytest.mark.parametrize("most", [7, 1000])
def test_lines_under_one_key_are_grouped_exactly(spark, most):
    rng = np.random.default_rng(23)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    found = []
    for _ in range(6):
        line = [word() for _ in range(20)]
        for _ in range(9):  # a walk: far members are unlike, neighbours alike
            line = list(line)
            for at in rng.choice(20, rng.integers(1, 4), replace=False):
                line[at] = word()
            found.append(" ".join(line))
    order = rng.permutation(len(found))
    rows = [(k, int(i), found[i]) for k in (7, 9) for i in order if k == 7 or i % 2]
    members = spark.createDataFrame(rows, "key long, line_id long, line string")
    of, between = (df.cache() for df in lines.heads_of(members, most=most))
    text = dict(enumerate(found))
    assert sorted(r["line_id"] for r in of.collect()) == list(range(len(found)))
    assert all(lines.edit_distance(text[r["line_id"]], text[r["head"]]) <= r["cost"] <= 0.2 * max(len(text[r["line_id"]]), len(text[r["head"]])) for r in of.collect())
    first = [(r["line_id"], r["head"]) for r in of.collect()] + [(r["a"], r["b"]) for r in between.collect()]
    groups = graph.components(spark.createDataFrame(first, "a long, b long"))
    more = [(r["a"], r["b"]) for r in lines.border_links(members, of, groups).collect()]
    brute = [(a, b) for a in text for b in text if a < b and lines.similar(text[a], text[b])]
    assert all(lines.similar(text[a], text[b]) for a, b in more)
    assert roots(text, first + more) == roots(text, brute) and roots(text, first) != roots(text, brute)


def test_near_copies_make_no_table_of_all_their_pairs(spark):
    rng = np.random.default_rng(29)
    base = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[i % 40] = f"other{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.permutation(base))) for i in range(5)]
    before = len(common.WRITTEN)
    docs = table(spark, rows)
    groups = [r["root"] for r in lines.line_groups(docs, lines.occurrences(docs)).collect()]
    assert sorted(collections.Counter(groups).values()) == [1] * 5 + [60]
    written = {p.rsplit("/", 1)[1].rsplit("-", 1)[0]: p for p in common.WRITTEN[before:]}
    assert spark.read.parquet(written["line-candidates"]).count() <= lines.BANDS * len(rows)
    assert spark.read.parquet(written["line-late"]).count() <= len(rows)


def test_distances_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(31)
    letters = list("abcde é東😀")
    text = lambda n: "".join(rng.choice(letters, n))
    for rows in (1, 63, 64, 65, 200):
        a = [text(rows) for _ in range(60)]
        b = [x[: rng.integers(0, rows + 1)] + text(rng.integers(0, 90)) + x[rng.integers(0, rows + 1) :] for x in a]
        pairs = [(x, y) for x, y in zip(a, b) if -(-min(len(x), len(y)) // 64) == -(-rows // 64)]
        assert lines.distances(*map(list, zip(*pairs))).tolist() == [lines.edit_distance(x, y) for x, y in pairs]
        assert lines.similar_pairs(a, b).tolist() == [lines.similar(x, y) for x, y in zip(a, b)]


def test_texts_of_needed_lines_come_through_a_filter(spark):
    found = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(50)]
    shorts = [lines.short_name(hashlib.md5(x.encode()).digest(), x.encode()) for x in found]
    needed = spark.createDataFrame([(x,) for x in shorts[:20]], "short long")
    docs = table(spark, [*enumerate(found), (99, None)])
    got = {r["line"]: r["bands"] for r in lines._texts(docs, needed, lines.MIN_WORDS).collect()}
    assert set(found[:20]) <= set(got) and len(got) <= 30
    assert [got[x] for x in found[:20]] == lines.line_bands([x.encode() for x in found[:20]]).tolist()


def test_most_similar_lines_of_the_table_share_a_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = sorted({b" ".join(w) for r in docs.collect() for w in lines.normalised_lines(r["text"] or "") if len(w) >= lines.MIN_WORDS})
    texts = [x.decode() for x in found]
    bigrams = np.array([lines.pair_counts(t) for t in texts], np.int16)
    length = np.array(list(map(len, texts)))
    pairs = []
    for i in range(len(texts)):
        allowed = 0.2 * np.maximum(length, length[i])
        near = np.flatnonzero((abs(length - length[i]) <= allowed) & (np.abs(bigrams - bigrams[i]).sum(axis=1) <= 4 * allowed))
        pairs += [(i, int(j)) for j in near if j > i and lines.similar(texts[i], texts[j])]
    assert len(pairs) >= 20
    groups = {bytes(r["name"]): r["root"] for r in lines.line_groups(docs, lines.occurrences(docs)).collect()}
    root = [groups[hashlib.md5(x).digest()] for x in found]
    assert np.mean([root[i] == root[j] for i, j in pairs]) >= 0.9


# embeddings


def clustered(seed, n=400, dims=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dims))
    found = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.15, 0.3)]).astype(np.float32)
    found[5] = found[4]
    return found


@pytest.mark.parametrize("chunk", [embeddings.CHUNK, 8])
def test_embedding_links(spark, chunk):
    x = clustered(16)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] + [1.0] * 63, 0), (903, [], 0), (904, [None] + [1.0] * 63, 0), (905, [float("inf")] * 64, 0), (None, [1.0] + [0.0] * 63, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vec", F.lit(1))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, chunk=chunk).collect()}
    assert len(got) == len(rows)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    whole = roots(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    assert np.mean([got[i]["component_id"] == whole[i] for i in whole]) > 0.9
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(900, 906))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_pairs_planted_in_the_table(spark):
    rng = np.random.default_rng(24)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    noise = rng.normal(size=x.shape)
    noise -= x * ((noise * x).sum(axis=1) / (x * x).sum(axis=1))[:, None]
    noise *= (np.linalg.norm(x, axis=1) / np.linalg.norm(noise, axis=1) * np.tan(np.arccos(rng.uniform(0.952, 0.999, len(x)))))[:, None]
    both = np.concatenate((x, x + noise))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    assert links.sum() >= 2 * len(x)
    assert all(got[i]["n_links"] <= links[i] for i in range(len(both)))
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * links.sum()
    whole = roots(range(len(both)), [(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    assert np.mean([got[i]["component_id"] == whole[i] for i in whole]) > 0.9


@pytest.mark.parametrize("count", [1 << 12, 1 << 20, 1 << 26])
def test_tables_widen_with_the_count_and_keep_their_recall(count):
    rng = np.random.default_rng(25)
    x = rng.normal(size=(4000, 96))
    noise = rng.normal(size=x.shape)
    noise -= x * ((noise * x).sum(axis=1) / (x * x).sum(axis=1))[:, None]
    noise *= (np.linalg.norm(x, axis=1) / np.linalg.norm(noise, axis=1) * np.tan(np.arccos(rng.uniform(0.95, 1, len(x)))))[:, None]
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    learned = embeddings.learn_rotation(unit(x))
    apart = (embeddings.codes(unit(x), *learned) ^ embeddings.codes(unit(x + noise), *learned)).view(np.uint64)
    masks = embeddings.table_masks(count)
    assert (np.bitwise_count(masks) >= min(32, count.bit_length() - 1)).all() or count < 1 << 16
    meet = ((apart[:, None] & masks[None, :]) == 0).any(axis=1) & (np.bitwise_count(apart) <= embeddings.MAX_BITS)
    assert meet.mean() >= 0.9


# urls


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?q=/x", "HTTPS://x.net#top", "http://example.com/de/9", "http://example.community/de/9", "ftp://user@x.org/fr/a://b/c", "a\nb://H.net/p", "://net/", "http://example.net/en"]
    df = spark.createDataFrame([(i, u, "<p>", "h", 3) for i, u in enumerate(urls)] + [(None, "http://q.com/1", "", "h", 3)], "page_id long, url string, html string, host string, label int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urltemplates.judge(df).collect()}
    assert len(got) == 12
    for i in range(3):
        assert got[i] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[4] == ("x.net", "", None, got[4][3])
    assert got[5] == ("example.com", "/de/9", "example.com/de/", "block")
    assert got[6] == ("example.community", "/de/9", None, "allow")
    assert got[7] == ("user@x.org", "/fr/a://b/c", "org/fr/", "allow")
    assert got[8] == ("h.net", "/p", "net/", "block") and got[9] == ("net", "/", "net/", "block")
    assert got[10] == ("example.net", "/en", "net/", "block")
    assert urltemplates.judge(df.limit(0)).count() == 0


def test_templates_generalise_pool_and_reject(spark):
    urls = [f"http://shop.example.com/item/{'abcdefghijklmnopqrstuvwxyz'[i]}{'xyz'[i % 3]}/view" for i in range(26)]
    urls += [f"http://shop.example.com/id/{i}.html" for i in range(30)] + [f"http://a.casino-win.org/p/{i}" for i in range(5)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in urltemplates.judge(df).collect()}
    assert {got[i][0] for i in range(26)} == {"/item/*/view"} and {got[i][0] for i in range(26, 56)} == {"/id/{n}.html"}
    assert {got[i][1] for i in range(56)} == {"allow"} and {got[i] for i in range(56, 61)} == {("/p/{n}", "block")}


def plain_tree(pages, depth, fan):
    """Purity of each page of (host, segments, label or None), by dictionaries."""
    prior, strength, reach = urltemplates.PRIOR, urltemplates.STRENGTH, urltemplates.REACH
    rows = [[h, [*seg[:depth], *[None] * (depth - len(seg[:depth]))], "**" if len(seg) > depth else None, y, [], []] for h, seg, y in pages]

    def far(p, n, q, m):
        whole = (p + q) / (n + m)
        return abs(p / n - q / m) > urltemplates.ALIKE * math.sqrt(max(whole * (1 - whole), 0) * (1 / n + 1 / m)) + 1e-12

    for level in range(depth):
        nodes = defaultdict(list)
        for r in rows:
            nodes[r[0], *r[5]].append(r)
        for inside in nodes.values():
            kids = Counter(r[1][level] for r in inside)
            named = [k for k in kids if k is not None]
            wild = len(named) > fan and max(kids.values()) < urltemplates.PREVAILS * len(inside)
            for r in inside:
                r[4].append("*" if wild and r[1][level] is not None else r[1][level])
            sums = defaultdict(lambda: [0, 0])
            for r in inside:
                if r[4][level] is not None and r[3] is not None:
                    sums[r[4][level]][0] += r[3]
                    sums[r[4][level]][1] += 1
            kinds = sorted({tuple(v) for v in sums.values()}, key=lambda v: (v[0] / v[1], v[1]))
            stretches, place = [], {}
            for k in kinds:
                if not stretches or far(*k, *stretches[-1][-1]):
                    stretches.append([])
                stretches[-1].append(k)
                place[k] = len(stretches)
            joined = set()
            for i, stretch in enumerate(stretches, 1):
                members = [c for c, v in sums.items() if place[tuple(v)] == i]
                low = min(stretch, key=lambda v: (v[0] / v[1], -v[1]))
                high = max(stretch, key=lambda v: (v[0] / v[1], v[1]))
                if len(members) > 1 and not far(*low, *high):
                    joined |= set(members)
            for r in inside:
                c = r[4][level]
                r[5].append(f"~{place[tuple(sums[c])]}" if c in joined else c)

    def climb(own, chain):
        below = own
        for keys in chain:
            n = [r for r in rows if keys(r)]
            less = [r for r in rows if below(r)]
            if sum(r[3] is not None for r in n) > sum(r[3] is not None for r in less):
                out = [r for r in n if not below(r)]
                return len(out), sum(r[3] is not None for r in out), sum(r[3] or 0 for r in out)
            below = keys
        return 0, 0, 0

    def domains(host):
        parts = host.split(".")
        short = ".".join(parts[1:]) if len(parts) > 2 else host
        return short, ".".join(short.split(".")[-2:])

    found = []
    for host, _, rest, _, g, t in rows:
        own = lambda r: (r[0], r[5], r[2]) == (host, t, rest)  # noqa: B023, E731
        ups = [lambda r, k=k: r[0] == host and r[5][:k] == t[:k] for k in range(depth, -1, -1)]  # noqa: B023
        same = lambda r: r[4] == g and r[2] == rest  # noqa: B023, E731
        sides = [lambda r: same(r) and domains(r[0]) == domains(host), lambda r: same(r) and domains(r[0])[1] == domains(host)[1], same]  # noqa: B023
        here = [r[3] for r in rows if own(r) and r[3] is not None]
        top, bottom = sum(here) + prior * strength, len(here) + strength
        for n, labelled, pos in (climb(own, ups), climb(lambda r: same(r) and r[0] == host, sides)):  # noqa: B023
            if n:
                top += min(n, reach) * (pos + prior * (n - labelled)) / n
                bottom += min(n, reach)
        found.append(top / bottom)
    return found


@pytest.mark.parametrize("seed", [19, 20, 21])
def test_purities_equal_a_plain_tree(spark, seed):
    rng = np.random.default_rng(seed)
    hosts = ["a.x.org", "b.x.org", "x.org", "c.y.org", "y.net", "d.e.y.net", "single"]
    rules = [("block", "org/bad/"), ("allow", "x.org/good/"), ("block", "y.net/odd/"), ("allow", "b.x.org/bad/fine/")]
    first = ["bad", "good", "odd", "plain", "q", "w", "e", "r"]
    pages, urls = [], []
    for _ in range(260):
        host = str(rng.choice(hosts))
        segments = [str(rng.choice(first)), *rng.choice(["fine", "page", "other", "u", "v"], rng.integers(0, 4)).tolist()]
        path = "/" + "/".join(segments)
        fits = [(len(r), v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        pages.append((host, segments, int(max(fits)[1] == "block") if fits else None))
        urls.append(f"http://{host}{path}")
    want = plain_tree(pages, 2, 5)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in urltemplates.judge(df, rules, (), depth=2, fan=5).collect()}
    assert len({round(w, 6) for w in want}) > 20
    for i, w in enumerate(want):
        assert got[i]["purity"] == pytest.approx(w), (urls[i], got[i]["template"])
        assert (got[i]["rule"] is None) == (pages[i][2] is None)
        label = pages[i][2] if pages[i][2] is not None else int(w >= urltemplates.REJECT)
        assert got[i]["verdict"] == ("block" if label else "allow"), urls[i]


def test_verdicts_follow_labelled_neighbours(spark):
    rules = [("block", "bad.org/x/"), ("block", "other.net/y/"), ("allow", "fine.net/y/")]
    urls = [*[f"http://bad.org/x/{i}" for i in range(20)], "http://bad.org/z/1", "http://calm.org/z/1"]
    urls += [*[f"http://other.net/y/{i}" for i in range(20)], "http://third.net/y/1"]
    judged = lambda us: {r["url"]: r["verdict"] for r in urltemplates.judge(spark.createDataFrame(list(enumerate(us)), "page_id long, url string"), rules, ()).join(spark.createDataFrame(list(enumerate(us)), "page_id long, url string"), "page_id").collect()}
    got = judged(urls)
    assert got["http://bad.org/z/1"] == "block" and got["http://calm.org/z/1"] == "allow"  # what else its host has
    assert got["http://third.net/y/1"] == "block"  # the same template on other hosts
    assert judged([*urls, *[f"http://fine.net/y/{i}" for i in range(60)]])["http://third.net/y/1"] == "allow"


def test_alike_branches_become_one(spark):
    schema = "host string, t1 string, n long, labelled long, pos long"
    rows = [("h", "a", 10, 10, 9), ("h", "b", 1, 1, 1), ("h", "c", 40, 40, 0), ("h", "d", 5, 0, 0), ("h", None, 2, 2, 2)]
    got = {r["n"]: r["t1"] for r in urltemplates._merged(spark.createDataFrame(rows, schema), ["host"], "t1").collect()}
    assert got[10] == got[1] == "~2" and got[40] == "c" and got[5] == "d" and got[2] is None
