"""Decontamination against every window of every document, and its SQL."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = cut(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, names = cut(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()), key=str)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1, "r", "k") for d, t in docs], "doc_id long, text string, size int, row string, known string").repartition(3),
        spark.createDataFrame([(i, t, "w", 3) for i, t in items], "item_id long, text string, window string, length int"),
    )


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(30)] + ["É", "été", "Ünder", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice((1, 4, 9, 10, 11, 25)))) for i in range(12)] + [(3, text(12)), (None, text(14)), (50, None), (51, "?!"), (52, "a b " * 9), (53, "a b " * 9)]
    docs = [(None, None), (1, ""), (2, "..."), (3, "one"), (4, "a b " * 40)]
    for i in range(30):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = cut(rng.choice(items)[1])
            low = rng.randint(0, max(0, len(w) - 9))
            parts += [", ".join(w[low : low + rng.randint(8, 12)]).upper().replace("É", "é"), text(rng.randint(0, 12))]
        docs.append((i, " ".join(parts)))
    return docs + docs[7:9], items


@pytest.mark.parametrize("seed,few", [(0, 200_000), (1, 200_000), (2, 0)])
def test_every_shared_window_is_found(spark, monkeypatch, seed, few):
    monkeypatch.setattr(decontaminate, "FEW", few)
    docs, items = made(seed)
    got = found(decontaminate.contaminated(*tables(spark, docs, items)))
    want = brute(docs, items)
    assert got == want and sum(x[2] > 0 for x in want) > 10


def test_only_long_items(spark):
    docs, items = made(3)
    items = [x for x in items if len(cut(x[1])) >= 10]
    assert found(decontaminate.contaminated(*tables(spark, docs, items))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = made(4)
    assert found(decontaminate.contaminated(*tables(spark, [], items))) == []
    assert found(decontaminate.contaminated(*tables(spark, docs, []))) == brute(docs, [])


def test_long_text_full_of_hits(spark):
    item = " ".join("w%d" % (i % 17) for i in range(40))
    docs = [(1, " ".join([item] * 500)), (2, item.replace("w3", "v3"))]
    assert found(decontaminate.contaminated(*tables(spark, docs, [(1, item)]))) == brute(docs, [(1, item)])


def test_no_python_in_the_plan(spark):
    docs, items = tables(spark, *made(5))
    plan = decontaminate.contaminated(docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, folder):
    data = f"/root/testdata/{folder}"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL['op12_decontaminate']})").fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in queries.op12_decontaminate(spark, data).collect())
    assert got == want and any(x[-1] for x in want)
