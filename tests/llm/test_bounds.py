"""What no partitioning, number of levels or size of a lexicon may change."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import lm, toxicity, urltemplates


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(None if i % 5 == 0 else i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(60)]
    rows += [(i, rows[1][1]) for i in range(100, 140)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learns = F.crc32(F.coalesce("text", F.lit(""))) % 3 != 0
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"])
    one = sorted(lm.score(df.repartition(1), learns).collect(), key=key)
    five = sorted(lm.score(df.repartition(5), learns).collect(), key=key)
    assert [r["base_score"] for r in one] == pytest.approx([r["base_score"] for r in five])
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in five], rel=1e-4)


def test_equal_keys_are_numbered_over_partitions(spark):
    df = spark.range(0, 200, 1, 7).select(F.monotonically_increasing_id().alias("row"), (F.col("id") % 3).alias("key"))
    found: dict = {}
    for r in lm.numbered(df).collect():
        found.setdefault(r["key"], []).append(r["number"])
    assert {k: sorted(v) for k, v in found.items()} == {0: list(range(67)), 1: list(range(67)), 2: list(range(66))}


def test_levels_go_as_deep_as_nodes_branch(spark):
    deep = "/a/b/c/d/e/f"
    urls = [f"http://h.x{deep}/good/{w}" for w in "abcdefghijklmnopqrst"] + [f"http://h.x{deep}/bad/{w}" for w in "abcdefghijklmnopqrst"]
    urls += ["http://h.x/" + "/".join("z" * 300), None, "", "no url", "http://h.x", "http://h.x" + deep]
    # Of the pages below "bad" four have no label: (16 + 0.4 + 8 * 0.2 * 18 / 26) / (16 + 2 + 8) is beyond a half.
    rules = [("block", f"h.x{deep}/bad/{w}") for w in "abcdefghijklmnop"] + [("allow", f"h.x{deep}/good/{w}") for w in "abcd"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in urltemplates.judge(df, rules, ()).collect()}
    assert len(got) == len(urls)
    assert all(got[i]["verdict"] == "allow" for i in range(20)) and all(got[i]["verdict"] == "block" for i in range(20, 40))
    assert got[19]["template"] == f"{deep}/good/*" and got[39]["template"] == f"{deep}/bad/*"


def test_branching_counts_ends_and_needs_pages(spark):
    rows = [("h", ["a", "b", "c"], 10), ("h", ["a", "b"], 10), ("i", ["a", "b", "c", "d"], 3), ("i", ["a", "b", "c", "e"], 3), ("j", [], 50)]
    df = spark.createDataFrame(rows, "host string, segments array<string>, n long")
    assert urltemplates.branching(df, 16) == 3
    assert urltemplates.branching(df, 4) == 4
    assert urltemplates.branching(df.limit(0)) == 1


def test_entries_are_chosen_as_pair_by_pair(spark):
    rng = random.Random(1)
    words = {"".join(rng.choices("ab", k=rng.randrange(3, 10))) for _ in range(300)}
    rows = [(w, rng.randrange(4, 30), rng.random()) for w in sorted(words)]
    rows += [(s + "*", rng.randrange(4, 60), rng.random()) for s in sorted({w[:k] for w in words for k in toxicity.STEM_LENGTHS if len(w) >= k})]
    order = sorted(rows, key=lambda r: (-r[2], len(r[0]), r[0]))
    usual = {e: p for e, p, _ in order if not e.endswith("*")}
    stems: list[str] = []
    for entry, p, _ in order:
        stem = entry[:-1]
        if entry.endswith("*"):
            best = max((q for w, q in usual.items() if w.startswith(stem)), default=0)
            if p >= 1.5 * best and p >= best + toxicity.SUPPORT // 2 and not any(stem.startswith(s) or s.startswith(stem) for s in stems):
                stems.append(stem)
    assert stems
    assert toxicity.choose(rows) == ([w for w in usual if not any(w.startswith(s) for s in stems)], stems)
