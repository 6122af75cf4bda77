"""The corpus pipeline: each stage's decisions, edge cases, and brute force."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from strandlake.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string"


@pytest.fixture(autouse=True)
def quick_tagger(monkeypatch):
    """A tagger trained for a moment: these tests are about the stages' decisions."""
    whole = pii.train
    monkeypatch.setattr(pii, "train", lambda background: whole(background, count=150, steps=15))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    plain = ["".join(rng.choice(list("aeioulnrst"), 7)) for _ in range(400)]
    texts, labels = [], []
    for i in range(160):
        found = rng.choice(plain, 60).tolist()
        if i % 5 == 0:
            for at in rng.integers(0, 60, 3):
                found[at] = str(rng.choice(["wretched", "rotten", "vermin"]))
        texts.append(" ".join(found))
        labels.append(int(i % 5 == 0))
    texts[1] += " mail to me.too@example.org or 10.2.3.4"
    rows = [(i, t, "en", "s", len(t), "d") for i, t in enumerate(texts)]
    rows += [(200, texts[2].upper(), "en", "s", 1, None), (201, texts[2], None, None, None, None), (202, None, "en", "s", 0, "d"), (203, "", "en", "s", 0, "d"), (204, " ", "en", "s", 1, "d"), (None, "odd " + texts[3][::-1], "en", "s", 5, "d")]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(500, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), str(folder), rows


def test_stages(spark, corpus):
    docs, folder, rows = corpus
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is None, i))
    clean = pipeline.clean_of_toxicity(spark, docs, folder).cache()
    assert ids(clean) == [i for i in range(160) if i % 5] + [200, 201, 202, 203, 204, None] and clean.columns == docs.columns
    single = pipeline.without_copies(spark, clean, folder).cache()
    assert ids(single) == [i for i in range(160) if i % 5 and i != 2] + [201, 203, 204, None] and single.columns == docs.columns
    apart = pipeline.without_near_copies(spark, single, folder).cache()
    assert ids(apart) == [i for i in range(160) if i % 5 and i != 2] + [201, 203, None]
    safe = pipeline.without_personal_data(spark, apart, folder).cache()
    texts = {r["doc_id"]: r for r in safe.collect()}
    assert texts[1]["text"].endswith("mail to [EMAIL] or [IP]") and texts[1]["n_chars"] == len(texts[1]["text"]) and safe.columns == docs.columns
    assert not any(pii.base_spans(r["text"]) for r in texts.values())
    final = pipeline.packed(spark, safe, folder)
    pieces = final.collect()
    assert sorted({r["doc_id"] for r in pieces}, key=lambda i: (i is None, i)) == ids(safe)
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
    assert pipeline.run(spark, folder).count() == len(pieces)


def test_one_row_of_each_group_stays(spark, corpus):
    _, folder, _ = corpus
    near = "the same long run of words " * 20
    rows = [(1, near + "a"), (None, near + "a"), (5, "quite another text of a few words"), (5, near + "a"), (None, "lonely words without any id"), (None, "lonely words without any id"), (7, "x y"), (7, "x y")]
    df = spark.createDataFrame([(i, t, "en", str(k), 3, "d") for k, (i, t) in enumerate(rows)], SCHEMA)
    left = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    want = sorted([(1, near + "a"), (5, rows[2][1]), (None, rows[4][1]), (7, "x y")], key=str)
    assert left(pipeline.without_near_copies(spark, df, folder)) == want
    want = sorted([(5, near + "a"), (5, rows[2][1]), (None, rows[4][1]), (7, "x y")], key=str)
    assert left(pipeline.without_copies(spark, df, folder)) == want
    same = spark.createDataFrame([(7, "x y", "en", "s", 3, "d")] * 3 + [(8, "z", "en", "s", 1, "d")] * 2, SCHEMA)
    assert left(pipeline.without_copies(spark, same, folder)) == left(pipeline.without_near_copies(spark, same, folder)) == [(7, "x y"), (8, "z")]


def test_clashing_names_pass_every_stage(spark, corpus):
    docs, folder, _ = corpus
    names = ["_text", "_score", "_predicted", "score", "predicted", "_redacted", "redacted", "row_hash", "_key_doc_id", "group", "digest", "fp", "id", "hash", "text_", "h", "n"]
    wide = docs.limit(30)
    for name in names:
        wide = wide.withColumn(name, wide["doc_id"].cast("string"))
    for name, stage in pipeline.STAGES:
        done = stage(spark, wide, folder)
        if name != "packing":
            assert done.columns == wide.columns
            assert all(r["_score"] == r["row_hash"] == r["n"] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in done.collect())
        assert done.count() > 0


def test_empty_tables(spark, corpus):
    docs, folder, _ = corpus
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_registered():
    found = entry.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11))
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii", "packing"]


def test_exact_dedup_equals_its_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = sorted(map(tuple, con.execute(entry.oracle_sql()["op10_exact_dedup"]).fetchall()))
    got = sorted(map(tuple, entry.queries()["op10_exact_dedup"](spark, data).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == want


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and p.name not in ("corpus_pipeline.py", "__spark_entry__.py")]
    assert not [p for p in users if "llm" in p.read_text()]


def test_held_out_toxicity(spark):
    from strandlake.llm import queries

    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = queries.op6_toxicity(spark, data).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert len(rows) > 500 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.85
