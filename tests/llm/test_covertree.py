"""Hard negatives against all scores of all rows, and their SQL; the tree's bounds."""

import math

import duckdb
import numpy as np
import pytest

from strandlake.llm import covertree, queries

SCHEMA = "vec_id long, embedding array<double>, label int, request string, cell int, vector string"


def brute(rows):
    taken = []
    for i, v, label in dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label
        row = (i, int(label), tuple(math.floor(256 * x) for x in v))
        if row not in taken:
            taken.append(row)
    score = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
    rank = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for i, label, v in taken:
        if i is None or i % 100:
            continue
        each = [(score(v, w), j, m) for j, m, w in taken]
        for ps, p, _ in rank([x for x in each if x[2] == label and x[1] != i])[:5]:
            found = rank([x for x in each if x[2] != label and 80 * ps <= 100 * x[0] <= 100 * ps])[:5]
            out += [(i, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(found)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "q", 1, "v") for r in rows], SCHEMA).repartition(3)


def made(seed, n, width=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, width))
    rows = [(i, (middles[i % 5] + 0.3 * rng.normal(size=width)).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    copies = rng.normal(size=width).tolist()
    rows += [(n + i, copies, i % 3) for i in range(n // 2)]  # a third of all rows are one vector
    return rows


ODD = [
    (100, None, 1), (None, [1.0] * 6, 1), (None, [0.5] * 6, 2), (7, [math.nan] * 6, 1), (5000, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (8, [None, 1.0], 1), (9, [1.0], None), (10_000, [], 1), (10_100, [1.0, 2.0], 0),
    (10_200, [-0.001] * 6, 2), (0, [0.1] * 6, 2), (200, [0.0] * 6, 0),
]


@pytest.mark.parametrize("seed,n,per_tree", [(0, 400, 2048), (1, 500, 40), (2, 60, 8)])
def test_all_scores(spark, seed, n, per_tree):
    rows = made(seed, n) + ODD
    rows = rows + rows[:9]
    want = brute(rows)
    assert found(covertree.hard_negatives(table(spark, rows), per_tree=per_tree)) == want and len(want) > 5


def test_large_components_stay_exact(spark):
    rows = [(100 * i if i < 3 else i, [1e9 * (i + 1), 1.5e9, -3.25 * i], i % 2) for i in range(40)]
    rows[3] = (3, rows[0][1], 0)
    want = brute(rows)
    assert found(covertree.hard_negatives(table(spark, rows), per_tree=9)) == want and want
    small = [(i, [x / 2e6 for x in v], m) for i, v, m in rows]
    assert found(covertree.hard_negatives(table(spark, small), per_tree=9)) == brute(small)


def test_empty_tables(spark):
    assert found(covertree.hard_negatives(table(spark, []))) == []
    assert found(covertree.hard_negatives(table(spark, [(1, [1.0], 1), (2, [1.0], 2)]))) == []


def test_tree_shows_every_leaf_that_matters():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 8))
    points = np.floor(256 * (middles[rng.integers(0, 30, 3000)] + 0.05 * rng.normal(size=(3000, 8)))).astype(np.int64)
    points[:400] = points[0]
    top = float(np.sqrt((points.astype(float) ** 2).sum(axis=1).max()))
    tree = covertree.CoverTree(points, top)
    assert sorted(np.concatenate([x for x in tree.leaves if x is not None]).tolist()) == list(range(3000))
    asked = points[rng.integers(400, 3000, 20)]
    true, shown = asked @ points.T, 0
    for low, high in ((-np.inf, np.inf), (50_000, 120_000), (400_000, np.inf)):
        seen = [set() for _ in asked]
        for at, leaf, scored in tree.search(asked, np.full(20, low), np.full(20, high)):
            assert (scored == true[at][:, leaf]).all()
            for q in at:
                seen[q] |= set(leaf.tolist())
        for q in range(20):
            assert set(np.flatnonzero((true[q] >= low) & (true[q] <= high)).tolist()) <= seen[q]
        shown += sum(map(len, seen))
    assert shown < 3 * 20 * 3000 * 0.75


def test_scores_beyond_doubles():
    a = np.array([[1 << 40, 3], [1 << 62, 1]], np.int64)
    assert covertree.scores(a, a).tolist() == [[covertree.HIGHEST] * 2] * 2
    b = np.array([[(1 << 29) + 1, 3], [-(1 << 31), 5]], np.int64)
    assert covertree.scores(b, b[:1]).tolist() == [[((1 << 29) + 1) ** 2 + 9], [-(1 << 31) * ((1 << 29) + 1) + 15]]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_query_equals_its_sql(spark, folder):
    data = f"/root/testdata/{folder}"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    want = sorted(con.execute(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({queries.ORACLE_SQL['op11_hard_negatives']})").fetchall(), key=str)
    assert found(queries.op11_hard_negatives(spark, data)) == want and want
