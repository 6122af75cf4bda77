"""Strand agreement by tiles against all pairs."""

from collections import Counter

import numpy as np
import pytest

from strandlake.operators import model


def by_pairs(rows, longest, bin_width):
    span, found = -(-longest // bin_width), Counter()
    for c, p, s, n in rows:
        for d, q, t, m in rows:
            if None not in (c, p, s, d, q, t) and c == d and s != "-" and t == "-":
                step = q // bin_width - p // bin_width
                if 0 < step <= span:
                    found[step * bin_width] += n * m
    return {k: v for k, v in found.items() if v}


@pytest.mark.parametrize("longest, bin_width, tile", [(7, 1, 1), (7, 1, 8), (20, 1, 64), (20, 3, 5), (40, 1, 1 << 16)])
def test_tiles_equal_all_pairs(spark, longest, bin_width, tile):
    rng = np.random.default_rng(longest + tile)
    rows = [(str(rng.choice(["a", "b"])), int(rng.integers(-30, 200)), str(rng.choice(["+", "-", "."])), int(rng.choice([0, 1, 2, 5000, 3_000_001]))) for _ in range(150)]
    rows += [(None, 5, "+", 1), ("a", None, "-", 1), ("a", 9, None, 1), ("a", 7, "+", 2), ("a", 7, "+", 2)]
    df = spark.createDataFrame(rows, "chrom string, pos long, strand string, n long").repartition(3)
    got = {r["offset"]: r["pairs"] for r in model.strand_agreement(df, longest, bin_width, tile).collect()}
    assert got == by_pairs(rows, longest, bin_width)


def test_deep_places_stay_exact():
    rng = np.random.default_rng(3)
    one, other = rng.integers(0, 1 << 20, 3000), rng.integers(0, 1 << 20, 3400)
    wanted = [sum(int(x) * int(y) for x, y in zip(one, other[k:])) for k in range(1, 401)]
    assert model._agreement(one, other, 400).tolist() == wanted


def test_offsets_beyond_the_reads_and_empty_sides(spark):
    schema = "chrom string, pos long, strand string"
    df = spark.createDataFrame([("a", 0, "+"), ("a", 3, "-")], schema)
    assert [tuple(r) for r in model.strand_agreement(df, 5000).collect()] == [(3, 1)]
    assert model.fragment_length(df, 5000).collect()[0].asDict() == {"d": 3, "pairs": 1}
    for rows in ([], [("a", 0, "+")], [("a", 0, "-")]):
        assert model.strand_agreement(spark.createDataFrame(rows, schema), 10).count() == 0
    with pytest.raises(ValueError):
        model.strand_agreement(df, 0)
