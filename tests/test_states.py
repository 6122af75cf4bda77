"""Smoothing, clusters, hidden states, digestion, fragment length."""

import numpy as np
import pytest

from strandlake.operators import model, smooth, states


def test_slope_of_a_parabola_is_exact():
    x = np.arange(100.0)
    got = smooth.savitzky_golay_slope(3 + 2 * x + 0.5 * x * x, 11)
    assert got[5:-5] == pytest.approx((2 + x)[5:-5])


def test_maxima_of_two_hills():
    x = np.arange(400.0)
    y = np.exp(-(((x - 100) / 20) ** 2)) + 0.7 * np.exp(-(((x - 280) / 25) ** 2))
    assert smooth.maxima(y, 51) == pytest.approx([100, 280], abs=2)


def test_sub_summits_get_letters(spark):
    values = [1, 5, 9, 5, 1, 4, 8, 4, 1]
    track = spark.createDataFrame([("c", 10 * i, 10 * i + 10, float(v)) for i, v in enumerate(values)], "chrom string, start long, end long, value double")
    peaks = spark.createDataFrame([("c", 0, 90, "p_1")], "chrom string, start long, end long, name string")
    got = sorted((r["name"], r["summit"] // 10) for r in smooth.sub_summits(peaks, track, 11).collect())
    assert [n for n, _ in got] == ["p_1a", "p_1b"] and [s for _, s in got] == [2, 6]


def test_kmeans():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (50, 1)) for c in (0, 5, 9)])
    centres, inertia = states.kmeans(x, 3)
    assert centres.ravel() == pytest.approx([0, 5, 9], abs=0.1) and inertia < 3


def test_kmeans_query_takes_every_row(spark, monkeypatch):
    from strandlake.plans import queries

    rng = np.random.default_rng(3)
    x = np.concatenate([np.round(rng.normal(c, 0.2, (n, 2)), 1) for c, n in ((0, 4000), (4, 2000), (9, 300))])
    rows = [("a" if i < 5000 else "b", i, *map(float, v)) for i, v in enumerate(x)]
    monkeypatch.setattr(queries, "_state_rows", lambda *_: spark.createDataFrame(rows, "chrom string, start long, x double, y double"))
    got = [[r["x"], r["y"]] for r in queries.kmeans_state(spark, "").orderBy("state").collect()]
    assert np.array(got) == pytest.approx(states.kmeans(x, 3)[0], abs=1e-3)


def test_posteriors_match_enumeration():
    import itertools

    hmm = states.GaussianHmm(np.array([0.6, 0.3, 0.1]), np.array([[0.8, 0.15, 0.05], [0.1, 0.7, 0.2], [0.3, 0.3, 0.4]]), np.array([[0.0, 0.0], [2.0, 1.0], [4.0, 3.0]]), np.array([[[1, 0.4], [0.4, 1.0]]] * 3))
    x = np.array([[0.1, 0.2], [1.9, 1.3], [3.0, 2.0], [2.2, 0.8]])
    dens = np.exp(hmm.log_density(x))
    want = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = hmm.start[path[0]] * dens[0, path[0]]
        for t in range(1, 4):
            p *= hmm.step[path[t - 1], path[t]] * dens[t, path[t]]
        for t, s in enumerate(path):
            want[t, s] += p
    assert hmm.posteriors(x) == pytest.approx(want / want.sum(axis=1, keepdims=True))


def test_fit_and_decode_by_sequence(spark):
    rng = np.random.default_rng(1)
    rows = [("c", i, float(v)) for i, v in enumerate(np.r_[rng.normal(0, 0.3, 60), rng.normal(4, 0.3, 60)])]
    df = spark.createDataFrame(rows, "chrom string, start long, x double")
    x = np.array([[r[2]] for r in rows])
    hmm = states.GaussianHmm.from_kmeans(x, 2).fit([x], rounds=3)
    got = {r["start"]: r["state"] for r in states.decode(df, hmm, "chrom", "start", ["x"], block=25).collect()}
    assert len(got) == 120 and {got[i] for i in range(60)} == {0} and {got[i] for i in range(60, 120)} == {1}


def test_hmm_query_learns_from_every_row(spark, monkeypatch):
    from strandlake.plans import queries

    rng = np.random.default_rng(4)
    x = np.concatenate([np.round(rng.normal(c, 0.3, (n, 2)), 1) for c, n in ((0, 1200), (4, 600), (9, 400))])
    rows = [("a" if i < 1800 else "b", i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "chrom string, start long, x double, y double")
    monkeypatch.setattr(queries, "_state_rows", lambda *_: df)
    got = {r["start"]: r["state"] for r in queries.hmm_posterior(spark, "").collect()}
    assert len(got) == 2200 and {got[i] for i in range(1200)} == {0} and {got[i] for i in range(1200, 1800)} == {1} and {got[i] for i in range(1800, 2200)} == {2}
    whole = states.GaussianHmm.from_kmeans(x, 3).fit([g[["x", "y"]].to_numpy() for _, g in df.orderBy("start").toPandas().groupby("chrom")], rounds=2)
    spread = states.fit_rows(df, states.weighted_points(df, ["x", "y"]), "chrom", "start", ["x", "y"], rounds=2, block=300)
    for name in ("start", "step", "means", "covariances"):
        assert getattr(spread, name) == pytest.approx(getattr(whole, name), abs=1e-3)


MODEL = states.GaussianHmm(np.array([0.6, 0.3, 0.1]), np.array([[0.8, 0.15, 0.05], [0.1, 0.7, 0.2], [0.3, 0.3, 0.4]]), np.array([[0.0, 0.0], [2.0, 1.0], [4.0, 3.0]]), np.array([[[1, 0.4], [0.4, 1.0]]] * 3))


@pytest.mark.parametrize("block,fan", [(1 << 17, 1024), (100, 1024), (7, 5), (1, 1024)])
def test_blocks_do_not_change_posteriors(spark, monkeypatch, block, fan):
    monkeypatch.setattr(states, "FAN", fan)
    rng = np.random.default_rng(5)
    found = {c: rng.normal(1.5, 2, (n, 2)) for c, n in (("a", 400), ("b", 37), ("c", 1))}
    df = spark.createDataFrame([(c, 3 * i - 50, *map(float, v)) for c, x in found.items() for i, v in enumerate(x)], "chrom string, start long, x double, y double")
    got = states.decode(df, MODEL, "chrom", "start", ["x", "y"], block=block).orderBy("start").toPandas()
    for c, x in found.items():
        own = np.array(got[got["chrom"] == c]["posteriors"].tolist())
        assert own == pytest.approx(MODEL.posteriors(x), abs=1e-9)


def test_likeliest_path_over_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(1.5, 2, (150, 2))
    dens = MODEL.log_density(x)
    best, back = np.log(MODEL.start) + dens[0], []
    for row in dens[1:]:
        both = best[:, None] + np.log(MODEL.step)
        back.append(both.argmax(axis=0))
        best = both.max(axis=0) + row
    path = [int(best.argmax())]
    for own in reversed(back):
        path.append(int(own[path[-1]]))
    df = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], "chrom string, start long, x double, y double")
    got = states.decode(df, MODEL, "chrom", "start", ["x", "y"], block=11, best=True).orderBy("start").collect()
    assert [r["state"] for r in got] == path[::-1]


def test_spread_starts_are_no_worse(spark):
    # Points whose best clustering has the inertia 0.2175.
    x = [(0.0, 0.0), (0.2, 0.0), (0.0, 0.2), (10.0, 10.0), (10.2, 10.0), (10.0, 10.2), (20.0, 0.0), (20.2, 0.0), (20.0, 0.2), (10.3, 10.1), (0.1, 0.2), (20.1, 0.1)]
    df = spark.createDataFrame(x, "x double, y double")
    centres, inertia = states.kmeans_rows(states.weighted_points(df, ["x", "y"]), ["x", "y"], 3)
    assert inertia == pytest.approx(0.2175, abs=1e-9) and centres == pytest.approx(states.kmeans(np.array(x), 3)[0], abs=1e-9)


def test_digestion_weights_sum_to_one(spark):
    df = spark.createDataFrame([("c", 0, 50), ("c", 0, 210), ("c", 0, 3000)], "chrom string, left long, right long")
    rows = states.digested(df).collect()
    assert all(sum(r[f"w{i}"] for i in range(4)) == pytest.approx(1) for r in rows)
    assert rows[0]["w0"] > 0.99 and rows[1]["w1"] > 0.99 and rows[2]["w3"] > 0.99


def test_fragment_length(spark):
    rng = np.random.default_rng(2)
    at = rng.integers(0, 10**6, 300)
    rows = [("c", int(a), "+") for a in at] + [("c", int(a) + 150, "-") for a in at]
    got = model.fragment_length(spark.createDataFrame(rows, "chrom string, pos long, strand string"), 400).first()
    assert got["d"] == 150 and got["pairs"] >= 300


def test_clusters_with_known_centres():
    # Points, and the centres and inertia of the best clustering.
    x = [(0.0, 0.0), (0.2, 0.0), (0.0, 0.2), (10.0, 10.0), (10.2, 10.0), (10.0, 10.2), (20.0, 0.0), (20.2, 0.0), (20.0, 0.2), (10.3, 10.1), (0.1, 0.2), (20.1, 0.1)]
    centres, inertia = states.kmeans(np.array(x), 3)
    assert centres == pytest.approx(np.array([[0.075, 0.1], [10.125, 10.075], [20.075, 0.075]]), abs=1e-12)
    assert inertia == pytest.approx(0.2175, abs=1e-12)


def test_open_regions_follow_short_fragments(spark):
    import random

    from strandlake.plans.openregions import digested_signal, open_regions

    rng = random.Random(6)
    rows = []
    for k in range(6):
        for _ in range(250):  # short fragments pile up over 400 bases
            left = 20_000 * k + 5_000 + rng.randint(0, 350)
            rows.append(("c", left, left + rng.randint(35, 70), 1))
        for _ in range(500):  # and long ones everywhere
            left = 20_000 * k + rng.randint(0, 15_000)
            rows.append(("c", left, left + rng.choice((200, 400, 600)) + rng.randint(-15, 15), 1))
    df = spark.createDataFrame(rows, "chrom string, left long, right long, n long")
    total = digested_signal(df).selectExpr("sum(s0 + s1 + s2 + s3) * 10").first()[0]
    assert total == pytest.approx(sum(r[2] - r[1] for r in rows), rel=1e-3)
    found = open_regions(df).collect()
    for k in range(6):
        inside = [r for r in found if r["start"] < 20_000 * k + 5_420 and r["end"] > 20_000 * k + 5_000]
        assert sum(min(r["end"], 20_000 * k + 5_420) - max(r["start"], 20_000 * k + 5_000) for r in inside) > 300
    assert sum(r["end"] - r["start"] for r in found) < 6 * 800
    assert open_regions(df.limit(0)).count() == 0


def test_fragment_length_of_paired_peaks(spark):
    import random

    from strandlake.operators import model

    rng = random.Random(7)
    rows = []
    for k in range(25):
        middle = 4_000 * k + 2_000
        for _ in range(60):
            at = middle + round(rng.gauss(0, 25))
            rows += [("c", at - 75, "+"), ("c", at + 75, "-")]
    rows += [("c", rng.randrange(100_000), rng.choice("+-")) for _ in range(600)]
    df = spark.createDataFrame(rows, "chrom string, pos long, strand string")
    got = model.model_length(df, 100_000.0, (2, 50), 300).first()
    assert got["n_pairs"] >= 20 and abs(got["d"] - 150) <= 10
    assert model.model_length(df, 100_000.0, (900, 1000)).first()["d"] is None
    with pytest.raises(ValueError, match="low and a high"):
        model.paired_peaks(df, 1e5, (5,))
    nulls = df.unionByName(df.limit(500).selectExpr("cast(null as string) as chrom", "pos", "strand"))
    assert model.model_length(nulls, 100_000.0, (2, 50), 300).first() == got
    assert {r["chrom"] for r in model.strand_peaks(nulls, 100_000.0, (2, 50), 300).collect()} == {"c"}

    from strandlake.plans.callpeak import PeakOptions, call_narrow, table_header, with_length

    options = PeakOptions(100_000.0, fragment=None, tag=50, fold_range=(2, 50), least_pairs=20, keep_duplicates="all")
    own = with_length(df, options)
    assert own.fragment == got["d"]
    rows = sorted(map(tuple, call_narrow(df, None, options).collect()))
    assert rows == sorted(map(tuple, call_narrow(df, None, own).collect())) and len(rows) >= 20
    middles = {4_000 * k + 2_000 for k in range(25)}
    assert sum(any(abs(r[3] - m) <= 30 for m in middles) for r in rows) >= 20
    assert f"# d = {got['d']}" in table_header(df, None, options)
    with pytest.raises(ValueError, match="too few"):
        with_length(df, PeakOptions(100_000.0, fragment=None, fold_range=(900, 1000)))
    assert with_length(df, PeakOptions(100_000.0, fragment=None, fold_range=(900, 1000), fallback=147)).fragment == 147


def test_differences_read_every_track_twice_at_most(spark):
    from strandlake.plans import queries

    plan = queries.bdgdiff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 8 and "l_shipdate" not in plan
