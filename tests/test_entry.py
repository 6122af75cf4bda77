"""The driver's entry points, and queries against their SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from strandlake.plans import oracle, queries

DATA = "/root/testdata/sf0.001"
CHECKED = ["read_stats", "filterdup_auto", "fragments_dedup", "pileup_se", "pileup_weighted", "pileup_clamped", "cutoff_scores", "scale_small", "lambda_nocontrol", "track_align", "bdgcmp_loglr", "poisson_score", "qtable", "peaks_narrow", "peaks_gapped", "bdgdiff", "refinepeak", "predictd", "stream_counts", "lambda_fragments", "bdgcmp_ppois", "bdgcmp_qpois", "peaks_narrow_q", "peaks_broad_q", "signal_per_million"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["chrom", "start", "end", "treat", "lambda", "p", "fe", "q"] and df.count() > 0


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(oracle.oracle_sql()) <= set(queries.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(oracle.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if got[c].dtype.kind in "if":
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=1e-9, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.mark.parametrize("name", ["randsample", "summits_sg", "peaks_summits", "predictd_model", "open_states", "kmeans_state", "hmm_posterior"])
def test_query_without_sql_has_rows(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0
