"""Scalar statistics against direct sums."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.functions import stats


def direct_tail(k, lam):
    terms = [-lam + i * math.log(lam) - math.lgamma(i + 1) for i in range(k + 1, k + 4000)]
    top = max(terms)
    return -(top + math.log(math.fsum(math.exp(t - top) for t in terms))) / math.log(10)


@pytest.mark.parametrize("k", [0, 1, 2, 5, 10, 50, 100, 500, 1000])
@pytest.mark.parametrize("lam", [0.01, 0.1, 1.0, 5.0, 34.56, 181.97, 1000.0])
def test_poisson_grid(k, lam):
    want = direct_tail(k, lam)
    assert stats.poisson_score(np.array([k]), np.array([lam]))[0] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_poisson_known_scores():
    got = stats.poisson_score(np.array([3, 3, 9, 168298]), np.array([0.04, 1000 / 48200, 0.096, 84199.5]))
    assert got == pytest.approx([6.98586, 8.11961, 16.7749, 14098.4], rel=5e-6)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.floats(0.05, 300))
def test_poisson_falls_with_the_rate_and_rises_with_the_count(k, lam):
    a, b, c = stats.poisson_score(np.array([k, k + 1, k]), np.array([lam, lam, lam * 1.1]))
    assert a >= 0 and b >= a and c <= a + 1e-9


def test_poisson_edges():
    got = stats.poisson_score(np.array([0, 3, 2]), np.array([0.0, 0.0, np.nan]))
    assert got[0] == np.inf and got[1] == np.inf and np.isnan(got[2])


def test_binomial_limit():
    def direct(n, p):
        total = 0.0
        for x in range(n + 1):
            total += math.comb(n, x) * p**x * (1 - p) ** (n - x)
            if total >= 1 - 1e-5:
                return max(1, x)

    for n, g in ((12, 48200), (500, 1000), (2000, 3500), (5, 1.5)):
        assert stats.binomial_max_duplicates(n, g) == direct(n, 1 / g)
    assert stats.binomial_max_duplicates(0, 100) == 1


def test_normal_and_chi_square():
    assert stats.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert stats.chi_square_score(3.841458821, 1) == pytest.approx(-math.log10(0.05), abs=1e-6)
    assert stats.chi_square_score(9.487729037, 4) == pytest.approx(-math.log10(0.05), abs=1e-6)
    assert stats.chi_square_score(0, 3) == 0
