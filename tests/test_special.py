import math

import pytest

from millwright.functions import special
from millwright.functions.report import to_jsonable


def test_known_quantiles():
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert special.chi2_quantile(0.95, 1) == pytest.approx(3.841458820694124)
    assert special.chi2_quantile(0.025, 12) == pytest.approx(4.403788506981702)
    assert special.chi2_quantile(0.975, 12) == pytest.approx(23.33666415864534)


def test_tails():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074037)
    assert special.f_tail(3.0, 4, 20) == pytest.approx(0.0431, abs=5e-4)
    assert special.binomial_tail(2, 100, 0.01) == pytest.approx(1 - sum(math.comb(100, k) * 0.01**k * 0.99 ** (100 - k) for k in range(3)))
    assert special.poisson_quantile(0.9, 4.0) == 7
    assert special.poisson_quantile(0.1, 4.0) == 2
    assert sum(special.poisson_pmf(k, 2.5) for k in range(60)) == pytest.approx(1)


def test_gamma_against_closed_forms():
    for x in (0.1, 1.0, 3.0, 30.0):
        assert special.gamma_p(1.0, x) == pytest.approx(1 - math.exp(-x))
        assert special.gamma_p(0.5, x) == pytest.approx(math.erf(math.sqrt(x)))


def test_minimum_and_root():
    assert special.golden_minimum(lambda x: (x - 2) ** 2, 0, 5)[0] == pytest.approx(2, abs=1e-6)
    assert special.bisect(lambda x: x**3 - 8, 0, 10) == pytest.approx(2)


def test_jsonable():
    assert to_jsonable({1: float("nan"), "a": (1, float("inf"), None, True)}) == {"1": None, "a": [1, None, None, True]}
