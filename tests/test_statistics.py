"""Agreement, consensus and the exact interval."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from acuity.functions import interval, ordinal

WORKED = {
    (4, 0, 0, 0): (1, 1), (2, 0, 0, 2): (-1, 0), (1, 1, 1, 1): (0, 0.3684828), (6, 3, 1, 0): (2 / 3, 0.6632690),
    (10, 2, 3, 1): (0.4791667, None), (2, 1, 0, 1): (1 / 12, None), (1, 0, 3, 2): (5 / 18, None), (0, 0, 0, 0): (None, None),
}
profiles = st.lists(st.tuples(*[st.integers(0, 30)] * 4).filter(any), min_size=1, max_size=40)
few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def both(spark):
    def run(counts):
        df = spark.createDataFrame([(i, *c) for i, c in enumerate(counts)], "i int, a long, b long, c long, d long")
        names = list("abcd")
        out = df.selectExpr("i", f"{ordinal.agreement(names)} as a", f"{ordinal.consensus(names)} as c").orderBy("i").collect()
        return [(r["a"], r["c"]) for r in out]
    return run


def test_worked_values(both):
    for (counts, (a, c)), (got_a, got_c) in zip(WORKED.items(), both(list(WORKED))):
        assert (got_a is None) == (a is None), counts
        if a is not None:
            assert got_a == pytest.approx(a, abs=1e-7), counts
        if c is not None:
            assert got_c == pytest.approx(c, abs=1e-7), counts


def layered(counts):
    """Agreement by peeling layers one at a time, in exact fractions."""
    k, total, out, rest = len(counts), sum(counts), Fraction(0), list(counts)
    while any(rest):
        height = min(v for v in rest if v)
        pattern = [int(v > 0) for v in rest]
        s = sum(pattern)
        if s in (1, k):
            u = Fraction(1)
        else:
            tu = tdu = 0
            for i in range(k):
                for j in range(i + 1, k):
                    for m in range(j + 1, k):
                        triple = (pattern[i], pattern[j], pattern[m])
                        tu += triple in ((1, 1, 0), (0, 1, 1))
                        tdu += triple == (1, 0, 1)
            u = Fraction((k - 2) * tu - (k - 1) * tdu, (k - 2) * (tu + tdu))
        out += Fraction(height * s, total) * u * (1 - Fraction(s - 1, k - 1))
        rest = [max(v - height, 0) for v in rest]
    return float(out)


@few
@given(profiles)
def test_agreement_equals_peeling(both, counts):
    for c, (got, _) in zip(counts, both(counts)):
        assert got == pytest.approx(layered(c), abs=1e-12)


@few
@given(profiles, st.integers(2, 9))
def test_scale_and_reversal(both, counts, factor):
    plain = both(counts)
    for changed in ([tuple(v * factor for v in c) for c in counts], [c[::-1] for c in counts]):
        for (a, c), (a2, c2) in zip(plain, both(changed)):
            assert a == pytest.approx(a2, abs=1e-12) and c == pytest.approx(c2, abs=1e-12)
    assert all(-1 - 1e-12 <= a <= 1 + 1e-12 and -1e-12 <= c <= 1 + 1e-12 for a, c in plain)


def upper_tail(k, n, p):
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))


def test_interval_solves_the_tail_equations():
    pairs = [(k, n) for n in (2, 3, 10, 37, 150) for k in range(1, n)]
    low, high = interval.clopper_pearson(*np.array(pairs).T)
    for (k, n), a, b in zip(pairs, low, high):
        assert upper_tail(k, n, a) == pytest.approx(0.025, rel=1e-9)
        assert 1 - upper_tail(k + 1, n, b) == pytest.approx(0.025, rel=1e-9)


def test_interval_ends_and_large_counts():
    low, high = interval.clopper_pearson(np.array([0, 5, 3 * 10 ** 9]), np.array([5, 5, 10 ** 10]))
    assert (low[0], high[1]) == (0, 1)
    assert high[0] == pytest.approx(0.52182, abs=1e-5) and low[1] == pytest.approx(0.47818, abs=1e-5)
    half = 1.959964 * math.sqrt(0.3 * 0.7 / 1e10)
    assert low[2] == pytest.approx(0.3 - half, abs=1e-8) and high[2] == pytest.approx(0.3 + half, abs=1e-8)


def test_both_cdf_forms_meet():
    a, b = np.array([3001.0, 3500, 5000]), np.array([3001.0, 90000, 5010])
    for shift in (0.97, 1.0, 1.02):
        x = a / (a + b) * shift
        assert np.allclose(interval._beta_cdf_large(x, a, b), interval._beta_cdf_small(x, a, b), atol=1e-9)


def test_interval_text(rows):
    df = rows("k long, n long", (3, 10), (0, 5), (5, 5), (75, 100), (1, 1), (0, 1))
    got = df.withColumn("ci", interval.exact_interval(df.k, df.n)).selectExpr(interval.interval_text("ci")).collect()
    assert [r[0] for r in got] == ["7 to 65", "0 to 52", "48 to 100", "65 to 83", "3 to 100", "0 to 98"]
