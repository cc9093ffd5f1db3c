"""Model cells and the random-intercept fit."""

import math

import numpy as np
import pytest

from acuity.operators import mixed_logit as ml, model_data as md

RATING = "booked_procedure string, sex string, age double, emerg_priority_collapse string, trauma boolean"


def test_cells_equal_the_frame(spark):
    rng = np.random.default_rng(1)
    data = [(f"p{i % 9}", ["M", "F"][rng.integers(2)], float(rng.integers(0, 97)), ["<1hr", "<4hrs", "<8hrs", None][rng.integers(4)],
             bool(rng.integers(2))) for i in range(400)]
    data += [("q", "M", 20.0, "<1hr", False)] * 30 + [("r", "M", None, "<1hr", False), ("r", "F", 1.0, None, True)] * 6
    df = spark.createDataFrame(data, RATING)
    for options in ({"min_raters": 8, "both_sexes": True}, {"min_raters": 20, "both_sexes": False}):
        frame = md.model_frame(df, **options).dropna(subset=["age_gp"])
        counted = frame.groupBy("booked_procedure", "sex", "age_gp", "trauma").count().collect()
        events = {tuple(r)[:4]: r["count"] for r in frame.filter("urgent_yn = 'not urgent'")
                  .groupBy("booked_procedure", "sex", "age_gp", "trauma").count().collect()}
        expected = {tuple(r)[:4]: (r["count"], events.get(tuple(r)[:4], 0)) for r in counted}
        wide = md.model_cells(df, with_trauma=True, **options)
        assert {tuple(r)[:4]: (r.n, r.y) for r in md.cells_long(wide, True).collect()} == expected
        size = md.sample_size(wide, True).first()
        assert size.n_modelled == frame.count() and size.n_ratings == md.model_frame(df, **options).count()


def test_frame_cells_count_the_frame(spark):
    rng = np.random.default_rng(2)
    data = [(f"p{i % 9}" if i % 50 else None, ["M", "F", None][rng.choice(3, p=[0.5, 0.45, 0.05])], float(rng.integers(0, 97)) if i % 17 else None,
             ["<1hr", "<4hrs", "<8hrs", None][rng.integers(4)], bool(rng.integers(2)) if i % 13 else None) for i in range(300)]
    data += [("q", "M", 20.0, "<1hr", False)] * 30 + [("r", "M", None, "<1hr", False), ("r", "F", 1.0, None, True)] * 6
    df = spark.createDataFrame(data, RATING)
    for options in ({"min_raters": 8, "both_sexes": True}, {"min_raters": 20, "both_sexes": False}):
        for given in (df, df.drop("trauma"), df.filter("false")):
            frame = md.model_frame(given, **options)
            want = {tuple(r)[:-1]: r["count"] for r in frame.groupBy(*frame.columns).count().collect()}
            counted = md.frame_cells(given, **options)
            assert counted.columns == [*frame.columns, "n"] and {tuple(r)[:-1]: r.n for r in counted.collect()} == want
        assert len(want) == 0


def simulated(groups, beta, tau, seed, terms="main"):
    _, x = ml.design(terms)
    rng = np.random.default_rng(seed)
    n = rng.integers(2, 30, (groups, len(x)))
    eta = x @ np.array(beta) + tau * rng.normal(size=(groups, 1))
    return n, rng.binomial(n, 1 / (1 + np.exp(-eta)))


def frame(spark, n, y):
    columns = [c for j in range(n.shape[1]) for c in (f"n{j}", f"y{j}")]
    rows = [[int(v) for j in range(n.shape[1]) for v in (a[j], b[j])] for a, b in zip(n, y)]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))


def test_gradient_is_the_derivative():
    n, y = simulated(40, [-0.5, 0.4, 0.3, -0.6], 0.8, 3)
    _, x = ml.design("main")
    point = np.array([-0.3, 0.2, 0.1, -0.4, 0.6])
    _, grad = ml.laplace(n, y, x, point[:-1], point[-1])
    for i in range(5):
        h = np.eye(5)[i] * 1e-5
        up, down = (ml.laplace(n, y, x, p[:-1], p[-1])[0] for p in (point + h, point - h))
        assert grad[i] == pytest.approx((up - down) / 2e-5, rel=1e-5, abs=1e-4)


def test_laplace_is_close_to_the_integral():
    n, y = simulated(6, [-0.5, 0.4, 0.3, -0.6], 0.8, 4)
    _, x = ml.design("main")
    beta, tau = np.array([-0.5, 0.4, 0.3, -0.6]), 0.8
    u, w = np.polynomial.hermite_e.hermegauss(80)
    eta = (x @ beta)[None, :, None] + tau * u
    logs = (y[..., None] * eta - n[..., None] * np.logaddexp(0, eta)).sum(1)
    exact = np.log((np.exp(logs - logs.max(1, keepdims=True)) * w).sum(1) / math.sqrt(2 * math.pi)) + logs.max(1)
    assert ml.laplace(n, y, x, beta, tau)[0] == pytest.approx(exact.sum(), abs=0.05)


def test_recovers_simulated_parameters(spark):
    beta, tau = [-0.5, 0.4, 0.3, -0.6], 0.8
    n, y = simulated(600, beta, tau, 5)
    counts = ml.prepare_counts(frame(spark, n, y))
    fit = ml.random_intercept_logit(counts)
    assert fit.n_procedures == 600 and fit.n_ratings == n.sum()
    errors = np.sqrt(np.diag(fit.covariance))
    assert np.all(np.abs(fit.beta - beta) < 3 * errors) and fit.tau == pytest.approx(tau, abs=0.1)
    _, x = ml.design("main")
    assert np.abs(ml.laplace(n, y, x, fit.beta, fit.tau)[1]).max() < 0.05

    small = ml.random_intercept_logit(counts, "null")
    assert small.log_likelihood < fit.log_likelihood
    test = {r.model: r for r in ml.compare_models(spark, small, fit).collect()}
    assert test["m1"].df == 3 and test["m1"].p_value < 1e-6 and test["m_null"].chisq is None
    assert test["m1"].AIC == pytest.approx(-2 * fit.log_likelihood + 10)
    assert ml.icc(small) == pytest.approx(small.tau ** 2 / (small.tau ** 2 + 1))
    assert ml.icc(small, latent=True) == pytest.approx(small.tau ** 2 / (small.tau ** 2 + math.pi ** 2 / 3))

    table = ml.odds_ratios(spark, fit)
    assert [r.Variable for r in table.collect()] == ["(Intercept)", "sexM", "age_gpelderly", "age_gppaeds"]
    r = table.filter("Variable = 'sexM'").first()
    assert r.OddsRatio == round(math.exp(fit.beta[1]), 2) and r.LL < r.OddsRatio < r.UL


def test_without_variation_between_groups_it_is_the_plain_model(spark):
    n, y = simulated(400, [-0.5, 0.4, 0.3, -0.6], 0.0, 7)
    counts = frame(spark, n, y)
    fit = ml.random_intercept_logit(counts)
    plain = {r.Variable: r.OddsRatio for r in ml.fixed_effect_odds(counts).collect()}
    assert fit.tau < 0.15
    for name, b in zip(fit.terms, fit.beta):
        assert math.exp(b) == pytest.approx(plain[name], abs=0.02)


def test_constant_outcome_is_refused(spark):
    n, _ = simulated(5, [0, 0, 0, 0], 0, 1)
    with pytest.raises(ValueError):
        ml.random_intercept_logit(frame(spark, n, n))


def test_interaction_design():
    names, x = ml.design("interaction", with_trauma=True)
    assert names == ["(Intercept)", "sexM", "age_gpelderly", "age_gppaeds", "traumaTRUE", "sexM:age_gpelderly", "sexM:age_gppaeds"]
    assert x.shape == (12, 7) and np.linalg.matrix_rank(x) == 7


@pytest.mark.parametrize("x, df, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (11.0705, 5, 0.05), (0, 2, 1)])
def test_chi_square_tail(x, df, p):
    assert ml.chi_square_tail(x, df) == pytest.approx(p, abs=1e-6)


def test_an_exhausted_fit_raises(spark):
    n, y = simulated(40, [-0.5, 0.4, 0.3, -0.6], 0.8, 3)
    with pytest.raises(ArithmeticError):
        ml.random_intercept_logit(frame(spark, n, y), "main", max_steps=1)


def test_counts_leave_no_files(spark, tmp_path):
    from acuity.sources import writers
    n, y = simulated(40, [-0.5, 0.4, 0.3, -0.6], 0.8, 3)
    counts = ml.prepare_counts(frame(spark, n, y), 10, str(tmp_path))
    assert counts.count() == 40 and len(list(tmp_path.glob("*/*.parquet"))) >= 4
    ml.random_intercept_logit(counts, "null")
    writers.remove(counts)
    assert list(tmp_path.iterdir()) == []
