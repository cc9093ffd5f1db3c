"""Logistic regression with a random intercept per procedure.

The data enter as one row of cell counts per procedure (``model_data``), written
once. Every step of the fit is one Spark job: executors turn their procedures
into sums of the Laplace log-likelihood and its gradient at a handful of
parameter points, and only those sums (a few numbers per point) come back. The
driver takes Newton steps on them.
"""

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from acuity.operators.model_data import cells
from acuity.sources.writers import materialize

# Executors get this small module with the task; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- design ------------------------------------------------------------------
def design(terms: str, with_trauma: bool = False) -> tuple[list[str], np.ndarray]:
    """Term names and the cell x term matrix.

    ``terms``: ``null`` (intercept only), ``main`` (sex + age group, and trauma
    if present) or ``interaction`` (sex * age group, and trauma).
    """
    columns = {"(Intercept)": lambda sex, age, trauma: 1.0}
    if terms in ("main", "interaction"):
        columns["sexM"] = lambda sex, age, trauma: float(sex == "M")
        columns["age_gpelderly"] = lambda sex, age, trauma: float(age == "elderly")
        columns["age_gppaeds"] = lambda sex, age, trauma: float(age == "paeds")
        if with_trauma:
            columns["traumaTRUE"] = lambda sex, age, trauma: float(bool(trauma))
        if terms == "interaction":
            columns["sexM:age_gpelderly"] = lambda sex, age, trauma: float(sex == "M" and age == "elderly")
            columns["sexM:age_gppaeds"] = lambda sex, age, trauma: float(sex == "M" and age == "paeds")
    elif terms != "null":
        raise ValueError(f"terms must be 'null', 'main' or 'interaction', not {terms!r}")
    matrix = np.array([[f(*cell) for f in columns.values()] for cell in cells(with_trauma)])
    return list(columns), matrix


# --- one batch of procedures at one parameter point --------------------------
def laplace(n: np.ndarray, y: np.ndarray, x: np.ndarray, beta: np.ndarray, tau: float):
    """Sum over procedures of the Laplace log-likelihood, and its gradient in (beta, tau).

    ``n`` and ``y`` are procedures x cells. The random effect is ``tau * u`` with
    standard normal ``u``; its mode comes from a damped Newton iteration for all
    procedures at once.
    """
    fixed = x @ beta
    u = np.zeros(len(n))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(fixed + tau * u[:, None])))
        slope = tau * (y - n * p).sum(1) - u
        step = slope / (1 + tau * tau * (n * p * (1 - p)).sum(1))
        u = u + np.clip(step, -2, 2)
        if np.max(np.abs(step), initial=0) < 1e-10:
            break
    else:
        raise ArithmeticError("a mode did not converge")
    eta = fixed + tau * u[:, None]
    p = 1 / (1 + np.exp(-eta))
    residual, w = y - n * p, n * p * (1 - p)
    w3 = w * (1 - 2 * p)
    curve = 1 + tau * tau * w.sum(1)
    value = (y * eta - n * np.logaddexp(0, eta)).sum(1) - u * u / 2 - np.log(curve) / 2
    # the mode moves with the parameters; only the curvature term feels that
    du_beta = -tau * (w @ x) / curve[:, None]
    du_tau = (residual.sum(1) - tau * w.sum(1) * u) / curve
    dc_beta = tau ** 2 * (w3 @ x + tau * w3.sum(1)[:, None] * du_beta)
    dc_tau = 2 * tau * w.sum(1) + tau ** 2 * w3.sum(1) * (u + tau * du_tau)
    grad_beta = residual @ x - dc_beta / (2 * curve[:, None])
    grad_tau = residual.sum(1) * u - dc_tau / (2 * curve)
    return value.sum(), np.append(grad_beta.sum(0), grad_tau.sum())


# --- sums over all procedures: one Spark job ---------------------------------
def _evaluate(counts: DataFrame, x: np.ndarray, points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Log-likelihood and gradient at several points (beta..., tau) in one job."""
    size = x.shape[0]
    n_columns, y_columns = [f"n{j}" for j in range(size)], [f"y{j}" for j in range(size)]
    width = x.shape[1] + 1
    names = ["value", *[f"g{i}" for i in range(width)]]

    def partition_sums(batches):
        sums = np.zeros((len(points), width + 1))
        for pdf in batches:
            n, y = pdf[n_columns].to_numpy(float), pdf[y_columns].to_numpy(float)
            for i, point in enumerate(points):
                value, grad = laplace(n, y, x, point[:-1], point[-1])
                sums[i, 0] += value
                sums[i, 1:] += grad
        yield pd.DataFrame(sums, columns=names).assign(point=range(len(points)))

    typed = ", ".join(f"{c} double" for c in names) + ", point int"
    rows = (counts.select(*n_columns, *y_columns).mapInPandas(partition_sums, typed)
            .groupBy("point").agg(*[F.expr(f"sum({c}) as {c}") for c in names]).collect())
    return [(r["value"], np.array([r[f"g{i}"] for i in range(width)])) for r in sorted(rows, key=lambda r: r["point"])]


@dataclass
class Fit:
    """A fitted model. ``covariance`` covers the fixed effects only."""

    terms: list[str]
    beta: np.ndarray
    tau: float
    covariance: np.ndarray
    log_likelihood: float
    n_ratings: int
    n_procedures: int

    @property
    def parameters(self) -> int:
        return len(self.beta) + 1


def cell_totals(counts: DataFrame, x: np.ndarray) -> DataFrame:
    """One row per covariate cell with its totals and design columns."""
    sums = counts.agg(*[F.expr(f"sum({c}{j}) as {c}{j}") for j in range(len(x)) for c in "ny"])
    rows = ", ".join(
        f"struct(cast(n{j} as double) as n, try_divide(y{j}, n{j}) as share, "
        + ", ".join(f"{float(v)}D as x{i}" for i, v in enumerate(x[j])) + ")"
        for j in range(len(x)))
    return sums.selectExpr(f"inline(array({rows}))").filter("n > 0")


def _plain_logit(counts: DataFrame, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors of the logistic model without a random effect."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    covariates = VectorAssembler(inputCols=[f"x{i}" for i in range(1, len(names))], outputCol="features")
    glm = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="n", labelCol="share", tol=1e-10)
    fitted = glm.fit(covariates.transform(cell_totals(counts, x)))
    errors = np.array(fitted.summary.coefficientStandardErrors)  # the intercept comes last
    return np.append(fitted.intercept, fitted.coefficients.toArray()), np.append(errors[-1], errors[:-1])


def fixed_effect_odds(counts: DataFrame, terms: str = "main", with_trauma: bool = False) -> DataFrame:
    """Odds ratios of the plain logistic model on the same cells."""
    names, x = design(terms, with_trauma)
    return _odds_table(counts.sparkSession, names, *_plain_logit(counts, names, x))


def random_intercept_logit(counts: DataFrame, terms: str = "main", with_trauma: bool = False,
                           max_steps: int = 30, tolerance: float = 1e-9) -> Fit:
    """Maximum of the Laplace likelihood by damped Newton steps.

    ``counts`` is the output of ``model_cells``; pass it materialized to fit
    several models on it. Curvature is the difference of gradients at nearby
    points, evaluated in the same job as the gradient itself. A fit that does
    not reach an optimum within ``max_steps`` raises.
    """
    names, x = design(terms, with_trauma)
    k = len(names) + 1
    n_sum, y_sum = (" + ".join(f"{c}{j}" for j in range(len(x))) for c in "ny")
    groups, n_total, y_total = counts.agg(
        F.expr("count(*)"), F.expr(f"coalesce(sum({n_sum}), 0)"), F.expr(f"coalesce(sum({y_sum}), 0)")).first()
    if not 0 < y_total < n_total:
        raise ValueError("the outcome does not vary")
    point = np.zeros(k)
    point[0], point[-1] = math.log(y_total / (n_total - y_total)), 1.0

    def with_curvature(at):
        h = 1e-4 * np.maximum(1, np.abs(at))
        nearby = [at + s * h[i] * np.eye(k)[i] for i in range(k) for s in (1, -1)]
        (value, grad), *rest = _evaluate(counts, x, [at, *nearby])
        hessian = np.array([(rest[2 * i][1] - rest[2 * i + 1][1]) / (2 * h[i]) for i in range(k)])
        return value, grad, (hessian + hessian.T) / 2

    value, grad, hessian = with_curvature(point)
    converged = False
    for _ in range(max_steps):
        # concave direction: flip and floor the eigenvalues
        lam, vectors = np.linalg.eigh(-hessian)
        step = vectors @ ((vectors.T @ grad) / np.maximum(np.abs(lam), 1e-6 * np.abs(lam).max()))
        if grad @ step < tolerance:
            converged = True
            break
        step *= min(1, 3 / np.abs(step).max())
        moved = point + step
        reached = with_curvature(moved)
        if reached[0] < value:  # the full step overshoots: look along it
            shrink = [2.0 ** -i for i in range(1, 12)]
            tried = _evaluate(counts, x, [point + s * step for s in shrink])
            best = max(range(len(shrink)), key=lambda i: tried[i][0])
            if tried[best][0] <= value:
                converged = grad @ step < 1e-3
                break
            moved = point + shrink[best] * step
            reached = with_curvature(moved)
        point, (value, grad, hessian) = moved, reached
    if not converged:
        raise ArithmeticError(f"no optimum within {max_steps} steps")
    tau = abs(point[-1])  # the sign of tau carries no meaning
    covariance = np.linalg.pinv(-hessian)[:-1, :-1]
    return Fit(names, point[:-1], float(tau), covariance, float(value), int(n_total), int(groups))


# --- results -----------------------------------------------------------------
def _odds_table(spark: SparkSession, names, beta, errors, digits: int | None = 2) -> DataFrame:
    table = spark.createDataFrame(
        [(n, float(b), float(e)) for n, b, e in zip(names, beta, errors)], "Variable string, beta double, se double")

    ratios = {"OddsRatio": "exp(beta)", "LL": "exp(beta - 1.96e0 * se)", "UL": "exp(beta + 1.96e0 * se)"}
    return table.selectExpr("Variable", *[
        f"{r} as {name}" if digits is None else f"bround({r}, {digits}) as {name}" for name, r in ratios.items()])


def odds_ratios(spark: SparkSession, fit: Fit, digits: int | None = 2) -> DataFrame:
    """Odds ratio and 95 % limits of every fixed effect."""
    return _odds_table(spark, fit.terms, fit.beta, np.sqrt(np.diag(fit.covariance)), digits)


def icc(fit: Fit, latent: bool = False) -> float:
    """Share of variance between procedures.

    The residual variance of a binomial model counts as 1; ``latent=True`` uses
    that of the logistic distribution instead.
    """
    between = fit.tau ** 2
    return between / (between + (math.pi ** 2 / 3 if latent else 1.0))


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) for a chi-square variable with a small whole number of degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return total


def compare_models(spark: SparkSession, small: Fit, large: Fit, names: tuple[str, str] = ("m_null", "m1")) -> DataFrame:
    """Likelihood-ratio test of two nested models, one row per model."""
    df = large.parameters - small.parameters
    chisq = 2 * (large.log_likelihood - small.log_likelihood)
    rows = []
    for name, fit, test in ((names[0], small, (None, None, None)), (names[1], large, (chisq, df, chi_square_tail(chisq, df)))):
        deviance = -2 * fit.log_likelihood
        rows.append((name, fit.parameters, deviance + 2 * fit.parameters,
                     deviance + math.log(fit.n_ratings) * fit.parameters, fit.log_likelihood, deviance, *test))
    return spark.createDataFrame(
        rows, "model string, npar int, AIC double, BIC double, log_lik double, deviance double, "
              "chisq double, df int, p_value double")


def prepare_counts(counts: DataFrame, rows_per_file: int = 1000, folder: str | None = None) -> DataFrame:
    """Write the cell counts once, for the many jobs of a fit; ``writers.remove`` deletes them after it.

    The table is tiny next to the ratings but every row costs a small
    optimisation, so it is spread over files by rows and not by bytes.
    """
    return materialize(counts, folder, rows_per_file)
