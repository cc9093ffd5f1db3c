"""Whitening against whole-number covariances computed the plain way."""

import math

import numpy as np
import pytest

from acuity.llm import whitening as W
from acuity.llm.queries import QUERIES, table

SCHEMA = "vec_id long, embedding array<double>, label int, component string, n string, whitened string"


def vectors(spark, *rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA)


def brute(rows):
    """n, x of every usable vector, covariance; all by Python numbers."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(v) for _, v in usable), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (size - len(v))]] for _, v in usable]
    n = len(x)
    sums = [sum(r[d] for r in x) for d in range(size)]
    off = [[n * r[d] - sums[d] for d in range(size)] for r in x]
    covariance = [[sum(o[a] * o[b] for o in off) / n ** 3 for b in range(size)] for a in range(size)] if n else []
    return n, [i for i, _ in usable], off, np.array(covariance)


def check(rows, got):
    n, ids, off, covariance = brute(rows)
    size = min(W.COMPONENTS, len(covariance))
    assert len(got) == n * size
    assert {r["n"] for r in got} <= {n}
    values = {}
    for r in got:
        values.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(values) == set(ids) and all(set(v) == set(range(1, size + 1)) for v in values.values())
    variances = np.linalg.eigvalsh(covariance)[::-1][:size]
    for i, o in zip(ids, off):
        assert int(values[i][1]["deviation"]) == sum(d * d for d in o)
    for k in range(1, size + 1):
        (share,) = {r["explained"] for r in got if r["component"] == k}
        assert share == pytest.approx(variances[k - 1] / np.trace(covariance), rel=1e-9)
    white = np.array([[values[i][k + 1]["whitened"] for k in range(size)] for i in ids])
    # the projection gives the covariance back: sum of whitened * x over the rows is an eigenvector times its deviation
    axes = (np.array(off, float) / n).T @ white / n / np.sqrt(variances)
    assert np.allclose(covariance @ axes, axes * variances, atol=1e-7 * variances[0])
    assert np.allclose(axes.T @ axes, np.eye(size), atol=1e-7)
    assert np.allclose((np.array(off, float) / n) @ axes / np.sqrt(variances), white, atol=1e-8)
    error = np.abs(white.T @ white / n - np.eye(size)).max()
    (stated,) = {r["identity_error"] for r in got}
    assert stated == pytest.approx(error, abs=1e-9) and error < 1e-8


def test_equals_plain_covariance(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=11) * np.arange(1, 12) / 3).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 9), (1002, [math.nan] * 11), (1003, [math.inf] * 11), (1004, [0.5, 0.5]), (1005, [])]
    check(rows, W.whiten(vectors(spark, *rows)).collect())


def test_cross_products_of_any_size():
    rng = np.random.default_rng(1)
    for low, high, shape in ((0, 1, (5, 3)), (-600, 700, (130, 4)), (-(1 << 40), 1 << 40, (70, 3)), (-(1 << 62), 1 << 62, (9, 3)), (7, 8, (64, 2))):
        x = rng.integers(low, high, shape)
        sums, products = W.cross_products(x)
        whole = x.astype(object)
        assert (sums == whole.sum(axis=0)).all() and (products == np.triu(whole.T @ whole)).all()
    for value in (0, 5, -5, 1 << 32, -(1 << 32), 1 << 90, -(1 << 90) - 7):
        assert sum(v << W.LIMB * place for place, v in W._limbs(value)) == value


def test_blocks_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(200)] + [(0, [0.1] * 5)] * 100
    one, many = W.fit(vectors(spark, *rows).repartition(1)), W.fit(vectors(spark, *rows).repartition(17), block=7)
    assert one.n == many.n and one.sums == many.sums and (one.components == many.components).all()


def test_equal_rows_nulls_and_huge_entries(spark):
    same = W.whiten(vectors(spark, (1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25]))).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in same] == [
        (k, 3, 0, None, 0.0, 0.0) for _ in range(3) for k in (1, 2)]
    line = W.whiten(vectors(spark, (1, [1.0, 2.0]), (2, [2.0, 4.0]))).collect()
    assert sorted((r["component"], r["vec_id"], r["whitened"] is None) for r in line) == [(1, 1, False), (1, 2, False), (2, 1, True), (2, 2, True)]
    assert {abs(round(r["whitened"], 9)) for r in line if r["component"] == 1} == {1.0}
    huge = W.whiten(vectors(spark, (1, [1e300, 0.0]), (2, [-1e300, 1.0]))).collect()
    assert {int(r["deviation"]) for r in huge} == {(1 << 126) + 1024 ** 2} and {abs(round(r["whitened"], 9)) for r in huge if r["component"] == 1} == {1.0}


def test_empty_table(spark):
    assert W.whiten(vectors(spark)).collect() == [] and W.whiten(vectors(spark, (1, None), (2, [math.nan]))).collect() == []
    assert W.whiten(vectors(spark, (1, []))).collect() == []


def test_query(spark):
    rows = table(spark, "/root/testdata/sf0.001", "embeddings").collect()
    found = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                  "explained": "double", "identity_error": "double"}
    check([(r["vec_id"], list(r["embedding"])) for r in rows], found.collect())
