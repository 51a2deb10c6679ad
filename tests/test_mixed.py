"""The mixed logistic regression against a dense version of itself on planted data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import mixed

def terms():
    """Features of a row; twice follows from g."""
    return {"one": F.lit(1.0), "x": F.col("x"), "g": F.col("g"), "twice": 2 * F.col("g"), "both": F.col("x") * F.col("g")}


def planted(groups, years, beta, sd_group, sd_time, rho, seed):
    """Rows (pop, yr, x, g, yes) of a population model; some years are missing."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(groups):
        u, w = rng.normal(0, sd_group), rng.normal(0, sd_time)
        g = float(k % 2)
        for t in range(years):
            w = rho * w + rng.normal(0, sd_time * math.sqrt(1 - rho * rho)) if t else w
            x = rng.normal()
            eta = beta @ [1, x, g, x * g] + u + w
            if rng.random() < 0.9:
                rows.append((k, 2000 + t, float(x), g, bool(rng.random() < 1 / (1 + math.exp(-eta)))))
    return rows


def dense_loglik(rows, point):
    """Laplace's log-likelihood with one covariance matrix for all rows, and its mode by plain Newton steps."""
    beta, (a, b, c) = np.asarray(point[:-3]), point[-3:]
    pop, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x, g, y = (np.array([float(r[i]) for r in rows]) for i in (2, 3, 4))
    same = pop[:, None] == pop[None]
    rho = math.tanh(c)
    cov = same * (math.exp(2 * a) + math.exp(2 * b) * np.sign(rho) ** np.abs(t[:, None] - t[None]) * abs(rho) ** np.abs(t[:, None] - t[None]))
    fixed = np.column_stack([np.ones(len(x)), x, g, x * g]) @ beta
    z = np.zeros(len(y))
    for _ in range(40):
        mu = 1 / (1 + np.exp(-fixed - z))
        w = mu * (1 - mu)
        new = np.linalg.solve(np.eye(len(y)) + cov * w, cov @ (w * z + y - mu))
        done, z = np.abs(new - z).max() < 1e-10, new
        if done:
            break
    eta = fixed + z
    mu = 1 / (1 + np.exp(-eta))
    _, logdet = np.linalg.slogdet(np.eye(len(y)) + cov * (mu * (1 - mu))[None])
    return float((y * eta - np.log1p(np.exp(eta))).sum() - 0.5 * z @ (y - mu) - 0.5 * logdet)


@pytest.fixture(scope="module")
def data(spark):
    rows = planted(30, 6, np.array([0.2, 0.8, -0.5, 0.6]), 0.9, 0.8, 0.6, 1)
    return rows, spark.createDataFrame(rows, "pop int, yr int, x double, g double, yes boolean")


def test_fit_is_the_dense_maximum(spark, data):
    rows, df = data
    fit = mixed.mixed_logistic(df.repartition(5), ["pop"], "yr", terms(), F.col("yes"))
    assert fit.terms == ["one", "x", "g", "both"] and (fit.n_groups, fit.n_rows) == (30, len(rows))
    point = np.array([*fit.beta, math.log(fit.random["sd_group"]), math.log(fit.random["sd_time"]), math.atanh(fit.random["rho"])])
    best = dense_loglik(rows, point)
    assert fit.loglik == pytest.approx(best, abs=1e-6)
    at = lambda i, h: dense_loglik(rows, point + h * np.eye(len(point))[i])
    for i in range(len(point)):
        if -4.9 < point[i]:
            assert abs(at(i, 1e-4) - at(i, -1e-4)) / 2e-4 < 5e-3, i
    bend = np.array([[(dense_loglik(rows, point + e + f) - dense_loglik(rows, point + e - f) - dense_loglik(rows, point - e + f) + dense_loglik(rows, point - e - f)) / 4e-4 for f in 1e-2 * np.eye(len(point))] for e in 1e-2 * np.eye(len(point))])
    free = [i for i in range(len(point)) if i < 4 or fit.random["sd_time"] > 0.01 or i == 4]
    cov = np.linalg.inv(-bend[np.ix_(free, free)])[:4, :4]
    assert np.allclose(fit.cov, cov, rtol=0.05, atol=2e-3)


def test_planted_parameters_come_back(spark):
    rows = planted(300, 8, np.array([-0.3, 1.0, 0.4, -0.7]), 1.0, 0.0, 0.0, 2)
    df = spark.createDataFrame(rows, "pop int, yr int, x double, g double, yes boolean")
    fit = mixed.mixed_logistic(df, ["pop"], "yr", terms(), F.col("yes"))
    assert np.allclose(fit.beta, [-0.3, 1.0, 0.4, -0.7], atol=4 * np.sqrt(np.diag(fit.cov)).max())
    assert math.hypot(fit.random["sd_group"], fit.random["sd_time"]) == pytest.approx(1.0, abs=0.25)
    assert (np.sqrt(np.diag(fit.cov)) < 0.2).all()


def test_gradient_of_a_batch():
    rng = np.random.default_rng(3)
    mask = (rng.random((9, 6)) < 0.8).astype(float)
    t, x = np.tile(np.arange(6.0), (9, 1)), rng.normal(size=(9, 6, 2)) * mask[..., None]
    y = (rng.random((9, 6)) < 0.4) * mask
    for point in (np.array([0.3, -0.2, 0.1, -0.4, 0.6]), np.array([-1.0, 0.5, -2.0, 0.8, -0.9])):
        _, slope = mixed.laplace(t, y, x, mask, point)
        for i in range(5):
            e = 1e-5 * np.eye(5)[i]
            assert slope[i] == pytest.approx((mixed.laplace(t, y, x, mask, point + e)[0] - mixed.laplace(t, y, x, mask, point - e)[0]) / 2e-5, abs=1e-6)


def test_tests_do_not_depend_on_the_order_of_terms(spark, data):
    _, df = data
    turned = {k: terms()[k] for k in ("both", "g", "x", "one")}
    blocks, within = {"x": ["x"], "g": ["g"], "both": ["both"]}, {"x": ["both"], "g": ["both"]}
    found = []
    for some in (terms(), turned):
        fit = mixed.mixed_logistic(df, ["pop"], "yr", some, F.col("yes"))
        found.append(mixed.type2(fit, blocks, within))
    for a, b in zip(*found, strict=True):
        assert a[0] == b[0] and a[2] == b[2] == 1 and a[1] == pytest.approx(b[1], rel=1e-3, abs=1e-4)
    # Leaving out what contains a term is what its test compares with.
    fit = mixed.mixed_logistic(df, ["pop"], "yr", terms(), F.col("yes"))
    assert found[0][2][1] == pytest.approx(float(fit.beta[3] ** 2 / fit.cov[3, 3]), rel=1e-6)


def test_odd_rows(spark, data):
    _, df = data
    assert mixed.mixed_logistic(df.limit(0), ["pop"], "yr", terms(), F.col("yes")).terms == []
    holes = df.limit(200).unionByName(df.limit(5).withColumn("x", F.lit(None).cast("double"))).unionByName(df.limit(5).withColumn("yr", F.lit(None).cast("int")))
    a = mixed.mixed_logistic(df.limit(200), ["pop"], "yr", terms(), F.col("yes"))
    assert mixed.mixed_logistic(holes, ["pop"], "yr", terms(), F.col("yes")).loglik == pytest.approx(a.loglik, abs=1e-6)


def test_predictions(spark, data):
    _, df = data
    fit = mixed.mixed_logistic(df, ["pop"], "yr", terms(), F.col("yes"))
    for r in mixed.predicted(df.limit(40), fit, terms()).collect():
        f = np.array([1, r["x"], r["g"], r["x"] * r["g"]])
        eta, se = f @ fit.beta, math.sqrt(f @ fit.cov @ f)
        assert [r["fit"], r["lower"], r["upper"]] == pytest.approx([1 / (1 + math.exp(-v)) for v in (eta, eta - 1.96 * se, eta + 1.96 * se)])
