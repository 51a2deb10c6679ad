"""Models without a closed form, fitted group by group with NumPy inside the tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import ship, staged

GOLDEN = (math.sqrt(5) - 1) / 2


def minimum(f, lo: float, hi: float, steps: int = 60) -> float:
    """Golden-section search."""
    a, b = lo, hi
    c, d = b - GOLDEN * (b - a), a + GOLDEN * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - GOLDEN * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + GOLDEN * (b - a)
            fd = f(d)
    return (a + b) / 2


#: Places along its range at which a profile is looked at once its first search is done.
PLACES = 41


def profiled(f, lo: float, hi: float) -> tuple[float, str | None]:
    """The least place of a profile of one parameter, and a warning where it stays in doubt.

    First rung: golden section over the whole range.  Where a place elsewhere is lower, the search goes on beside the lowest one,
    and the lower result stays.  A place at the end of the range or one without curvature is returned with its reason.
    """
    wide = hi - lo
    best = minimum(f, lo, hi)
    value, step = f(best), wide / (PLACES - 1)
    seen = [f(lo + i * step) for i in range(PLACES)]
    i = min(range(PLACES), key=seen.__getitem__)
    if seen[i] < value - 1e-6:
        again = minimum(f, lo + max(i - 1, 0) * step, lo + min(i + 1, PLACES - 1) * step)
        best = min((again, lo + i * step, best), key=f)
    if min(best - lo, hi - best) < 1e-3 * wide:
        return best, "correlation at the end of its range"
    h = min(1e-2 * wide, (best - lo) / 2, (hi - best) / 2)
    bend = (f(best + h) - 2 * f(best) + f(best - h)) / (h * h)
    return best, None if bend > 1e-6 else "non-positive-definite Hessian matrix"


def correlated(x: np.ndarray, y: np.ndarray, times: np.ndarray, kind: str) -> dict:
    """Maximum likelihood of y ~ x with residual correlation ``none``, ``ar1`` or ``ou``.

    The correlation of two times is rho^|i - j| over places (ar1) or exp(-theta |t - s|) (ou); its
    parameter is profiled out, with the retries of ``profiled``, and counts as a parameter of AIC.
    """
    n, design = len(y), np.column_stack([np.ones(len(x)), x - x.mean()])
    gap = np.abs(times[:, None] - times[None]) if kind == "ou" else np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)

    def fit(p: float):
        corr = np.eye(n) if kind == "none" else np.exp(-math.exp(p) * gap) if kind == "ou" else np.where(gap == 0, 1.0, np.sign(p) ** gap * np.abs(p) ** gap)
        root = np.linalg.cholesky(corr + 1e-10 * np.eye(n))
        a, b = np.linalg.solve(root, design), np.linalg.solve(root, y)
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        var = max(float(((b - a @ beta) ** 2).mean()), 1e-300)
        loglik = -0.5 * n * (math.log(2 * math.pi * var) + 1) - float(np.log(np.diag(root)).sum())
        return beta, var * np.linalg.inv(a.T @ a), loglik

    p, warning = (0.0, None) if kind == "none" else profiled(lambda q: -fit(q)[2], *((-6.0, 4.0) if kind == "ou" else (-0.95, 0.95)))
    beta, cov, loglik = fit(p)
    se = math.sqrt(cov[1, 1])
    return {"estimate": float(beta[1]), "se": se, "p_value": math.erfc(abs(beta[1] / se) / math.sqrt(2)) if se > 0 else None, "aic": 2 * (4 + (kind != "none")) - 2 * loglik, "warning": warning}


def negative_binomial(x: np.ndarray, y: np.ndarray) -> dict:
    """y ~ x with log link and variance mu + mu^2 / k; k by golden section, coefficients by scoring."""
    design = np.column_stack([np.ones(len(x)), x - x.mean()])

    def fit(log_k: float):
        k, beta = math.exp(log_k), np.array([math.log(max(y.mean(), 1e-9)), 0.0])
        for _ in range(50):
            mu = np.exp(np.clip(design @ beta, -30, 30))
            w = mu / (1 + mu / k)
            step = np.linalg.solve(design.T @ (design * w[:, None]) + 1e-12 * np.eye(2), design.T @ ((y - mu) / (1 + mu / k)))
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-10:
                break
        mu = np.exp(np.clip(design @ beta, -30, 30))
        gamma = np.array([math.lgamma(v + k) - math.lgamma(k) - math.lgamma(v + 1) for v in y])
        loglik = float((gamma + k * np.log(k / (k + mu)) + y * np.log(mu / (k + mu))).sum())
        return beta, np.linalg.inv(design.T @ (design * (mu / (1 + mu / k))[:, None])), loglik

    beta, cov, loglik = fit(minimum(lambda q: -fit(q)[2], -5.0, 10.0, 40))
    se = math.sqrt(cov[1, 1])
    return {"estimate": float(beta[1]), "se": se, "p_value": math.erfc(abs(beta[1] / se) / math.sqrt(2)), "aic": 8 - 2 * loglik}


#: Iterations of a first fit and of the last one.
FIRST_STEPS, LAST_STEPS = 100, 1000


def slope_of(f, x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    return np.array([(f(x + e) - f(x - e)) / (2 * h) for e in h * np.eye(len(x))])


def quasi_newton(f, start: np.ndarray, steps: int) -> tuple[np.ndarray, float, str | None]:
    """Minimises f by BFGS with differences for gradients: place, value, and a reason where it did not converge."""
    x, value, slope, inverse = start.copy(), f(start), slope_of(f, start), np.eye(len(start))
    for _ in range(steps):
        if np.abs(slope).max() < 1e-4:
            return x, value, None
        move = -inverse @ slope
        if move @ slope >= 0:
            inverse, move = np.eye(len(x)), -slope
        move *= min(1.0, 2.0 / np.abs(move).max())
        size = 1.0
        while (new := f(x + size * move)) > value + 1e-4 * size * (move @ slope) or not math.isfinite(new):
            size /= 2
            if size < 1e-9:
                return x, value, None if np.abs(slope).max() < 1e-2 else "false convergence"
        step, x = size * move, x + size * move
        turned = slope_of(f, x)
        change, slope, value = turned - slope, turned, new
        if step @ change > 1e-12:
            r = 1 / (step @ change)
            left = np.eye(len(x)) - r * np.outer(step, change)
            inverse = left @ inverse @ left.T + r * np.outer(step, step)
    return x, value, "iteration limit reached without convergence"


def ladder(f, starts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None, float, str | None]:
    """The minimum of f with its covariance, tried again where the fit is in doubt: place, covariance, value, warning.

    First rung: a fit from the first start.  If it did not converge or its Hessian is not positive definite, the other starts
    follow and the best of all stays.  If the iterations did not suffice, it goes on for up to LAST_STEPS.  What is still in
    doubt after that is returned with the reason as a warning, and without a covariance where there is none.
    """

    def judged(start: np.ndarray, steps: int):
        x, value, reason = quasi_newton(f, start, steps)
        bend = np.array([(slope_of(f, x + e) - slope_of(f, x - e)) / 2e-3 for e in 1e-3 * np.eye(len(x))])
        bend = (bend + bend.T) / 2
        if not np.isfinite(bend).all() or np.linalg.eigvalsh(bend).min() <= 1e-6:
            return x, None, value, reason or "non-positive-definite Hessian matrix"
        return x, np.linalg.inv(bend), value, reason

    best = judged(starts[0], FIRST_STEPS)
    for other in starts[1:] if best[3] else ():
        tried = judged(other, FIRST_STEPS)
        if tried[2] < best[2] - 1e-6 or tried[3] is None and tried[2] < best[2] + 1e-6:
            best = tried
    if best[3] and "limit" in best[3]:
        best = judged(best[0], LAST_STEPS)
    return best


def latent_negative_binomial(x: np.ndarray, y: np.ndarray, times: np.ndarray, kind: str) -> dict:
    """y ~ x with log link, variance mu + mu^2 / k and a latent series with OU or AR1 correlation on the log scale.

    The series is integrated out by Laplace's approximation; coefficients, its deviation and correlation and k maximise the result.
    """
    n, design = len(y), np.column_stack([np.ones(len(x)), x - x.mean()])
    gap = np.abs(times[:, None] - times[None]) if kind == "ou" else np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)
    constant = -float(sum(math.lgamma(v + 1) for v in y))
    warm = [np.zeros(n)]

    def negative_loglik(p: np.ndarray) -> float:
        beta, k = p[:2], math.exp(min(max(p[4], -6.0), 12.0))
        c = min(max(p[3], -6.0), 6.0)
        corr = np.exp(-math.exp(c) * gap) if kind == "ou" else np.where(gap % 2 == 1, math.copysign(1.0, c), 1.0) * abs(math.tanh(c)) ** gap
        cov = math.exp(2 * min(max(p[2], -6.0), 4.0)) * corr
        fixed = np.clip(design @ beta, -30, 30)
        gammas = float(sum(math.lgamma(v + k) for v in y)) - n * math.lgamma(k) + constant

        def at(w):
            z = cov @ w
            eta = np.clip(fixed + z, -40, 40)
            mu = np.exp(eta)
            return float((y * eta - (y + k) * np.log(k + mu)).sum()) + n * k * math.log(k) - 0.5 * float(w @ z), z, mu

        w = warm[0]
        value, z, mu = at(w)
        for _ in range(50):
            info, rest = mu * k * (k + y) / (k + mu) ** 2, (y - mu) * k / (k + mu)
            new = np.linalg.solve(np.eye(n) + info[:, None] * cov, info * z + rest)
            size, tried = 1.0, at(new)
            while tried[0] < value - 1e-9 * abs(value) and size > 1e-4:
                size /= 2
                tried = at(w + size * (new - w))
            moved = float(np.abs(tried[1] - z).max())
            w = w + size * (new - w)
            value, z, mu = tried
            if moved < 1e-9:
                break
        warm[0] = w
        info = mu * k * (k + y) / (k + mu) ** 2
        return -(value + gammas - 0.5 * float(np.linalg.slogdet(np.eye(n) + info[:, None] * cov)[1]))

    level, spread = math.log(max(float(y.mean()), 1e-3)), 0.5
    starts = [np.array([level, 0.0, math.log(s), c, math.log(k)]) for s, c, k in ((spread, 0.0, 5.0), (0.2, 0.5, 50.0), (1.0, -0.5, 1.0))]
    place, cov, value, warning = ladder(negative_loglik, starts)
    se = math.sqrt(cov[1, 1]) if cov is not None and cov[1, 1] > 0 else None
    p = math.erfc(abs(place[1] / se) / math.sqrt(2)) if se else None
    return {"estimate": float(place[1]), "se": se, "p_value": p, "aic": 10 + 2 * value, "warning": warning}


def fitted(df: DataFrame, keys: Sequence[str], specs: DataFrame, x: str = "yr", y: str = "y", t: str = "t_coord", least: int = 4) -> DataFrame:
    """Every model of the grid (spec, autocor, trans, family) for every group.

    One row each: estimate, se, p_value, aic.  Where a fit failed there is a warning instead of them; where it is in doubt even after the
    retries of ``ladder`` or ``profiled``, a warning beside them.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", spec string, n bigint, estimate double, se double, p_value double, aic double, warning string"
    grid = specs.select("spec", "autocor", "trans", "family")

    ship(df.sparkSession)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        row, s = pdf.iloc[0], pdf.sort_values(x)
        out = {**{k: row[k] for k in keys}, "spec": row.spec, "n": len(s), "estimate": None, "se": None, "p_value": None, "aic": None, "warning": None}
        try:
            a, b = s[x].to_numpy(float), s[y].to_numpy(float)
            if row.trans == "Standardize":
                a = (a - a.mean()) / a.std(ddof=1)
                b = (b - b.mean()) / b.std(ddof=1) if row.family == "gaussian" else b
            if row.family == "nbinom2" and row.autocor != "no_autocor":
                out.update(latent_negative_binomial(a, np.round(b), s[t].to_numpy(float), row.autocor))
            elif row.family == "nbinom2":
                out.update(negative_binomial(a, np.round(b)))
            else:
                kind = {"no_autocor": "none"}.get(row.autocor, row.autocor)
                out.update(correlated(a, np.log(b) if row.family == "lognormal" else b, s[t].to_numpy(float), kind))
                if row.family == "lognormal":
                    out["aic"] += 2 * float(np.log(b).sum())
            if not out["warning"] and not all(v is not None and math.isfinite(v) for v in (out["estimate"], out["se"], out["aic"])):
                raise ArithmeticError("not finite")
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
            out.update(estimate=None, se=None, p_value=None, aic=None, warning=str(e) or type(e).__name__)
        return pd.DataFrame([out])

    known = df.select(*keys, x, y, t).where(F.col(y).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least)
    return known.crossJoin(F.broadcast(grid)).groupBy(*keys, "spec").applyInPandas(fit, schema)


def logistic_sums(df: DataFrame, features: Sequence[Column], yes: Column, steps: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression over all rows: coefficients, covariance and log-likelihood.

    Each step of the scoring sums the gradient and the information in one aggregate, so only
    that small matrix reaches the driver, whatever the number of rows.
    """
    k = len(features)
    rows = staged(df.select(*[f.cast("double").alias(f"x{i}") for i, f in enumerate(features)], yes.cast("double").alias("y")).dropna())
    beta = np.zeros(k)
    for _ in range(steps):
        eta = F.lit(0.0)
        for i, b in enumerate(beta):
            eta = eta + F.col(f"x{i}") * float(b)
        p = 1 / (1 + F.exp(-eta))
        w = p * (1 - p)
        aggs = [F.sum(F.col(f"x{i}") * (F.col("y") - p)).alias(f"g{i}") for i in range(k)]
        aggs += [F.sum(F.col(f"x{i}") * F.col(f"x{j}") * w).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        aggs += [F.sum(F.col("y") * eta - F.log1p(F.exp(eta))).alias("ll")]
        s = rows.agg(*aggs).first()
        info = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.solve(info + 1e-10 * np.eye(k), np.array([s[f"g{i}"] for i in range(k)]))
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta, np.linalg.inv(info + 1e-10 * np.eye(k)), float(s["ll"])


def logistic_curve(df: DataFrame, x: str, terms, beta: np.ndarray, cov: np.ndarray, points: int = 80, z: float = 1.959963984540054) -> DataFrame:
    """Predictions at evenly spaced points between the least and the largest x, with delta-method intervals.

    ``terms`` gives the features of x.  The interval is that of the linear predictor, eta +- z * sqrt(f' cov f), turned
    into probabilities.  Returns x, p, se (of p), lower, upper.
    """
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = ends.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi").select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)).alias(x))
    f = [t.cast("double") for t in terms(F.col(x))]
    eta, var = F.lit(0.0), F.lit(0.0)
    for i, a in enumerate(f):
        eta = eta + a * float(beta[i])
        for j, b in enumerate(f):
            var = var + a * b * float(cov[i, j])
    curve = lambda v: 1 / (1 + F.exp(-v))
    rows = at.select(x, eta.alias("_eta"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("_se"))
    p = curve(F.col("_eta"))
    return rows.select(x, p.alias("p"), (p * (1 - p) * F.col("_se")).alias("se"), curve(F.col("_eta") - z * F.col("_se")).alias("lower"), curve(F.col("_eta") + z * F.col("_se")).alias("upper"))


def multinomial_deviance(rows: DataFrame, label: str, features: Sequence[str]) -> float:
    """-2 log-likelihood of a multinomial logit of the label on the features, fitted by Spark's own optimiser."""
    if not features:
        n = rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))  # one row a class
        return float(-2 * n.agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("all"))).alias("ll")).first()["ll"])
    made = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows)
    model = LogisticRegression(family="multinomial", featuresCol="_features", labelCol=label, probabilityCol="_p", maxIter=200, tol=1e-10).fit(made)
    own = F.get(vector_to_array(F.col("_p")), F.col(label).cast("int"))
    return float(-2 * model.transform(made).agg(F.sum(F.log(own)).alias("ll")).first()["ll"])


def multinomial(rows: DataFrame, label: str, features: Sequence[str]) -> tuple[list[tuple[int, str, float, float | None, float | None]], DataFrame]:
    """A multinomial logit of the label (0, 1, ...) on the features: its terms, and the probabilities of every distinct row of features.

    Terms are (class, term, estimate, se, p) of each class against the least one that occurs; standard errors come from the information
    matrix, summed over all rows in one aggregate.  Probabilities are rows of the features with label and p.
    """
    classes = sorted(int(r[0]) for r in rows.select(label).distinct().collect())  # one row a class
    made = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows)
    model = LogisticRegression(family="multinomial", featuresCol="_features", labelCol=label, probabilityCol="_p", maxIter=200, tol=1e-10).fit(made)
    beta = np.column_stack([model.interceptVector.toArray(), model.coefficientMatrix.toArray()])
    x, names = [F.lit(1.0), *(F.col(f) for f in features)], ["intercept", *features]
    p = vector_to_array(F.col("_p"))
    own = [(k, i) for k in classes[1:] for i in range(len(x))]
    upper = [(a, b) for a in range(len(own)) for b in range(a, len(own))]
    cell = lambda a, b: F.sum(p[own[a][0]] * (float(own[a][0] == own[b][0]) - p[own[b][0]]) * x[own[a][1]] * x[own[b][1]])
    info = np.zeros((len(own), len(own)))
    if own:
        for (a, b), v in zip(upper, model.transform(made).agg(*[cell(a, b).alias(f"_{a}_{b}") for a, b in upper]).first(), strict=True):
            info[a, b] = info[b, a] = v
    known = len(own) > 0 and np.linalg.eigvalsh(info).min() > 1e-9
    se = np.sqrt(np.diag(np.linalg.inv(info))) if known else [None] * len(own)
    terms = []
    for (k, i), s in zip(own, se, strict=True):
        b = float(beta[k, i] - beta[classes[0], i])
        terms.append((k, names[i], b, None if s is None else float(s), None if s is None else math.erfc(abs(b / float(s)) / math.sqrt(2))))
    seen = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows.select(*features).distinct())
    shares = model.transform(seen).select(*features, F.posexplode(p).alias("label", "p"))
    return terms, shares


def type3(rows: DataFrame, label: str, features: Sequence[str]) -> list[tuple[str, float, int, float]]:
    """Type-3 tests of a multinomial logit: (term, chi2, df, p) of leaving out each term alone."""
    classes = rows.select(label).distinct().count()
    full = multinomial_deviance(rows, label, features)
    out = []
    for f in features:
        chi2 = max(0.0, multinomial_deviance(rows, label, [g for g in features if g != f]) - full)
        out.append((f, chi2, classes - 1, chi2_tail(chi2, classes - 1)))
    return out


def chi2_tail(x: float, k: int) -> float:
    """P(chi2_k > x), by the series of the incomplete gamma function or its continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def rank_sums(df: DataFrame, keys: Sequence[str], arm: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Wilcoxon's rank sum with mid-ranks and Welch's t of two arms: n, medians, u, z (ties corrected), t, df."""
    rows = df.where(F.col(arm).isin(*names) & F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(*[F.count_if(F.col(arm) == a).alias(f"_{i}") for i, a in enumerate(names)])
    t = F.col("_0") + F.col("_1")
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_rank", F.coalesce(F.sum(t).over(w), F.lit(0)) + (t + 1) / 2)
    ranks = ranked.groupBy(*keys).agg(F.sum(F.col("_0") * F.col("_rank")).alias("_r"), F.sum("_0").alias("n0"), F.sum("_1").alias("n1"), F.sum(t * t * t - t).alias("_ties"))
    n0, n1 = F.col("n0"), F.col("n1")
    n, u = n0 + n1, F.col("_r") - n0 * (n0 + 1) / 2
    var = n0 * n1 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1)))
    ranks = ranks.select(*keys, "n0", "n1", u.alias("u"), ((u - n0 * n1 / 2) / F.nullif(F.sqrt(var), F.lit(0.0))).alias("z"))
    own = lambda i: F.when(F.col(arm) == names[i], F.col(value))
    m = rows.groupBy(*keys).agg(*[f(own(i)).alias(f"_{k}{i}") for i in (0, 1) for k, f in (("m", F.avg), ("v", F.var_samp), ("c", F.count), ("med", F.median))])
    e0, e1 = F.col("_v0") / F.col("_c0"), F.col("_v1") / F.col("_c1")
    welch = m.select(*keys, F.col("_med0").alias("median0"), F.col("_med1").alias("median1"), ((F.col("_m0") - F.col("_m1")) / F.sqrt(e0 + e1)).alias("t"), (F.pow(e0 + e1, 2) / (e0 * e0 / (F.col("_c0") - 1) + e1 * e1 / (F.col("_c1") - 1))).alias("df"))
    return ranks.join(welch, list(keys))
