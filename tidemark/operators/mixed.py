"""Mixed logistic regression: an intercept for every group and an autoregressive series over its times.

The log-odds of row i of group g are x_i' beta + u_g + w_g(t_i), with u_g ~ N(0, sd_group^2) and w_g a stationary AR1 series
of deviation sd_time and correlation rho over the levels of time.  The random part is integrated out by Laplace's
approximation, group by group; beta and the three parameters maximise the sum.

A group is one row of a staged table (its rows are bounded by its times).  Each pass over that table finds the modes of
the groups' latent series at several points of the parameter space and returns the sums of their log-likelihoods and of
their exact gradients, so that only numbers of the size of the parameters squared reach the driver.  Differences of gradients give
the Hessian, for Newton's steps and for the covariance.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import ship, staged
from .models import chi2_tail

#: log sd_group, log sd_time, atanh rho: where the search begins, and its bounds.
RANDOM = ("sd_group", "sd_time", "rho")
START, LOW, HIGH = (-0.5, -0.5, 0.3), (-5.0, -5.0, -2.5), (3.0, 3.0, 2.5)
#: Groups that are solved together.
TOGETHER = 512


def packed(df: DataFrame, keys: Sequence[str], time: str, features: Mapping[str, Column], yes: Column) -> DataFrame:
    """One row per group: t (levels of time, from 0), y and x (row by row) as arrays; rows with a missing value are left out."""
    rows = df.select(*keys, F.col(time).alias("_time"), yes.cast("double").alias("_y"), F.array(*[f.cast("double") for f in features.values()]).alias("_x"))
    rows = rows.where(F.col("_time").isNotNull() & F.col("_y").isNotNull() & F.forall("_x", lambda v: v.isNotNull()))
    levels = rows.select("_time").distinct().withColumn("_t", (F.row_number().over(Window.orderBy("_time")) - 1).cast("double"))  # one row a year
    groups = rows.join(levels, "_time").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_t", "_y", "_x"))).alias("r"))
    return groups.select(F.col("r._t").alias("t"), F.col("r._y").alias("y"), F.flatten(F.col("r._x")).alias("x"))


def padded(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """t, y, x and mask of the groups of a batch, each group filled up to the longest."""
    sizes = np.array([len(v) for v in batch.column("y")], np.int64)
    shape = (len(sizes), int(sizes.max(initial=0)))
    row, k = np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    t, y, x, mask = np.zeros(shape), np.zeros(shape), np.zeros((*shape, p)), np.zeros(shape)
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
    t[row, k], y[row, k], x[row, k], mask[row, k] = flat("t"), flat("y"), flat("x").reshape(-1, p), 1.0
    return t, y, x, mask


def laplace(t: np.ndarray, y: np.ndarray, x: np.ndarray, mask: np.ndarray, point: np.ndarray, steps: int = 60) -> tuple[float, np.ndarray]:
    """The sums over groups of Laplace's log-likelihood and of its gradient at (beta, log sd_group, log sd_time, atanh rho)."""
    p = x.shape[2]
    beta, (a, b, c) = point[:p], point[p:]
    rho, both = math.tanh(c), mask[:, :, None] * mask[:, None, :]
    lag = np.abs(t[:, :, None] - t[:, None, :])
    decay = np.where(lag % 2 == 0, 1.0, math.copysign(1.0, rho)) * np.abs(rho) ** lag
    steeper = np.where(lag % 2 == 1, 1.0, math.copysign(1.0, rho)) * lag * np.abs(rho) ** np.maximum(lag - 1, 0)
    group, series = math.exp(2 * a) * both, math.exp(2 * b) * decay * both
    cov = group + series
    slopes = (2 * group, 2 * series, math.exp(2 * b) * (1 - rho * rho) * steeper * both)

    fixed, own = x @ beta, np.eye(t.shape[1])[None]
    weight = np.zeros_like(y)  # the latent series is cov @ weight

    def objective(w):
        z = np.einsum("gij,gj->gi", cov, w)
        eta = fixed + z
        return (mask * (y * eta - np.logaddexp(0, eta))).sum(1) - 0.5 * (w * z).sum(1), z, eta

    value, z, eta = objective(weight)
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-eta))
        info = mask * mu * (1 - mu)
        root = np.sqrt(info)
        target = info * z + mask * (y - mu)
        solved = np.linalg.solve(own + root[:, :, None] * cov * root[:, None, :], (root * np.einsum("gij,gj->gi", cov, target))[:, :, None])[:, :, 0]
        move, size = target - root * solved - weight, np.ones(len(y))
        for _ in range(12):
            new, z_new, eta_new = objective(weight + size[:, None] * move)
            worse = new < value - 1e-9 * (1 + np.abs(value))
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        weight = weight + size[:, None] * move
        moved = float(np.abs(z_new - z).max(initial=0))
        value, z, eta = new, z_new, eta_new
        if moved < 1e-9:
            break
    mu = 1 / (1 + np.exp(-eta))
    rest, info = mask * (y - mu), mask * mu * (1 - mu)
    root = np.sqrt(info)
    inner = own + root[:, :, None] * cov * root[:, None, :]
    half = np.linalg.solve(inner, root[:, :, None] * cov)
    left = cov - np.einsum("gij,gjk->gik", cov * root[:, None, :], half)  # covariance of the latent series given the data
    total = float(value.sum() - 0.5 * np.linalg.slogdet(inner)[1].sum())
    bend = np.einsum("gii->gi", left) * info * (1 - 2 * mu)
    through = bend - info * np.einsum("gij,gj->gi", left, bend)
    out = [np.einsum("gij,gi->j", x, rest - 0.5 * through)]
    shrunk = info[:, :, None] * own - info[:, :, None] * left * info[:, None, :]
    for slope in slopes:
        q = np.einsum("gij,gj->gi", slope, rest)
        out.append(np.array([0.5 * (rest * q).sum() - 0.5 * (shrunk * slope).sum() - 0.5 * (through * q).sum()]))
    return total, np.concatenate(out)


def summed(groups: DataFrame, p: int, points: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Log-likelihood and gradient over all groups at each point, in one pass."""
    ship(groups.sparkSession)
    wanted = [np.asarray(x, float) for x in points]

    def partial(batches):
        sums = np.zeros((len(wanted), len(wanted[0]) + 1))
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = padded(batch.slice(i, TOGETHER), p)
                for k, point in enumerate(wanted):
                    value, slope = laplace(*some, point)
                    sums[k] += np.concatenate([[value], slope])
        index, place = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(index.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(sums.ravel())], names=["point", "place", "v"])

    out = np.zeros((len(wanted), len(wanted[0]) + 1))
    for r in groups.mapInArrow(partial, "point int, place int, v double").groupBy("point", "place").agg(F.sum("v").alias("v")).collect():
        out[r["point"], r["place"]] = r["v"]
    return [(float(row[0]), row[1:]) for row in out]


@dataclass
class MixedFit:
    """``terms`` that could be told apart, their estimates and covariance, the random part, log-likelihood and numbers of groups and rows."""

    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    random: dict[str, float]
    loglik: float
    n_groups: int
    n_rows: int

    @property
    def parameters(self) -> int:
        return len(self.terms) + len(RANDOM)

    def wald(self, terms: Sequence[str]) -> float:
        """The Wald statistic of some terms being 0 together."""
        at = [self.terms.index(t) for t in terms if t in self.terms]
        return float(self.beta[at] @ np.linalg.solve(self.cov[np.ix_(at, at)], self.beta[at])) if at else 0.0


def independent(groups: DataFrame, names: Sequence[str]) -> tuple[list[int], int, int]:
    """The features that don't follow from those before them; numbers of groups and rows."""
    p = len(names)
    ship(groups.sparkSession)

    def products(batches):
        total = np.zeros(p * p + 2)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            total += np.concatenate([(x.T @ x).ravel(), [batch.num_rows, len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p + 2), pa.int32()), pa.array(total)], names=["place", "v"])

    total = np.zeros(p * p + 2)
    for r in groups.mapInArrow(products, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        total[r["place"]] = r["v"]
    gram = total[: p * p].reshape(p, p)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    used: list[int] = []
    for c in range(p):
        tried = [*used, c]
        if gram[c, c] > 0 and np.linalg.matrix_rank((gram / scale / scale[:, None])[np.ix_(tried, tried)], tol=1e-8, hermitian=True) > len(used):
            used = tried
    return used, int(total[-2]), int(total[-1])


def mixed_logistic(df: DataFrame, keys: Sequence[str], time: str, features: Mapping[str, Column], yes: Column, steps: int = 40) -> MixedFit:
    """Fits the model to all rows; a feature that follows from those before it is left out.  Without rows there are no terms.

    A deviation that runs into its lower bound counts as nought, and is held there for the covariance.
    """
    names = list(features)
    groups = staged(packed(df, keys, time, features, yes))
    used, n_groups, n_rows = independent(groups, names)
    names = [names[i] for i in used]
    p = len(names)
    if not n_rows or not p:
        return MixedFit([], np.zeros(0), np.zeros((0, 0)), dict.fromkeys(RANDOM, math.nan), 0.0, 0, 0)
    if len(used) < len(features):
        picked = lambda i, of: F.array(*[F.get("x", (i * len(features) + c).cast("int")) for c in of])
        groups = staged(groups.withColumn("x", F.flatten(F.transform(F.sequence(F.lit(0), F.size("y") - 1), lambda i: picked(i, used)))))
    low, high = np.array([*[-50.0] * p, *LOW]), np.array([*[50.0] * p, *HIGH])
    point = np.array([*[0.0] * p, *START])
    width = np.array([*[1e-4] * p, *[1e-3] * len(RANDOM)])

    def around(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and Hessian at a point, in one pass."""
        shifts = np.diag(width)
        sums = summed(groups, p, [at, *(at + shifts), *(at - shifts)])
        n = len(at)
        bend = np.array([(sums[1 + i][1] - sums[1 + n + i][1]) / (2 * width[i]) for i in range(n)])
        return sums[0][0], sums[0][1], (bend + bend.T) / 2

    for _ in range(steps):
        value, slope, bend = around(point)
        free = ~((point <= low + 1e-9) & (slope < 0) | (point >= high - 1e-9) & (slope > 0))
        roots, axes = np.linalg.eigh(-bend[np.ix_(free, free)])
        floor = max(1e-6 * np.abs(roots).max(), 1e-8)
        move = np.zeros(len(point))
        move[free] = axes @ ((axes.T @ slope[free]) / np.maximum(np.abs(roots), floor))
        move *= min(1.0, 2.0 / max(np.abs(move[p:]).max(), 1e-12))
        if float(slope[free] @ move[free]) < 1e-7:
            break
        tried = [np.clip(point + move / 3**k, low, high) for k in range(6)]
        values = [v for v, _ in summed(groups, p, tried)]
        best = int(np.argmax(values))
        if values[best] <= value:
            break
        point = tried[best]
    # What no data speak to (a deviation at its bound, the correlation of a series that is nought) is held for the covariance.
    held = point <= low + 1e-6
    if held[p + 1]:
        held[p + 2] = True
    free = np.flatnonzero(~held)
    cov = np.linalg.pinv(-bend[np.ix_(free, free)], hermitian=True)[:p, :p]
    random = {"sd_group": math.exp(point[p]), "sd_time": math.exp(point[p + 1]), "rho": math.tanh(point[p + 2])}
    return MixedFit(names, point[:p], cov, random, value, n_groups, n_rows)


def type2(fit: MixedFit, blocks: Mapping[str, Sequence[str]], within: Mapping[str, Sequence[str]]) -> list[tuple[str, float, int, float]]:
    """Wald tests of blocks of terms: (block, chi2, degrees of freedom, P), each after all blocks that don't contain it.

    ``within`` names for each block those that contain it (interactions).  The order of blocks or terms doesn't matter.
    """
    out = []
    for name, terms in blocks.items():
        above = [t for other in within.get(name, ()) for t in blocks[other]]
        df = sum(t in fit.terms for t in terms)
        chi2 = max(0.0, fit.wald([*terms, *above]) - fit.wald(above))
        out.append((name, chi2, df, chi2_tail(chi2, df) if df else 1.0))
    return out


def predicted(points: DataFrame, fit: MixedFit, features: Mapping[str, Column], z: float = 1.96) -> DataFrame:
    """Adds fit, lower and upper: the probability where the random part is nought, with its interval on the log-odds scale."""
    columns = [F.col(f"_f{i}") for i in range(len(fit.terms))]
    rows = points.withColumns({f"_f{i}": features[t].cast("double") for i, t in enumerate(fit.terms)})
    eta, var = F.lit(0.0), F.lit(0.0)
    for i, a in enumerate(columns):
        eta = eta + a * float(fit.beta[i])
        of = F.lit(0.0)
        for j, b in enumerate(columns):
            of = of + b * float(fit.cov[i, j])
        var = var + a * of
    curve = lambda v: 1 / (1 + F.exp(-v))
    rows = rows.withColumns({"_eta": eta, "_se": F.sqrt(F.greatest(var, F.lit(0.0)))})
    out = rows.withColumns({"fit": curve(F.col("_eta")), "lower": curve(F.col("_eta") - z * F.col("_se")), "upper": curve(F.col("_eta") + z * F.col("_se"))})
    return out.drop("_eta", "_se", *[f"_f{i}" for i in range(len(fit.terms))])
