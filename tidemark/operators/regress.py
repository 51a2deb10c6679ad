"""Least-squares trends and contrasts of populations, in closed form.

``y ~ x`` in two arms is two regressions with a common residual variance, which is its maximum
likelihood estimate RSS / n.  Tests compare |z| with a fixed point, so no distribution function
is needed.  The group-level variance of a model with one group is taken as 0: AIC counts it as
a parameter and is always finite.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates of a regression of y on x over rows where both are there."""
    return {"n": F.regr_count(y, x), "mx": F.regr_avgx(y, x), "my": F.regr_avgy(y, x), "sxx": F.regr_sxx(y, x), "sxy": F.regr_sxy(y, x), "syy": F.regr_syy(y, x)}


def trends(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Per group: n, slope, intercept, the slope's standard error (n - 2 degrees of freedom), R2."""
    m = moments(F.col(x).cast("double"), F.col(y).cast("double"))
    out = df.groupBy(*keys).agg(*[c.alias(k) for k, c in m.items()]).where((F.col("n") >= least) & (F.col("sxx") > 0))
    slope, rss = F.col("sxy") / F.col("sxx"), F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    return out.select(
        *keys, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.when(F.col("n") > 2, F.sqrt(rss / (F.col("n") - 2) / F.col("sxx"))).alias("se"),
        F.when(F.col("syy") > 0, 1 - rss / F.col("syy")).alias("r2"),
    )


def ml_trends(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Maximum likelihood trends: slope, se, z, intercept, its se and z, and AIC with four parameters."""
    m = moments(F.col(x).cast("double"), F.col(y).cast("double"))
    s = df.groupBy(*keys).agg(*[c.alias(k) for k, c in m.items()]).where((F.col("n") >= least) & (F.col("sxx") > 0))
    slope = F.col("sxy") / F.col("sxx")
    s = s.withColumns({"slope": slope, "intercept": F.col("my") - slope * F.col("mx"), "var": F.greatest(F.col("syy") - F.col("sxy") * slope, F.lit(0.0)) / F.col("n")})
    s = s.withColumns({"se": F.sqrt(F.col("var") / F.col("sxx")), "intercept_se": F.sqrt(F.col("var") * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx")))})
    z = {"z": F.col("slope") / F.nullif("se", F.lit(0.0)), "intercept_z": F.col("intercept") / F.nullif("intercept_se", F.lit(0.0)), "aic": aic(F.col("n"), F.col("var"), 4)}
    return s.withColumns(z).select(*keys, "n", "slope", "se", "z", "intercept", "intercept_se", "intercept_z", "aic")


def aic(n: Column, variance: Column, parameters: int) -> Column:
    return F.when(variance > 0, n * (F.log(variance * (2 * math.pi)) + 1) + 2 * parameters)


def arms(df: DataFrame, keys: Sequence[str], arm: str, names: Sequence[str], x: str, y: str) -> DataFrame:
    """The moments of each arm side by side; both groupings share one exchange by the keys."""
    m = moments(F.col(x).cast("double"), F.col(y).cast("double"))
    each = df.where(F.col(arm).isin(*names)).repartition(*keys).groupBy(*keys, arm).agg(F.struct(*[c.alias(k) for k, c in m.items()]).alias("m"))
    wide = each.groupBy(*keys).agg(*[F.max(F.when(F.col(arm) == a, F.col("m"))).alias(a) for a in names])
    return wide.select(*keys, *[F.col(a)[k].alias(f"{k}_{a}") for a in names for k in m])


def contrasts(df: DataFrame, keys: Sequence[str], arm: str = "arm", ref: str = "ref", obs: str = "obs", x: str = "yr", y: str = "y", least: int = 4) -> DataFrame:
    """The model y ~ x * arm: reference intercept and slope, the observed arm's deviations, z of each, AIC.

    ``int_alone`` and ``slope_alone`` belong to the observed arm fitted by itself.
    """
    # An exchange of one row per group: with the grouping the projections below would outgrow one generated method.
    s = arms(df, keys, arm, (ref, obs), x, y).repartition(*keys).where((F.col(f"n_{ref}") >= least) & (F.col(f"n_{obs}") >= least) & (F.col(f"sxx_{ref}") > 0) & (F.col(f"sxx_{obs}") > 0))
    c = lambda k, a: F.col(f"{k}_{a}")
    b = {a: c("sxy", a) / c("sxx", a) for a in (ref, obs)}
    s = s.withColumns({**{f"b_{a}": v for a, v in b.items()}, **{f"a_{a}": c("my", a) - v * c("mx", a) for a, v in b.items()}, **{f"rss_{a}": F.greatest(c("syy", a) - v * c("sxy", a), F.lit(0.0)) for a, v in b.items()}})
    n = c("n", ref) + c("n", obs)
    s = s.withColumn("var", (c("rss", ref) + c("rss", obs)) / n)
    at0 = {a: 1 / c("n", a) + c("mx", a) * c("mx", a) / c("sxx", a) for a in (ref, obs)}
    alone = c("rss", obs) / c("n", obs)
    var = F.col("var")
    parts = {
        "ref_int": (c("a", ref), var * at0[ref]),
        "ref_slope": (c("b", ref), var / c("sxx", ref)),
        "int_dev": (c("a", obs) - c("a", ref), var * (at0[ref] + at0[obs])),
        "slope_dev": (c("b", obs) - c("b", ref), var * (1 / c("sxx", ref) + 1 / c("sxx", obs))),
        "int_alone": (c("a", obs), alone * at0[obs]),
        "slope_alone": (c("b", obs), alone / c("sxx", obs)),
    }
    out = [e for k, (v, sq) in parts.items() for e in (v.alias(k), (v / F.nullif(F.sqrt(sq), F.lit(0.0))).alias(f"{k}_z"))]
    return s.select(*keys, n.alias("n"), *out, aic(n, var, 6).alias("aic"))


def three_arms(df: DataFrame, keys: Sequence[str], names: Sequence[str] = ("ref", "obs", "best"), x: str = "yr", y: str = "y") -> DataFrame:
    """Differences of slopes of three arms and their z; Var(best - obs) = V_bb + V_oo - 2 V_bo."""
    s = arms(df, keys, "arm", names, x, y)
    c = lambda k, a: F.col(f"{k}_{a}")
    rss, n = F.lit(0.0), F.lit(0)
    for a in names:
        rss, n = rss + F.greatest(c("syy", a) - c("sxy", a) * c("sxy", a) / c("sxx", a), F.lit(0.0)), n + c("n", a)
    s = s.withColumn("var", rss / n)
    ref, obs, best = names
    slope = lambda a: c("sxy", a) / c("sxx", a)
    v = lambda a: F.col("var") / c("sxx", a)
    dev_o, dev_b = slope(obs) - slope(ref), slope(best) - slope(ref)
    v_oo, v_bb, v_bo = v(obs) + v(ref), v(best) + v(ref), v(ref)
    return s.select(
        *keys, dev_o.alias("obs_dev"), dev_b.alias("best_dev"),
        (dev_b / F.nullif(F.sqrt(v_bb), F.lit(0.0))).alias("best_ref_z"),
        ((dev_b - dev_o) / F.nullif(F.sqrt(v_bb + v_oo - 2 * v_bo), F.lit(0.0))).alias("best_obs_z"),
    )


def path_tests(df: DataFrame, keys: Sequence[str], names: Sequence[str] = ("ref", "obs", "best"), x: str = "yr", y: str = "y") -> DataFrame:
    """The tests of a best path against the reference and the observed arm: obs_dev, best_dev, refugium, and the z of best < ref and best < obs.

    Where the best arm is constant (a refugium) no slope of it is fitted: its deviation is the reference's slope
    the other way, tested with the errors of the two other arms.
    """
    ref, obs, best = names
    still = df.where(F.col("arm") == best).groupBy(*keys).agg((F.min(y) == F.max(y)).alias("refugium"))
    s = arms(df, keys, "arm", (ref, obs), x, y).join(still, list(keys))
    c = lambda k, a: F.col(f"{k}_{a}")
    slope = lambda a: c("sxy", a) / c("sxx", a)
    rss = lambda a: F.greatest(c("syy", a) - c("sxy", a) * c("sxy", a) / c("sxx", a), F.lit(0.0))
    var = (rss(ref) + rss(obs)) / (c("n", ref) + c("n", obs))
    ref_se, obs_se = F.sqrt(var / c("sxx", ref)), F.sqrt(var / c("sxx", ref) + var / c("sxx", obs))
    none = F.lit(0.0)
    kept = s.select(*keys, "refugium", (slope(obs) - slope(ref)).alias("_obs"), (-slope(ref)).alias("_away"), F.nullif(ref_se, none).alias("_ref_se"), F.nullif(obs_se, none).alias("_obs_se"))
    out = kept.join(three_arms(df, keys, names, x, y), list(keys), "left")
    pick = lambda a, b: F.when(F.col("refugium"), a).otherwise(b)
    return out.select(
        *keys, "refugium", F.col("_obs").alias("obs_dev"), pick(F.col("_away"), F.col("best_dev")).alias("best_dev"),
        pick(F.col("_away") / F.col("_ref_se"), F.col("best_ref_z")).alias("best_ref_z"),
        pick((F.col("_away") - F.col("_obs")) / F.coalesce("_obs_se", "_ref_se"), F.col("best_obs_z")).alias("best_obs_z"),
    )


def mean_slope(slopes: DataFrame, keys: Sequence[str], slope: str = "slope") -> DataFrame:
    """The mean of slopes, its standard error sd / sqrt(n), and n."""
    return slopes.groupBy(*keys).agg(F.avg(slope).alias("mean_slope"), (F.stddev_samp(slope) / F.sqrt(F.count(slope))).alias("se"), F.count(slope).alias("n"))


def population_average(slopes: DataFrame, slope: str = "slope", variance: str = "v") -> DataFrame:
    """One row: the average slope over populations that differ, its standard error, tau2 (their variance) and n.

    Each slope weighs 1 / (its own variance + tau2); tau2 comes from the weighted squares about the mean by
    the method of moments and is not below 0.  Two aggregates over one row a population, nothing iterates.
    """
    b, w = F.col(slope), 1 / F.col(variance)
    m = slopes.agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * b).alias("wb"), F.sum(w * b * b).alias("wbb"))
    excess = (F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w") - (F.col("n") - 1)) / F.nullif(F.col("w") - F.col("ww") / F.col("w"), F.lit(0.0))
    tau2 = m.select("n", F.greatest(F.coalesce(excess, F.lit(0.0)), F.lit(0.0)).alias("tau2"))
    each = slopes.select(slope, variance).crossJoin(F.broadcast(tau2)).withColumn("_w", 1 / (F.col(variance) + F.col("tau2")))
    out = each.agg(F.first("n").alias("n"), (F.sum(F.col("_w") * b) / F.sum("_w")).alias("slope"), F.sqrt(1 / F.sum("_w")).alias("se"), F.first("tau2").alias("tau2"))
    return out.where("n is not null")


def back_transformed(estimate: Column, spec: Column, sd_year: Column, sd_env: Column, mean_coord: Column, kind: str) -> Column:
    """Estimates on their own scale: by the model string and by kind ``lat`` or ``env``."""
    scaled = estimate / sd_year if kind == "lat" else estimate * sd_env / sd_year
    out = F.when(spec.contains("_Standardize_"), scaled).otherwise(estimate)
    return F.when(spec.contains("_lognormal"), out * mean_coord).otherwise(out) if kind == "lat" else out
