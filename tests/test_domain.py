"""Rules that the order tables can't exercise."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import barriers, classify, exposure, models, path, regress, relational, sea, shape, spatial
from tidemark.operators import windows as win
from tidemark.sources import tables

S, N = 0.01, 0.5


@pytest.mark.parametrize(
    "r, d, i, pr, pd, pi, want",
    [
        (1, 1, 0, N, S, N, "Magnification"), (1, 1, 1, S, N, S, "Magnification"), (2, -1, 0, N, S, N, "Mitigation"), (1, 0, -1, S, N, S, "Mitigation"),
        (-1, 2, 0, S, S, N, "Opposition"), (1, 0, 0, N, N, N, "Steady"), (1, 0, 0, S, N, N, "Warming"), (-1, 0, 0, S, N, N, "Cooling"),
        (-1, -1, 0, N, S, N, "Acceleration"), (-1, 0, -1, S, N, S, "Acceleration"), (-2, 1, 0, N, S, N, "Deceleration"), (-1, 0, 1, S, N, S, "Deceleration"),
        (1, -2, 0, S, S, N, "Annihilation"), (1, 0, 1, N, N, S, "Magnification"), (1, 0, -1, N, N, S, "Mitigation"),
        (1, 0, 0, 0.05, 0.05, 0.05, "Steady"), (1, -2, 0, N, S, N, None), (None, 1, 0, N, S, N, None),
    ],
)
def test_response_rules(spark, r, d, i, pr, pd, pi, want):
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in (r, d, i, pr, pd, pi))], "r double, d double, i double, pr double, pd double, pi double")
    got = df.select(classify.response(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]
    assert (got and got["response"]) == want


def curve(*ys, key="c"):
    return [(key, float(i), float(y)) for i, y in enumerate(ys)]


@pytest.mark.parametrize(
    "ys, want",
    [((1, 5, 1, 5, 1), "bimodal"), ((1, 2, 3, 2, 1), "clear_unimodal"), ((9, 5, 3, 2, 1), "edge_peak"), ((9, 9.5, 10, 9.5, 9), "flat"), ((1, 2), None), ((0, 0, 0), None), ((1, 3, 3, 1, 0), "clear_unimodal")],
)
def test_curve_classes(spark, ys, want):
    df = spark.createDataFrame(curve(*ys), "k string, x double, mu double")
    got = shape.curve_classes(df, ["k"]).collect()
    assert (got[0]["class"] if got else None) == want


def test_time_coordinate_is_a_running_sum(spark):
    df = spark.createDataFrame([(1, "a", y) for y in (1993, 1994, 1997)], "region int, species string, yr int")
    got = [r["t_coord"] for r in win.with_time_coordinate(df).orderBy("yr").collect()]
    assert got == pytest.approx([1.1, 3.2, 8.3])


def test_exact_lag_over_gaps(spark):
    df = spark.createDataFrame([(1, "a", y, float(y)) for y in (1993, 1994, 1996)], "region int, species string, yr int, v double")
    got = [tuple(r) for r in df.orderBy("yr").select(win.exact_lag(F.col("v"), 1), win.exact_lag(F.col("v"), 2)).collect()]
    assert got == [(None, None), (1993.0, None), (None, None)]


def test_exposure_is_strict_and_sums_values(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0), (1, 12.0, 10.0), (1, 8.0, 10.0), (2, 1.0, 10.0)], "k int, v double, q90 double")
    got = {r["k"]: r.asDict() for r in df.groupBy("k").agg(*exposure.metrics("v", ["q90"], ["q90"])).collect()}
    assert (got[1]["cumtemp_above_q90"], got[1]["days_above_q90"], got[1]["cumtemp_below_q90"]) == (12.0, 1, 8.0)
    assert (got[2]["cumtemp_above_q90"], got[2]["days_above_q90"], got[2]["sd_temp"]) == (0.0, 0, None)


@pytest.mark.parametrize("missing, level", [(0, 0), (1, 0), (2, 1), (10, 1)])
def test_series_fallback(spark, missing, level):
    days = spark.createDataFrame([(f"2000-01-{i:02d}",) for i in range(1, 11)], "day string")
    own = [(0, 0, f"2000-01-{i:02d}", 1.0) for i in range(missing + 1, 11)]
    near = [(1, 1, f"2000-01-{i:02d}", 3.0) for i in range(1, 11)]
    cube = spark.createDataFrame(own + near, "cx int, cy int, day string, value double")
    site = spark.createDataFrame([(7, 0, 0)], "site int, cx int, cy int")
    got = exposure.site_series(site, cube, days, reject=False).collect()
    assert len(got) == 10 and {r["level"] for r in got} == {level}


def test_series_with_nothing(spark):
    days = spark.createDataFrame([("2000-01-01",)], "day string")
    cube = spark.createDataFrame([], "cx int, cy int, day string, value double")
    assert exposure.site_series(spark.createDataFrame([(7, 0, 0)], "site int, cx int, cy int"), cube, days).count() == 0


def test_counterfactual_pairs_by_year(spark):
    rows = [(1, "a", s, t, 10.0 * s + t) for s in (1, 3, 4) for t in (1, 3, 4) if t >= s and s != 3]
    panel = spark.createDataFrame(rows, "region int, species string, yr int, lead_yr int, m double")
    got = exposure.counterfactual(panel, ["m"]).collect()
    assert [(r["yr"], r["diff_first_site_m"]) for r in got] == [(4, 30.0)]


def test_contrasts_are_two_regressions(spark):
    rng = np.random.default_rng(1)
    x = np.arange(8.0)
    y = {"ref": 2 + 0.5 * x + rng.normal(size=8), "obs": 1 - 0.3 * x + rng.normal(size=8)}
    df = spark.createDataFrame([(1, a, float(u), float(v)) for a in y for u, v in zip(x, y[a], strict=True)], "k int, arm string, yr double, y double")
    got = regress.contrasts(df, ["k"]).first()
    fits = {a: np.polyfit(x, y[a], 1) for a in y}
    var = sum(((y[a] - np.polyval(fits[a], x)) ** 2).sum() for a in y) / 16
    sxx = ((x - x.mean()) ** 2).sum()
    assert got["slope_dev"] == pytest.approx(fits["obs"][0] - fits["ref"][0])
    assert got["int_dev"] == pytest.approx(fits["obs"][1] - fits["ref"][1])
    assert got["slope_dev_z"] == pytest.approx(got["slope_dev"] / math.sqrt(var * 2 / sxx))
    three = spark.createDataFrame([(1, a, float(u), float(v)) for a, b in (("ref", "ref"), ("obs", "obs"), ("best", "obs")) for u, v in zip(x, y[b], strict=True)], "k int, arm string, yr double, y double")
    r = regress.three_arms(three, ["k"]).first()
    assert r["obs_dev"] == pytest.approx(got["slope_dev"]) and r["best_obs_z"] == pytest.approx(0.0)


def test_correlated_without_correlation_is_least_squares():
    rng = np.random.default_rng(2)
    x = np.arange(12.0)
    y = 1 + 2 * x + rng.normal(size=12)
    assert models.correlated(x, y, x, "none")["estimate"] == pytest.approx(np.polyfit(x, y, 1)[0])
    assert models.correlated(x, y, x, "ar1")["aic"] <= models.correlated(x, y, x, "none")["aic"] + 2 + 1e-6


def test_negative_binomial_recovers_a_slope():
    rng = np.random.default_rng(3)
    x = np.linspace(0, 3, 400)
    y = rng.negative_binomial(5, 5 / (5 + np.exp(0.5 + 0.7 * x)))
    assert models.negative_binomial(x, y.astype(float))["estimate"] == pytest.approx(0.7, abs=0.12)


@pytest.mark.parametrize("x, k, want", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307, 10, 0.05), (0.0, 3, 1.0)])
def test_chi2_tail(x, k, want):
    assert models.chi2_tail(x, k) == pytest.approx(want, abs=1e-5)


def test_logistic_sums(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=500)
    y = rng.random(500) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y, strict=True)], "x double, y boolean")
    beta, cov, _ = models.logistic_sums(df, [F.lit(1.0), F.col("x")], F.col("y"))
    assert beta == pytest.approx([0.3, 1.2], abs=0.4) and cov[1, 1] > 0


def test_rank_sums(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 6.0, 7.0]
    df = spark.createDataFrame([(1, "a", v) for v in a] + [(1, "b", v) for v in b], "k int, arm string, v double")
    got = models.rank_sums(df, ["k"], "arm", "v", ("a", "b")).first()
    assert got["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def moves(d, reach):
    """The moves of a distance matrix that are within reach."""
    a, b = np.nonzero(d <= reach)
    return a, b, d[a, b]


@pytest.mark.parametrize("seed", range(12))
def test_best_path_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    years, cells = 4, 4
    e, xy = rng.integers(0, 5, (years, cells)).astype(float), rng.random((cells, 2))
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    reach = float(np.median(d))
    got = path.best_path(e, *moves(d, reach), 0)
    cost = lambda p: sum(e[t, c] for t, c in enumerate(p)) + 1e-9 * sum(d[a, b] for a, b in itertools.pairwise(p))
    best = min(cost(p) for p in itertools.product(range(cells), repeat=years) if p[0] == 0 and all(d[a, b] <= reach for a, b in itertools.pairwise(p)))
    assert cost(got) == pytest.approx(best) and best <= cost([0] * years)


def test_best_path_stays_on_ties_and_reports_none():
    d = np.array([[0.0, 0.0], [0.0, 0.0]])
    assert path.best_path(np.ones((3, 2)), *moves(d, 1.0), 1) == [1, 1, 1]
    assert path.best_path(np.array([[1.0], [np.nan]]), *moves(np.zeros((1, 1)), 1.0), 0) is None


def test_sea_distances_equal_brute_force():
    cells = {(x, y) for x in range(6) for y in range(5)} - {(2, y) for y in range(4)}
    graph = spatial.neighbours(cells, 1.0)
    got = spatial.sea_distances((0, 0), graph)
    best = {c: math.inf for c in cells} | {(0, 0): 0.0}
    for _ in cells:
        for c in cells:
            for o, s in graph[c]:
                best[o] = min(best[o], best[c] + s)
    assert got == pytest.approx(best)


def test_pieces_and_polygons(spark):
    assert spatial.components({(0, 0), (1, 1), (5, 5)}) == {(0, 0): 0, (1, 1): 0, (5, 5): 1}
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (20, 0), (20, 20), (0, 20))])
    polygons = spark.range(1).select(F.lit("p").alias("name"), ring.alias("ring"))
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 30.0, 10.0), (3, 19.0, 1.0)], "id int, lon double, lat double")
    assert sorted(r["id"] for r in spatial.inside(points, polygons).collect()) == [1, 3]


def test_relocation(spark):
    grid = [(1, x, 0, -10.0 if x == 4 else -500.0) for x in range(8)] + [(2, 0, 0, 5.0)]
    cells = spark.createDataFrame(grid, "region int, cx long, cy long, z double")
    optima = spark.createDataFrame([(1, 1, 4.5, 0.5), (1, 2, 0.5, 0.5), (2, 3, 0.5, 0.5)], "region int, id long, lon double, lat double")
    samples = spark.createDataFrame([], "region int, slon double, slat double")
    got = {r["id"]: (r["status"], r["lon"]) for r in sea.relocated(optima, cells, samples, 1.0).collect()}
    assert got == {1: ("ok", 4.5), 2: ("to_bathy_seapath", 4.5), 3: ("unplaced", 0.5)}


_LANDS = "region int, cx bigint, cy bigint, piece int, area_km2 double"


def _parts(spark, sites, land):
    got = barriers.split_regions(spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(sites)], "region int, site long, lon double, lat double"), spark.createDataFrame(land, _LANDS), 1.0)
    return {r["site"]: r["suffix"] for r in got.collect()}


def test_barrier_split(spark):
    sites = [(0.0, i / 10) for i in range(6)] + [(0.0, 10 + i / 10) for i in range(6)]
    south, north = (1, 0, 0, 0, 9000.0), (1, 0, 10, 1, 9000.0)
    assert _parts(spark, sites, [south, north]) == {i: "S" if i < 6 else "N" for i in range(12)}
    assert set(_parts(spark, sites, []).values()) == {"S", "N"}  # open water
    assert set(_parts(spark, sites, [(1, 3, y, 0, 90000.0) for y in range(12)]).values()) == {""}  # one coast
    # a small island beside each group: with large land near by both belong to it
    islands = [(1, 0, 0, 0, 500.0), (1, 0, 10, 1, 500.0)]
    assert set(_parts(spark, sites, islands).values()) == {"S", "N"}
    assert set(_parts(spark, sites, [*islands, *[(1, 1, y, 2, 90000.0) for y in range(12)]]).values()) == {""}
    assert set(_parts(spark, sites[:4] + sites[6:], [south, north]).values()) == {""}  # too few sites


def test_barrier_split_by_longitude(spark):
    coasts = [(x, i / 2) for x in (0.5, 6.5) for i in range(6)]
    between = [(1, x, y, 0, 9000.0) for x in (2, 3, 4) for y in range(3)]
    assert _parts(spark, coasts, between) == {i: "W" if i < 6 else "E" for i in range(12)}
    assert set(_parts(spark, coasts, between[:1]).values()) == {""}  # mostly water


def test_sources(spark, tmp_path):
    assert tables.snake("Selected.Model LON") == "selected_model_lon"
    grid = tables.parameter_grid(spark.createDataFrame([("NULL\r",)], "trans string"))
    assert grid.first()["trans"] == "NULL"
    work = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    target = str(tmp_path / "t")
    tables.append_missing(work.where("k = 1"), target, ["k"])
    tables.append_missing(work, target, ["k"])
    assert spark.read.parquet(target).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.table(spark, "none", str(tmp_path))


def test_refresh_takes_new_files_once(spark, tmp_path):
    from tidemark.streaming.refresh import refresh

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows.write.parquet(source)
    for _ in range(2):
        refresh(spark, source, rows.schema, target, ["k"], lambda df: df, str(tmp_path / "cp")).awaitTermination(60)
    rows.withColumn("v", F.lit("again")).write.mode("append").parquet(source)
    refresh(spark, source, rows.schema, target, ["k"], lambda df: df, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "a"), (2, "b")]


def test_path_tests_and_outcomes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(12):
        for t in range(8):
            rows += [(k, t, "ref", 0.5 * t + rng.normal()), (k, t, "obs", 0.3 * t + rng.normal()), (k, t, "best", 3.0 if k < 3 else -0.4 * t * (k % 3) + rng.normal())]
    df = spark.createDataFrame([(int(k), int(t), a, float(y)) for k, t, a, y in rows], "k int, yr int, arm string, y double")
    got = {r["k"]: r for r in regress.path_tests(df, ["k"]).withColumn("outcome", classify.path_outcome_of_tests(F.col("best_ref_z"), F.col("best_obs_z"))).collect()}
    assert len(got) == 12
    for k in range(12):
        arms = {a: np.array([(t, y) for i, t, b, y in rows if i == k and b == a]) for a in ("ref", "obs", "best")}
        used = ("ref", "obs") if k < 3 else ("ref", "obs", "best")
        fits = {a: np.polyfit(arms[a][:, 0], arms[a][:, 1], 1) for a in used}
        var = sum(((arms[a][:, 1] - np.polyval(fits[a], arms[a][:, 0])) ** 2).sum() for a in used) / (8 * len(used))
        sxx = ((np.arange(8) - 3.5) ** 2).sum()
        obs, ref = fits["obs"][0] - fits["ref"][0], fits["ref"][0]
        if k < 3:
            best, z1, z2 = -ref, -ref / np.sqrt(var / sxx), (-ref - obs) / np.sqrt(2 * var / sxx)
        else:
            best = fits["best"][0] - ref
            z1, z2 = best / np.sqrt(2 * var / sxx), (best - obs) / np.sqrt(2 * var / sxx)
        r = got[k]
        assert r["refugium"] == (k < 3)
        assert [r["obs_dev"], r["best_dev"], r["best_ref_z"], r["best_obs_z"]] == pytest.approx([obs, best, z1, z2])
        p = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
        assert r["outcome"] == ("none available" if p(z1) >= 0.05 else "available not followed" if p(z2) < 0.05 else "followed")


def test_predicted_curve(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    yes = rng.random(400) < 1 / (1 + np.exp(-(0.3 + x - 0.5 * x * x)))
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, yes)], "x double, yes boolean")
    terms = lambda c: [F.lit(1.0), c, c * c]
    beta, cov, _ = models.logistic_sums(df, terms(F.col("x")), F.col("yes"))
    got = models.logistic_curve(df, "x", terms, beta, cov).orderBy("x").toPandas()
    at = np.linspace(x.min(), x.max(), 80)
    f = np.column_stack([np.ones(80), at, at * at])
    eta, se = f @ beta, np.sqrt(np.einsum("ij,jk,ik->i", f, cov, f))
    curve = lambda v: 1 / (1 + np.exp(-v))
    for name, want in (("x", at), ("p", curve(eta)), ("se", curve(eta) * (1 - curve(eta)) * se), ("lower", curve(eta - 1.959963984540054 * se)), ("upper", curve(eta + 1.959963984540054 * se))):
        assert np.allclose(got[name], want, atol=1e-9)


def test_multinomial_equals_newton(spark):
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 4, 600) / 2, rng.normal(size=600).round(1)
    odds = np.column_stack([np.zeros(600), 0.4 + a - 0.5 * b, -0.3 - 0.8 * a + b])
    y = np.array([rng.choice(3, p=np.exp(o) / np.exp(o).sum()) for o in odds])
    x, beta = np.column_stack([np.ones(600), a, b]), np.zeros((2, 3))
    for _ in range(30):
        e = np.column_stack([np.ones(600), np.exp(x @ beta.T)])
        p = e / e.sum(axis=1, keepdims=True)
        grad = np.concatenate([x.T @ ((y == k) - p[:, k]) for k in (1, 2)])
        info = np.block([[x.T @ (x * (p[:, k] * ((k == m) - p[:, m]))[:, None]) for m in (1, 2)] for k in (1, 2)])
        beta = beta + np.linalg.solve(info, grad).reshape(2, 3)
    df = spark.createDataFrame([(float(k), float(u), float(v)) for k, u, v in zip(y, a, b, strict=True)], "label double, a double, b double")
    terms, shares = models.multinomial(df, "label", ["a", "b"])
    assert [t[:2] for t in terms] == [(k, n) for k in (1, 2) for n in ("intercept", "a", "b")]
    assert [t[2] for t in terms] == pytest.approx(beta.ravel(), abs=2e-3)
    assert [t[3] for t in terms] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))), rel=5e-3)
    at = {(u, v): p[i] for i, (u, v) in enumerate(zip(a, b, strict=True))}
    got = shares.collect()
    assert len(got) == 3 * len(at) and all(r["p"] == pytest.approx(at[r["a"], r["b"]][r["label"]], abs=2e-3) for r in got)


def test_type3_of_a_saturated_model(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.choice(3, p=(0.6, 0.3, 0.1) if a else (0.2, 0.3, 0.5))), float(a)) for a in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(rows, "label double, a double")
    loglik = lambda values: sum(values.count(v) * math.log(values.count(v) / len(values)) for v in set(values))
    want = 2 * (sum(loglik([y for y, b in rows if b == a]) for a in (0.0, 1.0)) - loglik([y for y, _ in rows]))
    ((term, chi2, dof, p),) = models.type3(df, "label", ["a"])
    assert (term, dof) == ("a", 2) and chi2 == pytest.approx(want, rel=1e-3) and p == pytest.approx(math.exp(-chi2 / 2))


@pytest.mark.parametrize("kind", ["ou", "ar1"])
def test_negative_binomial_with_correlated_residuals(spark, kind):
    """A planted slope comes back from long series, and better than chance the correlation pays in AIC."""
    rng, rows, slope = np.random.default_rng(3), [], 0.05
    for k in range(6):
        z = 0.0
        for t in range(60):
            z = 0.8 * z + rng.normal(0, 0.3)
            mu = math.exp(2.5 + slope * (t - 30) + z)
            rows.append((k, t, float(rng.poisson(mu * rng.gamma(20.0) / 20.0)), float(t)))
    df = spark.createDataFrame(rows, "k int, yr int, y double, t_coord double")
    grid = spark.createDataFrame([("with", kind, "NULL", "nbinom2"), ("without", "no_autocor", "NULL", "nbinom2")], "spec string, autocor string, trans string, family string")
    got = [r for r in models.fitted(df, ["k"], grid).collect()]
    own = [r for r in got if r["spec"] == "with"]
    assert len(own) == 6 and all(r["estimate"] is not None and r["aic"] is not None for r in own)
    assert np.mean([r["estimate"] for r in own]) == pytest.approx(slope, abs=0.02)
    aic = {(r["k"], r["spec"]): r["aic"] for r in got}
    assert sum(aic[k, "with"] < aic[k, "without"] for k in range(6)) >= 4
    assert all(r["se"] > o["se"] for r in own for o in got if o["k"] == r["k"] and o["spec"] == "without" and r["se"])


def test_latent_series_without_spread_is_a_plain_negative_binomial():
    """As the deviation of the series goes to nought its likelihood is that of the fit without it."""
    rng = np.random.default_rng(2)
    x = np.arange(40.0)
    y = rng.negative_binomial(4, 4 / (4 + np.exp(2 + 0.02 * (x - 20)))).astype(float)
    plain, latent = models.negative_binomial(x, y), models.latent_negative_binomial(x, y, x, "ou")
    assert latent["estimate"] == pytest.approx(plain["estimate"], abs=0.02)
    assert latent["aic"] <= plain["aic"] + 2 * (5 - 3) + 0.1


def test_ladder_of_fits():
    bowl = lambda p: float((p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2)
    place, cov, value, warning = models.ladder(bowl, [np.zeros(2)])
    assert np.allclose(place, [1, -2], atol=1e-3) and warning is None and np.allclose(cov, np.diag([0.5, 0.05]), atol=1e-3) and value < 1e-6
    # A flat valley has no Hessian; another start does not help, and the reason is told.
    assert models.ladder(lambda p: float(p[0] ** 2), [np.ones(2), -np.ones(2)])[3] == "non-positive-definite Hessian matrix"
    # Two hollows: the first start ends in a flat one, the second finds the deep one.
    hollows = lambda p: float(min(0.0, (p[0] + 4) ** 2 - 5))
    place, _, value, warning = models.ladder(hollows, [np.array([4.5]), np.array([-3.0])])
    assert place[0] == pytest.approx(-4, abs=1e-3) and warning is None and value == pytest.approx(-5, abs=1e-6)


def test_profiles_are_searched_again():
    hollows = lambda p: min((p + 3) ** 2 / 9, (p - 2.9) ** 2 * 40 - 1)
    assert models.minimum(hollows, -6.0, 4.0) == pytest.approx(-3, abs=1e-3)  # the first search alone
    place, warning = models.profiled(hollows, -6.0, 4.0)
    assert place == pytest.approx(2.9, abs=1e-4) and warning is None
    assert models.profiled(lambda p: p, 0.0, 1.0)[1] == "correlation at the end of its range"
    assert models.profiled(lambda p: 1e-9 * p * p, -1.0, 1.0)[1] == "non-positive-definite Hessian matrix"
    assert models.profiled(lambda p: 0.0, -1.0, 1.0)[1] is not None


@pytest.mark.parametrize("kind", ["ou", "ar1"])
def test_planted_correlation_is_found(kind):
    rng = np.random.default_rng(4)
    t = np.arange(200.0)
    noise = np.zeros(200)
    for i in range(1, 200):
        noise[i] = 0.6 * noise[i - 1] + rng.normal()
    got = models.correlated(t, 3 + 0.05 * t + noise, t, kind)
    assert got["warning"] is None and got["estimate"] == pytest.approx(0.05, abs=3 * got["se"])
    assert got["aic"] < models.correlated(t, 3 + 0.05 * t + noise, t, "none")["aic"] - 20


def test_ladder_goes_on_where_iterations_did_not_suffice(monkeypatch):
    monkeypatch.setattr(models, "FIRST_STEPS", 2)
    valley = lambda p: float((1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2)
    place, cov, _, warning = models.ladder(valley, [np.array([-1.2, 1.0])])
    assert warning is None and cov is not None and np.allclose(place, [1, 1], atol=1e-2)
    monkeypatch.setattr(models, "LAST_STEPS", 3)
    assert "limit" in models.ladder(valley, [np.array([-1.2, 1.0])])[3]


@pytest.mark.parametrize("n, length", [(1, 3), (7, 3), (1000, 10), (5, 1)])
def test_spread_rows(spark, n, length):
    got = relational.spread(spark.range(n).repartition(5), [F.col("id")], n, length).collect()
    want = sorted({round(1 + (n - 1) * i / (length - 1)) for i in range(length)}) if length > 1 else [1]
    assert sorted((r["place"], r["id"]) for r in got) == [(p, p - 1) for p in want]


_VISITS, _CELLS, _SEA = "region int, species string, yr int, lon double, lat double", "region int, cell bigint, lon double, lat double, yr int, exposure double", "region int, cx bigint, cy bigint"


def _solved(spark, visits, cells, water, schema=_VISITS, at=lambda c: (c + 0.5, 0.5)):
    """The visits name cells; ``at`` says where those are."""
    c, w = spark.createDataFrame(cells, _CELLS), spark.createDataFrame(water, _SEA)
    placed = [(r, s, t, *map(float, at(cell)), *more) for r, s, t, cell, *more in visits]
    return path.best_paths(spark.createDataFrame(placed, schema), c, w, 1.0).orderBy("species", "yr").collect()


def test_a_population_that_never_moved_stays(spark):
    visits = [(1, "s", y, 5) for y in range(4)]
    cells = [(1, c, c + 0.5, 0.5, y, float(c + y)) for c in (4, 5, 6) for y in range(4) if (c, y) != (5, 2)]
    got = _solved(spark, visits, cells, [(1, x, 0) for x in range(8)])
    assert [(r["yr"], r["cell"], r["drop_reason"]) for r in got] == [(y, 5, None) for y in range(4)]


def test_paths_go_round_land(spark):
    """A wall lies between the columns 2 and 4 except in row 5, so the cooler cell beyond it is too far in one year."""
    sea = [(1, x, y) for x in range(6) for y in range(6) if x != 3 or y == 5]
    spots = {1: (2, 0, 5.0), 2: (1, 0, 4.0), 3: (4, 0, 0.0), 4: (0, 0, 3.5)}
    cells = [(1, c, x + 0.5, y + 0.5, t, e) for c, (x, y, e) in spots.items() for t in range(4)]
    got = _solved(spark, [(1, "s", t, c) for t, c in enumerate((1, 2, 1, 2))], cells, sea, at=lambda c: (spots[c][0] + 0.5, spots[c][1] + 0.5))
    graph = spatial.neighbours({(x, y) for _, x, y in sea}, 1.0)
    far = {a: {b: spatial.sea_distances(spots[a][:2], graph)[spots[b][:2]] for b in spots} for a in spots}
    reach = far[1][2]
    best = min((p for p in itertools.product(spots, repeat=4) if p[0] == 1 and all(far[a][b] <= reach + 1e-9 for a, b in itertools.pairwise(p))), key=lambda p: sum(spots[c][2] + 0.0 for c in p))
    assert far[1][3] > 6 * reach and [r["cell"] for r in got] == list(best) and 3 not in best
    assert [r["step_km"] for r in got][1:] == pytest.approx([far[a][b] if a != b else 0.0 for a, b in itertools.pairwise(best)]) and got[0]["reach_km"] == pytest.approx(reach)


def test_reasons_instead_of_paths(spark):
    good = {"years": 4, "region": 1, "cell": 1, "sti": True, "ref": True}
    cases = {"few_years": {"years": 3}, "no_STI": {"sti": None}, "no_ref": {"ref": False}, "no_transition": {"region": 3}, "few_sea_cells": {"region": 2}, "no_reef_cells": {"region": 4}, "no_reef_in_reach": {"region": 5, "cell": 77}, "fine": {}}
    visits = [(v["region"], name, t, v["cell"], v["sti"], v["ref"]) for name, c in cases.items() for v in [good | c] for t in range(v["years"])]
    cells = [(r, c, c + 0.5, 0.5, t, 1.0) for r in (1, 2, 3) for c in (1, 2) for t in range(4)]
    cells += [(5, 1, 1.5, 0.5, t, 1.0) for t in range(4)]
    got = _solved(spark, visits, cells, [(1, x, 0) for x in range(6)] + [(2, 0, 0)] + [(r, x, 0) for r in (4, 5) for x in range(6)], _VISITS + ", has_sti boolean, has_ref boolean")
    assert {(r["species"], r["drop_reason"]) for r in got} == {(n, None if n == "fine" else n) for n in cases}


def test_a_broken_path_stays(spark):
    cells = [(1, c, c + 0.5, 0.5, t, 1.0) for c in (1, 2) for t in range(4) if t != 2] + [(1, 3, 400.5, 0.5, 2, 1.0)]
    got = _solved(spark, [(1, "s", t, 1 + t % 2) for t in range(4)], cells, [(1, x, 0) for x in range(6)])
    assert [r["cell"] for r in got] == [1, 1, 1, 1]


def test_a_start_off_the_habitat_goes_to_the_nearest_cell(spark):
    cells = [(1, c, c + 0.5, 0.5, t, float(c)) for c in (2, 3) for t in range(4)]
    got = _solved(spark, [(1, "s", t, c) for t, c in enumerate((4.2, 3, 4, 3))], cells, [(1, x, 0) for x in range(7)])
    assert [(r["cell"], r["drop_reason"]) for r in got] == [(3, None), (2, None), (2, None), (2, None)]


def test_one_population_that_fails_is_one_row(spark):
    cells = [(1, c, c + 0.5, 0.5, t, 1.0) for c in (1, 2) for t in range(4)]
    places = lambda c: (math.nan, 0.5) if c == 9 else (c + 0.5, 0.5)
    got = _solved(spark, [(1, s, t, c) for s, c in (("bad", 9), ("good", 1)) for t in range(4)], cells, [(1, x, 0) for x in range(6)], at=places)
    reasons = {r["species"]: r["drop_reason"] for r in got}
    assert reasons["good"] is None and reasons["bad"] is not None


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_by_tiles_equals_all_pairs(spark, k):
    rng = np.random.default_rng(k)
    points = [(i, int(rng.integers(0, 3)), float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.uniform(-90, 90, (80, 2))))] + [(900, 0, None, 1.0)]
    sites = [(i, int(rng.integers(0, 3)), float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.normal(0, 30, (60, 2))))] + [(901, 7, 0.0, 0.0), (902, 1, 1.0, None)]
    p = spark.createDataFrame(points, "point int, region int, lon double, lat double")
    s = spark.createDataFrame(sites, "site int, region int, slon double, slat double")
    got = {}
    for r in relational.nearest(p, s, "region", k).collect():
        got.setdefault(r["point"], set()).add(r["site"])
    for i, region, x, y in points:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, g, u, v in sites if g == region and v is not None) if x is not None else []
        assert got.get(i, set()) == {j for _, j in near[:k]}
    small = relational.near_pairs(p, s, ["region"], k, leaf=2)
    assert small.count() < p.join(s, "region").count()
    best = {}
    for r in small.collect():
        best.setdefault(r["point"], []).append(((r["lon"] - r["slon"]) ** 2 + (r["lat"] - r["slat"]) ** 2, r["site"]))
    assert {i: {j for _, j in sorted(v)[:k]} for i, v in best.items()} == got


def test_pairs_follow_the_points_however_dense_sites_are(spark):
    """Ten times the sites in the same square degree: pairs a point stay much the same."""
    rng = np.random.default_rng(5)
    shares = []
    for n in (600, 6_000):
        s = spark.createDataFrame([(i, 1, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(10, 11, (n, 2)))], "site int, region int, slon double, slat double")
        p = spark.createDataFrame([(i, 1, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(9.9, 11.1, (n, 2)))], "point int, region int, lon double, lat double")
        shares.append(relational.near_pairs(p, s, ["region"]).count() / n)
    assert shares[1] < 1.5 * shares[0] < 300, shares


def test_pairs_within_a_distance_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    p = spark.createDataFrame([(i, 1, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-80, 80, (60, 2)))], "point int, region int, lon double, lat double")
    s = spark.createDataFrame([(i, 1, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-80, 80, (60, 2)))], "site int, region int, slon double, slat double")
    km = scalar.haversine_km(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))
    want = {(r["point"], r["site"]) for r in p.join(s, "region").where(km <= 2500).collect()}
    assert {(r["point"], r["site"]) for r in relational.within_km(p, s, ["region"], 2500.0).collect()} == want and want


def test_population_average(spark):
    rows = [(float(b), float(v)) for b, v in ((0.5, 0.04), (-0.2, 0.09), (1.4, 0.01), (0.1, 0.25))]
    b, v = np.array(rows).T
    w = 1 / v
    q = (w * (b - (w * b).sum() / w.sum()) ** 2).sum()
    tau2 = max(0, (q - 3) / (w.sum() - (w * w).sum() / w.sum()))
    r = regress.population_average(spark.createDataFrame(rows, "slope double, v double")).first()
    u = 1 / (v + tau2)
    assert [r["n"], r["slope"], r["se"], r["tau2"]] == pytest.approx([4, (u * b).sum() / u.sum(), 1 / math.sqrt(u.sum()), tau2])
    alone = regress.population_average(spark.createDataFrame(rows[:1], "slope double, v double")).first()
    assert (alone["slope"], alone["tau2"]) == (0.5, 0.0)


@pytest.mark.parametrize("master, ok", [("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_clusters_need_a_shared_folder(master, ok):
    from tidemark.sources import staging

    class Session:
        class conf:
            values = {"spark.master": master}
            get = classmethod(lambda cls, k, default=None: cls.values.get(k, default))
            set = classmethod(lambda cls, k, v: cls.values.update({k: v}))

    if ok:
        assert staging.shared_folder(Session).startswith(Session.conf.values["spark.checkpoint.dir"])
    else:
        with pytest.raises(RuntimeError):
            staging.shared_folder(Session)


def test_series_are_worked_out_once_a_cell(spark):
    """A thousand sites of one cell make no more rows below the last join than one site does."""
    days = spark.createDataFrame([(f"2000-01-{i:02d}",) for i in range(1, 11)], "day string")
    cube = spark.createDataFrame([(0, 0, f"2000-01-{i:02d}", float(i)) for i in range(1, 11)], "cx int, cy int, day string, value double")
    many = spark.range(1000).select(F.col("id").alias("site"), F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    df = exposure.site_series(many, cube, days, reject=False)
    assert df.count() == 10_000 and df.select("site", "day").distinct().count() == 10_000
    assert [tuple(r) for r in df.groupBy("level").agg(F.sum("v"), F.count("v")).collect()] == [(0, 55_000.0, 10_000)]
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    df.write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().apply(int(before)).executionId()
    graph, values = store.planGraph(run), store.executionMetrics(run)
    joins = []
    for i in range(graph.allNodes().size()):
        node = graph.allNodes().apply(i)
        if "Join" in node.name():
            counts = [values.get(m.accumulatorId()) for k in range(node.metrics().size()) if (m := node.metrics().apply(k)).name() == "number of output rows"]
            joins += [int(c.get().replace(",", "")) for c in counts if c.isDefined()]
    assert sorted(joins)[-1] == 10_000 and all(n <= 30 for n in sorted(joins)[:-1])


@pytest.mark.parametrize("seed", range(12))
def test_moves_between_places_equal_moves_between_cells(seed):
    rng = np.random.default_rng(seed)
    years, cells = 6, 30
    e = rng.integers(0, 6, (years, cells)).astype(float)
    e[rng.random((years, cells)) < 0.2] = np.nan
    home, xy = rng.integers(0, 7, cells), rng.random((7, 2))
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    reach = float(np.median(d))
    want = path.best_path(e, *moves(d[home][:, home], reach), 3)
    assert path.best_path(e, *moves(d, reach), 3, place=home) == want


def test_moves_follow_places_not_cells(spark):
    """Forty cells of each of three places: nine moves, not 14,400."""
    cells = spark.createDataFrame([(1, 40 * x + i, x + 0.5, 0.5) for x in range(3) for i in range(40)], "region int, cell bigint, lon double, lat double")
    water = spark.createDataFrame([(1, x, 0) for x in range(3)], _SEA)
    at, far = path.sea_moves(cells, water, 1.0, spark.createDataFrame([(1, 1000.0)], "region int, reach_km double"))
    assert at.count() == 120 and far.count() == 9


def test_pairs_of_places_are_measured_once(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    step = 121 * 361  # keys that far apart lie at one place
    spark.createDataFrame([(1 + i * step, 3) for i in range(4)] + [(2, 3)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1 + i * step, 3) for i in range(3)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    own, seen = relational.within_km, []

    def within_km(points, sites, *more):
        seen.append((points.count(), sites.count()))
        return own(points, sites, *more)

    monkeypatch.setattr(relational, "within_km", within_km)
    got = [tuple(r) for r in entry.queries()["g15_geodesic_prefilter"](spark, str(tmp_path)).select("point", "site").collect()]
    points = {1 + i * step for i in range(4)}
    assert seen == [(2, 1)] and len(got) == len(set(got)) and {p for p, _ in got} >= points
    assert {(p, 1 + i * step) for p in points for i in range(3)} <= set(got)
