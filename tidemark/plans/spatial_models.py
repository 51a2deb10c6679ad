"""Queries over grids, paths and fitted models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import barriers, classify, mixed, models, path, regress, sea, spatial
from ..operators import relational as rel
from ..operators import windows as win
from ..sources.staging import staged
from .domain import _categorised, _curve_points, _lat_trends, stacked
from .proxy import POP, daily, optima, read, sites, sql, survey
from .registry import query

r4 = lambda c: F.round(c, 4)
_GRID = "SELECT CAST(floor(lon / 5) AS BIGINT) AS cx, CAST(floor(lat / 5) AS BIGINT) AS cy, avg(s_acctbal) AS value FROM sites JOIN supplier ON s_suppkey = site GROUP BY 1, 2"


def grid(spark, d):
    z = read(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("z"))
    return sites(spark, d).join(z, "site").groupBy(F.floor(F.col("lon") / 5).alias("cx"), F.floor(F.col("lat") / 5).alias("cy")).agg(F.avg("z").alias("value"))


def points(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("point"), F.col("c_nationkey").alias("region"), ((k * 29 % 121) - 60).cast("double").alias("lat"), ((k * 31 % 361) - 180).cast("double").alias("lon"))


_POINTS = "SELECT c_custkey AS point, c_nationkey AS region, CAST((c_custkey * 29 % 121) - 60 AS DOUBLE) AS lat, CAST((c_custkey * 31 % 361) - 180 AS DOUBLE) AS lon FROM customer"
_G = {"grid": _GRID, "points": _POINTS}


@query("g01_layers_of_years", sql("SELECT site, CAST(day AS VARCHAR) AS day FROM daily WHERE yr IN (1996, 1998)", "daily"))
def _(spark, d):
    return daily(spark, d).where("yr IN (1996, 1998)").select("site", F.col("day").cast("string").alias("day"))


@query("g02_j15_point_extract", sql("SELECT point, round(value, 4) AS value FROM points LEFT JOIN grid ON cx = floor(lon / 5) AND cy = floor(lat / 5)", "sites", **_G))
def _(spark, d):
    return spatial.extract(points(spark, d), grid(spark, d), 5.0).select("point", r4("value").alias("value"))


@query("g03_four_neighbours", sql("SELECT g.cx, g.cy, round(coalesce(g.v, n.m), 3) AS value FROM (SELECT cx, cy, CASE WHEN value > 0 THEN value END AS v FROM grid) g LEFT JOIN (SELECT cx + dx AS cx, cy + dy AS cy, avg(value) AS m FROM grid, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy) WHERE value > 0 GROUP BY 1, 2) n ON n.cx = g.cx AND n.cy = g.cy", "sites", **_G))
def _(spark, d):
    g = grid(spark, d).withColumn("value", F.when(F.col("value") > 0, F.col("value")))
    return spatial.filled(g).select("cx", "cy", F.round("value", 3).alias("value"))


@query("g04_crop", sql("SELECT point FROM points WHERE lon BETWEEN -31 AND 31 AND lat BETWEEN -11 AND 11", "sites", **_G))
def _(spark, d):
    return spatial.crop(points(spark, d), -30, 30, -10, 10, 1.0).select("point")


@query("g06_g08_coarser_classes", sql("SELECT CAST(floor(cx / 2.0) AS BIGINT) AS cx, CAST(floor(cy / 2.0) AS BIGINT) AS cy, max(CASE WHEN value < 0 THEN 0 WHEN value < 5000 THEN 1 ELSE 2 END) AS value FROM grid GROUP BY 1, 2", "sites", **_G))
def _(spark, d):
    v = F.col("value")
    return spatial.coarser(grid(spark, d).withColumn("value", F.when(v < 0, 0).when(v < 5000, 1).otherwise(2)), 2, F.max)


@query("g07_resample", sql("SELECT CAST(floor(cx / 3.0) AS BIGINT) AS cx, CAST(floor(cy / 3.0) AS BIGINT) AS cy, round(avg(value), 3) AS value FROM grid GROUP BY 1, 2", "sites", **_G))
def _(spark, d):
    return spatial.coarser(grid(spark, d), 3).withColumn("value", F.round("value", 3))


@query("g09_cell_centres", sql("SELECT site, CAST(floor((lat + 90) / 0.5) * 720 + floor((lon + 180) / 0.5) AS BIGINT) AS cell, floor((lon + 180) / 0.5) % 720 * 0.5 - 180 + 0.25 AS clon, floor((lat + 90) / 0.5) * 0.5 - 90 + 0.25 AS clat FROM (SELECT site, lat, CASE WHEN lon >= 180 THEN -180 ELSE lon END AS lon FROM sites)", "sites"))
def _(spark, d):
    s = sites(spark, d).withColumn("lon", F.when(F.col("lon") >= 180, -180.0).otherwise(F.col("lon")))
    s = s.withColumn("cell", scalar.cell_id(F.col("lon"), F.col("lat"), -180, -90, 0.5))
    return s.select("site", "cell", scalar.cell_lon(F.col("cell"), -180, 0.5).alias("clon"), scalar.cell_lat(F.col("cell"), -90, 0.5).alias("clat"))


@query("g15_geodesic_prefilter", sql("SELECT point, site, round(2 * 6371 * asin(sqrt(least(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2), 1))), 2) AS km FROM points p JOIN sites s USING (region) WHERE 2 * 6371 * asin(sqrt(least(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2), 1))) < 3000", "sites", **_G))
def _(spark, d):
    # Each pair of places is measured once, whatever number of points and sites lie there.
    p = points(spark, d).groupBy("region", "lon", "lat").agg(F.collect_list("point").alias("points"))
    s = sites(spark, d).groupBy("region", F.col("lon").alias("slon"), F.col("lat").alias("slat")).agg(F.collect_list("site").alias("sites"))
    near = rel.within_km(p, s, ["region"], 3000.0).where("km < 3000").select("points", "sites", F.round("km", 2).alias("km"))
    return near.select(F.explode("points").alias("point"), "sites", "km").select("point", F.explode("sites").alias("site"), "km")


@query("g16_snap", sql("SELECT point, clon, clat FROM (SELECT point, s.lon AS clon, s.lat AS clat, row_number() OVER (PARTITION BY point ORDER BY (p.lon - s.lon) ** 2 + (p.lat - s.lat) ** 2, s.lon, s.lat) AS k FROM points p JOIN sites s USING (region)) WHERE k = 1", "sites", **_G))
def _(spark, d):
    c = sites(spark, d).select("region", F.col("lon").alias("clon"), F.col("lat").alias("clat"))
    return spatial.snapped(points(spark, d), c, ["region"]).select("point", "clon", "clat")


@query("g18_centroids", sql("SELECT region, round(avg(lon), 4) AS lon, round(avg(lat), 4) AS lat FROM sites GROUP BY 1", "sites"))
def _(spark, d):
    return sites(spark, d).groupBy("region").agg(r4(F.avg("lon")).alias("lon"), r4(F.avg("lat")).alias("lat"))


@query("g19_straight_line", sql("SELECT region, species, yr, round(sqrt(pow((plon - lon) * cos(radians(lat)) * 111.32, 2) + pow((plat - lat) * 111.32, 2)), 3) AS km FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM optima WINDOW w AS (PARTITION BY region, species ORDER BY yr)) WHERE plon IS NOT NULL", "optima"))
def _(spark, d):
    w = win.by_year()
    o = optima(spark, d).withColumns({"plon": F.lag("lon").over(w), "plat": F.lag("lat").over(w)}).where("plon is not null")
    return o.select(*POP, "yr", F.round(scalar.line_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat")), 3).alias("km"))


_RING = "[(-60.5, -40.5), (60.5, -40.5), (0.5, 50.5)]"


@query("j14_g05_points_in_polygon", sql("SELECT point FROM points WHERE lat > -40.5 AND lat < 50.5 AND lon > -60.5 + (lat + 40.5) * 61 / 91 AND lon < 60.5 - (lat + 40.5) * 60 / 91", "sites", **_G))
def _(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((-60.5, -40.5), (60.5, -40.5), (0.5, 50.5))])
    return spatial.inside(points(spark, d), spark.range(1).select(F.lit("triangle").alias("name"), ring.alias("ring"))).select("point")


def _world(spark, d):
    """A small made-up sea for each region: depths by rule, 24 x 12 cells of one degree."""
    cells = spark.range(288).select((F.col("id") % 24 - 12).alias("cx"), (F.floor(F.col("id") / 24) - 6).alias("cy"))
    z = F.when((F.col("cx") * 7 + F.col("cy") * 5 + F.col("region")) % 11 == 0, 5.0).when((F.col("cx") + F.col("cy") + F.col("region")) % 4 == 0, -10.0).otherwise(-200.0)
    regions = sites(spark, d).select("region").distinct()
    return regions.crossJoin(F.broadcast(cells)).withColumn("z", z)


def _reefs(spark, d):
    """The sites at the cells of the made-up sea."""
    k = F.col("site")
    return sites(spark, d).select(F.col("region").cast("int").alias("region"), k.cast("bigint").alias("cell"), (F.pmod(k, F.lit(24)) - 11.5).cast("double").alias("lon"), (F.pmod(F.floor(k / 24), F.lit(12)) - 5.5).cast("double").alias("lat"))


@query("d10_g12_g13_relocation")
def _(spark, d):
    o = optima(spark, d).select("region", F.xxhash64("region", "species", "yr").alias("id"), (F.pmod("site", F.lit(24)) - 12 + 0.5).cast("double").alias("lon"), (F.pmod("site", F.lit(12)) - 6 + 0.5).cast("double").alias("lat"))
    samples = _reefs(spark, d).select("region", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    return sea.relocated(o, _world(spark, d), samples, 1.0)


_LAND = "SELECT region, cx, cy FROM (SELECT DISTINCT s_nationkey AS region FROM supplier), (SELECT i % 24 - 12 AS cx, i // 24 - 6 AS cy FROM range(288) t(i)) WHERE (cx * 7 + cy * 5 + region) % 11 = 0"
_PIECES = """WITH RECURSIVE land AS ({land}),
reach AS (SELECT region, cx, cy, cx * 1000 + cy AS root FROM land UNION SELECT r.region, l.cx, l.cy, r.root FROM reach r JOIN land l ON l.region = r.region AND abs(l.cx - r.cx) <= 1 AND abs(l.cy - r.cy) <= 1),
least AS (SELECT region, cx, cy, min(root) AS root FROM reach GROUP BY ALL),
pieces AS (SELECT region, cx, cy, dense_rank() OVER (PARTITION BY region ORDER BY root) - 1 AS piece, sum(111.32 * 111.32 * cos(radians(cy + 0.5))) OVER (PARTITION BY region, root) AS area_km2 FROM least)""".format(land=_LAND)
_NEAR = "SELECT site, piece, sqrt(pow((x - lon) * cos(radians(lat)), 2) + pow(y - lat, 2)) * 111.32 AS km FROM (SELECT site, lon, lat, cx + 0.5 AS x, cy + 0.5 AS y, piece FROM place JOIN pieces USING (region) WHERE area_km2 >= {least} QUALIFY row_number() OVER (PARTITION BY site ORDER BY (cx + 0.5 - lon) ** 2 + (cy + 0.5 - lat) ** 2, cx, cy) = 1)"
_PLACE = "SELECT s_suppkey AS site, s_nationkey AS region, s_suppkey % 24 - 11.5 AS lon, s_suppkey // 24 % 12 - 5.5 AS lat FROM supplier"


@query("g10_g11_land_pieces", _PIECES + " SELECT region, cx, cy, piece, round(area_km2, 3) AS area_km2 FROM pieces")
def _(spark, d):
    return sea.land_pieces(_world(spark, d), 1.0).withColumn("area_km2", F.round("area_km2", 3))


@query("g11_nearest_large_land", f"{_PIECES}, place AS ({_PLACE}), large AS ({_NEAR.format(least=20000)}), near AS ({_NEAR.format(least=0)}) SELECT n.site, CASE WHEN l.km <= 200 THEN l.piece ELSE n.piece END AS piece, round(CASE WHEN l.km <= 200 THEN l.km ELSE n.km END, 3) AS km FROM near n LEFT JOIN large l USING (site)")
def _(spark, d):
    """Land of the made-up sea is large from 20,000 km2, so that small pieces are there."""
    near = spatial.nearest_land(_reefs(spark, d).withColumnRenamed("cell", "point"), sea.land_pieces(_world(spark, d), 1.0), 1.0, 20_000.0)
    return near.select(F.col("point").alias("site"), "piece", F.round("km", 3).alias("km"))


def _coasts(spark, d):
    """The sites along three short coasts: one in the north, two in the south with a ridge of land between them."""
    k, part = F.col("s_suppkey"), F.pmod("s_suppkey", F.lit(3))
    lon = F.when(part == 0, -1.0).when(part == 1, -9.0).otherwise(7.0) + (k * 29 % 100) / 50
    lat = F.when(part == 0, 2.5).otherwise(-4.5) + (k * 37 % 100) / 50
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("region"), k.alias("site"), lon.alias("lon"), lat.alias("lat"))


def _ridges(spark, d):
    ridge = F.col("cx").between(-4, 3) & (F.col("cy") < 0)
    return _world(spark, d).withColumn("z", F.when(ridge, 5.0).otherwise(F.col("z")))


def _split(spark, d):
    return staged(barriers.split_regions(_coasts(spark, d), sea.land_pieces(_ridges(spark, d), 1.0), 1.0))


def _confirmed(spark, d):
    """Splits are recognised in the nations of the first four regions of the order tables."""
    return read(spark, d, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("region"))


@query("d23_barrier_split")
def _(spark, d):
    return _split(spark, d)


@query("d23_unconfirmed_splits")
def _(spark, d):
    return barriers.unconfirmed(_split(spark, d), _confirmed(spark, d))


@query("d23_split_viability")
def _(spark, d):
    return barriers.viability(barriers.confirmed_plan(_split(spark, d), _confirmed(spark, d)), survey(spark, d))


@query("d23_species_to_refit")
def _(spark, d):
    return barriers.to_refit(barriers.confirmed_plan(_split(spark, d), _confirmed(spark, d)), survey(spark, d))


@query("d24_pooled_coasts", sql("SELECT coast, species, region, yr FROM (SELECT *, region // 5 AS coast FROM optima) JOIN (SELECT region // 5 AS coast, species FROM optima GROUP BY ALL HAVING count(DISTINCT region) >= 2) USING (coast, species)", "optima"))
def _(spark, d):
    chains = sites(spark, d).select("region", F.floor(F.col("region") / 5).cast("int").alias("coast")).distinct()
    return spatial.pooled(optima(spark, d), chains).select("coast", "species", "region", "yr")


def _annual(spark, d):
    return daily(spark, d).groupBy("site", "yr").agg(F.avg("v").alias("exposure"))


def _paths(spark, d):
    reefs, water = _reefs(spark, d), _world(spark, d).where("z < 0").select("region", "cx", "cy")
    o = optima(spark, d).select(F.col("site").cast("bigint").alias("cell"), "species", "yr").join(reefs, "cell")
    cells = reefs.join(_annual(spark, d).withColumnRenamed("site", "cell"), "cell")
    return staged(path.best_paths(o, cells, water, 1.0))


@query("d27_g14_best_paths")
def _(spark, d):
    return _paths(spark, d)


def _path_tests(spark, d, paths=None):
    """The best arm is the exposure along the searched path; the paths may be given."""
    paths = _paths(spark, d) if paths is None else paths
    best = paths.where("drop_reason is null").select("region", "species", "yr", F.col("cell").alias("site")).join(_annual(spark, d), ["site", "yr"])
    arms = stacked(spark, d).select(F.col("region").cast("int").alias("region"), "species", "yr", "arm", "y")
    return regress.path_tests(arms.unionByName(best.select("region", "species", "yr", F.lit("best").alias("arm"), F.col("exposure").alias("y"))), POP)


@query("d27b_m07_three_arm_tests")
def _(spark, d):
    return _path_tests(spark, d)


def _tested_outcomes(spark, d):
    """Every population with the outcome of its tests, or else the reason why it has none: a drop reason, why it stays, or untested."""
    paths = _paths(spark, d)
    pops = paths.groupBy(*POP).agg(F.coalesce(F.split(F.max("drop_reason"), ":")[0], F.max("stays")).alias("reason"))
    ref_z, obs_z = (F.when(~F.isnan(z), F.col(z)) for z in ("best_ref_z", "best_obs_z"))
    t = staged(_path_tests(spark, d, paths).select(*POP, classify.path_outcome_of_tests(ref_z, obs_z).alias("outcome")))
    out = pops.join(t, POP, "left").withColumn("outcome", F.when(F.col("reason").isNull(), F.col("outcome")))
    return out.withColumn("reason", F.when(F.col("outcome").isNull(), F.coalesce("reason", F.lit("untested"))))


def _counted(df, keys):
    """Populations of each outcome or reason, and the share of each outcome in those that have one."""
    n = df.groupBy(*keys, "outcome", "reason").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100 * rel.share(F.when(F.col("outcome").isNotNull(), F.col("n")), keys))


@query("d28_tested_path_outcomes")
def _(spark, d):
    """Populations without an outcome are counted by reason and have no share."""
    return _counted(_tested_outcomes(spark, d), ["region"])


@query("d28b_tested_outcome_range")
def _(spark, d):
    """For each guild and outcome the least and the largest share over the parts of the range, from tested paths.

    Populations without an outcome, or without a guild and range, are counted by reason and have no share.
    """
    places = staged(_categorised(spark, d).select(F.col("region").cast("int").alias("region"), "species", "guild", "range").distinct())
    t = _tested_outcomes(spark, d).join(places, POP, "left").withColumn("outcome", F.when(F.col("guild").isNotNull(), F.col("outcome")))
    t = t.withColumn("reason", F.when(F.col("outcome").isNull(), F.coalesce("reason", F.lit("no_category"))))
    n = _counted(t, ["guild", "range"]).withColumn("p", F.round("pct", 0))
    return n.groupBy("guild", "outcome", "reason").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.sum("n").alias("n"))


@query("d13_m03_m04_model_grid")
def _(spark, d):
    grid = spark.createDataFrame([(f"Abund_{a}_{t}_{f}", a, t, f) for a in ("no_autocor", "ou", "ar1") for t in ("NULL", "Standardize") for f in ("gaussian", "lognormal", "nbinom2")], "spec string, autocor string, trans string, family string")
    s = win.with_time_coordinate(optima(spark, d)).withColumn("y", F.col("abund").cast("double"))
    return models.fitted(s, POP, grid)


@query("d16c_d40_signed_longitude_refit")
def _(spark, d):
    grid = spark.createDataFrame([(f"Lon_{a}", a, "NULL", "gaussian") for a in ("no_autocor", "ou", "ar1")], "spec string, autocor string, trans string, family string")
    s = win.with_time_coordinate(optima(spark, d)).withColumn("y", F.col("lon"))
    best = models.fitted(s, POP, grid).groupBy(*POP).agg(F.min_by(F.struct("spec", "estimate", "aic"), F.struct(F.coalesce("aic", F.lit(float("inf"))), "spec")).alias("b"))
    return best.select(*POP, "b.spec", "b.estimate", "b.aic")


def _factors():
    """The contrasts of guild (against Cool) and range (against Mid)."""
    return [(F.col("guild") == "Warm").cast("double")], [(F.col("range") == r).cast("double") for r in ("Warm", "Cold")]


#: What contains each block of terms.
_WITHIN = {
    "exposure": ("exposure_guild", "exposure_range", "exposure_guild_range"), "guild": ("exposure_guild", "guild_range", "exposure_guild_range"), "range": ("exposure_range", "guild_range", "exposure_guild_range"),
    "exposure_guild": ("exposure_guild_range",), "exposure_range": ("exposure_guild_range",), "guild_range": ("exposure_guild_range",),
}


def _blocks(curve):
    """Blocks of terms by name: exposure (x and more of it), guild, range and all that they do together."""
    warm, ranges = _factors()
    both = lambda some, more: [a * b for a in some for b in more]
    return {
        "intercept": [F.lit(1.0)], "exposure": curve, "guild": warm, "range": ranges, "exposure_guild": both(curve, warm), "exposure_range": both(curve, ranges),
        "guild_range": both(warm, ranges), "exposure_guild_range": both(both(curve, warm), ranges),
    }


def _named(blocks):
    names = {b: [f"{b}_{i + 1}" for i in range(len(terms))] for b, terms in blocks.items()}
    return names, {n: t for b, terms in blocks.items() for n, t in zip(names[b], terms, strict=True)}


def _probability_model(spark, d, degree=2):
    """P(poleward) ~ exposure (standardised, to a degree) x guild x range, an intercept by population, AR1 over years.

    Returns the rows, the moments of exposure, the names of terms by block, the terms and the fit.
    """
    rows = staged(_categorised(spark, d))
    m = rows.agg(F.avg("exposure").alias("m"), F.stddev_samp("exposure").alias("s")).first()
    centre, spread = float(m["m"] or 0.0), float(m["s"] or 1.0)
    z = (F.col("exposure") - centre) / spread
    names, terms = _named(_blocks([z, z * z][:degree]))
    return rows, (centre, spread), names, terms, mixed.mixed_logistic(rows, POP, "yr", terms, F.col("poleward_km") > 0)


@query("d22_m06_m10_m11_poleward_probability")
def _(spark, d):
    """The quadratic mixed model: fixed effects with standard errors and P, the random part, and the likelihood-ratio test against a straight line."""
    *_, fit = _probability_model(spark, d)
    *_, line = _probability_model(spark, d, 1)
    more = fit.parameters - line.parameters
    curve = models.chi2_tail(max(0.0, 2 * (fit.loglik - line.loglik)), more) if more else 1.0
    se = [math.sqrt(max(v, 0.0)) for v in fit.cov.diagonal()]
    rows = [(t, float(b), s, math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else None, curve) for t, b, s in zip(fit.terms, fit.beta, se, strict=True)]
    rows += [(k, v, None, None, curve) for k, v in fit.random.items() if fit.terms]
    return spark.createDataFrame(rows, "term string, estimate double, se double, p double, p_curve double")


@query("d22_guild_range_tests")
def _(spark, d):
    """Tests of exposure, guild, range and what they do together, each after all that doesn't contain it."""
    _, _, names, _, fit = _probability_model(spark, d)
    tested = {b: t for b, t in names.items() if b != "intercept"}
    return spark.createDataFrame(mixed.type2(fit, tested, _WITHIN) if fit.terms else [], "block string, chi2 double, df int, p double")


@query("m11_predicted_probability")
def _(spark, d):
    """The surface of d22 by guild and range: 80 points each between their binned points, with intervals."""
    rows, (centre, spread), _, _, fit = _probability_model(spark, d)
    points = _curve_points(rows).withColumnRenamed("x", "exposure")
    z = (F.col("exposure") - centre) / spread
    _, terms = _named(_blocks([z, z * z]))
    return mixed.predicted(points, fit, terms).select("guild", "range", "i", "exposure", "fit", "lower", "upper")


_ARMS = "SELECT species, CAST(abund AS DOUBLE) AS v, lat >= 0 AS a, rank() OVER (PARTITION BY species ORDER BY abund) + (count(*) OVER (PARTITION BY species, abund) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY species, abund) AS tied FROM optima"
_RANKS = "SELECT species, count_if(a) AS n0, count_if(NOT a) AS n1, median(v) FILTER (WHERE a) AS median0, median(v) FILTER (WHERE NOT a) AS median1, (avg(v) FILTER (WHERE a) - avg(v) FILTER (WHERE NOT a)) / sqrt(var_samp(v) FILTER (WHERE a) / count_if(a) + var_samp(v) FILTER (WHERE NOT a) / count_if(NOT a)) AS t, sum(CASE WHEN a THEN r ELSE 0 END) - count_if(a) * (count_if(a) + 1) / 2.0 AS u, count_if(a) * count_if(NOT a) / 12.0 * (count(*) + 1 - sum(CAST(tied AS DOUBLE) * tied - 1) / (count(*) * (count(*) - 1.0))) AS var FROM arms GROUP BY 1"


@query("d31_m09_two_groups", sql("SELECT species, n0, n1, median0, median1, round(t, 4) AS t, u, round((u - n0 * n1 / 2.0) / sqrt(nullif(var, 0)), 4) AS z FROM ranks", "optima", arms=_ARMS, ranks=_RANKS))
def _(spark, d):
    o = optima(spark, d).withColumn("arm", F.when(F.col("lat") >= 0, "north").otherwise("south"))
    return models.rank_sums(o, ["species"], "arm", "abund", ("north", "south")).select("species", "n0", "n1", "median0", "median1", r4("t").alias("t"), F.col("u").cast("double").alias("u"), r4("z").alias("z"))


def _classes(spark, d):
    """Trends of latitude in up to three classes by direction and size, with what may tell them apart."""
    b = _lat_trends(spark, d).select((F.col("slope") > 0).cast("int").alias("a"), "slope", F.col("region").cast("double").alias("region"), F.length("species").cast("double").alias("name"))
    return b.select((F.col("a") + F.when(F.abs("slope") > 5, 1).otherwise(0)).cast("double").alias("label"), (F.col("region") / 10).alias("region"), (F.col("name") / 10).alias("name"))


@query("m08_multinomial")
def _(spark, d):
    """Log-odds of each class against the first, with standard errors."""
    terms, _ = models.multinomial(staged(_classes(spark, d)), "label", ["region", "name"])
    return spark.createDataFrame(terms, "class int, term string, estimate double, se double, p double")


@query("m08_predicted_shares")
def _(spark, d):
    """The probability of each class in each region."""
    _, shares = models.multinomial(staged(_classes(spark, d)), "label", ["region"])
    return shares.select(F.round(10 * F.col("region")).cast("int").alias("region"), "label", "p")


@query("m08_type3_tests")
def _(spark, d):
    return spark.createDataFrame(models.type3(_classes(spark, d), "label", ["region", "name"]), "term string, chi2 double, df int, p double")


@query("m12_interaction_test", sql("SELECT CAST(n AS BIGINT) AS n, g, round((common - apart) / (g - 1) / (apart / (n - 2 * g)), 4) AS f FROM (SELECT sum(n) AS n, count(*) AS g, sum(syy - sxy * sxy / sxx) AS apart, sum(syy) - sum(sxy) * sum(sxy) / sum(sxx) AS common FROM (SELECT species, count(*) AS n, regr_sxx(abund, CAST(yr AS DOUBLE)) AS sxx, regr_sxy(abund, CAST(yr AS DOUBLE)) AS sxy, regr_syy(abund, CAST(yr AS DOUBLE)) AS syy FROM optima GROUP BY 1) WHERE sxx > 0)", "optima"))
def _(spark, d):
    """Whether the slopes of abund ~ yr * species differ: F of separate slopes against a common one."""
    y, x = F.col("abund").cast("double"), F.col("yr").cast("double")
    m = optima(spark, d).groupBy("species").agg(F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy")).where("sxx > 0")
    t = m.agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")).alias("apart"), (F.sum("syy") - F.sum("sxy") * F.sum("sxy") / F.sum("sxx")).alias("common"))
    return t.select("n", "g", r4((F.col("common") - F.col("apart")) / (F.col("g") - 1) / (F.col("apart") / (F.col("n") - 2 * F.col("g")))).alias("f"))


@query("m12_factor_interaction", sql("SELECT species, n, round(slope, 4) AS slope FROM (SELECT species, count(*) AS n, regr_slope(abund, CAST(yr AS DOUBLE)) AS slope FROM optima GROUP BY 1)", "optima"))
def _(spark, d):
    """abund ~ yr * species is one regression for each species."""
    return regress.trends(optima(spark, d), ["species"], "yr", "abund").select("species", "n", r4("slope").alias("slope"))
