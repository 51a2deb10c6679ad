"""Queries for sources, projections, joins, aggregates, windows, sorting, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import nulls, scalar
from ..operators import relational as rel
from ..operators.quantiles import exact_quantiles
from ..operators import windows as win
from ..sources import staging, tables
from .proxy import POP, optima, read, site_years, sites, sql, survey
from .registry import query

r4 = lambda c: F.round(c, 4)


# --- sources and sinks


@query("s01_s02_table_resolver", "SELECT * FROM nation")
def _(spark, d):
    return tables.table(spark, "nation", f"{d}/output-of-no-run", d)


@query("s03_chunked_scan", sql("SELECT region, species, yr, site, abund, lat, lon FROM optima", "optima"))
def _(spark, d):
    folder = staging.shared_folder(spark)
    optima(spark, d).repartition("region").write.parquet(f"{folder}/part=1")
    return tables.chunks(spark, folder).select("region", "species", "yr", "site", "abund", "lat", "lon")


@query("s04_keys_from_paths", sql("SELECT CAST(region AS INTEGER) AS region, count(*) AS n, sum(site) :: BIGINT AS total FROM optima GROUP BY 1", "optima"))
def _(spark, d):
    folder = staging.shared_folder(spark)
    optima(spark, d).write.partitionBy("region").parquet(folder)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder).withColumn("region", tables.file_key(r"region=(\d+)/").cast("int"))
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("site").alias("total"))


@query("s05_s06_csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    folder, nation = staging.shared_folder(spark), read(spark, d, "nation")
    nation.write.option("header", True).csv(folder)
    return spark.read.schema(nation.schema).option("header", True).csv(folder)


@query("s07_table_per_spec", "SELECT o_orderpriority AS spec, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    folder = staging.shared_folder(spark)
    tables.write_specs(read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("spec")).repartition("spec"), folder, "spec")
    return spark.read.parquet(folder).groupBy("spec").agg(F.count("*").alias("n"))


@query("s08_text_ids", "SELECT CAST(row_number() OVER (ORDER BY n_name) AS BIGINT) AS id FROM nation")
def _(spark, d):
    folder = staging.shared_folder(spark)
    n = read(spark, d, "nation").count()
    spark.range(1, n + 1).select(F.col("id").cast("string")).write.text(folder)
    return spark.read.text(folder).select(F.col("value").cast("bigint").alias("id"))


@query("s09_cube_by_year", sql("SELECT yr, count(DISTINCT day) AS layers, CAST(min(day) AS VARCHAR) AS first_day FROM daily GROUP BY yr", "daily"))
def _(spark, d):
    cube = survey(spark, d).select("day")
    return cube.groupBy(F.year("day").alias("yr")).agg(F.countDistinct("day").alias("layers"), F.min("day").cast("string").alias("first_day"))


@query("s10_tiled_layout", sql("SELECT yr AS year, count(*) AS n FROM (SELECT DISTINCT site, day, yr FROM survey) JOIN sites USING (site) WHERE lat BETWEEN -20 AND 20 AND yr IN (1996, 1997) GROUP BY 1", "survey", "sites"))
def _(spark, d):
    folder = staging.shared_folder(spark)
    cube = survey(spark, d).select("site", "day").distinct().join(sites(spark, d).drop("region"), "site")
    tables.write_tiles(cube, folder)
    return spark.read.parquet(folder).where("year IN (1996, 1997) AND lat BETWEEN -20 AND 20").groupBy("year").agg(F.count("*").alias("n"))


@query("s11_coarse_grid", sql("SELECT CAST(floor(lon / 2) AS BIGINT) AS gx, CAST(floor(lat / 2) AS BIGINT) AS gy, round(avg(s_acctbal), 4) AS mean_z, max(s_acctbal) AS max_z FROM sites JOIN supplier ON s_suppkey = site GROUP BY 1, 2", "sites"))
def _(spark, d):
    z = read(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("z"))
    grid = sites(spark, d).join(z, "site").groupBy(F.floor(F.col("lon") / 2).alias("gx"), F.floor(F.col("lat") / 2).alias("gy"))
    return grid.agg(r4(F.avg("z")).alias("mean_z"), F.max("z").alias("max_z"))


@query("s12_longitude_shift", sql("SELECT site, lat, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS lon360 FROM sites", "sites"))
def _(spark, d):
    return sites(spark, d).select("site", "lat", F.pmod("lon", F.lit(360.0)).alias("lon360"))


@query("s13_parameter_fan_out", sql("SELECT spec, region, round(CASE spec WHEN 'sum' THEN s ELSE m END, 4) AS value FROM (SELECT region, sum(abund) AS s, avg(abund) AS m FROM optima GROUP BY region), (VALUES ('sum'), ('mean')) g(spec)", "optima"))
def _(spark, d):
    grid = tables.parameter_grid(spark.createDataFrame([("sum\r",), ("mean",)], "spec string"))
    both = optima(spark, d).groupBy("region").agg(F.sum("abund").alias("s"), F.avg("abund").alias("m")).crossJoin(F.broadcast(grid))
    return both.select("spec", "region", r4(F.when(F.col("spec") == "sum", F.col("s")).otherwise(F.col("m"))).alias("value"))


@query("s14_restartable_sink", "SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    folder = staging.shared_folder(spark)
    work = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    work.where("k < '3'").write.parquet(folder)  # what an interrupted run had done
    tables.append_missing(work, folder, ["k"])
    return spark.read.parquet(folder)


@query("s15_row_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 139")
def _(spark, d):
    return read(spark, d, "orders").where(F.col("o_orderkey").between(100, 139)).select("o_orderkey", "o_totalprice")


# --- projection, filter, predicate


@query("p01_p02_p03_rename", "SELECT c_custkey AS customer, c_name AS temp_name, c_acctbal AS temp_acctbal FROM customer")
def _(spark, d):
    c = rel.rename_existing(read(spark, d, "customer"), {"c_custkey": "customer", "absent": "x"})
    return rel.rename_prefix(c.select("customer", "c_name", "c_acctbal"), "c_", "temp_")


@query("p04_p05_computed", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity > avg(l_quantity) OVER (PARTITION BY l_orderkey) AS above FROM lineitem")
def _(spark, d):
    w = Window.partitionBy("l_orderkey")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r4(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (F.col("l_quantity") > F.avg("l_quantity").over(w)).alias("above"))


@query("p06_dynamic_column", "SELECT o_orderkey, round(abs(o_totalprice), 4) AS value FROM orders")
def _(spark, d):
    name = "o_" + "totalprice"
    return read(spark, d, "orders").select("o_orderkey", r4(F.abs(F.col(name))).alias("value"))


@query("p07_filters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT coalesce(o_orderstatus IN ('F'), false)")
def _(spark, d):
    o = read(spark, d, "orders")
    return o.where((F.col("o_totalprice") > 1000) & nulls.is_in(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]) & ~nulls.is_in(F.col("o_orderstatus"), ["F"])).select("o_orderkey")


@query("p08_p09_complete_rows", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value)")
def _(spark, d):
    return read(spark, d, "events").dropna(subset=["value"]).where(nulls.finite(F.col("value"))).select("event_id", "value")


@query("p10_patterns", "SELECT p_partkey, contains(p_name, 'a.b') AS fixed, regexp_matches(lower(p_name), 'blue|red') AS nocase, regexp_matches(p_type, 'ED$') AS tail FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.col("p_name").contains("a.b").alias("fixed"), F.col("p_name").rlike("(?i)blue|red").alias("nocase"), F.col("p_type").rlike("ED$").alias("tail"))


@query("p11_group_size", sql("SELECT region, species, yr, site FROM optima QUALIFY count(*) OVER (PARTITION BY region, species) >= 5", "optima"))
def _(spark, d):
    return rel.at_least(optima(spark, d), POP, 5).select("region", "species", "yr", "site")


@query("p12_straddlers", sql("SELECT region, species, yr, lon FROM optima JOIN (SELECT region, species FROM optima GROUP BY ALL HAVING bool_or(lon > 0) AND bool_or(lon < 0) AND max(abs(lon)) < 175) USING (region, species)", "optima"))
def _(spark, d):
    w = Window.partitionBy(*POP)
    o = optima(spark, d).withColumn("k", F.bool_or(F.col("lon") > 0).over(w) & F.bool_or(F.col("lon") < 0).over(w) & (F.max(F.abs("lon")).over(w) < 175))
    return o.where("k").select("region", "species", "yr", "lon")


@query("p13_drop_first_row", sql("SELECT region, species, yr FROM optima QUALIFY row_number() OVER (PARTITION BY region, species ORDER BY yr) > 1", "optima"))
def _(spark, d):
    o = optima(spark, d).withColumn("k", F.row_number().over(win.by_year()))
    return o.where("k > 1").select("region", "species", "yr")


@query("p14_spread_subset", "SELECT c_custkey, CAST(place AS INTEGER) AS place FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM (SELECT DISTINCT c_custkey FROM customer)) WHERE place IN (SELECT CAST(round_even(1 + (n - 1) * i / 9.0, 0) AS BIGINT) FROM (SELECT count(DISTINCT c_custkey) AS n FROM customer), range(10) t(i))")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey").distinct()
    return rel.spread(c, [F.col("c_custkey")], c.count(), 10)


@query("p15_null_aware_choice", "SELECT p_partkey, CASE WHEN v > 1500 THEN 'Warm' WHEN NOT (v > 1500) THEN 'Cool' END AS guild FROM (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice END AS v FROM part)")
def _(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("v"))
    return p.select("p_partkey", nulls.if_else(F.col("v") > 1500, "Warm", "Cool").alias("guild"))


@query("p16_first_value", sql("SELECT region, species, arg_min(site, yr) AS first_site, min(yr) AS first_yr FROM optima GROUP BY ALL", "optima"))
def _(spark, d):
    return optima(spark, d).groupBy(*POP).agg(F.min_by("site", "yr").alias("first_site"), F.min("yr").alias("first_yr"))


@query("p17_checked_choice", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    kind = "O"
    if kind not in ("O", "F", "P"):
        raise ValueError(kind)
    return read(spark, d, "orders").where(F.col("o_orderstatus") == kind).agg(F.count("*").alias("n"))


# --- joins


@query("j01_left_coordinates", sql("SELECT o.region, o.species, o.yr, z.site AS there FROM optima o LEFT JOIN (SELECT * FROM sites WHERE lat > 0) z ON z.region = o.region AND round_even(z.lat, 4) = round_even(o.lat, 4) AND round_even(z.lon, 4) = round_even(o.lon, 4)", "optima"))
def _(spark, d):
    key = lambda t: t.withColumns({"klat": nulls.coordinate(F.col("lat")), "klon": nulls.coordinate(F.col("lon"))})
    there = key(sites(spark, d).where("lat > 0")).select("region", "klat", "klon", F.col("site").alias("there"))
    return key(optima(spark, d)).join(there, ["region", "klat", "klon"], "left").select("region", "species", "yr", "there")


@query("j02_left_other_names", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    return read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_brand")


@query("j03_coordinate_key", sql("SELECT region, site, CAST(round_even(lon, 4) AS DECIMAL(9, 4)) || ' ' || CAST(round_even(lat, 4) AS DECIMAL(9, 4)) AS k FROM sites", "sites"))
def _(spark, d):
    k = F.concat_ws(" ", nulls.coordinate(F.col("lon")).cast("decimal(9,4)"), nulls.coordinate(F.col("lat")).cast("decimal(9,4)"))
    return sites(spark, d).select("region", "site", k.alias("k"))


@query("j04_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j05_many_to_many", sql("SELECT o.region, count(DISTINCT (o.species, y.site)) AS pairs FROM optima o JOIN site_years y ON o.region = y.region AND o.species = y.species GROUP BY 1", "optima"))
def _(spark, d):
    y = site_years(spark, d).select("region", "species", F.col("site").alias("other"))
    return optima(spark, d).join(y, POP).groupBy("region").agg(F.countDistinct("species", "other").alias("pairs"))


@query("j06_right", "SELECT n_nationkey, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    s = read(spark, d, "supplier").where("s_acctbal > 5000")
    return s.join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_nationkey", "s_suppkey")


@query("j07_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    o = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j08_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def _(spark, d):
    o = read(spark, d, "orders").where("o_totalprice > 100000")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j09_triangular_self_join", sql("SELECT a.region, a.species, a.yr, a.site, b.yr AS lead_yr FROM optima a JOIN optima b ON a.region = b.region AND a.species = b.species AND b.yr >= a.yr", "optima"))
def _(spark, d):
    from ..operators.exposure import triangular

    return triangular(optima(spark, d)).select("region", "species", "yr", "site", "lead_yr")


@query("j10_complete_grid", "SELECT n_name, k AS o_orderpriority, count(o_orderkey) AS n FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority AS k FROM orders) LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = k GROUP BY 1, 2")
def _(spark, d):
    counts = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"))
    return rel.completed(counts, read(spark, d, "nation").select("n_name"), read(spark, d, "orders").select("o_orderpriority").distinct(), "n")


@query("j11_membership", "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def _(spark, d):
    p = read(spark, d, "part").where("p_size = 10").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, d, "lineitem").join(p, "l_partkey", "left_semi").agg(F.count("*").alias("n"))


POINTS = "SELECT c_custkey AS point, c_nationkey AS region, CAST((c_custkey * 29 % 121) - 60 AS DOUBLE) AS lat, CAST((c_custkey * 31 % 361) - 180 AS DOUBLE) AS lon FROM customer"


def points(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("point"), F.col("c_nationkey").alias("region"), ((k * 29 % 121) - 60).cast("double").alias("lat"), ((k * 31 % 361) - 180).cast("double").alias("lon"))


def _sites(spark, d):
    return sites(spark, d).select("region", "site", F.col("lon").alias("slon"), F.col("lat").alias("slat"))


@query("j12_nearest", sql("SELECT p.region, point, arg_min(site, ((p.lon - s.lon) ** 2 + (p.lat - s.lat) ** 2) * 100000 + site) AS site FROM points p JOIN sites s ON p.region = s.region GROUP BY 1, 2", "sites", points=POINTS))
def _(spark, d):
    return rel.nearest(points(spark, d), _sites(spark, d), "region").select("region", "point", "site")


@query("j13_k_nearest_mean", sql("SELECT region, point, round(avg(sqrt(d2)), 4) AS mean_distance FROM (SELECT p.region, point, (p.lon - s.lon) ** 2 + (p.lat - s.lat) ** 2 AS d2, site FROM points p JOIN sites s ON p.region = s.region QUALIFY row_number() OVER (PARTITION BY p.region, point ORDER BY d2, site) <= 10) GROUP BY 1, 2", "sites", points=POINTS))
def _(spark, d):
    return rel.nearest(points(spark, d), _sites(spark, d), "region", 10).groupBy("region", "point").agg(r4(F.avg(F.sqrt("d2"))).alias("mean_distance"))


@query("j16_bind_one_row", sql("SELECT region, species, yr, abund, total FROM optima JOIN (SELECT region, species, sum(abund) AS total FROM optima GROUP BY ALL) USING (region, species)", "optima"))
def _(spark, d):
    o = optima(spark, d)
    return o.join(o.groupBy(*POP).agg(F.sum("abund").alias("total")), POP).select("region", "species", "yr", "abund", "total")


@query("j17_wide_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    t = lambda n: read(spark, d, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("j18_scalar_lookup", sql("SELECT region, species, yr, abund / (SELECT max(abund) FROM optima) AS rel FROM optima", "optima"))
def _(spark, d):
    o = optima(spark, d)
    return o.crossJoin(F.broadcast(o.agg(F.max("abund").alias("m")))).select("region", "species", "yr", (F.col("abund") / F.col("m")).alias("rel"))


# --- aggregates


@query("a01_counts", sql("SELECT region, species, yr, count(*) AS n FROM survey GROUP BY ALL", "survey"))
def _(spark, d):
    return survey(spark, d).groupBy("region", "species", "yr").agg(F.count("*").alias("n"))


@query("a02_moments", sql("SELECT species, round(avg(temp), 4) AS mean, min(temp) AS lo, max(temp) AS hi, round(sum(abund), 4) AS total, round(stddev_samp(temp), 4) AS sd, median(temp) AS med FROM survey GROUP BY 1", "survey"))
def _(spark, d):
    s = survey(spark, d).select("species", "temp", "abund")
    moments = s.groupBy("species").agg(r4(F.avg("temp")).alias("mean"), F.min("temp").alias("lo"), F.max("temp").alias("hi"), r4(F.sum("abund")).alias("total"), r4(F.stddev_samp("temp")).alias("sd"))
    return moments.join(exact_quantiles(s, ["species"], "temp", {"med": 0.5}), "species")


@query("a03_distinct", sql("SELECT region, count(DISTINCT species) AS species, count(DISTINCT (species, site)) AS pairs FROM survey GROUP BY 1", "survey"))
def _(spark, d):
    return survey(spark, d).groupBy("region").agg(F.countDistinct("species").alias("species"), F.countDistinct("species", "site").alias("pairs"))


@query("a04_a05_conditional", "SELECT o_orderpriority, count_if(o_totalprice > 150000) AS large, round(100 * avg(CAST(o_orderstatus = 'F' AS INTEGER)), 4) AS pct_f FROM orders GROUP BY 1")
def _(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 150000).alias("large"), r4(F.avg((F.col("o_orderstatus") == "F").cast("int")) * 100).alias("pct_f"))


@query("a06_two_levels", sql("SELECT region, CAST(median(n) AS DOUBLE) AS med_sites, min(n) AS min_sites FROM (SELECT region, yr, count(DISTINCT site) AS n FROM survey GROUP BY ALL) GROUP BY 1", "survey"))
def _(spark, d):
    n = survey(spark, d).groupBy("region", "yr").agg(F.countDistinct("site").alias("n"))
    return n.groupBy("region").agg(F.median("n").alias("med_sites"), F.min("n").alias("min_sites"))


@query("a07_three_levels", sql("SELECT species, count(*) AS groups FROM (SELECT species, region FROM (SELECT species, region, yr, count(DISTINCT site) AS n FROM survey GROUP BY ALL) WHERE n >= 2 GROUP BY ALL HAVING count(*) >= 5) GROUP BY 1", "survey"))
def _(spark, d):
    n = survey(spark, d).groupBy("species", "region", "yr").agg(F.countDistinct("site").alias("n")).where("n >= 2")
    return n.groupBy("species", "region").agg(F.count("*").alias("k")).where("k >= 5").groupBy("species").agg(F.count("*").alias("groups"))


@query("a08_a09_shares", "SELECT o_orderpriority, o_orderstatus, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share, round(n / max(n) OVER (PARTITION BY o_orderpriority), 6) AS rel FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def _(spark, d):
    n = read(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.select("o_orderpriority", "o_orderstatus", F.round(rel.share(F.col("n"), ["o_orderpriority"]), 6).alias("share"), F.round(rel.relative_to_max(F.col("n"), ["o_orderpriority"]), 6).alias("rel"))


@query("a10_ordered_list", sql("SELECT region, species, array_to_string(list_sort(list(DISTINCT yr)), ',') AS years FROM survey GROUP BY ALL", "survey"))
def _(spark, d):
    return survey(spark, d).groupBy(*POP).agg(F.array_join(F.array_sort(F.collect_set("yr")), ",").alias("years"))


@query("a11_w09_nth_from_end", sql("SELECT region, species, yr, site FROM optima QUALIFY row_number() OVER (PARTITION BY region, species ORDER BY yr DESC) = 2", "optima"))
def _(spark, d):
    return rel.nth_from_end(optima(spark, d), POP, "yr", 2).select("region", "species", "yr", "site")


@query("a12_any_worst", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, max(o_orderpriority) AS worst FROM orders GROUP BY 1")
def _(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.max("o_orderpriority").alias("worst"))


@query("a13_annual_mean", sql("SELECT site, yr, round(avg(v) + 1e-9, 4) AS annual FROM daily GROUP BY ALL", "daily"))
def _(spark, d):
    from .proxy import daily

    return daily(spark, d).groupBy("site", "yr").agg(r4(F.avg("v") + 1e-9).alias("annual"))


@query("a17_total_row", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'Total', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rel.with_total(rows.groupBy("n_name").agg(F.count("*").alias("n")), rows.agg(F.count("*").alias("n")).select(F.lit("Total").alias("n_name"), "n"))


@query("a18_contingency", "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS F, count_if(o_orderstatus = 'O') AS O, count_if(o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("a19_row_sum", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 4) AS total FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r4(F.col("l_quantity") + F.col("l_discount") + F.col("l_tax")).alias("total"))


@query("a20_frequency_quantiles", "SELECT quantile_cont(n, 0.05) AS q05, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.95) AS q95 FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def _(spark, d):
    n = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return exact_quantiles(n, [], "n", {"q05": 0.05, "q50": 0.5, "q95": 0.95})


@query("a21_empty_maximum", "SELECT max(o_totalprice) FILTER (WHERE o_totalprice < 0) AS none, count(*) AS n FROM orders")
def _(spark, d):
    return read(spark, d, "orders").agg(F.max(F.when(F.col("o_totalprice") < 0, F.col("o_totalprice"))).alias("none"), F.count("*").alias("n"))


@query("a22_summary", "SELECT event_type, min(value) AS lo, quantile_cont(value, 0.25) AS q1, median(value) AS med, round(avg(value), 4) AS mean, quantile_cont(value, 0.75) AS q3, max(value) AS hi FROM events GROUP BY 1")
def _(spark, d):
    e = read(spark, d, "events")
    ends = e.groupBy("event_type").agg(F.min("value").alias("lo"), r4(F.avg("value")).alias("mean"), F.max("value").alias("hi"))
    return ends.join(exact_quantiles(e, ["event_type"], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75}), "event_type")


@query("a23_smallest_group_guard", sql("SELECT region, species, yr FROM optima QUALIFY count(*) OVER (PARTITION BY region, species) >= 4", "optima"))
def _(spark, d):
    return rel.at_least(optima(spark, d), POP, 4).select("region", "species", "yr")


# --- windows


@query("w01_exact_lags", sql("SELECT region, species, yr, CASE WHEN yr - lag(yr, 1) OVER w = 1 THEN lag(lat, 1) OVER w END AS lag1, CASE WHEN yr - lag(yr, 2) OVER w = 2 THEN lag(lat, 2) OVER w END AS lag2 FROM optima WINDOW w AS (PARTITION BY region, species ORDER BY yr)", "optima"))
def _(spark, d):
    return optima(spark, d).select("region", "species", "yr", win.exact_lag(F.col("lat"), 1).alias("lag1"), win.exact_lag(F.col("lat"), 2).alias("lag2"))


@query("w02_one_year_steps", sql("SELECT region, count(*) AS n FROM (SELECT region, species, yr - lag(yr) OVER (PARTITION BY region, species ORDER BY yr) AS gap FROM optima) WHERE gap = 1 GROUP BY 1", "optima"))
def _(spark, d):
    gap = optima(spark, d).withColumn("gap", F.col("yr") - F.lag("yr").over(win.by_year()))
    return gap.where("gap = 1").groupBy("region").agg(F.count("*").alias("n"))


@query("w04_d11_time_coordinate", sql("SELECT region, species, yr, round(sum(t) OVER (PARTITION BY region, species ORDER BY yr ROWS UNBOUNDED PRECEDING), 4) AS t_coord FROM (SELECT *, yr - first(yr) OVER (PARTITION BY region, species ORDER BY yr) + 1 + 0.1 AS t FROM optima)", "optima"))
def _(spark, d):
    return win.with_time_coordinate(optima(spark, d)).select("region", "species", "yr", r4("t_coord").alias("t_coord"))


@query("w05_visit_order", sql("SELECT region, species, site, CAST(row_number() OVER (PARTITION BY region, species ORDER BY min(yr), site) AS INTEGER) AS k FROM optima GROUP BY region, species, site", "optima"))
def _(spark, d):
    first = optima(spark, d).groupBy(*POP, "site").agg(F.min("yr").alias("y"))
    return first.select(*POP, "site", F.row_number().over(Window.partitionBy(*POP).orderBy("y", "site")).alias("k"))


@query("w06_segments", sql("SELECT region, species, yr, lat, lead(lat) OVER w AS lat_end, lead(lon) OVER w AS lon_end FROM optima WINDOW w AS (PARTITION BY region, species ORDER BY yr)", "optima"))
def _(spark, d):
    w = win.by_year()
    return optima(spark, d).select("region", "species", "yr", "lat", F.lead("lat").over(w).alias("lat_end"), F.lead("lon").over(w).alias("lon_end"))


@query("w07_partition_totals", sql("SELECT region, species, yr, round(abund / sum(abund) OVER p, 6) AS share, count(*) OVER p AS n FROM optima WINDOW p AS (PARTITION BY region, species)", "optima"))
def _(spark, d):
    w = Window.partitionBy(*POP)
    return optima(spark, d).select("region", "species", "yr", F.round(rel.share(F.col("abund"), POP), 6).alias("share"), F.count("*").over(w).alias("n"))


@query("w08_baseline_year", sql("SELECT region, species, yr, yr - min(yr) OVER (PARTITION BY region, species) + 1 AS idx FROM optima", "optima"))
def _(spark, d):
    return optima(spark, d).select("region", "species", "yr", (F.col("yr") - F.first("yr").over(win.by_year()) + 1).alias("idx"))


@query("w10_decile_bins", "SELECT event_type, bin, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean FROM (SELECT e.event_type, value, CAST(greatest(len(list_filter(c, lambda x: x < value)), 1) AS INTEGER) AS bin FROM events e JOIN (SELECT event_type, list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS c FROM events GROUP BY 1) q USING (event_type)) GROUP BY ALL")
def _(spark, d):
    return win.with_decile(read(spark, d, "events"), "value", ["event_type"]).groupBy("event_type", "bin").agg(F.count("*").alias("n"), r4(F.avg("value") + 1e-9).alias("mean"))


@query("w11_ntile", "SELECT event_type, event_id, CAST(ntile(10) OVER (PARTITION BY event_type ORDER BY value, event_id) AS INTEGER) AS tile FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_type", "event_id", F.ntile(10).over(Window.partitionBy("event_type").orderBy("value", "event_id")).alias("tile"))


@query("w12_global_z", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS z FROM events")
def _(spark, d):
    return win.with_z_score(read(spark, d, "events"), "value").select("event_id", F.round("z", 6).alias("z"))


@query("w13_group_z", sql("SELECT region, species, yr, round((abund - avg(abund) OVER p) / nullif(stddev_samp(abund) OVER p, 0), 6) AS z FROM optima WINDOW p AS (PARTITION BY region, species)", "optima"))
def _(spark, d):
    return optima(spark, d).select("region", "species", "yr", F.round(win.z_score(F.col("abund"), POP), 6).alias("z"))


# --- sorting, sets, reshaping


@query("t01_t02_ordered", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey")
def _(spark, d):
    return read(spark, d, "customer").orderBy(F.abs("c_acctbal").desc(), "c_custkey").select("c_custkey", "c_acctbal")


@query("t03_best_of_each", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey) = 1")
def _(spark, d):
    return rel.first_of_each(read(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("t04_head_two", sql("SELECT region, species, yr FROM optima QUALIFY row_number() OVER (PARTITION BY region, species ORDER BY yr) <= 2", "optima"))
def _(spark, d):
    return rel.first_of_each(optima(spark, d), POP, F.col("yr"), n=2).select("region", "species", "yr")


@query("t05_t06_arg_extremes", "SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS cheapest, arg_max(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY 1")
def _(spark, d):
    """Of orders with the same price the first counts, which is that of the smallest key."""
    known, k, price = F.col("o_orderkey").isNotNull() & F.col("o_totalprice").isNotNull(), F.col("o_orderkey"), F.col("o_totalprice")
    cheapest = F.min_by(k, F.when(known, F.struct(price, k))).alias("cheapest")
    return read(spark, d, "orders").groupBy("o_custkey").agg(cheapest, F.max_by(k, F.when(known, F.struct(price, -k))).alias("dearest"))


@query("t07_shared_order", sql("SELECT o.region, CAST(row_number() OVER (ORDER BY m DESC, region) AS INTEGER) AS k, n FROM (SELECT region, count(*) AS n FROM optima GROUP BY 1) o JOIN (SELECT region, avg(lat) AS m FROM sites GROUP BY 1) s USING (region)", "optima"))
def _(spark, d):
    n = optima(spark, d).groupBy("region").agg(F.count("*").alias("n"))
    m = sites(spark, d).groupBy("region").agg(F.avg("lat").alias("m"))
    return n.join(m, "region").select("region", F.row_number().over(Window.orderBy(F.col("m").desc(), "region")).alias("k"), "n")


@query("u01_union_by_name", "SELECT o_orderkey AS k, o_totalprice AS price, NULL :: DOUBLE AS qty FROM orders UNION ALL SELECT l_orderkey, NULL, l_quantity FROM lineitem")
def _(spark, d):
    a = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return a.unionByName(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("qty")), allowMissingColumns=True)


@query("u02_union_by_position", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).union(read(spark, d, "supplier").select("s_suppkey", "s_name"))


@query("u03_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


@query("u04_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(read(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("u05_distinct_on", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def _(spark, d):
    return rel.first_of_each(read(spark, d, "orders"), ["o_custkey"], F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("r01_unpivot", "SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_quantity', 'l_tax']) AS metric, unnest([l_discount, l_quantity, l_tax]) AS value FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "metric", "value")


@query("r02_pivot", "SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS F_price, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F_key, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS O_price, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O_key FROM orders GROUP BY 1")
def _(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.max("o_totalprice").alias("price"), F.max("o_orderkey").alias("key"))


@query("r03_explode_years", sql("SELECT region, species, CAST(unnest(range(1993, CAST(max(yr) AS BIGINT) + 1)) AS INTEGER) AS yr FROM optima GROUP BY region, species", "optima"))
def _(spark, d):
    return optima(spark, d).groupBy(*POP).agg(F.max("yr").alias("m")).select(*POP, F.explode(F.sequence(F.lit(1993), "m")).alias("yr"))


@query("r05_ordinal", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3 END AS ord FROM customer")
def _(spark, d):
    levels = {"BUILDING": 1, "AUTOMOBILE": 2, "MACHINERY": 3}
    return read(spark, d, "customer").select("c_custkey", F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[F.col("c_mktsegment")].alias("ord"))


@query("r06_even_grid", "SELECT event_type, CAST(i AS INTEGER) AS i, round(lo + i * (hi - lo) / 79, 6) AS x FROM (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), range(80) t(i)")
def _(spark, d):
    ends = read(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(79)))).select("event_type", "i", F.round(F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / 79, 6).alias("x"))


@query("r07_endpoints", sql("SELECT region, species, unnest([min(yr), max(yr)]) AS yr FROM optima GROUP BY region, species", "optima"))
def _(spark, d):
    return optima(spark, d).groupBy(*POP).agg(F.array(F.min("yr"), F.max("yr")).alias("y")).select(*POP, F.explode("y").alias("yr"))


# --- scalar functions


@query("f01_strings", r"SELECT p_partkey, p_brand || '_' || p_type AS pasted, replace(p_name, ' ', '.') AS dotted, regexp_extract(p_brand, '([A-Za-z]+)#?(\d+)', 2) AS num, lower(p_type) AS low, printf('%02d', p_size) AS padded, printf('%.1f%%', p_retailprice / 7) AS pct FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.concat_ws("_", "p_brand", "p_type").alias("pasted"), F.regexp_replace("p_name", " ", ".").alias("dotted"), F.regexp_extract("p_brand", r"([A-Za-z]+)#?(\d+)", 2).alias("num"), F.lower("p_type").alias("low"), F.format_string("%02d", "p_size").alias("padded"), F.format_string("%.1f%%", F.col("p_retailprice") / 7).alias("pct"))


@query("f02_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(dayofyear(make_date(year(o_orderdate), 12, 31)) AS INTEGER) AS ndays FROM orders")
def _(spark, d):
    y = F.year("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", y.alias("yr"), scalar.days_in_year(y).alias("ndays"))


@query("f03_math", "SELECT l_orderkey, l_linenumber, CAST(((l_partkey - 1000) % 7 + 7) % 7 AS BIGINT) AS floor_mod, round(atan2(l_tax, l_discount + 0.01), 6) AS ang, sign(l_discount - 0.05) AS sg, greatest(l_tax, l_discount) AS hi, round(1 / (1 + exp(-l_discount)), 6) AS logis FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod(F.col("l_partkey") - 1000, F.lit(7)).alias("floor_mod"), F.round(F.atan2(F.col("l_tax"), F.col("l_discount") + 0.01), 6).alias("ang"), F.signum(F.col("l_discount") - 0.05).alias("sg"), F.greatest("l_tax", "l_discount").alias("hi"), F.round(scalar.logistic(F.col("l_discount")), 6).alias("logis"))


@query("f04_signif", "SELECT o_orderkey, CAST(round_even(o_totalprice / pow(10, floor(log10(o_totalprice)) - 2), 0) * pow(10, floor(log10(o_totalprice)) - 2) AS BIGINT) AS three FROM orders WHERE o_totalprice > 1000")
def _(spark, d):
    return read(spark, d, "orders").where("o_totalprice > 1000").select("o_orderkey", F.round(scalar.signif(F.col("o_totalprice"), 3)).cast("bigint").alias("three"))


@query("f05_p_text", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax / 60 < 0.001 THEN '<0.001' ELSE printf('%.3f', l_tax / 60) END AS p FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.p_text(F.col("l_tax") / 60).alias("p"))
