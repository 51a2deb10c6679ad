"""The domain's tables, taken from the order tables: Spark and SQL side by side.

region = nation of the supplier, species = type of the part, population = both, site = supplier,
year = year of shipment, abundance = quantity, temperature = price on the day of shipment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..operators.relational import first_of_each

POP = ["region", "species"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, d: str) -> DataFrame:
    """One row per observation; both dimension tables may grow, so Spark picks the joins."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("site"), F.col("l_quantity").alias("abund"), F.col("l_extendedprice").alias("temp"), F.to_date("l_shipdate").alias("day"))
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("species"))
    where = read(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("region"))
    return li.join(part, "l_partkey").join(where, "site").withColumn("yr", F.year("day"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    lat, lon = ((s * 37 % 121) - 60).cast("double"), ((s * 53 % 361) - 180).cast("double")
    return read(spark, d, "supplier").select(s.alias("site"), F.col("s_nationkey").alias("region"), lat.alias("lat"), lon.alias("lon"))


def site_years(spark: SparkSession, d: str) -> DataFrame:
    return survey(spark, d).groupBy("region", "species", "yr", "site").agg(F.sum("abund").alias("abund"))


def optima(spark: SparkSession, d: str) -> DataFrame:
    """The site of the largest abundance of each population and year, with its coordinates."""
    best = first_of_each(site_years(spark, d), ["region", "species", "yr"], F.col("abund").desc(), F.col("site"))
    return best.join(sites(spark, d).drop("region"), "site")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """The mean value of each site and day."""
    return survey(spark, d).groupBy("site", "day", "yr").agg(F.avg("temp").alias("v"))


QUANTILES = {"q2_5": 0.025, "q5": 0.05, "q10": 0.1, "q50": 0.5, "q70": 0.7, "q90": 0.9, "q95": 0.95, "q97_5": 0.975}


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    s = survey(spark, d).select("species", "temp")
    return s.groupBy("species").agg(F.avg("temp").alias("mean")).join(exact_quantiles(s, ["species"], "temp", QUANTILES), "species")


CTE = {
    "survey": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS site, l_quantity AS abund, l_extendedprice AS temp, CAST(l_shipdate AS DATE) AS day, CAST(year(l_shipdate) AS INTEGER) AS yr, p_type AS species, s_nationkey AS region FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey",
    "sites": "SELECT s_suppkey AS site, s_nationkey AS region, CAST((s_suppkey * 37 % 121) - 60 AS DOUBLE) AS lat, CAST((s_suppkey * 53 % 361) - 180 AS DOUBLE) AS lon FROM supplier",
    "site_years": "SELECT region, species, yr, site, sum(abund) AS abund FROM survey GROUP BY ALL",
    "optima": "SELECT y.*, lat, lon FROM (SELECT * FROM site_years QUALIFY row_number() OVER (PARTITION BY region, species, yr ORDER BY abund DESC, site) = 1) y JOIN sites USING (site, region)",
    "daily": "SELECT site, day, yr, avg(temp) AS v FROM survey GROUP BY ALL",
    "thresholds": "SELECT species, avg(temp) AS mean, " + ", ".join(f"quantile_cont(temp, {q}) AS {n}" for n, q in QUANTILES.items()) + " FROM survey GROUP BY species",
}
NEEDS = {"survey": (), "sites": (), "site_years": ("survey",), "optima": ("survey", "sites", "site_years"), "daily": ("survey",), "thresholds": ("survey",)}


def sql(body: str, *names: str, **more: str) -> str:
    """A query over the named tables of the domain, and over further ones given by their SQL."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*NEEDS[n], n) if x not in wanted]
    tables = [f"{n} AS ({CTE[n]})" for n in wanted] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(tables)} {body}" if tables else body
