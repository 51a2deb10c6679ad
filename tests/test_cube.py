"""Series from a cube laid out by tile and year: equal to those of the plain cube, and files read follow the sites."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import exposure
from tidemark.sources import cube as cubes

CELLS, START = 32, datetime.date(2000, 12, 1)


@pytest.fixture(scope="module")
def plain(spark):
    """32 x 32 cells about the origin, 60 days over two years; some cells lack days, some lack all."""
    cell = spark.range(CELLS * CELLS).select((F.col("id") % CELLS - 16).alias("cx"), (F.floor(F.col("id") / CELLS) - 16).alias("cy"))
    day = spark.range(60).select(F.date_add(F.lit(START), F.col("id").cast("int")).alias("day"), "id")
    gap = ((F.col("cx") * 7 + F.col("cy") * 3 + F.col("id")) % 5 == 0) & (F.col("cx") % 3 == 0) | ((F.col("cx") + F.col("cy") * 2) % 7 == 0)
    return cell.crossJoin(day).select("cx", "cy", "day", F.when(~gap, F.col("cx") + F.col("cy") * 10.0 + F.col("id") / 100).alias("value"))


@pytest.fixture(scope="module")
def laid(plain, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube") / "c")
    cubes.lay_out(plain, path, 8)
    return path


def rows(df):
    return sorted((r["site"], r["day"], None if r["v"] is None else round(r["v"], 9), r["level"]) for r in df.collect())


def scans(node):
    """The metrics of each scan of an executed plan."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return scans(node.plan())
    if name == "FileSourceScanExec":
        return [(node.simpleString(1000), int(node.metrics().get("numFiles").get().value()))]
    return [s for i in range(node.children().size()) for s in scans(node.children().apply(i))]


@pytest.mark.parametrize("reject", [True, False])
def test_series_equal_those_of_the_plain_cube(spark, plain, laid, reject):
    sites = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(-16, -16), (0, 0), (7, 8), (3, -5), (-2, 1), (15, 15), (6, 11), (40, 2)])], "site long, cx long, cy long")
    want = exposure.site_series(sites, plain, plain.select("day").distinct(), reject=reject)
    got = rows(cubes.series(sites, laid, size=8, reject=reject))
    assert got == rows(want) and got
    year = cubes.series(sites, laid, years=[2001], size=8, reject=reject)
    assert rows(year) == rows(exposure.site_series(sites, plain.where("year(day) = 2001"), plain.where("year(day) = 2001").select("day").distinct(), reject=reject))


@pytest.mark.parametrize("at, years, files", [([(-12, -12)], None, 2), ([(-12, -12)], [2001], 1), ([(-12, -12), (4, 4), (5, 5)], None, 4), ([(0, 0)], None, 4)])
def test_only_tiles_of_the_sites_are_read(spark, laid, at, years, files):
    """32 files in all, two a tile; a site on the corner of tiles needs the two along its diagonal."""
    sites = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "site long, cx long, cy long")
    around = sites.select(F.explode(F.array(F.lit(-2), F.lit(-1), F.lit(0), F.lit(1), F.lit(2))).alias("o"), "cx", "cy").select((F.col("cx") + F.col("o")).alias("cx"), (F.col("cy") + F.col("o")).alias("cy"))
    df = cubes.values(around, laid, years, 8)
    df.collect()
    scan = [s for s in scans(df._jdf.queryExecution().executedPlan()) if "tile" in s[0]]
    assert len(scan) == 1 and "dynamicpruning" in scan[0][0]
    assert scan[0][1] == files


def test_series_prune(spark, laid):
    text = cubes.series(spark.createDataFrame([(1, 4, 4)], "site long, cx long, cy long"), laid, size=8)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text


def test_odd_rows(spark, tmp_path):
    day = datetime.date(2001, 1, 1)
    odd = spark.createDataFrame([(1, 1, day, 2.0), (1, 2, day, None), (1, 3, None, 1.0), (1 << 20, 0, day, 1.0), (None, 0, day, 1.0)], "cx long, cy long, day date, value double")
    cubes.lay_out(odd, str(tmp_path / "c"))
    sites = spark.createDataFrame([(1, 1, 1), (2, 1 << 20, 0), (3, None, 0)], "site long, cx long, cy long")
    assert rows(cubes.series(sites, str(tmp_path / "c"))) == [(1, day, 2.0, 0)]
