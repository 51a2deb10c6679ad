"""Regions split at barriers, level by level: every round looks at all groups of all regions at once.

A round is grouping, windows over distinct coordinates and joins; only its decisions, one row a group that splits, and the
places of those groups are written for the next one.  Distinct coordinates are rounded to a thousandth of a degree, so a window
holds 180,001 latitudes or 360,001 longitudes of a group at most, however many sites it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import line_km
from ..sources.staging import staged
from .spatial import LARGE_LAND_KM2, NEARBY_LAND_KM

NODE = ["region", "node"]

#: Points at which land is looked for between two sides: along the gap, along the shared latitudes.
ACROSS, ALONG = 10, 20

#: The share of a region's span by which a group's centre must be off its centre to be named after that direction.
OFF_CENTRE = 0.15


def split_regions(
    sites: DataFrame, land: DataFrame, step: float, lat_gap: float = 1.0, times: float = 4.0, lon_gap: float = 0.30,
    overlap: float = 0.30, land_share: float = 0.30, least: int = 5,
) -> DataFrame:
    """(region, site, part, suffix): groups of the sites of each region behind barriers, by repeated splits.

    ``sites`` has region, site, lon, lat; sites at one place count once, those without coordinates are left out.  ``land``
    is that of ``sea.land_pieces``.  A group splits at its widest gap of latitude if that is at least ``lat_gap`` degrees and
    ``times`` the median gap and the centres of both sides belong to different land masses; a region without land
    is open water, where they do.  Else it splits at its widest gap of longitude if that is at least ``lon_gap``, both sides share
    ``overlap`` of their latitudes and ``land_share`` of the gap between them is land.  Both sides keep ``least`` places.  Ties of
    width go to the smaller coordinate.

    Parts are numbered from 0, lower latitudes and western sides first.  The sides of a gap of longitude are named W and E,
    other groups after the direction of their centre from the region's (C where it lies there); equal names of a region get
    the numbers 1, 2, ... from the second on, and the only group of a region has no name.
    """
    own = sites.select(F.col("region").cast("int").alias("region"), F.col("site").cast("bigint").alias("site"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    own = own.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    cells = staged(land.select(F.col("region").cast("int").alias("region"), "cx", "cy", "piece", "area_km2"))
    places = staged(own.select("region", "lon", "lat").distinct().withColumns({"node": F.lit(""), "tag": F.lit("")}))
    whole = []
    while True:
        by_lat = staged(_apart(places, _wide(places, "lat", least).where((F.col("gap") >= lat_gap) & (F.col("gap") >= times * F.col("typical"))), cells, step))
        rest = places.join(by_lat.select(*NODE), NODE, "left_anti")
        by_lon = _doubled(rest, _wide(rest, "lon", least).where(F.col("gap") >= lon_gap), cells, step, overlap, land_share)
        cuts = staged(by_lat.withColumn("axis", F.lit("lat")).unionByName(by_lon.withColumn("axis", F.lit("lon"))))
        whole.append(places.join(cuts.select(*NODE), NODE, "left_anti"))
        if cuts.isEmpty():
            break
        upper = F.when(F.col("axis") == "lat", F.col("lat") > F.col("middle")).otherwise(F.col("lon") > F.col("middle"))
        tag = F.when(F.col("axis") == "lat", F.col("tag")).when(upper, "E").otherwise("W")
        node = F.concat("node", F.when(upper, "1").otherwise("0"))
        places = staged(places.join(cuts, NODE).select("region", "lon", "lat", node.alias("node"), tag.alias("tag")))
    placed = staged(reduce(DataFrame.unionByName, whole))
    return own.join(placed.select(*NODE, "lon", "lat"), ["region", "lon", "lat"]).join(_names(placed), NODE).select("region", "site", "part", "suffix")


def _wide(places: DataFrame, axis: str, least: int) -> DataFrame:
    """The widest gap of each node that leaves enough places on both sides: low, high, middle, gap and the median gap ``typical``."""
    along = Window.partitionBy(*NODE).orderBy("low")
    spots = places.groupBy(*NODE, F.round(axis, 3).alias("low")).agg(F.count("*").alias("_n"))
    gaps = spots.withColumns({"high": F.lead("low").over(along), "_below": F.sum("_n").over(along)}).withColumn("gap", F.col("high") - F.col("low"))
    widest = F.max(F.struct("gap", (-F.col("low")).alias("first"), "low", "high", "_below")).alias("w")
    out = gaps.groupBy(*NODE).agg(widest, F.median("gap").alias("typical"), F.sum("_n").alias("_n"))
    out = out.where((F.col("w._below") >= least) & (F.col("_n") - F.col("w._below") >= least))
    return out.select(*NODE, "w.low", "w.high", ((F.col("w.low") + F.col("w.high")) / 2).alias("middle"), "w.gap", "typical")


def _apart(places: DataFrame, wide: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """(region, node, middle) where the centres of both sides belong to different land masses.

    A centre belongs to the nearest large land within reach, else to the nearest of any size; nearest is by degrees, ties go
    to the smaller cell.  Each land cell of a region meets the centres of that region's wide gaps alone, and only
    the least by centre are shuffled.
    """
    side = F.col("lat") > F.col("middle")
    centres = places.join(wide.select(*NODE, "middle"), NODE).groupBy(*NODE, "middle", side.alias("upper")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    x, y = (F.col("cx") + 0.5) * step, (F.col("cy") + 0.5) * step
    square = F.pow(x - F.col("lon"), 2) + F.pow(y - F.col("lat"), 2)
    near = F.struct(square.alias("d"), "cx", "cy", "piece", line_km(x, y, F.col("lon"), F.col("lat")).alias("km"))
    met = centres.join(cells, "region", "left").groupBy(*NODE, "middle", "upper").agg(
        F.min(F.when(F.col("piece").isNotNull(), near)).alias("any"), F.min(F.when(F.col("area_km2") >= LARGE_LAND_KM2, near)).alias("large")
    )
    mass = F.when(F.col("large.km") <= NEARBY_LAND_KM, F.col("large.piece")).otherwise(F.col("any.piece"))
    both = met.groupBy(*NODE, "middle").agg(F.min(mass).alias("a"), F.max(mass).alias("b"))
    return both.where(F.coalesce(F.col("a") != F.col("b"), F.lit(True))).select(*NODE, "middle")


def _doubled(places: DataFrame, wide: DataFrame, cells: DataFrame, step: float, overlap: float, land_share: float) -> DataFrame:
    """(region, node, middle) where both sides of the gap share latitudes and land lies between them."""
    west, lat = F.col("lon") <= F.col("middle"), F.col("lat")
    of = lambda f, w: f(F.when(west if w else ~west, lat))
    sides = places.join(wide.select(*NODE, "middle", F.col("low").alias("from"), F.col("high").alias("to")), NODE).groupBy(*NODE, "middle", "from", "to").agg(
        F.greatest(of(F.min, True), of(F.min, False)).alias("south"), F.least(of(F.max, True), of(F.max, False)).alias("north"), (F.max(lat) - F.min(lat)).alias("span")
    )
    sides = sides.where((F.col("north") > F.col("south")) & ((F.col("north") - F.col("south")) / F.col("span") >= overlap))

    def spread(a: str, b: str, i: Column, n: int) -> Column:
        return F.floor((F.col(a) + i * ((F.col(b) - F.col(a)) / (n - 1))) / step)

    looked = sides.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(ACROSS * ALONG - 1))))
    looked = looked.select(*NODE, "middle", spread("from", "to", F.col("_i") % ACROSS, ACROSS).alias("cx"), spread("south", "north", F.floor(F.col("_i") / ACROSS), ALONG).alias("cy"))
    found = looked.join(cells.select("region", "cx", "cy", F.lit(1).alias("_land")), ["region", "cx", "cy"], "left")
    share = found.groupBy(*NODE, "middle").agg((F.count("_land") / F.count("*")).alias("share"))
    return share.where(F.col("share") >= land_share).select(*NODE, "middle")


def _names(placed: DataFrame) -> DataFrame:
    """(region, node, part, suffix) of the groups that are left."""
    w = Window.partitionBy("region")
    centre = placed.groupBy("region").agg(F.avg("lon").alias("_x"), F.avg("lat").alias("_y"), (F.max("lon") - F.min("lon")).alias("_w"), (F.max("lat") - F.min("lat")).alias("_h"))
    groups = placed.groupBy(*NODE).agg(F.max("tag").alias("tag"), F.avg("lon").alias("x"), F.avg("lat").alias("y")).join(centre, "region")
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    ns = F.when(dy > OFF_CENTRE * F.col("_h"), "N").when(dy < -OFF_CENTRE * F.col("_h"), "S").otherwise("")
    ew = F.when(dx > OFF_CENTRE * F.col("_w"), "E").when(dx < -OFF_CENTRE * F.col("_w"), "W").otherwise("")
    towards = F.when(F.concat(ns, ew) == "", "C").otherwise(F.concat(ns, ew))
    name = F.when(F.count("*").over(w) == 1, "").when(F.col("tag") != "", F.col("tag")).otherwise(towards)
    # The path to a group, 0 for the lower side and 1 for the upper, is the order of parts.
    groups = groups.withColumns({"part": F.row_number().over(w.orderBy("node")) - 1, "_name": name})
    again = F.row_number().over(Window.partitionBy("region", "_name").orderBy("node")) - 1
    return groups.withColumn("_again", again).select(*NODE, "part", F.concat("_name", F.when(F.col("_again") > 0, F.col("_again").cast("string")).otherwise("")).alias("suffix"))


# --- what is done with a split


def proposed(split: DataFrame) -> DataFrame:
    """The regions that have more than one group."""
    return split.groupBy("region").agg((F.max("part") + 1).alias("groups")).where("groups > 1")


def unconfirmed(split: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Regions whose split was detected but is not in the list of recognised barriers (region)."""
    return proposed(split).join(confirmed.select(F.col("region").cast("int").alias("region")), "region", "left_anti")


def confirmed_plan(split: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """The rows of regions that split and whose barrier is recognised; None confirms every split."""
    plan = split.join(proposed(split).select("region"), "region", "left_semi")
    return plan if confirmed is None else plan.join(unconfirmed(split, confirmed).select("region"), "region", "left_anti")


def viability(plan: DataFrame, survey: DataFrame, least_sites: int = 5, least_years: int = 4) -> DataFrame:
    """For each group of a plan: its sites, years, years with enough sites, the median and least number of sites a year, and whether it can be fitted.

    ``survey`` has region, site, yr.  A group fits (OK) with ``least_years`` years of ``least_sites`` sites, is MARGINAL with one less, else NO.
    """
    seen = survey.select(F.col("region").cast("int").alias("region"), F.col("site").cast("bigint").alias("site"), "yr").distinct()
    rows = plan.join(seen, ["region", "site"])
    years = rows.groupBy("region", "part", "suffix", "yr").agg(F.count("*").alias("n"))
    by_year = years.groupBy("region", "part", "suffix").agg(F.count("*").alias("n_years"), F.median("n").alias("median_sites"), F.min("n").alias("min_sites"), F.count_if(F.col("n") >= least_sites).alias("full_years"))
    n = rows.groupBy("region", "part").agg(F.countDistinct("site").alias("n_sites"))
    fit = F.when(F.col("full_years") >= least_years, "OK").when(F.col("full_years") >= least_years - 1, "MARGINAL").otherwise("NO")
    return by_year.join(n, ["region", "part"]).withColumn("fit", fit)


def to_refit(plan: DataFrame, survey: DataFrame, least_sites: int = 5, least_years: int = 4) -> DataFrame:
    """Species of a plan's regions with the groups that they occupy and whether these are several, so that the species is fitted anew for each.

    ``survey`` has region, species, site, yr.  A species occupies a group with ``least_years`` years of ``least_sites`` sites.
    """
    seen = survey.select(F.col("region").cast("int").alias("region"), "species", F.col("site").cast("bigint").alias("site"), "yr").distinct()
    years = plan.join(seen, ["region", "site"]).groupBy("region", "species", "part", "yr").agg(F.count("*").alias("n")).where(F.col("n") >= least_sites)
    held = years.groupBy("region", "species", "part").agg(F.count("*").alias("n")).where(F.col("n") >= least_years)
    out = held.groupBy("region", "species").agg(F.count("*").alias("n_groups"), F.array_join(F.array_sort(F.collect_list("part")), ",").alias("groups"))
    return out.withColumn("spans_multiple", F.col("n_groups") > 1)
