"""Searches over sea cells that no task needs a whole region for: connected pieces across tiles, and distances up to a bound.

A cell is a pair of integers (cx, cy) of a region.  Cells lie in square tiles of TILE x TILE; a task holds one tile, with as
wide a margin of its neighbours as the question needs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import KM_PER_DEGREE_LINE, line_km
from ..sources.staging import shared_folder, ship, staged
from .relational import first_of_each, near_pairs, nearest, within_km
from .spatial import components, neighbours, sea_distances

#: Cells along the side of a tile.
TILE = 64


def tile_of(c: Column, size: int = TILE) -> Column:
    return F.floor(c / size).cast("bigint")


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the least node that they reach.

    Each round takes the least root among a node's neighbours, and then the root of that root; rounds are written to the shared
    folder, which cuts the lineage, and end when nothing changes.
    """
    folder = shared_folder(edges.sparkSession)
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{folder}/edges")
    roots = staged(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), f"{folder}/0")
    k = 0
    while True:
        k += 1
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        new = roots.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("jumped"))
        new = new.join(jump, "next").select("node", F.least("next", "jumped").alias("new"), "root")
        new = staged(new, f"{folder}/{k}")
        roots = new.select("node", F.col("new").alias("root"))
        if not new.where(F.col("new") != F.col("root")).limit(1).count():
            return roots


def pieces(cells: DataFrame, size: int = TILE) -> DataFrame:
    """(region, cx, cy, root): the eight-connected pieces of the cells of each region, named by their least cell (struct cx, cy).

    Tiles are labelled on their own; labels that touch across a border of tiles are then joined.
    """
    own = cells.select(F.col("region").cast("int").alias("region"), F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy")).distinct()
    own = own.withColumns({"tx": tile_of(F.col("cx"), size), "ty": tile_of(F.col("cy"), size)})
    ship(cells.sparkSession)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers = components(set(zip(pdf.cx.tolist(), pdf.cy.tolist(), strict=True)))
        first: dict[int, tuple] = {}
        for cell in sorted(numbers):
            first.setdefault(numbers[cell], cell)
        rows = [(pdf.region.iloc[0], x, y, *first[k]) for (x, y), k in numbers.items()]
        return pd.DataFrame(rows, columns=["region", "cx", "cy", "lx", "ly"])

    labelled = staged(own.groupBy("region", "tx", "ty").applyInPandas(label, "region int, cx bigint, cy bigint, lx bigint, ly bigint"))
    labelled = labelled.select("region", "cx", "cy", F.struct("region", F.col("lx").alias("cx"), F.col("ly").alias("cy")).alias("label"))
    x, y = F.pmod("cx", F.lit(size)), F.pmod("cy", F.lit(size))
    rim = labelled.where((x == 0) | (x == size - 1) | (y == 0) | (y == size - 1))
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in ((1, -1), (1, 0), (1, 1), (0, 1))]))
    ahead = rim.withColumn("m", moves).select("region", (F.col("cx") + F.col("m.x")).alias("cx"), (F.col("cy") + F.col("m.y")).alias("cy"), F.col("label").alias("a"))
    touching = ahead.join(rim.withColumnRenamed("label", "b"), ["region", "cx", "cy"]).where(F.col("a") != F.col("b")).select("a", "b")
    roots = least_labels(touching)
    joined = labelled.join(roots, labelled["label"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "label"))
    return joined.select("region", "cx", "cy", F.struct(F.col("_root.cx").alias("cx"), F.col("_root.cy").alias("cy")).alias("root"))


def nearest_cells(points: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """``points`` (region, lon, lat, more) with sx, sy: the nearest cell of the region by degrees, the smaller of equals; null without any."""
    named = points.withColumn("_id", F.xxhash64("region", "lon", "lat"))
    places = named.select("region", "_id", "lon", "lat").distinct()
    centres = cells.select(F.col("region").cast("int").alias("region"), F.col("cx").alias("sx"), F.col("cy").alias("sy")).distinct().withColumns({"slon": (F.col("sx") + 0.5) * step, "slat": (F.col("sy") + 0.5) * step})
    square = F.pow(F.col("lon") - F.col("slon"), 2) + F.pow(F.col("lat") - F.col("slat"), 2)
    found = first_of_each(near_pairs(places, centres, ["region"]), ["region", "_id"], F.round(square, 12), F.col("sx"), F.col("sy"))
    return named.join(found.select("region", "_id", "sx", "sy"), ["region", "_id"], "left").drop("_id")


def distances_within(starts: DataFrame, cells: DataFrame, targets: DataFrame, step: float, least_km: float = 100.0, size: int = TILE) -> DataFrame:
    """(region, sx, sy, cx, cy, km): the least-cost distances by sea from each start to the targets at most its ``most`` km away.

    ``starts`` has region, sx, sy (sea cells) and most, ``cells`` the sea and ``targets`` those of its cells that are asked for (region,
    cx, cy).  A path of some length stays within that distance of its start, so a task holds a tile of starts and the sea
    around it up to their bound; bounds are dealt with by powers of two of ``least_km``.
    """
    level = F.greatest(F.ceil(F.log2(F.col("most") / least_km)), F.lit(0)).cast("int")
    asked = starts.groupBy(F.col("region").cast("int").alias("region"), F.col("sx").cast("bigint").alias("sx"), F.col("sy").cast("bigint").alias("sy")).agg(F.max("most").alias("most"))
    asked = asked.withColumns({"level": level, "tx": tile_of(F.col("sx"), size), "ty": tile_of(F.col("sy"), size)})
    tiles = asked.groupBy("region", "level", "tx", "ty").agg(F.max("most").alias("bound"), F.max(F.abs(F.col("sy") + 0.5) * step).alias("top"))
    high = F.ceil(F.col("bound") / (step * KM_PER_DEGREE_LINE)) + 1
    narrow = F.cos(F.radians(F.least(F.col("top") + F.col("bound") / KM_PER_DEGREE_LINE + step, F.lit(89.0))))
    wide = F.least(F.ceil(F.col("bound") / (step * KM_PER_DEGREE_LINE * narrow)) + 1, F.lit(math.ceil(360 / step)))
    span = lambda t, reach: F.explode(F.sequence(tile_of(F.col(t) * size - reach, size), tile_of((F.col(t) + 1) * size - 1 + reach, size)))
    # Which tiles of water each tile of starts looks at: rows in proportion to tiles and bounds, not to cells.
    views = tiles.withColumns({"_high": high, "_wide": wide})
    views = views.withColumn("wx", span("tx", F.col("_wide"))).withColumn("wy", span("ty", F.col("_high"))).select("region", "level", "tx", "ty", "wx", "wy")
    flagged = cells.select(F.col("region").cast("int").alias("region"), F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), F.lit(False).alias("target"))
    wanted = targets.select(F.col("region").cast("int").alias("region"), F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), F.lit(True).alias("target"))
    water = flagged.union(wanted).groupBy("region", "cx", "cy").agg(F.max("target").alias("target"), F.min("target").alias("aside"))
    water = water.where("not aside").drop("aside").withColumns({"wx": tile_of(F.col("cx"), size), "wy": tile_of(F.col("cy"), size)})
    seen = views.join(water, ["region", "wx", "wy"]).select("region", "level", "tx", "ty", "cx", "cy", "target")
    seen = seen.toDF(*seen.columns)  # columns of its own: views come from the starts
    ship(starts.sparkSession)

    def search(key, own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        graph = neighbours(set(zip(around.cx.tolist(), around.cy.tolist(), strict=True)), step)
        ends = set(zip(around.cx[around.target].tolist(), around.cy[around.target].tolist(), strict=True))
        out = []
        for sx, sy, most in zip(own.sx.tolist(), own.sy.tolist(), own.most.tolist(), strict=True):
            out += [(key[0], sx, sy, *c, d) for c, d in sea_distances((sx, sy), graph, most).items() if c in ends]
        return pd.DataFrame(out, columns=["region", "sx", "sy", "cx", "cy", "km"])

    by = ["region", "level", "tx", "ty"]
    return asked.groupBy(*by).cogroup(seen.groupBy(*by)).applyInPandas(search, "region int, sx bigint, sy bigint, cx bigint, cy bigint, km double")


def until_found(starts: DataFrame, cells: DataFrame, targets: DataFrame, step: float, wanted: DataFrame | None = None, size: int = TILE) -> DataFrame:
    """(region, sx, sy, cx, cy, km): what ``distances_within`` finds in the first round that finds any target for a start.

    ``starts`` has region, sx, sy and most, the bound of the first round, which doubles from round to round.  With ``wanted`` (region, sx,
    sy, cx, cy) a start is done when its own targets are all found, and only those are returned.  After the first round, starts
    whose piece of sea holds no (more wanted) target are left alone, so rounds end.
    """
    at, to = ["region", "sx", "sy"], ["region", "cx", "cy"]
    pairs = None if wanted is None else staged(wanted.select(F.col("region").cast("int").alias("region"), "sx", "sy", "cx", "cy").distinct())
    left = starts.groupBy(F.col("region").cast("int").alias("region"), "sx", "sy").agg(F.max("most").alias("most"))
    left, found, piece = staged(left), None, None
    while left.limit(1).count():
        got = distances_within(left, cells, targets, step, size=size)
        got = staged(got if pairs is None else got.join(pairs, [*at, "cx", "cy"], "left_semi"))
        found = got if found is None else found.union(got)
        if pairs is None:
            left = staged(left.join(got, at, "left_anti"))
        else:
            pairs = staged(pairs.join(got, [*at, "cx", "cy"], "left_anti"))
            left = staged(left.join(pairs, at, "left_semi"))
        if piece is None and left.limit(1).count():
            piece = staged(pieces(cells, size))
            of_start = piece.select("region", F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("root").alias("own"))
            if pairs is None:
                held = targets.select(F.col("region").cast("int").alias("region"), "cx", "cy").join(piece, to).select("region", F.col("root").alias("own")).distinct()
                left = staged(left.join(of_start, at).join(held, ["region", "own"], "left_semi").drop("own"))
            else:
                pairs = staged(pairs.join(of_start, at).join(piece, to).where(F.col("own") == F.col("root")).drop("own", "root"))
                left = staged(left.join(pairs, at, "left_semi"))
        left = left.withColumn("most", 2 * F.col("most"))
    empty = "region int, sx bigint, sy bigint, cx bigint, cy bigint, km double"
    return starts.sparkSession.createDataFrame([], empty) if found is None else found


def land_pieces(grid: DataFrame, step: float, size: int = TILE) -> DataFrame:
    """(region, cx, cy, piece, area_km2) of the land cells (z >= 0): pieces of a region are numbered in the order of their least cells."""
    cells = pieces(grid.where("z >= 0"), size).withColumn("_km2", (step * KM_PER_DEGREE_LINE) ** 2 * F.cos(F.radians((F.col("cy") + 0.5) * step)))
    cells = staged(cells)
    areas = cells.groupBy("region", "root").agg(F.sum("_km2").alias("area_km2"))
    numbered = areas.withColumn("piece", F.row_number().over(Window.partitionBy("region").orderBy("root")) - 1)  # one row a piece
    return cells.join(numbered, ["region", "root"]).select("region", "cx", "cy", "piece", "area_km2")


#: What a density is of where a region has fewer sampled sites.
LEAST_SAMPLES = 3


def densities(band: DataFrame, samples: DataFrame, k: int = 10) -> DataFrame:
    """``band`` (region, cx, cy, clon, clat) with density: the mean of 1 / (d + 0.01) over the k nearest sampled sites, scaled to 0..1 in the region.

    ``samples`` has region, slon, slat; d is in degrees.  A region with fewer than LEAST_SAMPLES sites has density 1 everywhere.
    """
    sites = samples.select(F.col("region").cast("int").alias("region"), "slon", "slat").dropna()
    sites = sites.withColumn("site", F.struct("slon", "slat", F.monotonically_increasing_id()))
    near = nearest(band.select("region", F.struct("cx", "cy").alias("point"), F.col("clon").alias("lon"), F.col("clat").alias("lat")), sites, "region", k)
    raw = near.groupBy("region", "point").agg(F.avg(1 / (F.sqrt("d2") + 0.01)).alias("_raw"))
    ends = raw.groupBy("region").agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    known = sites.groupBy("region").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_SAMPLES)
    scaled = raw.join(ends.join(known, "region"), "region").select("region", "point.cx", "point.cy", ((F.col("_raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).alias("density"))
    return band.join(scaled, ["region", "cx", "cy"], "left").withColumn("density", F.coalesce("density", F.lit(1.0)))


def relocated(
    optima: DataFrame, grid: DataFrame, samples: DataFrame, step: float, shallow: float = 30.0, band: float = 10.0, half: float = 1.0,
    buffer_km: float = 100.0, weight: float = 0.5, k: int = 10, lat_band: float = 1 / 12, size: int = TILE,
) -> DataFrame:
    """Moves optima off the habitat to a cell of the depth band: region, id, lon, lat, status, dist_km, lat_ddeg, lat_dkm, depth_m, density_score.

    ``optima`` has region, id, lon, lat; ``grid`` region, cx, cy, z (negative: sea); ``samples`` region, slon, slat.  An optimum on
    sea no deeper than ``shallow`` stays (``ok``).  Otherwise it enters the sea at the nearest sea cell, and the band cells
    within ``buffer_km`` by sea, doubled until there are any, compete: those within ``lat_band`` degrees of its latitude, or
    else those of the least change of it, by (1 - weight) * (1 - d / max d) + weight * density; equals go to the smaller cell.
    Where no band cell can be reached by sea the straight line counts.  In a region without band cells optima stay ``unplaced``.
    """
    cells = grid.select(F.col("region").cast("int").alias("region"), F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), "z")
    own = optima.select(F.col("region").cast("int").alias("region"), "id", "lon", "lat").withColumns({"cx": F.floor(F.col("lon") / step), "cy": F.floor(F.col("lat") / step)})
    own = staged(own.join(cells, ["region", "cx", "cy"], "left").drop("cx", "cy").withColumn("fine", F.coalesce((F.col("z") < 0) & (F.col("z") >= -shallow), F.lit(False))))
    sea = cells.where("z < 0")
    reef = sea.where(F.abs(-F.col("z") - band) <= half).withColumns({"clon": (F.col("cx") + 0.5) * step, "clat": (F.col("cy") + 0.5) * step})
    reef = staged(densities(reef, samples, k))
    held = reef.select("region").distinct()
    need = own.where("not fine").join(held, "region", "left_semi").select("region", "id", "lon", "lat")

    entering = staged(nearest_cells(need, sea, step))
    found = until_found(entering.where("sx is not null").withColumn("most", F.lit(float(buffer_km))), sea, reef, step, size=size)
    by_sea = entering.join(found, ["region", "sx", "sy"]).select("region", "id", "lon", "lat", "cx", "cy", "km")
    # Straight lines for the others, in rounds of doubled distance as well.
    places = reef.select("region", "cx", "cy", F.col("clon").alias("slon"), F.col("clat").alias("slat"))
    left, choices, reach = staged(need.join(by_sea.select("region", "id").distinct(), ["region", "id"], "left_anti")), by_sea, float(buffer_km)
    while left.limit(1).count():
        got = staged(within_km(left, places, ["region"], reach, line_km).select("region", "id", "lon", "lat", "cx", "cy", "km"))
        choices = choices.union(got)
        left, reach = staged(left.join(got, ["region", "id"], "left_anti")), 2 * reach

    choices = choices.join(reef.select("region", "cx", "cy", "clon", "clat", F.col("z").alias("depth_m"), "density"), ["region", "cx", "cy"])
    one = Window.partitionBy("region", "id")
    choices = choices.withColumn("_off", F.abs(F.col("clat") - F.col("lat"))).withColumn("_least", F.min("_off").over(one))
    choices = choices.where((F.col("_off") <= lat_band) | (F.col("_least") > lat_band) & (F.col("_off") <= F.col("_least") + 1e-9))
    close = 1 - F.coalesce(F.col("km") / F.nullif(F.max("km").over(one), F.lit(0.0)), F.lit(0.0))
    choices = choices.withColumn("_score", F.round((1 - weight) * close + weight * F.col("density"), 12))
    best = first_of_each(choices, ["region", "id"], F.col("_score").desc(), F.col("cx"), F.col("cy"))
    moved = best.select("region", "id", F.col("clon").alias("_lon"), F.col("clat").alias("_lat"), "km", F.col("depth_m").alias("_z"), "density")
    out = own.join(moved, ["region", "id"], "left")
    placed = F.col("_lon").isNotNull()
    return out.select(
        "region", "id", F.coalesce("_lon", "lon").alias("lon"), F.coalesce("_lat", "lat").alias("lat"),
        F.when(F.col("fine"), "ok").when(placed, "to_bathy_seapath").otherwise("unplaced").alias("status"), F.coalesce("km", F.lit(0.0)).alias("dist_km"),
        (F.coalesce("_lat", "lat") - F.col("lat")).alias("lat_ddeg"), (F.abs(F.coalesce("_lat", "lat") - F.col("lat")) * KM_PER_DEGREE_LINE).alias("lat_dkm"),
        F.coalesce("_z", "z").alias("depth_m"), F.col("density").alias("density_score"),
    )
