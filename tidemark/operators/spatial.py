"""Grids, polygons and paths over sea cells.

Grid algebra is relational: a cell is a pair of integers.  Searches over a region's cells run inside
the group of that region, whose size the grid bounds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import KM_PER_DEGREE_LINE, line_km
from .relational import first_of_each, near_pairs


def extract(points: DataFrame, grid: DataFrame, step: float, value: str = "value") -> DataFrame:
    """The value of the cell of each point (lon, lat); ``grid`` has cx, cy and the value."""
    at = points.withColumns({"cx": F.floor(F.col("lon") / step), "cy": F.floor(F.col("lat") / step)})
    return at.join(grid.select("cx", "cy", value), ["cx", "cy"], "left")


def filled(grid: DataFrame, value: str = "value") -> DataFrame:
    """Missing values replaced by the mean of the four neighbours that have one."""
    moves = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    given = grid.where(F.col(value).isNotNull()).withColumn("m", moves)
    near = given.groupBy((F.col("cx") + F.col("m.dx")).alias("cx"), (F.col("cy") + F.col("m.dy")).alias("cy")).agg(F.avg(value).alias("_near"))
    return grid.join(near, ["cx", "cy"], "left").withColumn(value, F.coalesce(value, "_near")).drop("_near")


def coarser(grid: DataFrame, factor: int, how=F.avg, value: str = "value") -> DataFrame:
    return grid.groupBy(F.floor(F.col("cx") / factor).alias("cx"), F.floor(F.col("cy") / factor).alias("cy")).agg(how(value).alias(value))


def crop(df: DataFrame, west: float, east: float, south: float, north: float, pad: float = 0.0) -> DataFrame:
    return df.where(F.col("lon").between(west - pad, east + pad) & F.col("lat").between(south - pad, north + pad))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of struct lon, lat; open or closed), by crossings of a ray; a point on the ring itself doesn't."""
    ends = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return F.when(straddles & (lon < at), 1).otherwise(0)

    def touches(a: Column, b: Column) -> Column:
        between = lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
        return between & ((b["lon"] - a["lon"]) * (lat - a["lat"]) == (lon - a["lon"]) * (b["lat"] - a["lat"]))

    odd = F.aggregate(F.zip_with(ring, ends, crosses), F.lit(0), lambda n, x: n + x) % 2 == 1
    return odd & ~F.exists(F.zip_with(ring, ends, touches), lambda x: x)


def inside(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points with the polygon they lie in.  ``polygons`` has name and ring; a point meets only
    polygons whose ten-degree tiles it lies in."""
    span = lambda f, c: F.floor(f(F.transform("ring", lambda p: p[c])) / 10)
    tiles = polygons.withColumn("tx", F.explode(F.sequence(span(F.array_min, "lon"), span(F.array_max, "lon")))).withColumn("ty", F.explode(F.sequence(span(F.array_min, "lat"), span(F.array_max, "lat"))))
    at = points.withColumns({"tx": F.floor(F.col("lon") / 10), "ty": F.floor(F.col("lat") / 10)})
    return at.join(tiles, ["tx", "ty"]).where(in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).drop("tx", "ty", "ring")


# --- graphs over the cells of one region

Cell = tuple[int, int]


def neighbours(cells: set[Cell], step: float) -> dict[Cell, list[tuple[Cell, float]]]:
    """The up to eight neighbours of each cell with their distance in km at the latitude half-way, so the same both ways."""
    out: dict[Cell, list[tuple[Cell, float]]] = {}
    for x, y in cells:
        shrink = {j: math.cos(math.radians((y + 0.5 + j / 2) * step)) for j in (-1, 0, 1)}
        out[x, y] = [((x + i, y + j), math.hypot(i * shrink[j], j) * step * KM_PER_DEGREE_LINE) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (x + i, y + j) in cells]
    return out


def sea_distances(start: Cell, graph: dict[Cell, list[tuple[Cell, float]]], most: float = math.inf) -> dict[Cell, float]:
    """Shortest distances from a cell over the graph, up to ``most``."""
    best, heap = {start: 0.0} if start in graph else {}, [(0.0, start)] if start in graph else []
    while heap:
        d, cell = heapq.heappop(heap)
        if d > best[cell]:
            continue
        for other, step in graph[cell]:
            new = d + step
            if new <= most and new < best.get(other, math.inf):
                best[other] = new
                heapq.heappush(heap, (new, other))
    return best


def components(cells: set[Cell]) -> dict[Cell, int]:
    """Numbers of the eight-connected pieces, in the order of their smallest cells."""
    out: dict[Cell, int] = {}
    pieces = 0
    for cell in sorted(cells):
        if cell not in out:
            number, todo = pieces, [cell]
            pieces += 1
            out[cell] = number
            while todo:
                x, y = todo.pop()
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        near = (x + i, y + j)
                        if near in cells and near not in out:
                            out[near] = number
                            todo.append(near)
    return out


#: km2 from which a land mass is large, km within which a large one counts.
LARGE_LAND_KM2, NEARBY_LAND_KM = 3000.0, 200.0


def nearest_land(sites: DataFrame, pieces: DataFrame, step: float, large_km2: float = LARGE_LAND_KM2, near_km: float = NEARBY_LAND_KM) -> DataFrame:
    """(region, point, piece, km): the nearest large land mass of each point if one lies near enough, else the nearest of any size.

    ``sites`` has region, point, lon, lat; ``pieces`` is that of ``sea.land_pieces``.  Nearest is by degrees, ties go to the
    smaller cell; points without any land in their region are left out.
    """
    own = sites.select(F.col("region").cast("int").alias("region"), "point", "lon", "lat")
    cells = pieces.select("region", "piece", "area_km2", ((F.col("cx") + 0.5) * step).alias("slon"), ((F.col("cy") + 0.5) * step).alias("slat"))

    def closest(land: DataFrame) -> DataFrame:
        square = F.pow(F.col("lon") - F.col("slon"), 2) + F.pow(F.col("lat") - F.col("slat"), 2)
        first = first_of_each(near_pairs(own, land, ["region"]), ["region", "point"], square, F.col("slon"), F.col("slat"))
        return first.select("region", "point", "piece", line_km(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat")).alias("km"))

    large = closest(cells.where(F.col("area_km2") >= large_km2)).where(F.col("km") <= near_km).select("region", "point", F.struct("piece", "km").alias("l"))
    return closest(cells).join(large, ["region", "point"], "left").select("region", "point", F.coalesce("l.piece", "piece").alias("piece"), F.coalesce("l.km", "km").alias("km"))


def pooled(optima: DataFrame, chains: DataFrame, least_regions: int = 2) -> DataFrame:
    """Regions of a chain as one coast; species that live in enough of its regions."""
    named = optima.join(chains.select("region", "coast"), "region")
    wide = named.groupBy("coast", "species").agg(F.countDistinct("region").alias("_n")).where(F.col("_n") >= least_regions)
    return named.join(wide.drop("_n"), ["coast", "species"], "left_semi")


def snapped(points: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each point with the nearest cell of its group."""
    pairs = near_pairs(points, cells, keys, at=("clon", "clat")).withColumn("_d", F.pow(F.col("lon") - F.col("clon"), 2) + F.pow(F.col("lat") - F.col("clat"), 2))
    return first_of_each(pairs, [*keys, "point"], F.col("_d"), F.col("clon"), F.col("clat")).drop("_d")
