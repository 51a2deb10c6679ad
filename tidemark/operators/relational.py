"""Relational verbs that need more than one call."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import haversine_km
from ..sources.staging import staged


def rename_existing(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames the columns that are there."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def rename_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.toDF(*[c.replace(old, new, 1) if c.startswith(old) else c for c in df.columns])


def first_of_each(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark cuts groups before it shuffles them."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def nth_from_end(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The n-th row from the end of each group, for groups that have so many rows."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where(F.col("_k") == n).drop("_k")


def at_least(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The rows of groups of n rows or more."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= n).drop("_n")


def spread(df: DataFrame, order: Sequence[Column], total: int, length: int) -> DataFrame:
    """Rows 1..total in order at evenly spread places, rounded half to even, both ends included.

    Rows are ranged and sorted once and written; the offsets of the partitions, one row each, number them.
    """
    spark = df.sparkSession
    places = sorted({round(1 + (total - 1) * i / (length - 1)) for i in range(length)}) if length > 1 else [1]
    at = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_at", 33))
    starts, before = [], 0
    for r in at.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        starts.append((r["_part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "_part bigint, _start bigint")
    out = at.join(F.broadcast(offsets), "_part").withColumn("place", (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int"))
    return out.where(F.col("place").isin(places)).drop("_at", "_part", "_start")


def completed(df: DataFrame, rows: DataFrame, columns: DataFrame, value: str) -> DataFrame:
    """All combinations of two small sets of names; missing values are 0."""
    keys = [*rows.columns, *columns.columns]
    return rows.crossJoin(F.broadcast(columns)).join(df, keys, "left").fillna(0, [value])


def with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    return df.unionByName(total, allowMissingColumns=True)


def share(value: Column, keys: Sequence[str]) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*keys))


def relative_to_max(value: Column, keys: Sequence[str]) -> Column:
    return value / F.max(value).over(Window.partitionBy(*keys))


#: The quadtree: degrees of a root, levels below it, sites from which a node is split.
ROOT, LEVELS, LEAF = 360.0, 16, 24


def site_tree(sites: DataFrame, within: Sequence[str], x: str, y: str, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """A quadtree of each region's sites, by counting: its nodes, and the leaf of each of the smallest squares that hold sites.

    Nodes are within, _l (level, 0 the root), _x, _y, _n and _inner (more than ``leaf`` sites, so split).  Squares are within,
    _dx, _dy with _l, _x, _y.  Counts are made once for the smallest squares and summed over their ancestors.
    """
    deep = sites.groupBy(*within, *deepest(x, y)).agg(F.count("*").alias("_n"))
    above = staged(ancestors(deep, within, "_n"))
    nodes = above.groupBy(*within, "_l", "_x", "_y").agg(F.sum("_n").alias("_n")).withColumn("_inner", (F.col("_n") > leaf) & (F.col("_l") < LEVELS))
    split = nodes.where("_inner").select(*within, (F.col("_l") + 1).alias("_l"), F.col("_x").alias("_px"), F.col("_y").alias("_py"))
    parents = nodes.withColumns({"_px": F.shiftright("_x", 1), "_py": F.shiftright("_y", 1)})
    nodes = staged(parents.join(split, [*within, "_l", "_px", "_py"], "left_semi").drop("_px", "_py").unionByName(nodes.where("_l = 0")))
    leaves = nodes.where("not _inner").select(*within, "_l", "_x", "_y")
    return nodes, above.drop("_n").join(leaves, [*within, "_l", "_x", "_y"])


def deepest(x: str, y: str) -> list[Column]:
    side = ROOT / (1 << LEVELS)
    return [F.floor((F.col(x) + 180) / side).alias("_dx"), F.floor((F.col(y) + 180) / side).alias("_dy")]


def ancestors(squares: DataFrame, within: Sequence[str], *more: str) -> DataFrame:
    """Each of the smallest squares with its ancestor (_l, _x, _y) at every level."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_l")
    out = squares.select(*within, "_dx", "_dy", *more, levels)
    up = F.lit(LEVELS) - F.col("_l")
    return out.withColumns({"_x": F.call_function("shiftright", F.col("_dx"), up), "_y": F.call_function("shiftright", F.col("_dy"), up)})


def near_pairs(points: DataFrame, sites: DataFrame, within: Sequence[str], k: int = 1, at: tuple[str, str] = ("slon", "slat"), leaf: int = LEAF) -> DataFrame:
    """Points paired with sites of the same region; the k nearest sites of every point, by degrees, are among them.

    Sites lie in a quadtree whose leaves hold few of them, however dense they are.  Points go by the smallest square they fall
    into.  Level by level each such square keeps the nodes that may hold one of the k nearest: those not farther off than the
    least distance within which k sites lie for certain.  Ties of distance stay in.  So pairs are in proportion to points, and a full
    region is no single group; more than ``leaf`` sites at one place stay together.  Points and sites without coordinates meet nothing.
    """
    lon, lat = at
    p = points.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)").withColumns({"_dx": deepest("lon", "lat")[0], "_dy": deepest("lon", "lat")[1]})
    s = sites.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns({"_dx": deepest(lon, lat)[0], "_dy": deepest(lon, lat)[1]})
    nodes, leaf_of = site_tree(s.drop("_dx", "_dy"), within, lon, lat, leaf)
    depth = nodes.agg(F.max("_l").alias("d")).first()["d"] or 0

    own = [*within, "_dx", "_dy"]
    met = p.select(*own).distinct().join(nodes.where("_l = 0"), list(within))
    children = nodes.select(*within, (F.col("_l") - 1).alias("_l"), F.shiftright("_x", 1).alias("_x"), F.shiftright("_y", 1).alias("_y"), F.col("_x").alias("_cx"), F.col("_y").alias("_cy"), F.col("_n").alias("_cn"), F.col("_inner").alias("_ci")).where("_l >= 0")
    for _ in range(depth):
        opened = met.where("_inner").drop("_n", "_inner").join(children, [*within, "_l", "_x", "_y"])
        opened = opened.select(*own, (F.col("_l") + 1).alias("_l"), F.col("_cx").alias("_x"), F.col("_cy").alias("_y"), F.col("_cn").alias("_n"), F.col("_ci").alias("_inner"))
        met = staged(_not_too_far(met.where("not _inner").select(*opened.columns).union(opened), own, k))
    placed = s.join(leaf_of, [*within, "_dx", "_dy"]).drop("_dx", "_dy")
    return p.join(met.select(*own, "_l", "_x", "_y"), own).drop("_dx", "_dy").join(placed, [*within, "_l", "_x", "_y"]).drop("_l", "_x", "_y")


def _not_too_far(met: DataFrame, own: Sequence[str], k: int) -> DataFrame:
    """The nodes that may hold one of the k sites nearest to some point of the square ``own``."""
    side = F.lit(1 << LEVELS) / F.pow(F.lit(2.0), F.col("_l"))  # in smallest squares
    low, high = F.lit(0.0), F.lit(0.0)
    for a, b in (("_dx", "_x"), ("_dy", "_y")):
        first, last, begin, end = F.col(a), F.col(a) + 1, F.col(b) * side, (F.col(b) + 1) * side
        gap, span = F.greatest(begin - last, first - end, F.lit(0.0)), F.greatest(end - first, last - begin)
        low, high = low + gap * gap, high + span * span
    w = Window.partitionBy(*own)
    ranked = met.withColumns({"_low": low, "_high": high}).withColumn("_held", F.sum("_n").over(w.orderBy("_high")))
    ranked = ranked.withColumn("_bound", F.min(F.when(F.col("_held") >= k, F.col("_high"))).over(w))
    return ranked.where(F.col("_bound").isNull() | (F.col("_low") <= F.col("_bound"))).drop("_low", "_high", "_held", "_bound")


def nearest(points: DataFrame, sites: DataFrame, within: str, k: int = 1) -> DataFrame:
    """The k nearest sites of each point in the same region, by squared degrees; ties go to the smaller site.

    ``points`` has point, lon, lat; ``sites`` has site, slon, slat; both have the region ``within``.
    """
    d2 = F.pow(F.col("lon") - F.col("slon"), 2) + F.pow(F.col("lat") - F.col("slat"), 2)
    pairs = near_pairs(points, sites, [within], k).withColumn("d2", d2)
    return first_of_each(pairs, [within, "point"], F.col("d2"), F.col("site"), n=k)


def within_km(points: DataFrame, sites: DataFrame, within: Sequence[str], km: float, distance=haversine_km) -> DataFrame:
    """Pairs of points (lon, lat) and sites (slon, slat) of the same region, at most so far apart, with their ``km`` (great-circle, or by line_km).

    They meet by bands of latitude as wide as the distance, cut into tiles that are at least as wide as the distance is in the
    band; tiles close round the globe.  Each site stands in up to nine tiles: those of the bands and tiles beside its own.
    """
    width = km / 111.0
    # The largest difference of longitude within the distance of a point of the band; from a pole on, any.
    top = F.least((F.greatest(F.abs(F.col("_band") * width), F.abs((F.col("_band") + 1) * width))), F.lit(90.0))
    shrink = F.cos(F.radians(top))
    apart = F.when((top + width < 90) & (shrink > 1e-6), F.greatest(F.degrees(F.asin(F.least(F.lit(math.sin(min(km / 6371.0, math.pi / 2))) / shrink, F.lit(1.0)))), width / shrink)).otherwise(F.lit(360.0))
    tiles = F.greatest(F.floor(F.lit(360.0) / (apart * 1.000001)), F.lit(1))
    tile = lambda lon: F.pmod(F.floor((F.col(lon) + 180) / (360 / F.col("_tiles"))), F.col("_tiles"))
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    s = sites.withColumn("_band", F.explode(F.transform(three, lambda i: F.floor(F.col("slat") / width) + i))).withColumn("_tiles", tiles)
    s = s.withColumn("_tile", F.explode(F.array_distinct(F.transform(three, lambda i: F.pmod(tile("slon") + i, F.col("_tiles")))))).drop("_tiles")
    p = points.withColumn("_band", F.floor(F.col("lat") / width)).withColumn("_tiles", tiles).withColumn("_tile", tile("lon")).drop("_tiles")
    pairs = p.join(s, [*within, "_band", "_tile"]).where(F.abs(F.col("slat") - F.col("lat")) <= width).drop("_band", "_tile")
    return pairs.withColumn("km", distance(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))).where(F.col("km") <= km)
