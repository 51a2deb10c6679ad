"""A daily cube of cells laid out by tile and year, and series that read only the tiles they need.

Below the folder, ``values`` holds cx, cy, day, value in directories of tile and yr, ``days`` the time axis.  A tile of a
year has SIZE * SIZE * 366 values at most, so it is one file, sorted by cell: its row groups tell cells apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exposure import site_series

#: Cells along the side of a tile.
SIZE = 64

#: Cells lie within so many of the origin, either way.  With SIZE, that bounds the number of tiles whose list is broadcast.
EDGE = 1 << 14


def tile_of(cx: Column, cy: Column, size: int = SIZE) -> Column:
    """The number of the tile that holds a cell."""
    across = 2 * EDGE // size + 2
    return ((F.floor(cy / size) + EDGE // size) * across + F.floor(cx / size) + EDGE // size).cast("int")


def on_grid() -> Column:
    return F.col("cx").between(-EDGE, EDGE) & F.col("cy").between(-EDGE, EDGE)


def lay_out(cube: DataFrame, path: str, size: int = SIZE) -> None:
    """Writes ``cube`` (cx, cy, day, value; one row a cell and day) by tile and year, and its days.

    Days without any value stay on the time axis; rows without a value or off the grid are not written.
    """
    rows = cube.select("cx", "cy", "day", "value")
    rows.select("day").where("day is not null").distinct().withColumn("yr", F.year("day")).write.parquet(f"{path}/days")
    held = rows.where(F.col("value").isNotNull() & F.col("day").isNotNull() & on_grid()).withColumns({"tile": tile_of(F.col("cx"), F.col("cy"), size), "yr": F.year("day")})
    held.repartition("tile", "yr").sortWithinPartitions("tile", "yr", "cx", "cy", "day").write.partitionBy("tile", "yr").parquet(f"{path}/values")


def days(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    axis = spark.read.parquet(f"{path}/days")
    return axis if years is None else axis.where(F.col("yr").isin(list(years)))


def values(cells: DataFrame, path: str, years: Sequence[int] | None = None, size: int = SIZE) -> DataFrame:
    """The values in all tiles that hold one of ``cells`` (cx, cy).

    The list of tiles is broadcast, and Spark prunes directories by it when the query runs; ``years`` prunes as it is planned.
    """
    wanted = cells.where(on_grid()).select(tile_of(F.col("cx"), F.col("cy"), size).alias("tile")).distinct()
    held = cells.sparkSession.read.schema("cx bigint, cy bigint, day date, value double, tile int, yr int").parquet(f"{path}/values")
    if years is not None:
        held = held.where(F.col("yr").isin(list(years)))
    return held.join(F.broadcast(wanted), "tile", "left_semi")


def series(sites: DataFrame, path: str, years: Sequence[int] | None = None, levels: int = 2, size: int = SIZE, **rules) -> DataFrame:
    """``exposure.site_series`` of sites (site, cx, cy) from a cube that is laid out at ``path``."""
    around = F.explode(F.sequence(F.lit(-levels), F.lit(levels)))
    cells = sites.select("cx", "cy", around.alias("_o")).select((F.col("cx") + F.col("_o")).alias("cx"), (F.col("cy") + F.col("_o")).alias("cy"))
    return site_series(sites, values(cells, path, years, size), days(sites.sparkSession, path, years).select("day"), levels=levels, **rules)
