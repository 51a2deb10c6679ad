"""Series of a population by year: lags, running coordinates, scores and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

POPULATION = ("region", "species")


def by_year(keys: Sequence[str] = POPULATION) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("yr")


def exact_lag(value: Column, k: int, keys: Sequence[str] = POPULATION) -> Column:
    """The value k rows before, if that row is exactly k years earlier."""
    w = by_year(keys)
    return F.when(F.col("yr") - F.lag("yr", k).over(w) == k, F.lag(value, k).over(w))


def time_coordinate(keys: Sequence[str] = POPULATION) -> Column:
    """The inclusive running sum of (year - first year + 1) + 0.1."""
    w = by_year(keys)
    index = F.col("yr") - F.first("yr").over(w) + 1
    return index + F.lit(0.1)


def with_time_coordinate(df: DataFrame, keys: Sequence[str] = POPULATION) -> DataFrame:
    running = by_year(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("t", time_coordinate(keys)).withColumn("t_coord", F.sum("t").over(running))


def z_score(value: Column, keys: Sequence[str]) -> Column:
    """Within groups, by the sample deviation; null where that is 0 or missing."""
    w = Window.partitionBy(*keys)
    return (value - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))


def with_z_score(df: DataFrame, value: str, name: str = "z") -> DataFrame:
    """Over the whole table: the two moments are one row that is joined on."""
    moments = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.crossJoin(F.broadcast(moments)).withColumn(name, (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def with_decile(df: DataFrame, value: str, keys: Sequence[str], name: str = "bin") -> DataFrame:
    """Decile bins closed on the right, the lowest value in bin 1, equal breaks merged."""
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / 10) for i in range(11)]))).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return df.join(cuts, list(keys)).withColumn(name, F.greatest(below, F.lit(1)).cast("int")).drop("_cuts")


def trimmed(curve: DataFrame, seen: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """The points of each group's curve that lie between the least and the largest x seen in the group."""
    span = seen.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return curve.join(span, list(keys)).where(F.col(x).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
