"""Reading and writing tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def table(spark: SparkSession, name: str, *roots: str) -> DataFrame:
    """The table from the first root that has it: fresh output first, then given data."""
    for root in roots:
        if exists(spark, f"{root}/{name}.parquet"):
            return spark.read.parquet(f"{root}/{name}.parquet")
    raise FileNotFoundError(f"{name} in none of {roots}")


def snake(name: str) -> str:
    """LON.x, Selected.Model and the like as snake_case; a dot would mean a struct's field."""
    return re.sub(r"_+", "_", re.sub(r"[.\s-]", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name))).lower().strip("_")


def normalized(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def chunks(spark: SparkSession, folder: str, order: Sequence[str] = ()) -> DataFrame:
    """All chunk files below a folder as one table."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return df.orderBy(*order) if order else df


def file_key(pattern: str, group: int = 1) -> Column:
    """A key that is written in the path of a row's file."""
    return F.regexp_extract(F.input_file_name(), pattern, group)


def parameter_grid(df: DataFrame) -> DataFrame:
    """A parameter table without the carriage returns that end its lines."""
    return df.withColumns({c: F.rtrim(F.regexp_replace(c, "\r", "")) for c, t in df.dtypes if t == "string"})


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose keys no earlier run has finished."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_missing(work: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows whose keys the table at ``path`` lacks, so a stopped job can be run again."""
    spark = work.sparkSession
    (remaining(work, spark.read.parquet(path), keys) if exists(spark, path) else work).write.mode("append").parquet(path)


def write_specs(df: DataFrame, path: str, spec: str) -> None:
    """One folder for each model specification."""
    df.write.partitionBy(spec).parquet(path)


def write_tiles(cube: DataFrame, path: str, tile: float = 10.0) -> None:
    """A daily cube laid out by year and tile, so that crops and years prune files."""
    at = cube.withColumns({"tile_x": F.floor(F.col("lon") / tile), "tile_y": F.floor(F.col("lat") / tile), "year": F.year("day")})
    at.repartitionByRange("year", "tile_y", "tile_x").sortWithinPartitions("year", "tile_y", "tile_x").write.partitionBy("year").parquet(path)
