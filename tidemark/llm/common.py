"""Helpers that several training-data operators share."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder, ship, staged  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word before lower-casing: no ASCII character but letters and digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: For bytes.translate: A-Z to a-z; in WORD_BYTES every ASCII character outside words becomes a space.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(text, UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, rows: int = 256):
    """Arrow batches in slices of few rows, so that a task holds little text as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def gathered(values: Sequence[bytes], index: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The integers in ``values[i]`` for each i of the index, one after the other, and how many each gave."""
    flat = np.frombuffer(b"".join(values), kind)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(kind).itemsize
    starts, own = np.cumsum(sizes) - sizes, sizes[index]
    return flat[np.repeat(starts[index] - (np.cumsum(own) - own), own) + np.arange(own.sum())], own


def sums_by(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the values, one for each length."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


def literal_rows(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A small table inside the plan, as one string that Spark parses, so that the plan doesn't grow with it; ``schema`` is the DDL of its rows."""
    if not rows:
        return spark.createDataFrame([], schema)
    parsed = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{', '.join(part.strip().replace(' ', ': ', 1) for part in schema.split(', '))}>>")
    return spark.range(1).select(F.inline(parsed))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a staged table by way of the file system that its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def large(df: DataFrame) -> DataFrame:
    """A table that grows with the input, as the other side of a join: it is never sent whole to the driver and from there to all executors.

    Left to itself, Spark goes by the size of the files, which for packed numbers says little about that of the rows.
    """
    return df.hint("merge")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def count_below(bounds: Sequence, value: Column, kind: str = "bigint") -> Column:
    """How many of the sorted bounds (without commas) are less than the value, by binary search."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast(f"array<{kind}>")  # folded into one literal
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = F.get(array, mid) < value
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~less, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """Adds the global row number (from 0) by ``order``; also returns the number of rows.

    Rows are range-partitioned and sorted once and staged; the offsets of the partitions are
    a table with one row per partition.  No window runs over all rows.  Rows that are equal in
    ``order`` get their numbers in any order.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    at = staged(ranged.withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumns({"_part": F.shiftright("_at", 33), "_idx": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r["_part"], r["n"]) for r in at.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append({"_part": part, "_start": total})
        total += n
    offsets = literal_rows(spark, starts, "_part bigint, _start bigint")
    out = at.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_idx"))
    return out.drop("_at", "_part", "_idx", "_start"), total
