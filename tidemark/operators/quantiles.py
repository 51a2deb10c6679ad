"""Exact quantiles of groups from ranked counts, for groups of any size.

Spark's own exact percentile holds all distinct values of a group in one aggregation state.  Here equal values are counted,
the counts are ranged by key and value over partitions, so a large group is many of them, and running sums within
partitions plus the offsets of a key's earlier partitions give each value its ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def ranked_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, _n (rows of that value), _before (rows of the group with a smaller one) and _total; nulls are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranged = staged(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("_here", F.coalesce(F.sum("_n").over(here), F.lit(0)))
    # One row for each key and partition that it reaches into.
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_m"))
    own = Window.partitionBy(*keys)
    parts = parts.withColumns({"_earlier": F.coalesce(F.sum("_m").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_m").over(own)})
    same = F.col("r._part") == F.col("p._part")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}"))
    joined = ranked.alias("r").join(parts.alias("p"), same)
    return joined.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col(f"r.{value}").alias(value), F.col("r._n").alias("_n"), (F.col("r._here") + F.col("p._earlier")).alias("_before"), F.col("p._total").alias("_total"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """keys and one column for each named share: the quantile by linear interpolation between the ranks around it.

    Groups without any value are left out; without keys there is one row, null if there are no values.
    """
    ranked = ranked_counts(df, keys, value)
    rank = {n: F.lit(float(q)) * (F.col("_total") - 1) for n, q in shares.items()}
    covers = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))
    wanted = F.lit(False)
    for r in rank.values():
        wanted = wanted | covers(F.floor(r)) | covers(F.ceil(r))
    ends = [F.max(F.when(covers(f(r)), F.col(value))).alias(f"_{side}_{n}") for n, r in rank.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked.where(wanted).groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    between = lambda n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (rank[n] - F.floor(rank[n]))
    return found.select(*keys, *[between(n).alias(n) for n in shares])
