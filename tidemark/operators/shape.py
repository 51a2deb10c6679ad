"""Shape of fitted curves and the filter that rests on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of the span that counts as an edge, and the least prominence of a peak.
EDGE, PROMINENCE = 0.05, 0.20


def curve_classes(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "mu") -> DataFrame:
    """One row per curve: n_modes, peak_x, peak_rel, prominence, class.

    Curves of fewer than 3 finite points, without span or without a positive maximum give no row.
    Among equal maxima the first along x is the peak.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    ok = points.where(~F.isnan(x) & ~F.isnan(y) & F.col(y).isNotNull() & F.col(x).isNotNull() & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    ok = ok.withColumns({"_before": F.lag(y).over(w), "_after": F.lead(y).over(w)})
    peak = F.min_by(F.col(x), F.struct(-F.col(y), F.col(x)))
    out = ok.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.max(y).alias("top"), F.min(y).alias("bottom"),
        F.count_if((F.col(y) > F.col("_before")) & (F.col(y) > F.col("_after"))).alias("n_modes"), peak.alias("peak_x"),
    )
    out = out.where((F.col("n") >= 3) & (F.col("hi") > F.col("lo")) & (F.col("top") > 0))
    rel, prominence = (F.col("peak_x") - F.col("lo")) / (F.col("hi") - F.col("lo")), (F.col("top") - F.col("bottom")) / F.col("top")
    name = F.when(F.col("n_modes") >= 2, "bimodal").when((rel < EDGE) | (rel > 1 - EDGE), "edge_peak").when(prominence < PROMINENCE, "flat").otherwise("clear_unimodal")
    return out.select(*keys, "n_modes", "peak_x", rel.alias("peak_rel"), prominence.alias("prominence"), name.alias("class"))


def decisions(classes: DataFrame, keys: Sequence[str], keep: float = 50.0) -> DataFrame:
    """Percent of each class over a population's curves, and KEEP where enough are clearly unimodal."""
    part = lambda c: (F.avg((F.col("class") == c).cast("int")) * 100).alias(f"pct_{c}")
    out = classes.groupBy(*keys).agg(F.count("*").alias("n_instances"), *[part(c) for c in ("clear_unimodal", "bimodal", "edge_peak", "flat")])
    return out.withColumn("decision", F.when(F.col("pct_clear_unimodal") >= keep, "KEEP").otherwise("REMOVE"))


def filtered(populations: DataFrame, qc: DataFrame, keys: Sequence[str], classes: Sequence[str] = ("bimodal", "edge_peak", "flat"), limit: float = 50.0) -> DataFrame:
    """Populations without those whose share of the given classes reaches the limit."""
    bad = F.lit(0.0)
    for c in classes:
        bad = bad + F.col(f"pct_{c}")
    return populations.join(qc.where(bad >= limit).select(*keys), list(keys), "left_anti")


def region_numbers(rows: DataFrame, species: str = "species", region: str = "region") -> DataFrame:
    """Regions of a species numbered by their first appearance (column row_id; ties by name)."""
    first = rows.groupBy(species, region).agg(F.min("row_id").alias("_first"))
    return first.withColumn("region_no", F.row_number().over(Window.partitionBy(species).orderBy("_first", region))).drop("_first")
