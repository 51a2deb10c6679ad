"""Exposure of populations to daily values, realised and counterfactual."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import sum0

POP = ("region", "species")


def metrics(value: str, above: Sequence[str], below: Sequence[str] = (), total: bool = True) -> list[Column]:
    """Aggregates over daily values: sum, mean, max, sd, then for each threshold column the sum of
    the values beyond it (of the values, not of their excess) and the number of such days."""
    v = F.col(value)
    out = [sum0(v).alias("cum_temp")] if total else []
    out += [F.avg(v).alias("mean_temp"), F.max(v).alias("max_temp"), F.stddev_samp(v).alias("sd_temp")]
    for side, names in (("above", above), ("below", below)):
        for n in names:
            hit = v > F.col(n) if side == "above" else v < F.col(n)
            out.append(sum0(F.when(hit, v)).alias(f"cumtemp_{side}_{n}"))
            out.append(F.count_if(hit).alias(f"days_{side}_{n}"))
    return out


def exposure(visits: DataFrame, series: DataFrame, thresholds: DataFrame, keys: Sequence[str], above: Sequence[str], below: Sequence[str] = (), total: bool = True) -> DataFrame:
    """Metrics of every visit (keys, site, yr): one join by site and year, one grouping."""
    limits = thresholds.select("species", *dict.fromkeys([*above, *below]))
    rows = visits.select(*keys, "site", "yr").join(series.select("site", "yr", "v"), ["site", "yr"]).join(limits, "species")
    return rows.groupBy(*dict.fromkeys([*keys, "site", "yr"])).agg(*metrics("v", above, below, total))


def triangular(optima: DataFrame, keys: Sequence[str] = POP) -> DataFrame:
    """Each year's site in its own and every later sampling year of the population.

    The equality on the population keys the join; the order of years is left to its condition.
    """
    later = optima.select(*keys, F.col("yr").alias("lead_yr"))
    return optima.join(later, list(keys)).where(F.col("lead_yr") >= F.col("yr"))


def counterfactual(panel: DataFrame, measures: Sequence[str], keys: Sequence[str] = POP) -> DataFrame:
    """Realised minus previous-site and minus first-site measures, for all years but the first.

    ``panel`` has the keys, yr (year of the site), lead_yr and the measures of that site in
    lead_yr.  Sites are paired by their years, so a missing series can't shift the pairs.
    """
    w = Window.partitionBy(*keys).orderBy("yr")
    real = panel.where("yr = lead_yr").withColumns({"prev_yr": F.lag("yr").over(w), "first_yr": F.first("yr").over(w)}).where("prev_yr is not null")

    def at(prefix: str) -> DataFrame:
        return panel.select(*keys, F.col("yr").alias(f"{prefix}_yr"), "lead_yr", *[F.col(m).alias(f"{prefix}_{m}") for m in measures])

    out = real.join(at("prev"), [*keys, "prev_yr", "lead_yr"], "left").join(at("first"), [*keys, "first_yr", "lead_yr"], "left")
    diffs = [(F.col(m) - F.col(f"{p}_{m}")).alias(f"diff_{'previous' if p == 'prev' else 'first'}_site_{m}") for p in ("prev", "first") for m in measures]
    return out.select(*keys, "yr", *measures, *diffs)


def reference_visits(optima: DataFrame, kind: str, first_year: int, last_year: int, keys: Sequence[str] = POP) -> DataFrame:
    """The site of the first (``firstsite``) or the last but one year (``previoussite``), in all years of a span."""
    if kind not in ("firstsite", "previoussite"):
        raise ValueError(kind)
    order = F.array_sort(F.collect_list(F.struct("yr", "site")))
    sites = optima.groupBy(*keys).agg(order.alias("s"))
    site = F.col("s")[0]["site"] if kind == "firstsite" else F.when(F.size("s") >= 2, F.element_at("s", -2)["site"])
    chosen = sites.select(*keys, site.alias("site")).where("site is not null")
    return chosen.withColumn("yr", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))


def site_series(sites: DataFrame, cube: DataFrame, days: DataFrame, levels: int = 2, most_missing: float = 0.1, strict: bool = True, reject: bool = True) -> DataFrame:
    """Daily series of sites with diagonal neighbours as a fallback.

    ``sites`` has site, cx, cy (cell indices); ``cube`` has cx, cy, day, value (null or absent:
    missing); ``days`` has day.  Level 0 is the cell itself, level k the mean over the 2k + 1 cells of
    the diagonal through it.  A level serves if its share of missing days is not above
    ``most_missing`` (``strict``; else not at or above it); level 1 serves whenever it has any day and
    level 2 follows only where level 1 has none.  With ``reject`` a series with ``most_missing`` or more missing
    days goes.  Returns site, day, v (null where missing), level.  All is worked out once for each cell, however many sites lie in it.
    """
    placed = sites.select("site", "cx", "cy").distinct()
    own = placed.select(F.struct("cx", "cy").alias("home"), "cx", "cy").where("cx is not null and cy is not null").distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(o).alias("o")) for k in range(levels + 1) for o in range(-k, k + 1)]))
    cells = own.withColumn("at", steps).select("home", "at.level", (F.col("cx") + F.col("at.o")).alias("cx"), (F.col("cy") + F.col("at.o")).alias("cy"))
    values = cells.join(cube.where("value is not null"), ["cx", "cy"]).groupBy("home", "level", "day").agg(F.avg("value").alias("v"))
    n = days.agg(F.count("*").alias("n_days"))
    every = own.select("home").crossJoin(F.broadcast(n)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    held = values.groupBy("home", "level").agg(F.count("*").alias("held"))
    state = every.join(held, ["home", "level"], "left").withColumn("missing", 1 - F.coalesce("held", F.lit(0)) / F.col("n_days"))
    fine = F.col("missing") <= most_missing if strict else F.col("missing") < most_missing
    usable = state.where(F.when(F.col("level") == 0, fine).otherwise(F.col("missing") < 1))
    chosen = usable.groupBy("home").agg(F.min(F.struct("level", "missing")).alias("c")).select("home", "c.level", "c.missing")
    if reject:
        chosen = chosen.where(F.col("missing") < most_missing)
    grid = chosen.select("home", "level").crossJoin(F.broadcast(days.select("day").distinct()))
    series = grid.join(values, ["home", "level", "day"], "left")
    return placed.select("site", F.struct("cx", "cy").alias("home")).join(series, "home").select("site", "day", "v", "level")


def covered_years(series: DataFrame) -> DataFrame:
    """The rows of a series, with yr, in years that have any value."""
    rows = series.withColumn("yr", F.year("day"))
    some = rows.where("v is not null").select("site", "yr").distinct()
    return rows.join(some, ["site", "yr"], "left_semi")


def site_catalogue(optima: DataFrame, least_years: int = 3, keys: Sequence[str] = POP) -> DataFrame:
    """The distinct sites of populations with enough years: their years as text and their order of first visit."""
    seen = optima.withColumn("_n", F.size(F.collect_set("yr").over(Window.partitionBy(*keys)))).where(F.col("_n") >= least_years)
    out = seen.groupBy(*keys, "site").agg(F.min("yr").alias("first_visit"), F.array_join(F.array_sort(F.collect_set("yr")), ",").alias("sampled_year"))
    return out.withColumn("site_order", F.row_number().over(Window.partitionBy(*keys).orderBy("first_visit", "site")))


def totals_difference(panel: DataFrame, sums: Mapping[str, str], keys: Sequence[str] = POP) -> DataFrame:
    """By population: the sum over realised rows minus the sum over first-site rows of each measure."""
    first = F.min("yr").over(Window.partitionBy(*keys))
    rows = panel.withColumn("_first", first)
    own = [F.sum(F.when(F.col("yr") == F.col("lead_yr"), F.col(m))) - F.sum(F.when(F.col("yr") == F.col("_first"), F.col(m))) for m in sums]
    return rows.groupBy(*keys).agg(*[c.alias(n) for c, n in zip(own, sums.values(), strict=True)])
