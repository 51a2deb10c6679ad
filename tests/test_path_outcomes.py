"""A population without a searched path, or without a test of it, has a reason and no outcome."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import path
from tidemark.plans import spatial_models
from tidemark.plans.proxy import optima

SF = "/root/testdata/sf0.001"


def test_why_a_population_stays(spark):
    stands = {"moves": (1, (1, 2, 1, 2)), "still": (1, (1, 1, 1, 1)), "apart": (2, (1, 11, 1, 11)), "half": (2, (1, 1, 11, 11)), "broken": (3, (1, 2, 1, 2)), "short": (1, (1, 2, 1))}
    visits = [(r, s, t, c + 0.5, 0.5) for s, (r, at) in stands.items() for t, c in enumerate(at)]
    water = [(r, x, 0) for r in (1, 3) for x in range(6)] + [(2, x, 0) for x in (*range(6), *range(10, 16))]
    cells = [(r, c, c + 0.5, 0.5, t, 1.0) for r in (1, 2, 3) for c in (1, 2) for t in range(4) if (r, t) != (3, 2)] + [(3, 3, 400.5, 0.5, 2, 1.0)]
    got = path.best_paths(
        spark.createDataFrame(visits, "region int, species string, yr int, lon double, lat double"),
        spark.createDataFrame(cells, "region int, cell bigint, lon double, lat double, yr int, exposure double"),
        spark.createDataFrame(water, "region int, cx bigint, cy bigint"), 1.0,
    )
    want = {"moves": (None, None), "still": ("never_moved", None), "apart": ("no_step_by_sea", None), "half": ("no_step_by_sea", None), "broken": ("no_path", None), "short": (None, "few_years")}
    assert {(r["species"], r["stays"], r["drop_reason"]) for r in got.collect()} == {(s, *why) for s, why in want.items()}


#: What the first populations of each region are made to be; the others have paths.
MADE = ("ERROR: out of range: 5", "few_years", "no_path", "never_moved")


def made_paths(spark, d):
    o = optima(spark, d).withColumn("k", F.dense_rank().over(Window.partitionBy("region").orderBy("species")))
    first = F.first("site").over(Window.partitionBy("region", "species").orderBy("yr"))
    why = F.get(F.array(*map(F.lit, MADE)), F.col("k") - 1)
    o = o.select(F.col("region").cast("int").alias("region"), "species", "yr", "k", first.cast("bigint").alias("cell"), F.lit(0.0).alias("step_km"), F.lit(1.0).alias("reach_km"), why.alias("why"))
    o = o.withColumn("drop_reason", F.when(F.col("k") <= 2, F.col("why"))).withColumn("stays", F.when(F.col("k").between(3, 4), F.col("why")))
    return o.where("drop_reason is null").union(o.where("drop_reason is not null").dropDuplicates(["region", "species"])).drop("k", "why")


def test_outcomes_count_every_population_and_no_failure_as_one(spark, monkeypatch):
    monkeypatch.setattr(spatial_models, "_paths", made_paths)
    many = {r["region"]: r["n"] for r in optima(spark, SF).groupBy("region").agg(F.countDistinct("species").alias("n")).collect()}
    got = plans.QUERIES["d28_tested_path_outcomes"](spark, SF).collect()
    for region, n in many.items():
        rows = [r for r in got if r["region"] == region]
        reasons = {r["reason"]: r["n"] for r in rows if r["outcome"] is None}
        assert reasons == dict.fromkeys(("ERROR", "few_years", "no_path", "never_moved"), 1) and sum(r["n"] for r in rows) == n
        assert all((r["outcome"] is None) == (r["pct"] is None) != (r["reason"] is None) for r in rows)
        assert sum(r["pct"] for r in rows if r["pct"] is not None) == pytest.approx(100)


def test_ranges_count_every_population_and_no_failure_as_an_outcome(spark, monkeypatch):
    monkeypatch.setattr(spatial_models, "_paths", made_paths)
    placed = spatial_models._categorised(spark, SF).select("region", "species", "guild", "range").distinct()
    lost = placed.groupBy("region").agg(F.max("species").alias("species"))  # these have paths, but no category
    monkeypatch.setattr(spatial_models, "_categorised", lambda spark, d: placed.join(lost, ["region", "species"], "left_anti"))
    o = optima(spark, SF)
    many, regions = o.select("region", "species").distinct().count(), o.select("region").distinct().count()
    got = plans.QUERIES["d28b_tested_outcome_range"](spark, SF).collect()
    reasons = {}
    for r in got:
        assert (r["outcome"] is None) == (r["lo"] is None) == (r["hi"] is None) != (r["reason"] is None)
        if r["reason"] is not None:
            reasons[r["reason"]] = reasons.get(r["reason"], 0) + r["n"]
    assert reasons == dict.fromkeys(("ERROR", "few_years", "no_path", "never_moved", "no_category"), regions)
    assert sum(r["n"] for r in got) == many
    assert {(r["guild"], r["outcome"]) for r in got if r["reason"] == "no_category"} == {(None, None)}
