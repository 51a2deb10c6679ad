"""Exact quantiles from ranked counts against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles, ranked_counts

SHARES = {"q0": 0.0, "q2_5": 0.025, "q50": 0.5, "q90": 0.9, "q1": 1.0}


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(0, 4000, 20_000)] + [("one", 7.0), (None, 1.0), (None, 3.0), ("none", None)]
    rows += [(f"g{i}", float(v)) for i in range(20) for v in rng.normal(0, 3, i + 1).round(1)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: [r[n] for n in SHARES] for r in exact_quantiles(df, ["k"], "v", SHARES).collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got == {k: pytest.approx(np.quantile(v, list(SHARES.values()))) for k, v in want.items()}


def test_quantiles_of_all_rows(spark):
    df = spark.range(1001).select(F.col("id").alias("n"))
    assert exact_quantiles(df, [], "n", {"a": 0.25, "b": 0.9999}).first().asDict() == pytest.approx({"a": 250.0, "b": 999.9})
    assert exact_quantiles(df.limit(0), [], "n", {"a": 0.5}).first()["a"] is None  # an aggregate of nothing


def test_a_large_group_is_many_partitions(spark):
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    text = ranked_counts(df, ["k"], "v")._jdf.queryExecution().toString()
    assert "Window" in text and "_part" in text
    ranks = ranked_counts(df, ["k"], "v")
    assert ranks.where("v <> _before or _total <> 40000").count() == 0
