"""Joins of tables that grow with the input: none is sent whole to the driver, however small its files are."""

import pytest

from tidemark.llm import golay_simhash, near_dup

SF = "/root/testdata/sf0.01"
JOBS = {"near_duplicates": near_dup.near_duplicates, "one_of_each": near_dup.one_of_each, "simhash_groups": golay_simhash.simhash_groups}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_no_join_is_broadcast(spark, name):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    JOBS[name](docs).write.format("noop").mode("overwrite").save()
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastExchange" in p for p in plans)
