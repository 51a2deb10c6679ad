"""Every query that has SQL, against DuckDB on the smallest tables; plan shapes."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.plans.proxy import optima

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    def cell(v):
        if v is None or v != v:
            return "null"
        return str(round(float(v), 3) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert all(len(r) == len(df.columns) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_of_each_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(plans.QUERIES["t03_best_of_each"](spark, SF))


def test_triangular_join_is_no_nested_loop(spark):
    text = plan(plans.QUERIES["j09_triangular_self_join"](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(optima(spark, SF))
    scan = next(line for line in text.splitlines() if "l_suppkey" in line and "ReadSchema" in line)
    assert "l_tax" not in scan


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 7


def test_a_point_on_the_ring_is_outside_as_in_the_sql(spark, tmp_path):
    """Customer 27,173 lies at (-30, 5), on the western side of the triangle."""
    key = next(k for k in range(1, 121 * 361 + 1) if k * 29 % 121 - 60 == 5 and k * 31 % 361 - 180 == -30)
    spark.createDataFrame([(k, 1) for k in (key, key + 1, 1, 2)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{SF}/supplier.parquet'")
    name = "j14_g05_points_in_polygon"
    got = {r["point"] for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {r[0] for r in con.sql(plans.SQL[name]).fetchall()} and key not in got


def test_the_first_of_equal_prices_counts(spark, tmp_path):
    orders = [(k, c, p) for c in (1, 2) for k, p in ((c * 10 + 1, 5.0), (c * 10 + 2, 1.0), (c * 10 + 3, 5.0), (c * 10 + 4, 1.0), (c * 10 + 5, None))] + [(90, 3, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).sortWithinPartitions("o_orderkey").write.parquet(str(tmp_path / "up"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/up/*.parquet'")
    name = "t05_t06_arg_extremes"
    want = sorted(con.sql(plans.SQL[name]).fetchall())
    assert want[:2] == [(1, 12, 11), (2, 22, 21)]
    for way in (F.col("o_orderkey").asc(), F.col("o_orderkey").desc()):
        path = tmp_path / f"way{len(list(tmp_path.iterdir()))}"
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).sortWithinPartitions(way).write.mode("overwrite").parquet(f"{path}/orders.parquet")
        assert sorted(map(tuple, plans.QUERIES[name](spark, str(path)).collect())) == want
