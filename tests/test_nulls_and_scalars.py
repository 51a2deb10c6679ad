import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import nulls, scalar


def one(spark, column, **values):
    row = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_if_else_keeps_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,)], "v double")
    assert [r[0] for r in df.select(nulls.if_else(F.col("v") > 5, "hi", "lo")).collect()] == ["lo", None, "hi"]


def test_is_in_is_never_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "v string")
    assert [r[0] for r in df.select(nulls.is_in(F.col("v"), ["a"])).collect()] == [True, False, False]


def test_sum0_and_clean(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "v double")
    assert nulls.clean(df).where("v is not null").count() == 0
    assert nulls.clean(df).agg(nulls.sum0(F.col("v"))).first()[0] == 0.0


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in df.select(nulls.finite(F.col("v"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize("x, digits, want", [(12345.0, 3, 12300.0), (0.012345, 2, 0.012), (0.0, 3, 0.0), (-98.7, 1, -100.0)])
def test_signif(spark, x, digits, want):
    assert one(spark, scalar.signif(F.lit(x), digits)) == pytest.approx(want)


@pytest.mark.parametrize("lat, want", [(23.5, "Tropical"), (-23.6, "Subtropical"), (40.0, "Temperate"), (-60.0, "Temperate"), (60.1, None)])
def test_realm(spark, lat, want):
    assert one(spark, scalar.realm(F.lit(lat))) == want


@pytest.mark.parametrize(
    "lat, q25, q75, want",
    [(5.0, 10.0, 20.0, "Warm"), (25.0, 10.0, 20.0, "Cold"), (15.0, 10.0, 20.0, "Mid"), (-5.0, -20.0, -10.0, "Warm"), (-25.0, -20.0, -10.0, "Cold"),
     (30.0, -5.0, 20.0, "Cold"), (30.0, -25.0, 20.0, "Warm"), (10.0, 0.0, 20.0, None), (10.0, None, 20.0, None), (10.0, 10.0, 20.0, "Mid")],
)
def test_range_position(spark, lat, q25, q75, want):
    df = spark.createDataFrame([(lat, q25, q75)], "lat double, q25 double, q75 double")
    assert df.select(scalar.range_position(F.col("lat"), F.col("q25"), F.col("q75"))).first()[0] == want


@pytest.mark.parametrize("dx, dy, want", [(0.0, 1.0, 0.0), (1.0, 0.0, 90.0), (0.0, -1.0, 180.0), (-1.0, 0.0, 270.0)])
def test_bearing(spark, dx, dy, want):
    assert one(spark, scalar.bearing(F.lit(dx), F.lit(dy))) == pytest.approx(want)


def test_octant_edges(spark):
    df = spark.createDataFrame([(0.0,), (44.9,), (45.0,), (359.9,), (360.0,)], "b double")
    assert [r[0] for r in df.select(scalar.octant(F.col("b"))).collect()] == [1, 1, 2, 8, 8]


def test_coordinate_rounds_half_to_even(spark):
    assert one(spark, nulls.coordinate(F.lit(2.5).cast("double"))) == 2.5
    df = spark.createDataFrame([(None, None), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(nulls.same(F.col("a"), F.col("b"))).collect()] == [True, False]
