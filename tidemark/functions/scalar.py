"""Scalar functions of the domain, all of them column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres per degree; the two are not to be unified.
KM_PER_DEGREE, KM_PER_DEGREE_LINE = 111.0, 111.32
#: Two-sided and one-sided 5 % points of the normal distribution.
Z_TWO_SIDED, Z_ONE_SIDED = 1.959963984540054, 1.6448536269514722
#: Bounds of the realms by absolute latitude, and the guilds' boundary in degrees.
TROPIC, SUBTROPIC, TEMPERATE, GUILD = 23.5, 40.0, 60.0, 23.0


def signif(x: Column, digits: int) -> Column:
    """x rounded to so many significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def realm(lat: Column) -> Column:
    """By absolute latitude; null beyond 60 degrees."""
    a = F.abs(lat)
    return F.when(a <= TROPIC, "Tropical").when(a < SUBTROPIC, "Subtropical").when(a <= TEMPERATE, "Temperate")


def guild(optimum: Column) -> Column:
    """Warm above 23 degrees, else Cool; null for null."""
    return F.when(optimum > GUILD, "Warm").when(optimum <= GUILD, "Cool")


def range_position(lat: Column, q25: Column, q75: Column) -> Column:
    """Warm, Mid or Cold part of a species' range; null without quantiles or with one at 0."""
    north = F.when(lat < q25, "Warm").when(lat > q75, "Cold").otherwise("Mid")
    south = F.when(lat > q75, "Warm").when(lat < q25, "Cold").otherwise("Mid")
    known = lat.isNotNull()
    return (
        F.when(known & (q25 > 0) & (q75 > 0), north)
        .when(known & (q25 < 0) & (q75 < 0), south)
        .when(known & (q25 < 0) & (q75 > 0), F.when(F.abs(q25) < F.abs(q75), north).otherwise(south))
    )


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, from 0 to below 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def octant(degrees: Column) -> Column:
    """Bins of 45 degrees, 1 to 8; 360 belongs to the last."""
    return F.least(F.floor(degrees / 45) + 1, F.lit(8)).cast("int")


def direction_class(degrees: Column, lat: Column) -> Column:
    """Four classes by the cosine of the bearing, flipped in the south."""
    score = F.cos(F.radians(degrees)) * F.when(lat < 0, -1.0).otherwise(1.0)
    return F.when(score >= 0.5, "poleward").when(score >= 0, "weakly poleward").when(score > -0.5, "weakly equatorward").when(score <= -0.5, "equatorward")


def line_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Straight-line distance on a locally flat earth."""
    dx = (lon2 - lon1) * F.cos(F.radians(lat1)) * KM_PER_DEGREE_LINE
    return F.hypot(dx, (lat2 - lat1) * KM_PER_DEGREE_LINE)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * 2 * 6371.0


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def p_text(p: Column) -> Column:
    """How a probability is printed: '<0.001', else with three decimals."""
    return F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def cell_id(lon: Column, lat: Column, lon0: float, lat0: float, step: float) -> Column:
    """The number of a grid cell, row by row from the south-west."""
    columns = round(360 / step)
    return (F.floor((lat - lat0) / step) * columns + F.floor((lon - lon0) / step)).cast("bigint")


def cell_lon(cell: Column, lon0: float, step: float) -> Column:
    return (cell % round(360 / step)) * step + lon0 + step / 2


def cell_lat(cell: Column, lat0: float, step: float) -> Column:
    return F.floor(cell / round(360 / step)) * step + lat0 + step / 2


def normal_tail(z: float) -> float:
    """P(Z > z) for Python code inside tasks."""
    return 0.5 * math.erfc(z / math.sqrt(2))
