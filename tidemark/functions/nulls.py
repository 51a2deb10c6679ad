"""Null and numeric rules that differ from Spark's defaults and change results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def if_else(condition: Column, yes: Column | object, no: Column | object) -> Column:
    """A two-way choice that is null where the condition is null."""
    yes, no = (x if isinstance(x, Column) else F.lit(x) for x in (yes, no))
    return F.when(condition, yes).when(~condition, no)


def is_in(value: Column, members: Sequence) -> Column:
    """Membership that is never null."""
    return F.coalesce(value.isin(*members), F.lit(False))


def sum0(value: Column) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def no_nan(value: Column) -> Column:
    """NaN as null: as a number it would compare greater than everything."""
    return F.when(~F.isnan(value), value)


def clean(df: DataFrame) -> DataFrame:
    """All floating columns without NaN; for use when data come in."""
    return df.withColumns({c: no_nan(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def coordinate(value: Column) -> Column:
    """A coordinate as a join key: rounded half to even at four decimals."""
    return F.bround(value, 4)


def same(a: Column, b: Column) -> Column:
    """Equality of join keys where null meets null."""
    return a.eqNullSafe(b)
