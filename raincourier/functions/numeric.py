"""Numeric helpers shared by all expressions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int = 0) -> Column:
    """Half-up rounding decided at twelve decimals, so the last bits of a
    distributed float sum (which depend on task order) cannot flip a tie."""
    return F.round(value.cast("decimal(38,12)"), places).cast("double")


def whole(value: Column) -> Column:
    return rounded(value, 0).cast("bigint")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null for a zero or null divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def pick(selector: Column, table: dict, default=None) -> Column:
    """Small literal lookup as a CASE chain, folded by Catalyst."""
    expr = None
    for key, value in table.items():
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(selector == key, value) if expr is None else expr.when(selector == key, value)
    return expr if default is None else expr.otherwise(default)


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def complementary_error(x: Column) -> Column:
    """erfc by the rational approximation 7.1.26 of Abramowitz and Stegun
    (absolute error below 1.5e-7); Spark has no builtin."""
    # Published coefficients of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for coefficient in reversed(a):
        poly = (poly + coefficient) * t
    tail = poly * F.exp(-x * x)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def finite(value: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(F.abs(value) < float("inf"), value)
