"""Arithmetic in which a missing or undefined result is NULL, never NaN, infinite or an error."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value as a double, or NULL if it is NaN or infinite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def divide(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or the result is not finite."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def log(x: Column) -> Column:
    """Natural logarithm, NULL where x is not above 0."""
    return F.when(x > 0, F.ln(x))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate over rows that have both, NULL if either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def row_sum(columns: list[Column]) -> Column:
    """Sum over columns, skipping NULLs; NULL if all are."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def row_mean(columns: list[Column]) -> Column:
    """Mean over columns, skipping NULLs; NULL if all are."""
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(row_sum(columns), n)


def mean_rank(x: Column, *by: Column | str) -> Column:
    """Rank among the values of a partition, ties sharing their mean rank; NULL for a missing value.

    Rank and ties come from one order of the partition (missing values last), so ranks of several columns share the
    partition's shuffle.
    """
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(w) + (peers - 1) / 2)
