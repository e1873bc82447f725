"""Patterns over ordered rows that many operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REC = ("recording_id",)


def along(order: Sequence[str] | str = "idx", by: Sequence[str] = REC):
    return Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order))


def finite(c: str | Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def run_ids(df: DataFrame, value: str, order: Sequence[str] | str = "idx", by: Sequence[str] = REC, name: str = "run") -> DataFrame:
    """Numbers the runs of equal values (null equals null) in order, from 1."""
    w = along(order, by)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w)).drop("_change")


def slope(y: str, x: str) -> Column:
    """Least-squares slope over pairs where both are there; null below two pairs or without spread in x."""
    y_ok = F.when(F.col(x).isNotNull(), F.col(y))
    x_ok = F.when(F.col(y).isNotNull(), F.col(x))
    return F.when((F.count(y_ok) > 1) & (F.var_pop(x_ok) > 0), F.regr_slope(y, x))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over pairs where both are there; null without spread in either (where corr would divide by zero)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def rmssd(df_d2: str) -> Column:
    """Root mean square of successive differences, from a column of squared differences."""
    return F.sqrt(F.avg(df_d2))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, for reports and comparisons."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
