"""Vectors as packed arrays of one type, without those that take no part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick


def usable_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows whose vector is not null and holds finite components only."""
    rows = pick(rows, vec_id="bigint", embedding="array<double>").withColumnRenamed("embedding", "v")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("v").isNotNull() & ~odd)
