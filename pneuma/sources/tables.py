"""Canonical inputs: recordings as long sample tables, from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples(recording_id, idx, t_s, value, label, code): one irregular recording per user of `events`."""
    ev = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "value",
        F.col("event_type").alias("label"),
        F.get_json_object("props", "$.k").cast("int").alias("code"),
    )
    w = Window.partitionBy("recording_id").orderBy("us", "event_id")
    every = Window.partitionBy("recording_id")
    return ev.select(
        "recording_id",
        F.row_number().over(w).alias("idx"),
        ((F.col("us") - F.min("us").over(every)) / 1e6).alias("t_s"),
        "value",
        "label",
        "code",
    )


#: The same rows in SQL, as a common table expression named s.
SAMPLES_SQL = """s AS (
  SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS idx,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t_s, value, event_type AS label,
    json_extract_string(props, '$.k')::INT AS code
  FROM events)"""


def vector_samples(spark: SparkSession, sf_dir: str, fs: float = 25.0) -> DataFrame:
    """samples of short uniform recordings, one per row of `embeddings`."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), "label", F.posexplode("embedding").alias("p", "x"))
    return rows.select("recording_id", "label", (F.col("p") + 1).alias("idx"), (F.col("p") / F.lit(fs)).alias("t_s"), F.col("x").cast("double").alias("value"))


VECTORS_SQL = """e AS (
  SELECT vec_id AS recording_id, label, unnest(range(1, len(embedding) + 1)) AS idx, unnest(embedding)::DOUBLE AS value
  FROM embeddings)"""


def from_vector(rows: DataFrame, key: str, values: str, fs: float, t0: float = 0.0, rate: str | None = None) -> DataFrame:
    """samples of one uniform recording per row: key as recording_id, idx from 1, t_s from t0, value. fs is the true rate: a row whose own rate
    (column `rate`) differs from it is an error, as is a rate that is not positive.
    """
    if fs <= 0:
        raise ValueError("the rate is not positive")
    array = F.col(values)
    if rate:
        wrong = F.coalesce(F.abs(F.col(rate) - fs) > 1e-9 * fs, F.lit(False))
        array = F.when(wrong, F.raise_error(F.concat(F.lit("the rate contradicts that of row "), F.col(key).cast("string"))).cast("array<double>")).otherwise(array.cast("array<double>"))
    each = rows.select(F.col(key).alias("recording_id"), F.posexplode(array).alias("_p", "_x"))
    return each.select("recording_id", (F.col("_p") + 1).cast("bigint").alias("idx"), (F.lit(t0) + F.col("_p") / F.lit(fs)).alias("t_s"), F.col("_x").cast("double").alias("value"))
