"""CSV logs of the recording app, with fixed schemas and the participant from the file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of each kind of log.
SCHEMAS = {
    "accel": "phase string, trial int, packet_timestamp bigint, sample_index int, x double, y double, z double, pacer_radius double",
    "hr": "phase string, trial int, timestamp bigint, heart_rate double",
    "trials": "phase string, trial int, condition string, base_period_s double, change_period_s double, start_ms double, end_ms double, peak_error_ms double",
    "quest": "trial int, direction string, delta_ratio double, response string, correct boolean, confidence double, arousal double, posterior_mean_log double, posterior_sd double",
}


def read_log(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Rows of all files with their participant and file; a row that does not fit the schema is an error."""
    rows = spark.read.schema(SCHEMAS[kind]).option("header", True).option("mode", "FAILFAST").csv(paths)
    file = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(file, r"([^/]+)_session[0-9]+_[a-z]+\.csv$", 1).alias("participant_id"), file.alias("file"))


def read_accel(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Accelerometer rows of participants; one who is in several files, or a file without a participant in its name, is an error."""
    return _whole(read_log(spark, paths, "accel"))


def read_hr(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _whole(read_log(spark, paths, "hr"))


def _whole(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("participant_id")
    several = F.min("file").over(w) != F.max("file").over(w)
    why = F.when(F.col("participant_id") == "", F.concat(F.lit("no participant in the name of "), "file")).when(several, F.concat(F.lit("several files of participant "), "participant_id"))
    return rows.withColumn("participant_id", F.when(why.isNotNull(), F.raise_error(why).cast("string")).otherwise(F.col("participant_id")))


def read_trial_logs(spark: SparkSession, paths: str | list[str], kind: str = "trials") -> DataFrame:
    """Rows of trial logs, or of staircase logs (kind quest)."""
    return read_log(spark, paths, kind)


def read_tables(spark: SparkSession, tables: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Named tables from (path, schema): Parquet where the path says so, else CSV with a header; other columns are left out, and a missing one is null."""
    out = {}
    for name, (path, schema) in tables.items():
        reader = spark.read.schema(schema)
        out[name] = reader.parquet(path) if ".parquet" in path else reader.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return out


def one_file_each(rows: DataFrame) -> DataFrame:
    """participant_id, n_files, ok: whether exactly one file holds the participant."""
    n = rows.groupBy("participant_id").agg(F.countDistinct("file").alias("n_files"))
    return n.withColumn("ok", F.col("n_files") == 1)


def read_channels(samples: DataFrame, name: str, exact: bool = False, strict: bool = True) -> DataFrame:
    """Samples of the channel called `name` (or whose name holds it, whatever the case) of each recording.

    A recording where several channels fit, or channels of one name have
    different rates, is an error; where not strict its rows are left out. So are
    those of a recording without such a channel.
    """
    c = F.lower("channel")
    hit = samples.where(c == name.lower() if exact else F.contains(c, F.lit(name.lower())))
    w = Window.partitionBy("recording_id")
    ok = (F.min("channel").over(w) == F.max("channel").over(w)) & F.coalesce(F.min("fs").over(w) == F.max("fs").over(w), F.lit(True))
    hit = hit.withColumn("_ok", ok)
    if not strict:
        return hit.where("_ok").drop("_ok")
    why = F.concat(F.lit(f"{name!r} is not one channel of one rate in recording "), F.col("recording_id").cast("string"))
    return hit.withColumn("channel", F.when(F.col("_ok"), F.col("channel")).otherwise(F.raise_error(why).cast("string"))).drop("_ok")
