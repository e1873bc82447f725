"""Clocks, grids, interpolation and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, along, finite

ACCEL_HZ, PACKET_SAMPLES = 203.4, 36


def accel_times(rows: DataFrame) -> DataFrame:
    """Time of each sample from its packet's time (the last sample's) and its place; marks impossible places and odd packets."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*REC, "packet_ts"))
    t = F.col("packet_ts") - (n - 1 - F.col("sample_index")) * (1000.0 / ACCEL_HZ)
    return rows.withColumns({"n_in_packet": n, "sample_ms": t, "bad_index": F.col("sample_index") >= PACKET_SAMPLES, "odd_packet": n != PACKET_SAMPLES})


def packet_stats(rows: DataFrame) -> DataFrame:
    p = rows.select(*REC, "packet_ts").distinct()
    p = p.withColumn("gap", F.col("packet_ts") - F.lag("packet_ts").over(along("packet_ts")))
    return p.groupBy(*REC).agg(
        F.count(F.lit(1)).alias("n_packets"), F.avg("gap").alias("mean_ms"), F.median("gap").alias("median_ms"),
        F.stddev_samp("gap").alias("jitter_ms"), F.percentile("gap", F.lit(0.95)).alias("p95_ms"), F.max("gap").alias("max_ms"),
    )


def make_grid(samples: DataFrame, step: float) -> DataFrame:
    """recording_id, k, t_s: min + k * step up to max; never summed up, so errors do not grow."""
    r = samples.groupBy(*REC).agg(F.min("t_s").alias("lo"), F.max("t_s").alias("hi"))
    r = r.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / step).cast("int"))))
    return r.select(*REC, "k", (F.col("lo") + F.col("k") * F.lit(step)).alias("t_s"))


def _neighbours(order: list, ahead: list, by: tuple[str, ...] = REC) -> tuple[Column, Column]:
    """The last known `point` up to each row along one order, and the next one: both look back, one along the reversed order."""
    back = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    front = Window.partitionBy(*by).orderBy(*ahead).rowsBetween(Window.unboundedPreceding, 0)
    return F.last("point", True).over(back), F.last("point", True).over(front)


def interp_to_grid(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """Linear interpolation of samples at grid times, ends held: both together sorted forward and backward in one shuffle."""
    point = F.struct("t_s", "value")
    both = samples.where("value is not null").select(*REC, "t_s", point.alias("point"), F.lit(None).cast("bigint").alias("k")).unionByName(
        grid.select(*REC, "t_s", F.lit(None).cast("struct<t_s:double,value:double>").alias("point"), F.col("k").cast("bigint").alias("k"))
    )
    # Samples have no k: they come before grid points of the same time.
    before, after = _neighbours([F.col("t_s"), F.col("k").asc_nulls_first()], [F.col("t_s").desc(), F.col("k").asc_nulls_first()])
    both = both.withColumns({"a": before, "b": after}).where("k is not null")
    a, b = F.col("a"), F.col("b")
    part = (F.col("t_s") - a["t_s"]) / (b["t_s"] - a["t_s"])
    line = F.when(a.isNull(), b["value"]).when(b.isNull() | (a["t_s"] == F.col("t_s")), a["value"]).otherwise(a["value"] + part * (b["value"] - a["value"]))
    return both.select(*REC, F.col("k").cast(grid.schema["k"].dataType).alias("k"), "t_s", line.alias("value"))


def fill_gaps(samples: DataFrame, by: tuple[str, ...] = REC) -> DataFrame:
    """Missing values interpolated along idx, ends held; filled marks them. A recording without values stays missing."""
    x = samples.withColumn("point", F.when(finite("value").isNotNull(), F.struct("idx", "value")))
    before, after = _neighbours([F.col("idx")], [F.col("idx").desc()], by)
    x = x.withColumns({"a": before, "b": after})
    a, b = F.col("a"), F.col("b")
    line = F.when(a.isNull(), b["value"]).when(b.isNull() | (a["idx"] == b["idx"]), a["value"])
    line = line.otherwise(a["value"] + (b["value"] - a["value"]) * (F.col("idx") - a["idx"]) / (b["idx"] - a["idx"]))
    return x.withColumns({"filled": F.col("point").isNull(), "value": line}).drop("a", "b", "point")


def sample_time(samples: DataFrame, fs: float, t0: Column | float = 0.0) -> DataFrame:
    """t_s of each sample: t0 + (idx - 1) / fs."""
    return samples.withColumn("t_s", (t0 if isinstance(t0, Column) else F.lit(t0)) + (F.col("idx") - 1) / F.lit(fs))


def project_to_grid(samples: DataFrame, drift: DataFrame, grid: DataFrame, fs: float = 25.0) -> DataFrame:
    """A second device's samples on the first one's grid: its clock is (idx - 1) / fs plus the fitted offset at trial 0 (drift.offset0_ms)."""
    own = samples.select(*REC, "idx", "value").join(drift.select(*REC, (F.col("offset0_ms") / 1000).alias("t0")), list(REC))
    return interp_to_grid(sample_time(own, fs, F.col("t0")), grid)


def recording_duration(samples: DataFrame, fs: float) -> DataFrame:
    return samples.groupBy(*REC).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(fs)).alias("duration_s"), ((F.max("idx") - 1) / F.lit(fs)).alias("last_time_s"))


def slice_recordings(samples: DataFrame, start: float, stop: float) -> DataFrame:
    """Samples with start <= t_s <= stop; t0 is the first kept time."""
    kept = samples.where(F.col("t_s").between(start, stop))
    return kept.withColumn("t0", F.min("t_s").over(Window.partitionBy(*REC)))


def align_trials(triggers: DataFrame, trials: DataFrame) -> DataFrame:
    """k-th trigger with k-th trial by time, in recordings with as many of both; offset in ms."""

    def ranked(d: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*REC))
        return d.select(*REC, F.row_number().over(along(["t_s", "idx"])).alias("trial_idx"), F.col("t_s").alias(name), n.alias(f"n_{name}"))

    both = ranked(triggers, "trigger_s").join(ranked(trials, "trial_s"), [*REC, "trial_idx"])
    return both.where("n_trigger_s = n_trial_s").select(*REC, "trial_idx", "trigger_s", "trial_s", (1000 * (F.col("trial_s") - F.col("trigger_s"))).alias("offset_ms"))


def fit_clock_drift(aligned: DataFrame) -> DataFrame:
    """Line of the offset over trials: start, slope, spread of residuals and total drift."""
    fit = aligned.groupBy(*REC).agg(
        F.count(F.lit(1)).alias("n_trials"), F.regr_slope("offset_ms", "trial_idx").alias("slope_ms"), F.regr_intercept("offset_ms", "trial_idx").alias("offset0_ms")
    )
    res = aligned.join(fit, list(REC)).withColumn("r", F.col("offset_ms") - F.col("offset0_ms") - F.col("slope_ms") * F.col("trial_idx"))
    sd = res.groupBy(*REC).agg(F.stddev_samp("r").alias("residual_sd_ms"))
    return fit.join(sd, list(REC)).withColumn("drift_ms", F.col("slope_ms") * (F.col("n_trials") - 1))


def assign_block(samples: DataFrame, windows: DataFrame, bucket_s: float) -> DataFrame:
    """Samples in windows [start, end] of their recording: an equi-join on time buckets, then the exact bounds.

    Buckets last bucket_s, or for longer windows that times the next power of two, so that a window of any length lies in a
    few of them; a sample is looked up once for each length of bucket that windows of its recording need.
    """
    lasts = F.lit(float(bucket_s)) * F.pow(F.lit(2.0), F.col("_level"))
    b = lambda c: F.floor(F.col(c) / lasts)
    level = F.ceil(F.log2(F.greatest((F.col("end") - F.col("start")) / bucket_s, F.lit(1.0))))
    w = windows.where("end >= start").withColumn("_level", level)
    s = samples.join(w.select(*REC, "_level").distinct(), list(REC)).withColumn("bucket", b("t_s"))
    w = w.withColumn("bucket", F.explode(F.sequence(b("start"), b("end"))))
    return s.join(w, [*REC, "_level", "bucket"]).where("t_s between start and end").drop("_level", "bucket")


def from_timestamped(samples: DataFrame) -> DataFrame:
    """Rate from the median step, and its jitter (sd over median), per recording."""
    d = samples.withColumn("d", F.col("t_s") - F.lag("t_s").over(along()))
    r = d.groupBy(*REC).agg(F.count(F.lit(1)).alias("n"), F.median("d").alias("step_s"), F.stddev_samp("d").alias("sd_s"))
    jitter = F.try_divide(F.col("sd_s"), F.col("step_s"))
    return r.select(*REC, "n", "step_s", F.try_divide(F.lit(1.0), F.col("step_s")).alias("fs"), jitter.alias("jitter"), (jitter > 0.01).alias("jittery"))


def list_channels(samples: DataFrame) -> DataFrame:
    """Number, name, units, rate (from the mean step), samples and span of each channel of a recording."""
    g = samples.groupBy(*REC, "channel").agg(F.first("units", True).alias("units"), F.count(F.lit(1)).alias("n"), F.min("t_s").alias("first_s"), F.max("t_s").alias("last_s"))
    fs = F.try_divide(F.col("n") - 1, F.col("last_s") - F.col("first_s"))
    return g.withColumns({"index": F.row_number().over(along("channel")), "fs": fs})


def legacy_rate_fix(recordings: DataFrame, most: int = 13) -> DataFrame:
    """Repairs a stored rate: the factor asked for, and the one that a decimator with stages of at most `most` reached.

    Each stage takes the largest whole divisor-free step: while the factor is
    above `most`, it is cut by `most` and truncated.
    """
    asked = F.round(F.col("fs_native") / F.col("fs")).cast("int")
    r = recordings.withColumn("q_req", asked)
    step = lambda acc, _: F.when(
        acc["left"] > most, F.struct((acc["done"] * most).alias("done"), F.floor(acc["left"] / most).cast("int").alias("left"))
    ).otherwise(acc)
    start = F.struct(F.lit(1).alias("done"), F.col("q_req").alias("left"))
    got = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda acc: acc["done"] * acc["left"])
    return r.withColumn("q_got", got).withColumn("fs_fixed", F.col("fs_native") / F.col("q_got"))
