"""Cleaning of signals: constants, clipping, scales, smoothing, flat and saturated stretches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, along, run_ids
from .breaths import MAD_SCALE


def constant_check(samples: DataFrame, eps: float = 2.0**-52) -> DataFrame:
    lo, hi = F.min("value"), F.max("value")
    flat = (hi - lo) <= eps * F.greatest(F.lit(1.0), F.greatest(F.abs(lo), F.abs(hi)))
    return samples.groupBy(*REC).agg(flat.alias("constant"), lo.alias("lo"), hi.alias("hi"))


def clip_quantiles(samples: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Values clamped to two exact quantiles of the recording."""
    q = samples.groupBy(*REC).agg(F.percentile("value", F.lit(low)).alias("lo"), F.percentile("value", F.lit(high)).alias("hi"))
    x = samples.join(q, list(REC))
    clipped = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    return x.withColumn("clipped", clipped).withColumn("value", F.least(F.greatest("value", "lo"), "hi")).drop("lo", "hi")


def normalise(samples: DataFrame, how: str = "robust") -> DataFrame:
    """(x - median) / (1.4826 MAD), or z with the n - 1 sd; without spread the signal is only centred."""
    if how == "z":
        s = samples.groupBy(*REC).agg(F.avg("value").alias("_c"), F.stddev_samp("value").alias("_s"))
    else:
        m = samples.groupBy(*REC).agg(F.median("value").alias("_c"))
        s = samples.join(m, list(REC)).groupBy(*REC).agg(F.first("_c").alias("_c"), (MAD_SCALE * F.median(F.abs(F.col("value") - F.col("_c")))).alias("_s"))
    x = samples.join(s, list(REC))
    return x.withColumn("value", (F.col("value") - F.col("_c")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))).drop("_c", "_s")


def smooth_ma(samples: DataFrame, k: int) -> DataFrame:
    """Centred moving average of k (odd) samples; ends keep their input."""
    h = k // 2
    w = along().rowsBetween(-h, h)
    full = F.count(F.lit(1)).over(w) == k
    return samples.withColumn("value", F.when(full, F.avg("value").over(w)).otherwise(F.col("value")))


def smooth_gaussian(samples: DataFrame, fwhm: float) -> DataFrame:
    """Centred Gaussian kernel (full width at half maximum in samples, three sigma each side); ends keep their input."""
    sigma = fwhm / (2 * math.sqrt(2 * math.log(2)))
    h = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-h, h + 1)]
    total = sum(weights)
    w = along()
    terms = [F.lit(x / total) * (F.col("value") if i == 0 else F.lead("value", i).over(w) if i > 0 else F.lag("value", -i).over(w)) for i, x in zip(range(-h, h + 1), weights, strict=True)]
    return samples.withColumn("value", F.coalesce(sum(terms[1:], terms[0]), F.col("value")))


def flatline(samples: DataFrame, min_run: int, digits: int = 6, by: tuple[str, ...] = REC) -> DataFrame:
    """Share of samples in runs of at least min_run equal rounded values, and their number."""
    r = run_ids(samples.withColumn("_v", F.round("value", digits)), "_v", "idx", by).groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("there"))
    long = (F.col("n") >= max(2, min_run)) & (F.col("there") > 0)
    return r.groupBy(*by).agg((100.0 * F.sum(F.when(long, F.col("n")).otherwise(0)) / F.sum("n")).alias("flat_pct"), F.count_if(long).alias("n_runs"))


def saturation(samples: DataFrame, tol: float = 0.001) -> DataFrame:
    """Share of samples within tol of the range from either rail, counted once."""
    by = Window.partitionBy(*REC)
    x = samples.withColumns({"lo": F.min("value").over(by), "hi": F.max("value").over(by)})
    band = tol * (F.col("hi") - F.col("lo"))
    at = (F.col("value") <= F.col("lo") + band) | (F.col("value") >= F.col("hi") - band)
    return x.groupBy(*REC).agg((100.0 * F.avg(at.cast("double"))).alias("saturated_pct"))


def vacant_channel_guard(samples: DataFrame, least_sd: float = 0.01) -> DataFrame:
    """Channels of a recording with next to no spread, as of an empty seat: recording_id, channel, n, sd."""
    s = samples.groupBy(*REC, "channel").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"))
    return s.where((F.col("sd") < least_sd) | (F.col("n") < 2))


def missing_pct(samples: DataFrame) -> DataFrame:
    gone = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return samples.groupBy(*REC).agg((100.0 * F.avg(gone.cast("double"))).alias("missing_pct"))
