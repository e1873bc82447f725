"""Replay of adaptive staircases: posteriors over 46 threshold levels as running sums of logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the task: log10 levels from 0.1 to 2.0, prior, slope, guess and lapse rates, and when it stops.
LEVELS, LOW, HIGH, PRIOR_MEAN, PRIOR_SD = 46, 0.1, 2.0, 0.5, 0.25
SLOPE, GUESS, LAPSE = 3.5, 0.5, 0.02
STOP_SD, STOP_TRIALS, STOP_ALL = 0.10, 10, 60
KEY = ("participant_id", "staircase")


def levels(spark) -> DataFrame:
    t = F.log10(F.lit(LOW)) + F.col("id") * (F.log10(F.lit(HIGH)) - F.log10(F.lit(LOW))) / (LEVELS - 1)
    prior = -0.5 * F.pow((t - F.log10(F.lit(PRIOR_MEAN))) / PRIOR_SD, F.lit(2.0))
    return spark.range(LEVELS).select(F.col("id").cast("int").alias("level"), t.alias("threshold"), prior.alias("prior"))


def likelihood(s: Column, t: Column, correct: Column) -> Column:
    """Chance of the answer at log intensity s and threshold t; a wrong answer is either of two."""
    hit = (1 - LAPSE) * (GUESS + (1 - GUESS) * (1 - F.exp(-F.pow(F.lit(10.0), SLOPE * (s - t))))) + LAPSE * GUESS
    return F.when(correct, hit).otherwise((1 - hit) / 2)


def _logs(trials: DataFrame) -> DataFrame:
    updating = trials.where("not catch")
    each = updating.crossJoin(F.broadcast(levels(trials.sparkSession)))  # 46 rows
    return each.withColumn("ll", F.log(likelihood(F.col("intensity"), F.col("threshold"), F.col("correct"))))


def _moments(weighted: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sd of the threshold under weights exp(logp - max)."""
    top = Window.partitionBy(*by)
    p = weighted.withColumn("p", F.exp(F.col("logp") - F.max("logp").over(top)))
    m = p.groupBy(*by).agg((F.sum(F.col("p") * F.col("threshold")) / F.sum("p")).alias("mean"), (F.sum(F.col("p") * F.col("threshold") * F.col("threshold")) / F.sum("p")).alias("m2"))
    return m.select(*by, "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - F.col("mean") * F.col("mean"))).alias("sd"))


def staircase_posterior(trials: DataFrame) -> DataFrame:
    """participant_id, staircase, level, p after all updating trials."""
    s = _logs(trials).groupBy(*KEY, "level", "threshold", "prior").agg(F.sum("ll").alias("ll"))
    logp = F.col("prior") + F.col("ll")
    top = Window.partitionBy(*KEY)
    s = s.withColumn("logp", logp).withColumn("e", F.exp(F.col("logp") - F.max("logp").over(top)))
    return s.select(*KEY, "level", "threshold", (F.col("e") / F.sum("e").over(top)).alias("p"))


def _trace(rows: pd.DataFrame) -> pd.DataFrame:
    """Posterior moments after each trial of each staircase (arrays of intensities and answers)."""
    t = np.linspace(np.log10(LOW), np.log10(HIGH), LEVELS)
    prior = -0.5 * ((t - np.log10(PRIOR_MEAN)) / PRIOR_SD) ** 2
    means, sds = [], []
    for s, correct in zip(rows["intensity"], rows["correct"], strict=True):
        hit = (1 - LAPSE) * (GUESS + (1 - GUESS) * (1 - np.exp(-(10.0 ** (SLOPE * (np.asarray(s, float)[:, None] - t)))))) + LAPSE * GUESS
        logp = prior + np.cumsum(np.log(np.where(np.asarray(correct, bool)[:, None], hit, (1 - hit) / 2)), axis=0)
        p = np.exp(logp - logp.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        mean = p @ t
        means.append(mean)
        sds.append(np.sqrt(np.maximum(0.0, p @ (t * t) - mean * mean)))
    return pd.DataFrame({"mean": means, "sd": sds})


def staircase_trace(trials: DataFrame) -> DataFrame:
    """Posterior mean and sd after each updating trial; a staircase is one array of trials, of which there are at most dozens."""
    rows = trials.where("not catch").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("trial", "intensity", "correct"))).alias("t"))
    moments = F.pandas_udf(_trace, "mean array<double>, sd array<double>")(F.struct(F.col("t.intensity").alias("intensity"), F.col("t.correct").alias("correct")))
    each = rows.withColumn("m", moments).select(*KEY, F.explode(F.arrays_zip(F.col("t.trial").alias("trial"), F.col("m.mean").alias("mean"), F.col("m.sd").alias("sd"))).alias("r"))
    return each.select(*KEY, "r.trial", "r.mean", "r.sd")


def staircase_stop(trials: DataFrame) -> DataFrame:
    """First trial at which a staircase's sd is small after enough trials, or the most trials are reached."""
    t = staircase_trace(trials).withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("trial")))
    done = F.when(((F.col("sd") < STOP_SD) & (F.col("k") >= STOP_TRIALS)) | (F.col("k") >= STOP_ALL), F.col("trial"))
    return t.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_trials"), F.min(done).alias("stop_trial"), F.max_by("sd", "trial").alias("last_sd"))


def threshold_table(trials: DataFrame, kinds: list[str]) -> DataFrame:
    """10^mean for each staircase side by side, their mean, and the sds."""
    s = _logs(trials).groupBy(*KEY, "level", "threshold", "prior").agg(F.sum("ll").alias("ll")).withColumn("logp", F.col("prior") + F.col("ll"))
    m = _moments(s, list(KEY)).withColumn("t", F.pow(F.lit(10.0), F.col("mean")))
    wide = m.groupBy("participant_id").agg(*[F.max(F.when(F.col("staircase") == k, F.col(c))).alias(f"{c}_{k}") for k in kinds for c in ("t", "sd")], F.avg("t").alias("t_mean"))
    return wide
