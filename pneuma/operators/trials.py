"""Trial-level behaviour: expected breaths, direction, quality tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.islands import correlation
from ..functions.tdist import t_cdf, t_quantile
from .extrema import enforce_alternation, extrema_zerocross
from .matching import match_onsets
from .timebase import assign_block


def expected_durations(trials: DataFrame, base_s: float = 4.0, breaths: int = 4) -> DataFrame:
    """One row per expected breath. Low salience: a geometric ramp to 1 + delta; High: two base, then two changed; no change: constant."""
    k = trials.withColumn("breath", F.explode(F.sequence(F.lit(1), F.lit(breaths))))
    ramp = F.pow(1 + F.col("delta"), (F.col("breath") - 1) / F.lit(breaths - 1.0))
    factor = F.when(F.coalesce("delta", F.lit(0.0)) == 0, 1.0).when(F.col("salience") == "Low", ramp).when(F.col("breath") > 2, 1 + F.col("delta")).otherwise(1.0)
    return k.withColumn("duration_s", F.lit(base_s) * factor)


def expected_waveform(durations: DataFrame, key: str, points: int) -> DataFrame:
    """A sine from trough to trough for each expected breath at `points` phases; the last breath's right end included."""
    last = F.col("breath") == F.max("breath").over(_by(key))
    start = F.sum("duration_s").over(_by(key).orderBy("breath")) - F.col("duration_s")
    w = durations.withColumns({"_start": start, "_n": F.when(last, points).otherwise(points - 1)})
    w = w.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    phase = F.col("k") / F.lit(float(points))
    return w.select(key, "breath", "k", (F.col("_start") + phase * F.col("duration_s")).alias("t_s"), (-F.cos(2 * math.pi * phase)).alias("value"))


def _by(key: str) -> WindowSpec:
    return Window.partitionBy(key)


def wide_breaths(breaths: DataFrame, key: str, value: str = "duration") -> DataFrame:
    """b1 to b4: the mean value of each numbered breath."""
    return breaths.groupBy(key).agg(*[F.avg(F.when(F.col("breath") == i, F.col(value))).alias(f"b{i}") for i in range(1, 5)])


def direction_correct(wide: DataFrame, delta: Column) -> DataFrame:
    """Whether the late pair moved from the early pair as the change did; nulls are skipped in a pair's mean, a null or zero change has no answer."""
    mean = lambda a, b: F.coalesce((F.col(a) + F.col(b)) / 2, F.col(a), F.col(b))
    move = mean("b3", "b4") - mean("b1", "b2")
    single = (F.col("b1").isNull() != F.col("b2").isNull()) | (F.col("b3").isNull() != F.col("b4").isNull())
    return wide.withColumns({"move": move, "correct": F.when(delta != 0, F.signum(move) == F.signum(delta)), "single": single})


def adherence_direction(slope: Column, change: Column) -> Column:
    """1 along the change, -1 against it, 0 without a slope's sign; null where there is no change or no slope."""
    return F.when((change != 0) & slope.isNotNull(), (F.signum(slope) * F.signum(change)).cast("int"))


def qc_summary(trials: DataFrame, by: list[str]) -> DataFrame:
    """Counts, means, share correct and r of change with the last less the first breath, overall and in changed trials."""
    move = F.col("b4") - F.col("b1")
    pair = F.when(move.isNotNull(), F.col("delta"))
    changed = F.when((F.col("delta") != 0) & move.isNotNull(), F.col("delta"))
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trials"), F.count("correct").alias("n_scored"), (100 * F.avg(F.col("correct").cast("double"))).alias("pct_correct"), F.median("move").alias("median_move"),
        F.when(F.count(pair) >= 3, correlation(pair, F.when(pair.isNotNull(), move))).alias("r_all"), F.when(F.count(changed) >= 3, correlation(changed, F.when(changed.isNotNull(), move))).alias("r_changed"),
        F.stddev_samp(F.when(F.col("delta") == 0, move)).alias("no_change_sd"),
    )


def t_bounds(values: DataFrame, value: str, margin: float, by: list[str]) -> DataFrame:
    """n, mean, sd and the two one-sided t statistics against the margins; null below three values or without spread."""
    g = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ok = (F.col("n") >= 3) & (F.col("sd") > 0)
    se = F.col("sd") / F.sqrt("n")
    return g.withColumns({"t_lower": F.when(ok, (F.col("mean") + margin) / se), "t_upper": F.when(ok, (F.col("mean") - margin) / se)})


def with_p(bounds: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds to t_bounds p (the larger of the two one-sided ones), the lower bound of the mean and the larger absolute limit of its interval."""
    df, half = (F.col("n") - 1).cast("double"), t_quantile(F.lit(level), (F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n")
    ok = F.col("t_lower").isNotNull()
    p = F.greatest(1 - t_cdf("t_lower", df), t_cdf("t_upper", df))
    return bounds.withColumns({"p": F.when(ok, p), "lower_bound": F.when(ok, F.col("mean") - half), "equivalence_bound": F.when(ok, F.greatest(F.abs(F.col("mean") - half), F.abs(F.col("mean") + half)))})


def lower_bound(values: DataFrame, value: str, by: list[str], level: float = 0.95) -> DataFrame:
    """n, mean and mean - t * sd / sqrt(n) per group; null below three values or without spread."""
    return with_p(t_bounds(values, value, 0.0, by), level).select(*by, "n", "mean", "lower_bound")


def equivalence_bound(values: DataFrame, value: str, by: list[str], level: float = 0.95) -> DataFrame:
    """n, mean and the larger absolute limit of the two-sided interval (90 % for a level of 0.95)."""
    return with_p(t_bounds(values, value, 0.0, by), level).select(*by, "n", "mean", "equivalence_bound")


def trial_qc_table(trials: DataFrame, breaths: DataFrame, key: str = "trial", delta: str = "delta") -> DataFrame:
    """Every trial once: breaths side by side (key, breath, duration), the late pair's move, whether it is as the change, and notes on what is missing."""
    j = direction_correct(trials.join(wide_breaths(breaths, key), key, "left"), F.col(delta))
    missing = [F.when(F.col(f"b{i}").isNull(), F.lit(f"no breath {i}")) for i in range(1, 5)]
    return j.withColumn("qc_note", F.concat_ws("; ", *missing, F.when(F.col(delta) == 0, F.lit("no change"))))


def good_subset(qc: DataFrame, by: str, run: str, runs: list, least: float = 90.0) -> DataFrame:
    """Per id the share of trials with all four breaths, where it is enough, the median move, and trials of each run side by side."""
    full = F.lit(True)
    for i in range(1, 5):
        full = full & F.col(f"b{i}").isNotNull()
    counts = [F.count_if(F.col(run) == r).alias(f"n_{str(r).lower()}") for r in runs]
    g = qc.groupBy(by).agg((100.0 * F.avg(full.cast("double"))).alias("pct_complete"), F.median("move").alias("median_move"), *counts)
    return g.where(F.col("pct_complete") >= least)


def align_first_peak(observed: DataFrame, peaks: DataFrame, expected: DataFrame, fs: float, start_s: float = 4.0, far_s: float = 1.0) -> DataFrame:
    """trial, lag_s, n, r, far: the expected waveform put under the observed one by the first peaks, and the correlation where they overlap.

    observed, expected: trial, i (from 0), value; peaks: trial, t_s from the
    trial's start. The expected peak is at half the first breath. Without a peak
    in the trial the largest sample stands for it (the first of ties). Fewer
    than three common samples, or one of them without spread, have no r.
    """
    size = observed.groupBy("trial").agg(F.max("i").alias("_last"), F.max_by("i", F.struct("value", -F.col("i"))).alias("_top"))
    p = peaks.join(size, "trial").where((F.col("t_s") >= 0) & (F.col("t_s") <= F.col("_last") / fs)).groupBy("trial").agg(F.min("t_s").alias("_p"))
    at = F.when(F.col("_p").isNotNull(), F.least(F.col("_last"), F.round(F.col("_p") * fs))).otherwise(F.col("_top"))
    shift = size.join(p, "trial", "left").select("trial", (at - round(start_s / 2 * fs)).cast("bigint").alias("shift"))
    moved = expected.join(shift, "trial").select("trial", (F.col("i") + F.col("shift")).alias("i"), F.col("value").alias("due"))
    both = observed.join(moved, ["trial", "i"]).groupBy("trial").agg(F.count(F.lit(1)).alias("n"), correlation("value", "due").alias("r"), F.var_pop("value").alias("_a"), F.var_pop("due").alias("_b"))
    out = shift.join(both, "trial", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lag = F.col("shift") / F.lit(fs)
    return out.select("trial", lag.alias("lag_s"), "n", F.when((F.col("n") >= 3) & (F.col("_a") > 0) & (F.col("_b") > 0), F.col("r")).alias("r"), (F.abs(lag) > far_s).alias("far"))


def match_expected_breaths(onsets: DataFrame, trials: DataFrame, expected: DataFrame, tol_s: float, bucket_s: float) -> DataFrame:
    """Expected breaths from the first detected onset of each trial on, matched nearest first: counts, mean absolute and signed error.

    onsets: recording_id, idx, t_s; trials: recording_id, trial, start, end; expected: recording_id, trial, breath, offset_s from the first breath.
    """
    key = ["recording_id", "trial"]
    found = assign_block(onsets.select("recording_id", "idx", "t_s"), trials.select(*key, "start", "end"), bucket_s)
    first = found.groupBy(*key).agg(F.min("t_s").alias("_first"))
    due = first.join(expected, key).select(*key, F.col("breath").cast("bigint").alias("idx"), (F.col("_first") + F.col("offset_s")).alias("t_s"))
    m = match_onsets(due, found.select(*key, "idx", "t_s"), tol_s, by=("recording_id", "trial"))
    e = F.col("b_t") - F.col("a_t")
    n = first.join(expected, key).groupBy(*key).agg(F.count(F.lit(1)).alias("n_expected"))
    g = m.groupBy(*key).agg(F.count(F.lit(1)).alias("n_matched"), F.avg(F.abs(e)).alias("mae_s"), F.avg(e).alias("bias_s"))
    out = n.join(g, key, "left").fillna(0, ["n_matched"])
    return out.select(*key, "n_matched", (F.col("n_expected") - F.col("n_matched")).alias("n_missing"), "mae_s", "bias_s")


def local_retry(samples: DataFrame, trials: DataFrame, extrema: DataFrame, breaths: int = 4, amplitude_min: float = 0.1, gap_s: float = 0.5, bucket_s: float = 60.0) -> DataFrame:
    """recording_id, trial, idx, t_s, value, kind, added: the extrema of each trial with too few breaths, with low ones found by zero crossings of
    the trial alone where nothing is near, made to alternate again.

    samples: recording_id, idx, t_s, value; trials: recording_id, trial, start,
    end; extrema: recording_id, idx, kind of the samples. A breath is a step
    between troughs.
    """
    key = ["recording_id", "trial"]
    mine = ["idx", "t_s", "value"]
    x = assign_block(samples.select("recording_id", *mine), trials.select(*key, "start", "end"), bucket_s).select(*key, *mine)
    inside = x.join(extrema.select("recording_id", "idx", "kind"), ["recording_id", "idx"])
    troughs = inside.where("kind = 'trough'").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    few = trials.select(*key).distinct().join(troughs, key, "left").where(F.coalesce("_n", F.lit(0)) - 1 < breaths).select(*key)
    x, old = x.join(few, key, "left_semi"), inside.join(few, key, "left_semi")
    low = extrema_zerocross(x, amplitude_min, by=tuple(key)).select(*key, "idx", "kind").join(x, [*key, "idx"])
    # Nothing within the gap: an anti join on buckets of that width and the neighbouring ones.
    bucket = F.floor(F.col("t_s") / gap_s)
    near = old.select(*key, F.col("t_s").alias("_t"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    close = low.withColumn("_b", bucket).join(near, [*key, "_b"]).where(F.abs(F.col("t_s") - F.col("_t")) < gap_s).select(*key, "idx")
    new = low.join(close, [*key, "idx"], "left_anti")
    both = old.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))
    return enforce_alternation(both, by=tuple(key)).select(*key, *mine, "kind", "added")
