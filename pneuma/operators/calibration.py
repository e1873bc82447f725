"""The reconstructed pacer and the calibration of an accelerometer against it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, correlation, run_ids
from ..sources.shared import stored
from .spectrum import calib_bandpass, calib_lowpass, with_halo
from .timebase import assign_block

#: The base period, breaths at it and in all, what the edges and the software add to a trial (ms).
BASE_MS, BASE_BREATHS, BREATHS, EDGE_MS, SOFTWARE_MS = 4000.0, 2, 4, 285.0, 548.0


def pacer_radius(t: Column, start: Column, period: Column) -> Column:
    return (1 - F.cos(2 * math.pi * (t - start) / period)) / 2


def pacer_radius_trial(t: Column, start: Column, base: Column, changed: Column) -> Column:
    """Base period for two breaths, then the changed one, anchored anew at the boundary."""
    boundary = start + BASE_BREATHS * base
    return F.when(t <= boundary, pacer_radius(t, start, base)).otherwise(pacer_radius(t, boundary, changed))


def pacer_overshoot(trials: DataFrame) -> DataFrame:
    """Extra time per breath of each participant's trials, from hardware durations or software ones less their overhead."""
    duration = F.coalesce("hardware_ms", F.col("end_ms") - F.col("onset_ms") - SOFTWARE_MS)
    nominal = BASE_BREATHS * BASE_MS + (BREATHS - BASE_BREATHS) * F.col("period_ms")
    t = trials.withColumn("d", (duration - nominal - EDGE_MS) / BREATHS)
    return t.groupBy("participant_id").agg(F.count("d").alias("n_trials"), F.median("d").alias("delta_ms"), F.stddev_samp("d").alias("delta_sd"), F.avg("d").alias("delta_mean"))


def condition_boundary(start: Column, delta: Column) -> Column:
    return start + BASE_BREATHS * (BASE_MS + delta)


def calib_attempts(packets: DataFrame) -> DataFrame:
    """Runs of calibration phases per recording: number of breathe runs, the last one's bounds and anchor.

    packets: recording_id, packet, phase (fixation or breathe), first_s, last_s; one row per packet. The end of fixation
    counts only where its run comes right before the last breathe run.
    """
    runs = run_ids(packets, "phase", "packet").groupBy(*REC, "run").agg(F.first("phase").alias("phase"), F.min("first_s").alias("start"), F.max("last_s").alias("end"))
    w = Window.partitionBy(*REC).orderBy("run")
    runs = runs.withColumns({"before": F.lag("phase").over(w), "before_end": F.lag("end").over(w)})
    b = runs.where("phase = 'breathe'").groupBy(*REC).agg(F.count(F.lit(1)).alias("n_attempts"), F.max_by(F.struct("start", "end", "before", "before_end"), "run").alias("l"))
    fix = F.when(F.col("l.before") == "fixation", F.col("l.before_end"))
    start = F.col("l.start")
    return b.select(*REC, "n_attempts", start.alias("start_s"), F.col("l.end").alias("end_s"), fix.alias("fix_end_s"), F.coalesce((fix + start) / 2, start).alias("anchor_s"))


def fit_mlr(rows: DataFrame, by: str = "participant_id") -> DataFrame:
    """Least squares of target on x, y, z with intercept, by Cramer's rule on grouped covariances, and the fit's correlation."""
    names = ["x", "y", "z"]
    c = lambda a, b: F.covar_samp(a, b)
    aggs = [c(a, b).alias(f"{a}{b}") for i, a in enumerate(names) for b in names[i:]] + [c(a, "target").alias(f"{a}t") for a in names]
    s = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.var_samp("target").alias("tt"), *[F.avg(a).alias(f"m{a}") for a in [*names, "target"]], *aggs)
    col = lambda a, b: F.col(a + b if a <= b else b + a)
    m = [[col(a, b) for b in names] for a in names]
    v = [F.col(f"{a}t") for a in names]

    def det(q: list[list[Column]]) -> Column:
        return (
            q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1]) - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0]) + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])
        )

    whole = det(m)
    w = [F.try_divide(det([[v[i] if k == j else m[i][k] for k in range(3)] for i in range(3)]), whole) for j in range(3)]
    s = s.withColumns({f"w{a}": w[j] for j, a in enumerate(names)})
    bias = F.col("mtarget") - sum(F.col(f"w{a}") * F.col(f"m{a}") for a in names)
    r2 = F.try_divide(sum(F.col(f"w{a}") * F.col(f"{a}t") for a in names), F.col("tt"))
    return s.select(by, "n", "wx", "wy", "wz", bias.alias("bias"), F.sqrt(F.greatest(F.lit(0.0), r2)).alias("r"))


def _lag_sums(a: np.ndarray, b: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Of pairs (a[i], b[i + d]) with both present and i own, for d = -most ... most: number, sums of a, b, a^2, b^2, a b.

    Each is a correlation of two arrays; all come from one transform of six
    arrays and one back, long enough that nothing wraps.
    """
    size = 1 << int(len(a) + most).bit_length()
    here, there = np.isfinite(a) & own, np.isfinite(b)
    a, b = np.where(here, a, 0.0), np.where(there, b, 0.0)
    u = np.conj(np.fft.rfft([here, a, a * a], size))
    v = np.fft.rfft([there, b, b * b], size)
    sums = np.fft.irfft([u[0] * v[0], u[1] * v[0], u[0] * v[1], u[2] * v[0], u[0] * v[2], u[1] * v[1]], size)
    sums = np.roll(sums, most, axis=1)[:, : 2 * most + 1]
    sums[0] = np.round(sums[0])
    return sums


def lag_search(pairs: DataFrame, most: int, least_overlap: int = 20, chunk: int = 7500) -> DataFrame:
    """recording_id, shift, r: the shift of b against a (positive: b trails) with the largest correlation, ties to the smallest shift.

    Shifts with fewer than least_overlap pairs of present samples, or without
    spread, have no correlation; recordings without any have no row. A
    recording is cut into chunks with a halo of `most` samples; each gives its
    sums for all shifts by fast correlation, and these are added up.
    """
    every, names = Window.partitionBy(*REC), ("n", "a", "b", "aa", "bb", "ab")
    # About their means, so that the sums lose no digits.
    x = pairs.select(*REC, "idx", *[F.when(~F.isnan(c), F.col(c)).cast("double").alias(c) for c in ("a", "b")])
    x = x.withColumns({c: F.col(c) - F.avg(c).over(every) for c in ("a", "b")} | {"_low": F.min("idx").over(every)}).withColumn("idx", F.col("idx") - F.col("_low") + 1)
    scale = x.groupBy(*REC).agg(F.avg(F.col("a") * F.col("a")).alias("va"), F.avg(F.col("b") * F.col("b")).alias("vb"))
    rows = F.array_sort(F.collect_list(F.struct("idx", "own", "a", "b"))).alias("rows")
    chunks = with_halo(x.drop("_low"), max(chunk, 4 * most), most).groupBy(*REC, "chunk").agg(rows)

    def sums(t: pd.DataFrame) -> pd.DataFrame:
        out = []
        for idx, own, a, b in zip(t["idx"], t["own"], t["a"], t["b"], strict=True):
            at = np.asarray(idx, np.int64) - idx[0]
            p, q, mine = np.full(at[-1] + 1, np.nan), np.full(at[-1] + 1, np.nan), np.zeros(at[-1] + 1, bool)
            p[at], q[at], mine[at] = np.asarray(a, float), np.asarray(b, float), np.asarray(own, bool)
            out.append(list(_lag_sums(p, q, mine, most)))
        return pd.DataFrame(out, columns=names)

    packed = F.struct(*[F.col(f"rows.{c}").alias(c) for c in ("idx", "own", "a", "b")])
    each = chunks.select(*REC, F.pandas_udf(sums, ", ".join(f"{c} array<double>" for c in names))(packed).alias("s"))
    each = each.select(*REC, F.posexplode(F.arrays_zip(*[F.col(f"s.{c}").alias(c) for c in names])).alias("shift", "v"))
    total = each.groupBy(*REC, (F.col("shift") - most).alias("shift")).agg(*[F.sum(f"v.{c}").alias(c) for c in names])
    n, var = F.col("n"), lambda c: F.col(c + c) - F.col(c) * F.col(c) / F.col("n")
    total = total.where(n >= max(2, least_overlap)).join(scale, list(REC))
    # Below a rounding error of the whole recording's variance there is no spread.
    spread = (var("a") > 1e-12 * n * F.col("va")) & (var("b") > 1e-12 * n * F.col("vb"))
    r = (F.col("ab") - F.col("a") * F.col("b") / n) / F.sqrt(var("a") * var("b"))
    found = total.where(spread).select(*REC, F.col("shift").cast("int").alias("shift"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"))
    best = found.groupBy(*REC).agg(F.max_by(F.struct("shift", "r"), F.struct(F.round("r", 9), -F.col("shift"))).alias("s"))
    return best.select(*REC, "s.shift", "s.r")


def calib_window(attempts: DataFrame, period_s: float = BASE_MS / 1000, cycles: int = BREATHS) -> DataFrame:
    """Adds the fit window of each recording's last attempt: from the anchor over `cycles` periods, the time needed, what the label
    overruns it by, and too_short where the label does not last as long."""
    needed = cycles * period_s
    span = F.col("end_s") - F.col("start_s")
    return attempts.withColumns(
        {"window_start_s": F.col("anchor_s"), "window_end_s": F.col("anchor_s") + needed, "span_s": span, "overrun_s": span - needed, "too_short": span < needed}
    )


def calib_overrun(attempts: DataFrame, period_s: float = BASE_MS / 1000, cycles: int = BREATHS, strict: bool = True) -> DataFrame:
    """recording_id, span_s, paced_s, overrun_s, n_attempts; an attempt cut short is an error, or left out where not strict."""
    w = calib_window(attempts, period_s, cycles)
    overrun = F.when(~F.col("too_short"), F.col("overrun_s"))
    if strict:
        overrun = overrun.otherwise(F.raise_error(F.concat(F.lit("calibration was cut short in recording "), F.col("recording_id").cast("string"))).cast("double"))
    out = w.select(*REC, "span_s", F.lit(cycles * period_s).alias("paced_s"), overrun.alias("overrun_s"), "n_attempts")
    return out if strict else out.where("overrun_s is not null")


def realised_change(period_ms: Column, overshoot_ms: Column) -> Column:
    """Proportion by which the realised period (commanded plus the participant's overshoot) differs from the base."""
    return (period_ms + F.coalesce(overshoot_ms, F.lit(0.0)) - BASE_MS) / BASE_MS


AXES = ("x", "y", "z")


def _reading(prefix: str = "") -> Column:
    """bias + w . axes."""
    return F.col("bias") + F.col("wx") * F.col(f"{prefix}x") + F.col("wy") * F.col(f"{prefix}y") + F.col("wz") * F.col(f"{prefix}z")


def device_signal(axes: DataFrame, fits: DataFrame, by: str = "recording_id") -> DataFrame:
    """The calibrated reading of raw axes, for filters that follow (they commute with it)."""
    return axes.join(fits.select(by, F.coalesce("bias", F.lit(0.0)).alias("bias"), "wx", "wy", "wz"), by).select(by, "idx", _reading().alias("value"))


def _with_smooth(predicted: DataFrame, fs: float) -> DataFrame:
    """Adds the low-passed prediction as `smooth_value`."""
    low = calib_lowpass(predicted.select(*REC, "idx", F.col("value")), fs).withColumnRenamed("value", "smooth_value")
    return predicted.join(low, [*REC, "idx"])


def apply_calibration(axes: DataFrame, fits: DataFrame, fs: float = 25.0, band: tuple[float, float] = (0.05, 1.0)) -> DataFrame:
    """recording_id, idx, value and the band-passed axes: bias + w . band-passed axes, smoothed where the fit says so.

    axes: recording_id, idx, x, y, z of a whole session; fits: recording_id, bias, wx, wy, wz, smooth.
    """
    f = calib_bandpass(axes, fs, *band, columns=AXES)
    p = f.join(fits.select(*REC, "bias", "wx", "wy", "wz", "smooth"), list(REC)).withColumn("value", _reading())
    p = _with_smooth(p.select(*REC, "idx", "value", "smooth", *AXES), fs)
    return p.select(*REC, "idx", F.when(F.col("smooth"), F.col("smooth_value")).otherwise(F.col("value")).alias("value"), *AXES)


#: The models in the order that ties follow, the correlation below which a fit is low, the samples a fit needs.
MODELS = ("mlr-wide", "mlr-wide-lp", "pca-wide")
LOW_FIT, LEAST_SAMPLES = 0.40, 100


def score_models(
    rows: DataFrame, fs: float = 25.0, band: tuple[float, float] = (0.05, 1.0), least: int = LEAST_SAMPLES, most_lag_s: float = 2.0, keep: Callable[[DataFrame, str], DataFrame] = stored
) -> DataFrame:
    """The best of three models of the pacer from band-passed axes, by signed correlation; ties go to the first.

    rows: recording_id, idx, x, y, z, target of the calibration window. Models:
    least squares on the axes, the same low-passed, and a regression on the
    first principal axis. Returns model, r, margin over the runner-up, low_fit
    below 0.40, n, bias, wx, wy, wz, smooth, and the lag with its correlation.
    Fewer than `least` samples, or no model with a fit, give too_few or no model.
    The band-passed axes and the models' predictions are read several times, so
    keep(rows, name) writes them to the shared folder; it may do something else.
    """
    f = keep(calib_bandpass(rows, fs, *band, columns=AXES).join(rows.select(*REC, "idx", "target"), [*REC, "idx"]), "banded")
    fits = fit_mlr(f, "recording_id").withColumn("kind", F.lit("mlr-wide")).unionByName(fit_pca(f, "recording_id").withColumn("kind", F.lit("pca-wide")))
    p = f.join(fits.select(*REC, "kind", "bias", "wx", "wy", "wz"), list(REC)).withColumn("value", _reading()).select(*REC, "idx", "kind", "value", "target")
    smooth = _with_smooth(p.where("kind = 'mlr-wide'"), fs).select(*REC, "idx", F.lit("mlr-wide-lp").alias("kind"), F.col("smooth_value").alias("value"), "target")
    p = keep(p.unionByName(smooth), "predictions")
    r = p.groupBy(*REC, "kind").agg(F.count("value").alias("n"), F.when((F.var_pop("value") > 0) & (F.var_pop("target") > 0), correlation("value", "target")).alias("r"))
    place = sum(F.when(F.col("kind") == m, i).otherwise(0) for i, m in enumerate(MODELS))
    order = Window.partitionBy(*REC).orderBy(F.round("r", 9).desc_nulls_last(), place)
    top = r.withColumns({"_k": F.row_number().over(order), "margin": F.col("r") - F.lead("r").over(order)}).where("_k = 1").drop("_k")
    best = top.join(fits.select(*REC, F.col("kind").alias("_fit"), "bias", "wx", "wy", "wz"), list(REC)).where(F.col("_fit") == F.replace("kind", F.lit("-lp"), F.lit(""))).drop("_fit")
    chosen = p.join(best.select(*REC, "kind"), [*REC, "kind"], "left_semi").select(*REC, "idx", F.col("target").alias("a"), F.col("value").alias("b"))
    lag = lag_search(chosen, round(most_lag_s * fs)).select(*REC, (1000.0 * F.col("shift") / fs).alias("lag_ms"), F.col("r").alias("lag_r"))
    ok = (F.col("n") >= least) & F.col("r").isNotNull()
    out = best.join(lag, list(REC), "left").withColumns({"too_few": F.col("n") < least, "low_fit": F.col("r") < LOW_FIT, "smooth": F.col("kind") == "mlr-wide-lp", "model": F.col("kind")})
    return out.select(*REC, "n", "too_few", *[F.when(ok, F.col(c)).alias(c) for c in ("model", "r", "margin", "low_fit", "bias", "wx", "wy", "wz", "smooth", "lag_ms", "lag_r")])


def _spaced(peaks: DataFrame, key: list[str], share: float) -> DataFrame:
    """Of each trial's peaks, in order of time, those farther than share * sep from the last one kept; a fold over the few peaks of a trial."""
    ts = F.array_sort(F.collect_list("t_s"))
    g = peaks.groupBy(*key, "sep").agg(ts.alias("ts"))
    late = lambda kept, t: (F.size(kept) == 0) | (t - F.element_at(kept, -1) > share * F.col("sep"))
    kept = F.aggregate("ts", F.array().cast("array<double>"), lambda acc, t: F.when(late(acc, t), F.concat(acc, F.array(t))).otherwise(acc))
    return g.select(*key, "sep", F.explode(kept).alias("t_s"))


def trial_sync(signal: DataFrame, trials: DataFrame, lag_s: float = 0.0, least: int = 20, every: int = 5, bucket_s: float = 60.0) -> DataFrame:
    """Per trial: r_baseline and r_condition (absolute correlations with the pacer before and behind the change, the latter lag-corrected),
    and peak_error_s, the upper median of distances from pacer peaks to the nearest signal peak.

    signal: recording_id, t_s, value; trials: recording_id, trial, start, end,
    base, changed (seconds). A half needs more than `least` samples. Peaks are
    higher than both neighbours and keep half (signal) or 0.7 (pacer, every
    fifth sample) of the shorter period between them; an error counts below
    0.75 of it. Peaks meet in an equi-join on buckets of that reach.
    """
    key = [*REC, "trial"]
    x = assign_block(signal.select(*REC, "t_s", "value"), trials, bucket_s)
    boundary = F.col("start") + BASE_BREATHS * F.col("base")
    t = F.col("t_s")
    first, later = pacer_radius(t, F.col("start"), F.col("base")), pacer_radius_trial(t - lag_s, F.col("start"), F.col("base"), F.col("changed"))
    x = x.withColumns({"late": t >= boundary, "p": F.when(t < boundary, first).otherwise(later), "whole": pacer_radius_trial(t, F.col("start"), F.col("base"), F.col("changed"))})
    x = x.withColumn("sep", F.least("base", "changed"))
    mine = lambda late, c: F.when(F.col("late") == late, F.col(c))
    half = lambda late: F.when(F.count_if(F.col("late") == late) > least, F.abs(correlation(mine(late, "value"), mine(late, "p"))))
    g = x.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), half(False).alias("r_baseline"), half(True).alias("r_condition"))

    w = Window.partitionBy(*key).orderBy("t_s", "value")
    higher = lambda c: (F.col(c) > F.lag(c).over(w)) & (F.col(c) > F.lead(c).over(w))
    found = _spaced(x.withColumn("_top", higher("value")).where("_top").select(*key, "sep", "t_s"), key, 0.5)
    thin = x.withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") % every == 0)
    due = _spaced(thin.withColumn("_top", higher("whole")).where("_top").select(*key, "sep", "t_s"), key, 0.7)
    reach = 0.75 * F.col("sep")
    bucket = F.floor(F.col("t_s") / reach)
    left = due.select(*key, "sep", F.col("t_s").alias("_due"), bucket.alias("_b"))
    right = found.select(*key, F.col("t_s").alias("_at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    far = left.join(right, [*key, "_b"]).groupBy(*key, "_due", "sep").agg(F.min(F.abs(F.col("_at") - F.col("_due"))).alias("_e")).where(F.col("_e") < reach)
    errors = far.groupBy(*key).agg(F.array_sort(F.collect_list("_e")).alias("_e"))
    return g.join(errors, key, "left").select(*key, "n", "r_baseline", "r_condition", F.get("_e", F.floor(F.size("_e") / 2).cast("int")).alias("peak_error_s"))


def quality_index(rows: DataFrame, window: int) -> DataFrame:
    """Variance along the calibrated direction over total axis variance, in the window of samples up to each."""
    w = Window.partitionBy("participant_id").orderBy("idx").rowsBetween(-(window - 1), 0)
    norm = F.sqrt(F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy") + F.col("wz") * F.col("wz"))
    along = (F.col("wx") * F.col("x") + F.col("wy") * F.col("y") + F.col("wz") * F.col("z")) / norm
    q = rows.withColumn("p", along)
    share = F.try_divide(F.var_pop("p").over(w), F.var_pop("x").over(w) + F.var_pop("y").over(w) + F.var_pop("z").over(w))
    return q.withColumn("quality", share).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") == window).select("participant_id", "idx", "quality", (F.col("quality") < 0.5).alias("low"))


def _axes(c: pd.DataFrame) -> pd.DataFrame:
    """First principal axis of a 3 x 3 covariance (columns xx, xy, xz, yy, yz, zz), its variance and the total; null where any entry is."""
    m = c[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
    ok = np.isfinite(m).all(axis=(1, 2))
    values, vectors = np.linalg.eigh(np.where(ok[:, None, None], m, 0.0))
    out = pd.DataFrame({"w": list(vectors[:, :, 2]), "top": values[:, 2], "total": np.trace(m, axis1=1, axis2=2)})
    out.loc[~ok, ["top", "total"]] = np.nan
    out["w"] = [w if good else None for w, good in zip(out["w"], ok, strict=True)]
    return out


def leading_axis() -> Column:
    """Struct of w, top and total from the covariance columns of the row."""
    return F.pandas_udf(_axes, "w array<double>, top double, total double")(F.struct("xx", "xy", "xz", "yy", "yz", "zz"))


def fit_pca(rows: DataFrame, by: str = "participant_id") -> DataFrame:
    """Target regressed on the first principal axis of x, y, z; the fit's sign goes into the weights."""
    s = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("target").alias("tt"), F.avg("target").alias("mt"), F.array(*[F.avg(c) for c in "xyz"]).alias("m"),
        F.array(*[F.covar_samp(c, "target") for c in "xyz"]).alias("ct"), *[F.covar_samp(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")],
    )
    s = s.withColumn("p", leading_axis())
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda t, u: t + u)
    s = s.withColumn("cov", dot(F.col("p.w"), "ct"))
    slope = F.try_divide(F.col("cov"), F.col("p.top"))
    w = F.transform("p.w", lambda u: u * slope)
    r = F.try_divide(F.abs("cov"), F.sqrt(F.col("p.top") * F.col("tt")))
    return s.select(by, "n", w[0].alias("wx"), w[1].alias("wy"), w[2].alias("wz"), (F.col("mt") - dot(w, "m")).alias("bias"), r.alias("r"))


def axis_clarity(rows: DataFrame, window: int, by: str = "participant_id") -> DataFrame:
    """Largest share of variance along one axis, in the window of samples up to each."""
    w = Window.partitionBy(by).orderBy("idx").rowsBetween(-(window - 1), 0)
    c = rows.withColumns({a + b: F.covar_pop(a, b).over(w) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")} | {"_n": F.count(F.lit(1)).over(w)})
    c = c.where(F.col("_n") == window).withColumn("p", leading_axis())
    return c.select(by, "idx", F.try_divide(F.col("p.top"), F.col("p.total")).alias("clarity"))
