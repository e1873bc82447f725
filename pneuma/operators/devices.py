"""Two devices on one clock: onset detection, coherence, pacer offsets and adherence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.islands import REC, along, correlation, slope
from .calibration import pacer_radius_trial
from .clean import normalise
from .extrema import collapse_refined, extrema_prominence, refine_extrema
from .spectrum import hann, segment_arrays, whole_arrays, zero_phase_filter
from .timebase import assign_block, interp_to_grid


def detect_onsets(samples: DataFrame, fs: float, prominence: float = 0.4, distance_s: float = 1.0, refine_s: float = 0.5) -> DataFrame:
    """Peaks and troughs of the detection band 0.05-0.6 Hz, moved to the extremes of the measurement band 0.05-2 Hz; no alternation.

    Recordings shorter than three seconds give none.
    """
    long = samples.groupBy(*REC).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 3 * fs).select(*REC)
    x = samples.join(long, list(REC), "left_semi")
    coarse = normalise(zero_phase_filter(x, fs, 0.05, 0.6))
    fine = normalise(zero_phase_filter(x, fs, 0.05, 2.0))
    found = extrema_prominence(coarse, prominence, max(1.0, round(distance_s * fs)))
    return collapse_refined(refine_extrema(found, fine, round(refine_s * fs)))


def _windowed(x: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Spectra of demeaned, weighted segments, below half the rate."""
    return np.fft.rfft((x - x.mean(axis=-1, keepdims=True)) * window)[..., : x.shape[-1] // 2]


def cross_spectra(pairs: DataFrame, segment: int, overlap: float = 0.5) -> DataFrame:
    """recording_id, bin and summed auto and cross spectra of a and b over demeaned Hann segments."""
    window = hann(segment)

    def spectra(x: pd.DataFrame) -> pd.DataFrame:
        out = {c: [None] * len(x) for c in ("paa", "pbb", "re", "im")}
        for lo in range(0, len(x), 256):
            a, b = (_windowed(np.stack(x[c].iloc[lo : lo + 256].to_list()), window) for c in "ab")
            cross = a * np.conj(b)
            for c, v in (("paa", np.abs(a) ** 2), ("pbb", np.abs(b) ** 2), ("re", cross.real), ("im", cross.imag)):
                out[c][lo : lo + 256] = list(v)
        return pd.DataFrame(out)

    each = segment_arrays(pairs, ["a", "b"], segment, overlap).where(F.col("seg") == segment)
    each = each.select(*REC, F.pandas_udf(spectra, "paa array<double>, pbb array<double>, re array<double>, im array<double>")(F.struct("a", "b")).alias("s"))
    each = each.select(*REC, F.posexplode(F.arrays_zip(*[F.col(f"s.{c}").alias(c) for c in ("paa", "pbb", "re", "im")])).alias("bin", "v"))
    return each.groupBy(*REC, "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"v.{c}").alias(c) for c in ("paa", "pbb", "re", "im")])


def cross_coherence(pairs: DataFrame, fs: float, segment: int = 512) -> DataFrame:
    """Magnitude-squared coherence and phase per frequency."""
    s = cross_spectra(pairs, segment)
    msc = F.try_divide(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.col("paa") * F.col("pbb"))
    return s.select(*REC, "bin", (F.col("bin") * fs / segment).alias("freq"), "n", msc.alias("coherence"), F.atan2("im", "re").alias("phase"))


#: Multipliers of the counters and of the two mixing steps of random_turns.
COUNTERS, MIXERS = (2654435761, 2246822519, 3266489917), (2146121005, 2221713035)


def random_turns(key: int, surrogates: np.ndarray, bins: int) -> np.ndarray:
    """A phase in whole turns (0 to 1) for each surrogate and bin of a recording, from these numbers alone."""
    mask, of = np.uint64(0xFFFFFFFF), lambda x, c: x.astype(np.uint64) * np.uint64(c)
    x = np.uint64(key % (1 << 32) * COUNTERS[0] % (1 << 32)) + (of(surrogates, COUNTERS[1]) & mask)[:, None] + (of(np.arange(bins), COUNTERS[2]) & mask)
    x = (x & mask) ^ (x & mask) >> np.uint64(16)
    x = x * np.uint64(MIXERS[0]) & mask
    x ^= x >> np.uint64(15)
    x = x * np.uint64(MIXERS[1]) & mask
    return (x ^ x >> np.uint64(16)) / float(1 << 32)


def surrogate_coherence(a: np.ndarray, b: np.ndarray, key: int, surrogates: np.ndarray, segment: int) -> np.ndarray:
    """A row for each surrogate of b (its spectrum's amplitudes with random phases): coherence with a by frequency."""
    window, step = hann(segment), max(1, segment // 2)
    cut = lambda v: np.lib.stride_tricks.sliding_window_view(v, segment, axis=-1)[..., ::step, :]
    fa = _windowed(cut(a), window)
    paa, size = (np.abs(fa) ** 2).sum(axis=0), np.abs(np.fft.rfft(b - b.mean()))
    out, some = np.empty((len(surrogates), segment // 2)), max(1, (1 << 20) // len(b))
    for lo in range(0, len(surrogates), some):
        turns = random_turns(key, surrogates[lo : lo + some], len(size))
        fb = _windowed(cut(np.fft.irfft(size * np.exp(2j * np.pi * turns), len(b))), window)
        out[lo : lo + some] = np.abs((fa * np.conj(fb)).sum(axis=1)) ** 2 / np.maximum(paa * (np.abs(fb) ** 2).sum(axis=1), 1e-300)
    return out


def coherence_null(pairs: DataFrame, fs: float, segment: int = 512, surrogates: int = 1000, share: float = 0.95, block: int = 125) -> DataFrame:
    """Per frequency, the quantile of coherences of a with phase-randomised surrogates of b: amplitudes of b's spectrum, random phases.

    Phases follow from the recording's number, the surrogate's and the bin's,
    so every run, and every way to deal the work out, gives the same. A row
    holds a recording's two signals and a block of surrogates, so the
    surrogates of a recording are spread over tasks; their coherences meet in
    an aggregation by frequency. Recordings shorter than a segment give none.
    """

    def found(x: pd.DataFrame) -> pd.Series:
        out = []
        for key, lo, a, b in zip(x["key"], x["block"], x["a"], x["b"], strict=True):
            mine = np.arange(lo * block, min(surrogates, (lo + 1) * block))
            out.append(surrogate_coherence(np.asarray(a), np.asarray(b), int(key), mine, segment).ravel())
        return pd.Series(out)

    arrays = whole_arrays(pairs.where("a is not null and b is not null"), ["a", "b"]).where(F.size("a") >= segment)
    each = arrays.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((surrogates - 1) // block)))).repartition(*REC, "block")
    packed = F.struct(F.col(REC[0]).cast("bigint").alias("key"), "block", F.col("a").cast("array<double>").alias("a"), F.col("b").cast("array<double>").alias("b"))
    each = each.select(*REC, F.posexplode(F.pandas_udf(found, "array<double>")(packed)).alias("p", "coherence"))
    null = each.groupBy(*REC, (F.col("p") % (segment // 2)).alias("bin")).agg(F.percentile("coherence", F.lit(share)).alias("null_coherence"))
    return null.select(*REC, "bin", "null_coherence", (F.col("bin") * fs / segment).alias("freq"))


def cycle_shape_corr(a: DataFrame, b: DataFrame, cycles: DataFrame, points: int = 32) -> DataFrame:
    """Correlation of both devices' signals over each cycle, sampled at `points` equal phases; cycles without spread have none.

    a, b: recording_id, t_s, value; cycles: recording_id, breath, t_start, t_end.
    """
    grid = cycles.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("t_start") + (F.col("t_end") - F.col("t_start")) * F.col("i") / F.lit(float(points))
    grid = grid.select(*REC, (F.col("breath").cast("bigint") * points + F.col("i")).alias("k"), at.alias("t_s"))
    both = interp_to_grid(a, grid).select(*REC, "k", F.col("value").alias("va")).join(interp_to_grid(b, grid).select(*REC, "k", F.col("value").alias("vb")), [*REC, "k"])
    g = both.groupBy(*REC, F.floor(F.col("k") / points).alias("breath")).agg(correlation("va", "vb").alias("r"), F.var_pop("va").alias("_a"), F.var_pop("vb").alias("_b"))
    return g.select(*REC, "breath", F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("r")).alias("r"))


def offset_per_breath(onsets: DataFrame, commanded: DataFrame, within: float) -> DataFrame:
    """The nearest detected onset within reach of each commanded one: offset by breath, ties to the earlier onset.

    onsets: recording_id, t_s; commanded: recording_id, trial, breath, t_s. An equi-join on buckets of the reach.
    """
    bucket = F.floor(F.col("t_s") / within)
    left = commanded.select(*REC, "trial", "breath", F.col("t_s").alias("due"), bucket.alias("_b"))
    right = onsets.select(*REC, F.col("t_s").alias("at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    near = left.join(right, [*REC, "_b"]).where(F.abs(F.col("at") - F.col("due")) <= within)
    best = near.groupBy(*REC, "trial", "breath").agg(F.min(F.struct(F.abs(F.col("at") - F.col("due")).alias("d"), "at", "due")).alias("m"))
    return best.select(*REC, "trial", "breath", (F.col("m.at") - F.col("m.due")).alias("offset_s"))


def offset_summary(offsets: DataFrame, rigs: DataFrame) -> DataFrame:
    """Per participant (recording): slope of the offset on the breath's place, and the parts of the variance.

    offsets: recording_id, trial, breath, offset_s; rigs: recording_id, rig.
    trial_var is the variance of trial means less what breaths within trials
    explain of it; rig_mean the mean of all offsets of the participant's rig.
    """
    each = offsets.groupBy(*REC, "trial").agg(F.count(F.lit(1)).alias("n"), F.avg("offset_s").alias("m"), F.var_samp("offset_s").alias("v"))
    parts = each.groupBy(*REC).agg(F.avg("v").alias("breath_var"), F.greatest(F.lit(0.0), F.var_samp("m") - F.avg(F.col("v") / F.col("n"))).alias("trial_var"))
    line = offsets.groupBy(*REC).agg(F.count(F.lit(1)).alias("n"), F.avg("offset_s").alias("mean_s"), slope("offset_s", "breath").alias("slope_s"))
    rig = rigs.join(offsets, list(REC)).groupBy("rig").agg(F.avg("offset_s").alias("rig_mean"))
    return line.join(parts, list(REC)).join(rigs.select(*REC, "rig").distinct(), list(REC), "left").join(rig, "rig", "left")


def adherence_corr(signal: DataFrame, trials: DataFrame, lag_s: float, bucket_s: float = 60.0) -> DataFrame:
    """Correlation per trial of the lag-corrected signal with the two-phase pacer rebuilt from the trial."""
    t = F.col("t_s") - lag_s
    x = assign_block(signal.withColumn("t_s", t), trials, bucket_s)
    t = F.col("t_s")
    pacer = pacer_radius_trial(t, F.col("start"), F.col("base"), F.col("changed"))
    return x.groupBy(*REC, "trial").agg(F.count(F.lit(1)).alias("n"), correlation("value", pacer).alias("r"))


def lag_confound(lag_ms: Column, period_ms: Column) -> Column:
    """Correlation that a pure lag leaves between two sines of a period."""
    return F.cos(2 * np.pi * lag_ms / period_ms)


def trial_breaths(troughs: DataFrame, trials: DataFrame, pad_s: float, bucket_s: float) -> DataFrame:
    """Troughs in each padded window and the breaths between them: counts and mean duration; windows without any stay."""
    b = lambda c: F.floor(c / bucket_s)
    w = trials.withColumn("_b", F.explode(F.sequence(b(F.col("start") - pad_s), b(F.col("end") + pad_s))))
    hit = troughs.select(*REC, "t_s", b(F.col("t_s")).alias("_b")).join(w, [*REC, "_b"]).where((F.col("t_s") >= F.col("start") - pad_s) & (F.col("t_s") <= F.col("end") + pad_s))
    hit = hit.withColumn("gap", F.col("t_s") - F.lag("t_s").over(along("t_s", (*REC, "trial"))))
    g = hit.groupBy(*REC, "trial").agg(F.count(F.lit(1)).alias("n_troughs"), F.count("gap").alias("n_breaths"), F.avg("gap").alias("mean_s"))
    return trials.select(*REC, "trial").join(g, [*REC, "trial"], "left").fillna(0, ["n_troughs", "n_breaths"])


def recording_qc_code(files: DataFrame) -> DataFrame:
    """99 both sides, 98 several files on one side, 0 no file or no start trigger, 1 one trigger, 2 the expected number, 3 another; abnormal marks all but 2."""
    code = F.when((F.col("left_files") > 0) & (F.col("right_files") > 0), 99).when(F.col("left_files") + F.col("right_files") > 1, 98)
    code = code.when((F.col("left_files") + F.col("right_files") == 0) | (F.col("starts") == 0), 0).when(F.col("starts") == F.col("expected"), 2).when(F.col("starts") == 1, 1).otherwise(3)
    return files.withColumn("code", code).withColumn("abnormal", F.col("code") != 2)
