"""Whole recordings to breaths and features in one call, for any number of recordings at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.islands import REC
from ..sources.shared import stored
from .breaths import breath_table, flag_breaths, polarity_verdict, summarise_breaths
from .epochs import epoch_features
from .extrema import detect_breaths
from .quality import preprocess, quality


@dataclass(frozen=True)
class Analysis:
    """What analyse() finds: the copy that detection ran on, the one that amplitudes and times are read from, extrema, flagged breaths, a feature
    row for each recording (or window), the polarity that the data suggest beside the one assumed, quality, and the rate of both copies."""

    detected: DataFrame
    measured: DataFrame
    extrema: DataFrame
    breaths: DataFrame
    features: DataFrame
    polarity: DataFrame
    quality: DataFrame | None
    rate: float


def analyse(
    samples: DataFrame, fs: float, target_fs: float | None = 25.0, detect_band: tuple[float, float] | None = (0.05, 0.6), measure_band: tuple[float, float] | None = (0.05, 2.0),
    min_prominence: float = 0.4, min_distance_s: float = 1.5, method: str = "prominence", polarity: str = "up", refine_window_s: float = 0.5, how: str = "robust",
    spikes: float | None = 3.0, epochs: DataFrame | None = None, grade: bool = True, bounds_s: tuple[float, float] = (0.8, 20.0), keep: Callable[[DataFrame, str], DataFrame] = stored,
) -> Analysis:
    """samples: recording_id, idx, value at fs; t_s counts from each recording's first sample.

    Spikes are bridged at the native rate and the signal is decimated once; two
    band-passed copies share that time base. Extrema are found on the first and
    moved to the extremes of the second within refine_window_s; without a
    measure band, or with the same one, there is one copy. Every recording of
    samples has a row of features, of nothing but counts of 0 where it has no
    breath, as a constant one has not. A polarity that the data contradict confidently is marked
    (`contradicted`), not mended. Each step that several later ones read
    ("base", "detected", "measured", "extrema", "breaths") goes through
    keep(rows, name), which writes it to the shared folder; it may do something
    else, or nothing, without a change of results.
    """
    base, rate = preprocess(samples, fs, target_fs, None, None, spikes=spikes, how="none")
    # In a constant recording a filter leaves rounding errors alone, and scaling would make breaths of them.
    moving = samples.groupBy(*REC).agg((F.max("value") > F.min("value")).alias("moves")).where("moves").select(*REC)
    base = keep(base.select(*REC, "idx", "value").join(moving, list(REC), "left_semi"), "base")

    def copy(band: tuple[float, float] | None) -> DataFrame:
        low, high = band or (None, None)
        x, _ = preprocess(base, rate, None, low, high, spikes=None, how=how)
        return x.select(*REC, "idx", ((F.col("idx") - 1) / F.lit(rate)).alias("t_s"), "value")

    detected = keep(copy(detect_band), "detected")
    one = measure_band is None or measure_band == detect_band
    measured = detected if one else keep(copy(measure_band), "measured")
    extrema = keep(detect_breaths(detected, rate, method, min_prominence, min_distance_s, refine_on=None if one else measured, refine_window_s=refine_window_s), "extrema")
    breaths = keep(flag_breaths(breath_table(extrema, measured, polarity, *bounds_s)), "breaths")
    verdict = polarity_verdict(breaths)
    if polarity == "down":  # the table was made of the turned signal
        turned = F.when(F.col("suggestion") == "up", "down").when(F.col("suggestion") == "down", "up")
        verdict = verdict.select(*REC, F.col("duty_cycle_down").alias("duty_cycle_up"), F.col("duty_cycle_up").alias("duty_cycle_down"), turned.alias("suggestion"), "confident")
    verdict = verdict.withColumn("contradicted", F.coalesce(F.col("confident") & (F.col("suggestion") != polarity), F.lit(False)))
    if epochs is None:
        counts = ["n_breaths_total", "n_breaths", "n_breaths_no_peak"]
        features = samples.select(*REC).distinct().join(summarise_breaths(breaths), list(REC), "left").fillna(0, counts).fillna(0.0, ["window_coverage_s"])
    else:
        features = epoch_features(breaths, epochs)
    return Analysis(detected, measured, extrema, breaths, features, verdict, quality(samples, fs, target_fs=target_fs) if grade else None, rate)
