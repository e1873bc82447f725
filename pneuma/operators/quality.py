"""Quality of recordings: metrics of the raw and the filtered signal against thresholds, whole and by segment; the preprocessing chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, finite
from .clean import flatline, missing_pct, normalise, saturation
from .spectrum import band_metrics, despike, downsample, welch_psd, zero_phase_filter
from .timebase import fill_gaps

#: The published defaults of the nine thresholds. None switches a test off.
THRESHOLDS = {
    "iqr_unusable": 0.05, "iqr_degraded": 0.20, "freq_lo": 0.10, "freq_hi": 0.60, "flatline_pct": 10.0, "saturation_pct": 5.0,
    "na_degraded": 1.0, "na_unusable": 20.0, "band_ratio_min": 0.80,
}
#: Seconds that trimming leaves at least.
LEAST_S = 30.0


def _filtered(samples: DataFrame, fs: float, target_fs: float | None, low: float, high: float) -> tuple[DataFrame, float]:
    """Band-passed at the target rate; missing samples are bridged for decimation, and else put back."""
    if target_fs and target_fs < fs:
        samples, fs = downsample(fill_gaps(samples.select(*REC, "idx", "value")), fs, target_fs)
    return zero_phase_filter(samples, fs, low, high), fs


def _spread() -> Column:
    return F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))


def _tests(th: dict) -> dict[str, Column]:
    """A condition for each flag whose threshold is set."""
    no = F.lit(False)
    below = lambda c, k: no if th[k] is None else F.coalesce(F.col(c) < th[k], no)
    above = lambda c, k: no if th[k] is None else F.coalesce(F.col(c) > th[k], no)
    return {
        "missing": above("na_pct", "na_degraded"), "low spread": below("filtered_iqr", "iqr_degraded"),
        "frequency": below("dominant_hz", "freq_lo") | above("dominant_hz", "freq_hi"), "flatline": above("flat_pct", "flatline_pct"),
        "saturated": above("saturated_pct", "saturation_pct"), "band ratio": below("band_ratio", "band_ratio_min"),
        "mostly missing": above("na_pct", "na_unusable"), "no spread": below("filtered_iqr", "iqr_unusable"),
    }


def quality(samples: DataFrame, fs: float, trim_s: float = 120.0, target_fs: float | None = 25.0, low: float = 0.05, high: float = 1.0, resp_band: float = 0.6,
            dom_lo: float = 0.10, thresholds: dict | None = None, segment_s: float = 120.0) -> DataFrame:
    """One row per recording: metrics, flags and quality (good, degraded or unusable).

    Raw samples are trimmed at both ends, less where under 30 s would be left.
    Flatline, saturation and missing share are of the raw span, spread and
    spectrum of the filtered one. A recording without finite samples in the
    span is unusable and has no metrics.
    """
    if dom_lo >= resp_band:
        raise ValueError("the search for the dominant frequency has no room")
    tests = _tests(THRESHOLDS | (thresholds or {}))
    every = Window.partitionBy(*REC)
    duration = F.count(F.lit(1)).over(every) / F.lit(fs)
    trim = F.when(duration - 2 * trim_s < LEAST_S, F.greatest(F.lit(0.0), (duration - LEAST_S) / 2)).otherwise(F.lit(trim_s))
    x = samples.select(*REC, "idx", finite("value").alias("value")).withColumns({"_d": duration, "_t": trim})
    at = (F.col("idx") - 1) / F.lit(fs)
    x = x.where((at >= F.col("_t")) & (at <= F.col("_d") - F.col("_t")))
    x = x.withColumns({"idx": (F.col("idx") - F.min("idx").over(every) + 1).cast("bigint"), "_some": F.count("value").over(every) > 0})
    base = x.groupBy(*REC).agg(F.first("_d").alias("duration_s"), (F.count(F.lit(1)) / F.lit(fs)).alias("usable_s"), F.first("_some").alias("_some"))
    raw = x.select(*REC, "idx", "value")
    there = x.where("_some").select(*REC, "idx", "value")
    work, rate = _filtered(there, fs, target_fs, low, high)
    length = F.greatest(F.lit(64), F.round(F.least(F.lit(segment_s), F.col("n") / rate / 2) * rate))
    bands = band_metrics(welch_psd(work, rate, length), (low, resp_band), (low, high), (dom_lo, resp_band))
    m = base.join(missing_pct(raw).withColumnRenamed("missing_pct", "na_pct"), list(REC))
    for part in (flatline(there, max(2, round(fs))).drop("n_runs"), saturation(there.where("value is not null")), work.groupBy(*REC).agg(_spread().alias("filtered_iqr")), bands):
        m = m.join(part, list(REC), "left")
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    flags = F.when(F.col("_some"), found).otherwise(F.array(F.lit("no finite samples")))
    unusable = ~F.col("_some") | tests["mostly missing"] | tests["no spread"]
    verdict = F.when(unusable, "unusable").when(F.size("_f") > 0, "degraded").otherwise("good")
    return m.withColumn("_f", flags).select(
        *REC, verdict.alias("quality"), "filtered_iqr", "band_ratio", "dominant_hz", (60 * F.col("dominant_hz")).alias("dominant_rate_bpm"), "flat_pct", "saturated_pct",
        "na_pct", "duration_s", F.when(F.col("_some"), F.col("usable_s")).otherwise(F.lit(0.0)).alias("usable_s"), F.array_join("_f", "; ").alias("flags"),
    )


def quality_segments(samples: DataFrame, fs: float, segment_s: float = 120.0, target_fs: float | None = 25.0, low: float = 0.05, high: float = 1.0, resp_band: float = 0.6,
                     dom_lo: float = 0.10, thresholds: dict | None = None, stub_s: float = 10.0) -> DataFrame:
    """One row per segment of a recording: spread, dominant frequency, flatline and missing share, and whether it is usable. Stubs are left out."""
    tests = _tests(THRESHOLDS | (thresholds or {}))
    raw = samples.select(*REC, "idx", finite("value").alias("value"))
    some = raw.where("value is not null").select(*REC).distinct()
    work, rate = _filtered(raw.join(some, list(REC), "left_semi"), fs, target_fs, low, high)
    by, size = (*REC, "segment"), max(2, round(segment_s * rate))
    work = work.withColumn("segment", F.floor((F.col("idx") - 1) / size))
    m = work.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (100.0 * F.avg(F.col("value").isNull().cast("double"))).alias("na_pct"), _spread().alias("filtered_iqr"), F.min("idx").alias("_a"), F.max("idx").alias("_z"))
    m = m.where(F.col("n") - 1 >= rate * stub_s)
    inner = work.withColumn("idx", F.col("idx") - F.col("segment") * size)
    length = F.greatest(F.lit(64), F.round(F.col("n") / 2))
    bands = band_metrics(welch_psd(inner, rate, length, by=by), (low, resp_band), (low, high), (dom_lo, resp_band), by).drop("band_ratio")
    cut = raw.withColumn("segment", F.floor((F.col("idx") - 1) * F.lit(rate / fs) / size))
    flat = flatline(cut, max(2, round(fs)), by=by).drop("n_runs")
    m = m.join(bands, list(by), "left").join(flat, list(by), "left")
    bad = tests["low spread"] | tests["frequency"] | tests["flatline"] | tests["missing"] | F.col("filtered_iqr").isNull()
    m = m.withColumns({"saturated_pct": F.lit(None).cast("double"), "band_ratio": F.lit(None).cast("double")}).withColumn("usable", ~bad)
    time = lambda c: (F.col(c) - 1) / F.lit(rate)
    return m.select(*by, time("_a").alias("start_s"), time("_z").alias("end_s"), "filtered_iqr", "dominant_hz", "flat_pct", "na_pct", "usable")


def preprocess(samples: DataFrame, fs: float, target_fs: float | None = 25.0, low: float | None = 0.05, high: float | None = 1.0, order: int = 2, spikes: float | None = 3.0,
               how: str = "robust") -> tuple[DataFrame, float]:
    """Despiked at the native rate, decimated towards the target, band-passed and normalised, and the rate reached; None (or how "none") leaves a step out."""
    x = samples.select(*REC, "idx", finite("value").alias("value"))
    if spikes is not None:
        x = despike(x, fs, spikes).drop("spiked")
    if target_fs is not None and target_fs < fs:
        x, fs = downsample(fill_gaps(x).drop("filled"), fs, target_fs)
    if low or high:
        x = zero_phase_filter(x, fs, low, high, order=order)
    return (x if how == "none" else normalise(x, how)), fs


def provenance_log(recordings: DataFrame, step: Column) -> DataFrame:
    """recordings with a step added to the end of `provenance`, which begins where there is none."""
    have = F.col("provenance") if "provenance" in recordings.columns else F.array().cast("array<string>")
    return recordings.withColumn("provenance", F.array_append(F.coalesce(have, F.array().cast("array<string>")), step))
