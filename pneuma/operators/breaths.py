"""The breath table: one row per cycle from trough to trough, its flags and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, along, slope

MAD_SCALE, EPS = 1.4826, 2.0**-26


def breath_table(extrema: DataFrame, samples: DataFrame, polarity: str = "up", min_s: float = 0.8, max_s: float = 20.0) -> DataFrame:
    """One row per pair of consecutive troughs; peak columns only where exactly one peak lies in (start, end].

    polarity down swaps peaks and troughs and negates the signal; the baseline
    keeps its sign. Implausible durations are marked, never dropped.
    """
    low = "trough" if polarity == "up" else "peak"
    sign = 1.0 if polarity == "up" else -1.0
    ev = extrema.select(*REC, "idx", (F.col("kind") == low).alias("low"))
    ev = ev.join(samples.select(*REC, "idx", "t_s", (sign * F.col("value")).alias("v")), [*REC, "idx"])
    # A peak at a trough's sample belongs to the cycle that the trough ends.
    order = Window.partitionBy(*REC).orderBy("idx", F.col("low").cast("int"))
    ev = ev.withColumn("cycle", F.sum(F.col("low").cast("int")).over(order))
    starts = ev.where("low")
    w = along("idx")
    cycles = starts.select(
        *REC, F.col("cycle").alias("breath"), F.col("idx").alias("i_start"), F.col("t_s").alias("t_start"), F.col("v").alias("v_start"),
        F.lead("idx").over(w).alias("i_end"), F.lead("t_s").over(w).alias("t_end"), F.lead("v").over(w).alias("v_end"),
    ).where("i_end is not null")
    peaks = ev.where("not low").groupBy(*REC, F.col("cycle").alias("breath")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("idx", "t_s", "v")).alias("_p"))
    b = cycles.join(peaks.where("_n = 1").select(*REC, "breath", "_p"), [*REC, "breath"], "left")
    b = b.withColumns({"i_peak": F.col("_p.idx"), "t_peak": F.col("_p.t_s"), "v_peak": F.col("_p.v")})
    b = b.withColumns({"duration": F.col("t_end") - F.col("t_start"), "inhale_dur": F.col("t_peak") - F.col("t_start"), "exhale_dur": F.col("t_end") - F.col("t_peak"), "amp_inhale": F.col("v_peak") - F.col("v_start"), "amp_exhale": F.col("v_peak") - F.col("v_end")})
    b = b.withColumn("amplitude", (F.col("amp_inhale") + F.col("amp_exhale")) / 2)
    over = lambda a, c: F.try_divide(F.col(a), F.col(c))
    return b.select(
        *REC, "breath", "i_start", "i_peak", "i_end", "t_start", "t_peak", "t_end", "duration", "inhale_dur", "exhale_dur",
        over("inhale_dur", "duration").alias("duty_cycle"), over("inhale_dur", "exhale_dur").alias("ie_ratio"),
        F.try_divide(F.lit(60.0), F.col("duration")).alias("rate_bpm"), "amp_inhale", "amp_exhale", "amplitude",
        (sign * F.col("v_start")).alias("baseline"), over("amplitude", "duration").alias("rvt"),
        over("amp_inhale", "inhale_dur").alias("flow_in"), over("amp_exhale", "exhale_dur").alias("flow_out"),
        F.col("i_peak").isNotNull().alias("has_peak"), ((F.col("duration") < min_s) | (F.col("duration") > max_s)).alias("implausible"),
    )


def flag_breaths(breaths: DataFrame, low_frac: float = 0.2, mads: float = 5.0) -> DataFrame:
    """bad_amplitude (not positive), low_amplitude, duration_outlier and keep. Unknown values raise no flag but a null duration is not kept."""
    every = Window.partitionBy(*REC)
    b = breaths.withColumns({"_amp": F.median("amplitude").over(every), "_med": F.median("duration").over(every)})
    b = b.withColumn("_mad", MAD_SCALE * F.median(F.abs(F.col("duration") - F.col("_med"))).over(every))
    t = lambda c: F.coalesce(c, F.lit(False))
    b = b.withColumns(
        {
            "bad_amplitude": t(F.col("amplitude") <= 0),
            "low_amplitude": t((F.col("_amp") > 0) & (F.col("amplitude") < low_frac * F.col("_amp"))),
            "duration_outlier": t((F.col("_mad") > EPS * F.greatest(F.lit(1.0), F.abs("_med"))) & (F.abs(F.col("duration") - F.col("_med")) > mads * F.col("_mad"))),
        }
    )
    keep = ~t(F.col("implausible")) & ~F.col("bad_amplitude") & ~F.col("low_amplitude") & ~F.col("duration_outlier") & F.col("duration").isNotNull()
    return b.withColumn("keep", keep).drop("_amp", "_med", "_mad")


def polarity_verdict(breaths: DataFrame) -> DataFrame:
    up = F.median("duty_cycle")
    v = breaths.groupBy(*REC).agg(up.alias("duty_cycle_up"))
    return v.select(
        *REC, "duty_cycle_up", (1 - F.col("duty_cycle_up")).alias("duty_cycle_down"),
        F.when(F.col("duty_cycle_up") < 0.5, "up").when(F.col("duty_cycle_up").isNotNull(), "down").alias("suggestion"),
        F.coalesce(F.abs(F.col("duty_cycle_up") - 0.5) >= 0.05, F.lit(False)).alias("confident"),
    )


def variation(value: str, time: str, prefix: str) -> list[Column]:
    """n, mean, median, sd, cv, rmssd and slopes, for an aggregate over rows with `<value>_d2` and `<value>_k` beside the value."""
    v = F.col(value)
    many = F.count(v) > 1
    return [
        F.avg(v).alias(f"{prefix}_mean"),
        F.median(v).alias(f"{prefix}_median"),
        F.when(many, F.stddev_samp(v)).alias(f"{prefix}_sd"),
        F.when(many & (F.abs(F.avg(v)) >= EPS), F.stddev_samp(v) / F.abs(F.avg(v))).alias(f"{prefix}_cv"),
        F.sqrt(F.avg(f"{value}_d2")).alias(f"{prefix}_rmssd"),
        slope(value, f"{value}_k").alias(f"{prefix}_slope_per_breath"),
        slope(value, time).alias(f"{prefix}_slope_per_s"),
    ]


def with_differences(df: DataFrame, value: str, order: str, by: tuple[str, ...] = REC) -> DataFrame:
    """Squared differences between successive present values (`_d2`), and the place of each row (`_k`)."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({f"{value}_d2": F.pow(F.col(value) - before, F.lit(2.0)), f"{value}_k": F.row_number().over(w).cast("double")})


def variability(rows: DataFrame, value: str, order: str, time: str, by: tuple[str, ...] = REC, prefix: str = "v") -> DataFrame:
    """n, mean, median, sd, cv, rmssd and the slopes per step and per second of a column; nulls go before differences are taken."""
    v = with_differences(rows.where(F.col(value).isNotNull()), value, order, by)
    return v.groupBy(*by).agg(F.count(value).alias("n"), *variation(value, time, prefix))


def summarise_breaths(breaths: DataFrame, by: tuple[str, ...] = REC) -> DataFrame:
    """The feature row of each group: on kept breaths where there are flags, with the number of all."""
    keep = F.coalesce("keep", F.lit(False)) if "keep" in breaths.columns else F.lit(True)
    values = ["duration", "amplitude", "t_start", "rate_bpm", "inhale_dur", "exhale_dur", "duty_cycle", "ie_ratio", "rvt", "flow_in", "flow_out", "baseline"]
    b = breaths.select(*by, "breath", keep.alias("_kept"), (keep & ~F.col("has_peak")).alias("_bare"), *[F.when(keep, F.col(c)).alias(c) for c in values])
    b = with_differences(with_differences(b, "duration", "breath", by), "amplitude", "breath", by)
    place = F.sum(F.col("_kept").cast("double")).over(Window.partitionBy(*by).orderBy("breath"))
    b = b.withColumns({"duration_k": place, "amplitude_k": place})
    amp = [c for c in variation("amplitude", "t_start", "amplitude")]
    f = b.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_breaths_total"),
        F.count_if("_kept").alias("n_breaths"),
        F.count_if("_bare").alias("n_breaths_no_peak"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("window_coverage_s"),
        *variation("duration", "t_start", "duration"),
        F.avg("rate_bpm").alias("rate_bpm_mean"),
        F.try_divide(F.lit(60.0), F.avg("duration")).alias("rate_from_mean_duration"),
        F.avg("inhale_dur").alias("inhale_dur_mean"),
        F.avg("exhale_dur").alias("exhale_dur_mean"),
        F.avg("duty_cycle").alias("duty_cycle_mean"),
        F.median("ie_ratio").alias("ie_ratio_median"),
        amp[0], amp[1], amp[2], amp[3], amp[5],
        F.avg("rvt").alias("rvt_mean"),
        F.avg("flow_in").alias("flow_in_mean"),
        F.avg("flow_out").alias("flow_out_mean"),
        slope("baseline", "t_start").alias("baseline_drift"),
    )
    return f.withColumn("pct_breaths_rejected", 100.0 * (F.col("n_breaths_total") - F.col("n_breaths")) / F.col("n_breaths_total"))


def durations_ms(onsets: DataFrame, lo: float = 1500.0, hi: float = 12000.0, by: tuple[str, ...] = REC) -> DataFrame:
    """Onset differences in ms within [lo, hi]."""
    w = Window.partitionBy(*by).orderBy("t_s")
    d = onsets.withColumn("duration_ms", 1000.0 * (F.col("t_s") - F.lag("t_s").over(w)))
    return d.where(F.col("duration_ms").between(lo, hi))


def dropped_intervals(onsets: DataFrame, lo: float, hi: float) -> DataFrame:
    d = onsets.withColumn("_d", 1000.0 * (F.col("t_s") - F.lag("t_s").over(along("t_s"))))
    return d.groupBy(*REC).agg(F.count_if(~F.col("_d").between(lo, hi)).alias("n_dropped"), F.count("_d").alias("n_intervals"))


def block_variability(breaths: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """cv, rmssd and sd of durations per block; null below five."""
    b = with_differences(breaths.where(F.col("duration").isNotNull()), "duration", "t_start", by)
    enough = F.count("duration") >= 5
    return b.groupBy(*by).agg(
        F.count("duration").alias("n"),
        F.when(enough, F.stddev_samp("duration") / F.avg("duration")).alias("cv"),
        F.when(enough, F.sqrt(F.avg("duration_d2"))).alias("rmssd"),
        F.when(enough, F.stddev_samp("duration")).alias("sd"),
    )


def duty_cycle_simple(extrema: DataFrame) -> DataFrame:
    """Median over cycles with exactly one peak strictly between two onsets (troughs) of (peak - onset) / cycle, in samples."""
    order = Window.partitionBy(*REC).orderBy("idx")
    ev = extrema.withColumn("cycle", F.sum((F.col("kind") == "trough").cast("int")).over(order))
    on = ev.where("kind = 'trough'").select(*REC, "cycle", F.col("idx").alias("o1"), F.lead("idx").over(along("idx")).alias("o2")).where("o2 is not null")
    pk = ev.where("kind = 'peak'").groupBy(*REC, "cycle").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("pk")).where("n = 1")
    d = on.join(pk, [*REC, "cycle"]).where("pk > o1 and pk < o2")
    return d.groupBy(*REC).agg(F.median((F.col("pk") - F.col("o1")) / (F.col("o2") - F.col("o1"))).alias("duty_cycle"), F.count(F.lit(1)).alias("n"))


def peak_intervals(peaks: DataFrame, slow_s: float = 3.5) -> DataFrame:
    w = along("t_s")
    gap = F.lead("t_s").over(w) - F.col("t_s")
    return peaks.select(*REC, F.row_number().over(w).alias("peak_num"), "t_s", gap.alias("interval_s"), (gap >= slow_s).alias("slow"))


def depths_z(samples: DataFrame, onsets: DataFrame) -> DataFrame:
    """max - min between consecutive onsets (three samples or more), z-scored within the recording."""
    marks = samples.join(onsets.select(*REC, "idx", F.lit(1).alias("on")), [*REC, "idx"], "left")
    marks = marks.withColumn("cycle", F.sum(F.coalesce("on", F.lit(0))).over(along("idx")))
    # The onset that ends a cycle is its last sample too.
    shared = marks.select(*REC, "value", F.explode(F.when(F.col("on") == 1, F.array("cycle", F.col("cycle") - 1)).otherwise(F.array("cycle"))).alias("breath"))
    last = onsets.groupBy(*REC).agg(F.count(F.lit(1)).alias("_last"))
    d = shared.join(last, list(REC)).where("breath >= 1 and breath < _last").groupBy(*REC, "breath").agg(F.count(F.lit(1)).alias("n"), (F.max("value") - F.min("value")).alias("depth")).where("n >= 3")
    every = Window.partitionBy(*REC)
    return d.select(*REC, "breath", "depth", F.try_divide(F.col("depth") - F.avg("depth").over(every), F.stddev_samp("depth").over(every)).alias("depth_z"))

