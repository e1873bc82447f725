"""Cohort statistics: gates, summaries, comparisons of two devices per participant, flags and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, along, correlation, finite, slope
from ..functions.tdist import t_quantile
from .stats import ccc, classification_agreement, two_predictor_slopes


def quality_gate(features: DataFrame, by: tuple[str, ...] = REC, coverage: float = 0.7, breaths: int = 2, quality: str | None = None) -> DataFrame:
    """Windows per key, those with enough covered time and breaths (and, where a quality column is named, not unusable), and their share."""
    ok = (F.col("coverage_frac") >= coverage) & (F.col("n_breaths") >= breaths)
    if quality:
        ok = ok & (F.coalesce(F.col(quality), F.lit("unusable")) != "unusable")
    ok = F.coalesce(ok, F.lit(False))
    return features.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(ok).alias("n_usable"), F.avg(ok.cast("double")).alias("usable_rate"))


def cohort_medians(breaths: DataFrame, by: tuple[str, ...] = REC) -> DataFrame:
    """Median over keys of each one's median duration and duty cycle over kept breaths; the rate is 60 over that duration."""
    each = breaths.where("keep").groupBy(*by).agg(F.median("duration").alias("d"), F.median("duty_cycle").alias("u"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.median("d").alias("duration_s"), F.try_divide(F.lit(60.0), F.median("d")).alias("rate_bpm"), F.median("u").alias("duty_cycle"))


def dist_summary(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, extremes, quartiles and sd of the finite values."""
    v = finite(F.col(value).cast("double"))
    q = lambda p: F.percentile(v, F.lit(p))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), q(0.25).alias("q25"), F.median(v).alias("median"), q(0.75).alias("q75"), F.max(v).alias("max"), F.stddev_samp(v).alias("sd"))


def by_block_and_pooled(rows: DataFrame, a: str, b: str, block: str = "block") -> DataFrame:
    """Bias, mean absolute difference and concordance per block and over all, by one pass over grouping sets; pooled is 1 in the row of all."""
    d = F.col(a) - F.col(b)
    return rows.rollup(block).agg(F.grouping(block).cast("int").alias("pooled"), F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), ccc(a, b).alias("ccc"))


def pacer_error(rows: DataFrame, by: str, a: str, b: str, commanded: Column) -> DataFrame:
    """Signed and absolute error of both devices against the commanded value, and the difference of the absolute ones, per key."""
    aggs = [f(F.col(c) - commanded).alias(f"{n}_{k}") for k, c in (("a", a), ("b", b)) for n, f in (("bias", F.avg), ("mae", lambda x: F.avg(F.abs(x))))]
    return rows.groupBy(by).agg(*aggs).withColumn("mae_difference", F.col("mae_a") - F.col("mae_b"))


def rate_slopes(rows: DataFrame, by: str, error: Column, change: str, least: int = 4) -> DataFrame:
    """Slope of an error on the imposed change per key with enough trials; null without spread in the change."""
    r = rows.select(by, error.alias("_e"), F.col(change).alias("_x")).where("_e is not null and _x is not null")
    return r.groupBy(by).agg(F.count(F.lit(1)).alias("n"), slope("_e", "_x").alias("slope")).where(F.col("n") >= least)


def alertness_slopes(rows: DataFrame, by: str, alertness: str, a: str, b: str) -> DataFrame:
    """Alertness centred within the key; slope of each device's measure on it, and the difference."""
    r = rows.withColumn("_q", F.col(alertness) - F.avg(alertness).over(Window.partitionBy(by)))
    g = r.groupBy(by).agg(slope(a, "_q").alias("slope_a"), slope(b, "_q").alias("slope_b"))
    return g.withColumn("difference", F.col("slope_a") - F.col("slope_b"))


def pre_post_change(rows: DataFrame, by: str, block: str, pre: str, post: str, a: str, b: str) -> DataFrame:
    """Agreement (mean absolute difference and concordance) and each device's coefficient of variation in two blocks, and post less pre."""
    measures = {"mae": F.avg(F.abs(F.col(a) - F.col(b))), "ccc": ccc(a, b), "cv_a": F.try_divide(F.stddev_samp(a), F.avg(a)), "cv_b": F.try_divide(F.stddev_samp(b), F.avg(b))}
    each = rows.where(F.col(block).isin(pre, post)).groupBy(by, block).agg(*[m.alias(n) for n, m in measures.items()])
    side = lambda n, which: F.max(F.when(F.col(block) == which, F.col(n)))
    wide = each.groupBy(by).agg(*[side(n, w).alias(f"{n}_{k}") for n in measures for k, w in (("pre", pre), ("post", post))])
    return wide.withColumns({f"{n}_change": F.col(f"{n}_post") - F.col(f"{n}_pre") for n in measures})


def coefficient_difference(rows: DataFrame, by: str, x: str, a: str, b: str, least: int = 4) -> DataFrame:
    """Slope on x once with each device, and the difference, per key with enough rows; the differences go into trials.t_bounds."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), slope(a, x).alias("slope_a"), slope(b, x).alias("slope_b")).where(F.col("n") >= least)
    return g.withColumn("difference", F.col("slope_a") - F.col("slope_b"))


def quality_moderation(rows: DataFrame, by: str, time: str, quality: str, a: str, b: str, window: float) -> DataFrame:
    """Per key the slopes of agreement over rolling windows of elapsed time on the quality index (standardised within the key) and on elapsed time."""
    over = f"OVER (PARTITION BY `{by}` ORDER BY `{time}` RANGE BETWEEN {float(window)}D PRECEDING AND CURRENT ROW)"
    r = rows.select(by, F.col(time).alias("_t"), F.expr(f"avg(abs(`{a}` - `{b}`)) {over}").alias("_e"), F.expr(f"avg(`{quality}`) {over}").alias("_q"))
    every = Window.partitionBy(by)
    sd = F.stddev_samp("_q").over(every)
    r = r.withColumn("_z", (F.col("_q") - F.avg("_q").over(every)) / F.when(sd > 0, sd))
    return two_predictor_slopes(r, "_e", "_z", "_t", (by,))


def confidence_mean(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean over a key's rows, their number, and the standard error."""
    n = F.count(value)
    return rows.groupBy(by).agg(F.avg(value).alias("confidence"), n.alias("n"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).alias("se"))


def agreement_by_model(rows: DataFrame, scores: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Per selected model: participants, mean calibration fit and margin, mean absolute difference, and the slope of it on the margin.

    rows: by, a, b; scores: by, model, r, margin (of score_models).
    """
    each = rows.groupBy(by).agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))
    j = scores.where("model is not null").select(by, "model", "r", "margin").join(each, by)
    return j.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("fit"), F.avg("margin").alias("margin"), F.avg("mae").alias("mae"), slope("mae", "margin").alias("slope"))


def device_missingness(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Trials with a class from one device only, the rate of it, and trials whose class rests on a single breath. a, b: key, class, n_breaths."""
    j = a.select(key, F.col("class").alias("_a"), F.col("n_breaths").alias("_na")).join(b.select(key, F.col("class").alias("_b"), F.col("n_breaths").alias("_nb")), key, "full")
    only = lambda x, y: F.col(x).isNotNull() & F.col(y).isNull()
    single = F.coalesce(F.col("_na") == 1, F.lit(False)) | F.coalesce(F.col("_nb") == 1, F.lit(False))
    g = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(only("_a", "_b")).alias("only_a"), F.count_if(only("_b", "_a")).alias("only_b"), F.count_if(single).alias("single"))
    return g.withColumns({"missing_rate": F.try_divide((F.col("only_a") + F.col("only_b")).cast("double"), F.col("n")), "single_rate": F.try_divide(F.col("single").cast("double"), F.col("n"))})


def bias_sweep(rows: DataFrame, by: str, a: str, b: str, limit: float, biases: list[float], fails_below: float = 0.80) -> DataFrame:
    """Agreement of classes (value above the limit) when a bias is added to device b, for each bias, with the lower bound of keys' mean agreement
    and the first bias at which it falls below 0.80 (null if none does).
    """
    grid = rows.sparkSession.createDataFrame([(float(x),) for x in biases], "bias double")
    x = rows.select(by, F.col(a).alias("_a"), F.col(b).alias("_b")).crossJoin(F.broadcast(grid))  # a fixed list of biases
    x = x.withColumns({"ca": F.col("_a") > limit, "cb": (F.col("_b") + F.col("bias")) > limit})
    whole = classification_agreement(x, "ca", "cb", ("bias",))
    keys = x.groupBy("bias", by).agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("p"))
    k = keys.groupBy("bias").agg(F.count("p").alias("_n"), F.avg("p").alias("_m"), F.stddev_samp("p").alias("_s"))
    bound = F.when(F.col("_n") >= 3, F.col("_m") - t_quantile(F.lit(0.95), (F.col("_n") - 1).cast("double")) * F.col("_s") / F.sqrt("_n"))
    both = whole.join(k.select("bias", bound.alias("lower_bound")), "bias")
    return both.withColumn("first_failing", F.min(F.when(F.col("lower_bound") < fails_below, F.col("bias"))).over(Window.partitionBy(F.lit(1))))  # a row a bias


def dependent_corr_contrast(rows: DataFrame, shared: str, x: str, y: str) -> DataFrame:
    """r12 (shared with x), r13 (shared with y), r23, and the t statistic of r12 - r13 with n - 3 degrees of freedom."""
    c = rows.agg(F.count(F.lit(1)).alias("n"), correlation(shared, x).alias("r12"), correlation(shared, y).alias("r13"), correlation(x, y).alias("r23"))
    two = F.lit(2.0)
    det = 1 - F.pow("r12", two) - F.pow("r13", two) - F.pow("r23", two) + 2 * F.col("r12") * F.col("r13") * F.col("r23")
    mean = (F.col("r12") + F.col("r13")) / 2
    spread = 2 * (F.col("n") - 1) / (F.col("n") - 3) * det + mean * mean * F.pow(1 - F.col("r23"), F.lit(3.0))
    return c.withColumn("t", F.when(F.col("n") > 3, (F.col("r12") - F.col("r13")) * F.sqrt((F.col("n") - 1) * (1 + F.col("r23")) / spread)))


def questionnaire_corr(scores: DataFrame, measures: DataFrame, by: str, score: str, columns: list[str]) -> DataFrame:
    """Correlations of a participant's score with measures of theirs, over participants that have both."""
    j = scores.select(by, F.col(score).cast("double").alias("_s")).join(measures, by)
    return j.agg(F.count(F.lit(1)).alias("n"), *[correlation("_s", c).alias(f"r_{c}") for c in columns])


def model_frequency(scores: DataFrame) -> DataFrame:
    """Participants of each selected model, and those of a low fit."""
    return scores.where("model is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("low_fit").alias("n_low"))


def band_bias_table(true: DataFrame, found: DataFrame, within: float, row: str, column: str, columns: list) -> DataFrame:
    """Mean bias of the nearest found onset to each true one, `row` values down and `column` values side by side, with the difference of the first two.

    true: recording_id, t_s, row; found: recording_id, column, t_s. An onset
    without one within reach is left out; ties to the earlier. Equal true
    onsets are looked up once and count as often as they stand there.
    """
    bucket = F.floor(F.col("t_s") / within)
    left = true.groupBy(*REC, row, F.col("t_s").alias("_due"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    right = found.where(F.col(column).isin(columns)).select(*REC, column, F.col("t_s").alias("_at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    d = F.col("_at") - F.col("_due")
    near = left.join(right, [*REC, "_b"]).where(F.abs(d) <= within).groupBy(*REC, row, "_due", "_n", column).agg(F.min(F.struct(F.abs(d).alias("d"), "_at")).alias("m"))
    mine = lambda c, v: F.sum(F.when(F.col(column) == c, v))
    wide = near.groupBy(row).agg(*[F.try_divide(mine(c, (F.col("m._at") - F.col("_due")) * F.col("_n")), mine(c, F.col("_n"))).alias(f"bias_{c}") for c in columns])
    return wide.withColumn("difference", F.col(f"bias_{columns[0]}") - F.col(f"bias_{columns[1]}"))


def participant_extract(matched: DataFrame, depths: DataFrame | None = None, least: int = 5) -> DataFrame:
    """Per recording: blocks used, matched pairs, mean and sd of the difference per block averaged over blocks, and the mean depth difference.

    matched: recording_id, block, diff_ms; depths: recording_id, block,
    depth_diff of paired breaths. Blocks below `least` pairs give neither.
    """
    b = matched.groupBy(*REC, "block").agg(F.count("diff_ms").alias("n"), F.avg("diff_ms").alias("m"), F.stddev_samp("diff_ms").alias("s"))
    use = F.col("n") >= least
    out = b.groupBy(*REC).agg(F.count_if(use).alias("n_blocks"), F.sum("n").alias("n_pairs"), F.avg(F.when(use, F.col("m"))).alias("mean_ms"), F.avg(F.when(use, F.col("s"))).alias("sd_ms"))
    if depths is None:
        return out
    d = depths.groupBy(*REC, "block").agg(F.count("depth_diff").alias("n"), F.avg("depth_diff").alias("m")).where(F.col("n") >= least)
    return out.join(d.groupBy(*REC).agg(F.avg("m").alias("depth_diff")), list(REC), "left")


#: Limits of the flags: calibration fit, mean quality index, pacer adherence, spread of alignment residuals (ms).
FLAG_LIMITS = {"fit": 0.40, "quality": 0.50, "adherence": 0.40, "residual_ms": 100.0}


def participant_flags(ids: DataFrame, fits: DataFrame, quality: DataFrame, adherence: DataFrame, alignment: DataFrame, staircases: DataFrame, by: str = "participant_id", limits: dict | None = None, order: str | None = None) -> DataFrame:
    """Every id with what it is flagged for (never excluded): flags array, n_flags, flagged.

    fits: by, r; quality: by, quality (rows of the index); adherence: by, r
    (rows of trials); alignment: by, residual_sd_ms; staircases: by, stop_trial
    (a row a staircase). Something an id lacks raises no flag but for a
    staircase without a stop. Where a mean is the limit but for rounding, the
    order in which quality is added up decides: that of its column `order`, or
    any without one.
    """
    lim = FLAG_LIMITS | (limits or {})
    mean = F.avg("quality")
    if order:
        every = along(order, (by,)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        quality, mean = quality.withColumn("quality", F.avg("quality").over(every)), F.max("quality")
    parts = (
        fits.groupBy(by).agg(F.max("r").alias("_fit")), quality.groupBy(by).agg(mean.alias("_quality")), adherence.groupBy(by).agg(F.median("r").alias("_adherence")),
        alignment.groupBy(by).agg(F.max("residual_sd_ms").alias("_residual")), staircases.groupBy(by).agg(F.count_if(F.col("stop_trial").isNull()).alias("_open")),
    )
    j = ids.select(by).distinct()
    for part in parts:
        j = j.join(part, by, "left")
    tests = {
        "low calibration fit": F.col("_fit") < lim["fit"], "low signal quality": F.col("_quality") < lim["quality"], "poor pacer adherence": F.col("_adherence") < lim["adherence"],
        "large alignment residuals": F.col("_residual") > lim["residual_ms"], "staircase not converged": F.col("_open") > 0,
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return j.select(by, flags.alias("flags"), F.size(flags).alias("n_flags"), (F.size(flags) > 0).alias("flagged"))


def batch_report(rows: DataFrame, status: str = "status", flags: str | None = None) -> DataFrame:
    """Rows of each status, and how many of them carry flags."""
    flagged = F.lit(0).cast("bigint") if flags is None else F.count_if(F.coalesce(F.size(flags) > 0, F.lit(False)))
    return rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"), flagged.alias("n_flagged"))
