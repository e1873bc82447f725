"""Windows over breaths: assignment, features, rate series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, along
from .timebase import interp_to_grid


def make_epochs(windows: DataFrame, lag: float = 0.0) -> DataFrame:
    """Numbered windows shifted by the lag, further columns carried; windows that do not end after their start go to `bad`."""
    w = along(["onset", "offset"])
    e = windows.withColumns({"epoch": F.row_number().over(w), "start": F.col("onset") + F.lit(lag), "end": F.col("offset") + F.lit(lag)})
    return e.withColumn("bad", F.col("offset") <= F.col("onset")).drop("onset", "offset")


def _pairs(breaths: DataFrame, epochs: DataFrame, bucket: float) -> DataFrame:
    """Breaths and windows of a recording that share a time bucket, each pair once: both lists of buckets begin with max of the two."""
    b = lambda c: F.floor(F.col(c) / bucket)
    left = breaths.withColumn("_b", F.explode(F.sequence(b("t_start"), b("t_end"))))
    right = epochs.select(*REC, "epoch", "start", "end", F.explode(F.sequence(b("start"), b("end"))).alias("_b"))
    both = left.join(right, [*REC, "_b"])
    return both.where(F.col("_b") == F.greatest(b("t_start"), b("start"))).drop("_b")


def epoch_breaths(breaths: DataFrame, epochs: DataFrame, rule: str = "start", pad: float = 0.0, bucket: float = 259200.0) -> DataFrame:
    """Breaths with their window. start and contained: every breath once, in its first window or none; overlap: every pair."""
    wide = epochs.withColumns({"start": F.col("start") - pad, "end": F.col("end") + pad})
    if rule == "start":
        hit = F.col("t_start").between(F.col("start"), F.col("end"))
    elif rule == "contained":
        hit = (F.col("t_start") >= F.col("start")) & (F.col("t_end") <= F.col("end"))
    else:
        hit = (F.col("t_end") >= F.col("start")) & (F.col("t_start") <= F.col("end"))
    found = _pairs(breaths, wide, bucket).where(hit)
    if rule == "overlap":
        return found.drop("start", "end")
    first = found.groupBy(*REC, "breath").agg(F.min("epoch").alias("epoch"))
    return breaths.join(first, [*REC, "breath"], "left")


def epoch_features(breaths: DataFrame, epochs: DataFrame, bucket: float = 259200.0) -> DataFrame:
    """Every window once: breaths that start in it (kept and all), partly covered ones, covered share, mean duration."""
    mine = epoch_breaths(breaths, epochs, "start", 0.0, bucket).where("epoch is not null").join(epochs.select(*REC, "epoch", "start", "end"), [*REC, "epoch"])
    span = F.greatest(F.lit(0.0), F.least("t_end", "end") - F.greatest("t_start", "start"))
    keep = F.coalesce("keep", F.lit(False))
    f = mine.groupBy(*REC, "epoch").agg(
        F.count(F.lit(1)).alias("n_breaths_total"), F.count_if(keep).alias("n_breaths"), F.sum(F.when(keep, span)).alias("covered"),
        F.avg(F.when(keep, F.col("duration"))).alias("duration_mean"),
    )
    part = _pairs(breaths, epochs, bucket).where("t_end >= start and t_start <= end and not (t_start >= start and t_end <= end)")
    part = part.groupBy(*REC, "epoch").agg(F.count(F.lit(1)).alias("n_breaths_partial"))
    out = epochs.join(f, [*REC, "epoch"], "left").join(part, [*REC, "epoch"], "left")
    share = F.when(F.col("end") > F.col("start"), F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0)) / (F.col("end") - F.col("start")))).otherwise(F.lit(0.0))
    return out.select(
        *REC, "epoch", "start", "end", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_breaths_total", "n_breaths", "n_breaths_partial")],
        share.alias("coverage_frac"), F.coalesce("covered", F.lit(0.0)).alias("window_coverage_s"), "duration_mean",
    )


def rate_series(breaths: DataFrame, step: float, value: str = "rate_bpm", method: str = "constant") -> DataFrame:
    """Regular series per recording: the value of the breath begun last, or a line between breath middles, ends held."""
    r = breaths.groupBy(*REC).agg(F.min("t_start").alias("lo"), F.max("t_end").alias("hi"))
    r = r.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / step).cast("int"))))
    grid = r.select(*REC, "k", (F.col("lo") + F.col("k") * F.lit(step)).alias("t_s"))
    if method == "linear":
        return interp_to_grid(breaths.select(*REC, ((F.col("t_start") + F.col("t_end")) / 2).alias("t_s"), F.col(value).alias("value")), grid)
    both = breaths.select(*REC, F.col("t_start").alias("t_s"), F.struct(F.col(value).alias("v")).alias("p"), F.lit(None).cast("int").alias("k"))
    both = both.unionByName(grid.select(*REC, "t_s", F.lit(None).cast("struct<v:double>").alias("p"), "k"))
    held = F.last("p", True).over(along(["t_s", "k"]).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("h", held).where("k is not null").select(*REC, "k", "t_s", F.col("h.v").alias("value"))
