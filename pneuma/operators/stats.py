"""Agreement and variance statistics as grouped sums."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ccc(a: str, b: str) -> Column:
    """Lin's concordance."""
    return 2 * F.covar_pop(a, b) / (F.var_pop(a) + F.var_pop(b) + F.pow(F.avg(a) - F.avg(b), F.lit(2.0)))


def icc_2_1(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Two-way random, absolute agreement, single measures: each row a subject, two raters."""
    m = (F.col(a) + F.col(b)) / 2
    n = F.count(F.lit(1))
    s = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(
        n.alias("n"), (2 * F.var_samp(m)).alias("msr"), (n * F.pow(F.avg(a) - F.avg(b), F.lit(2.0)) / 2).alias("msc"), (F.var_samp(F.col(a) - F.col(b)) / 2).alias("mse")
    )
    icc = F.try_divide(F.col("msr") - F.col("mse"), F.col("msr") + F.col("mse") + 2 * (F.col("msc") - F.col("mse")) / F.col("n"))
    return s.select(*by, "n", icc.alias("icc"))


def group_table(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean and within sum of squares of each group."""
    return rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(F.lit(1))).alias("ssw"))


def bland_altman(rows: DataFrame, group: str, diff: str) -> DataFrame:
    """Bias and limits of agreement with repeated measures per group, from the one-way mean squares."""
    g = group_table(rows, group, diff)
    t = g.agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("bias"), F.sum("ssw").alias("ssw"),
        F.sum(F.pow("n", F.lit(2.0))).alias("n2"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"),
    )
    msw = F.col("ssw") / (F.col("N") - F.col("k"))
    msb = (F.col("nmm") - F.col("N") * F.col("bias") * F.col("bias")) / (F.col("k") - 1)
    n0 = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("k") - 1)
    total = F.sqrt(F.greatest(F.lit(0.0), (msb - msw) / n0) + msw)
    return t.select(F.col("k").alias("n_groups"), "bias", (F.col("bias") - 1.96 * total).alias("lower"), (F.col("bias") + 1.96 * total).alias("upper"), F.sqrt(msw).alias("within_sd"))


def between_sd_moment(rows: DataFrame, group: str, value: str) -> DataFrame:
    """sqrt(max(0, var(means) - mean(sd^2 / n))) over groups of two or more; null below three groups."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n >= 2")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.var_samp("m") - F.avg(F.col("v") / F.col("n"))))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.when(F.count(F.lit(1)) >= 3, sd).alias("between_sd"))


#: Fixed value: the 95 % point of chi squared with one degree of freedom.
CHI2_95 = 3.841458820694124
_GOLDEN = (5**0.5 - 1) / 2


def _minimum(f: Callable[[float], float], lo: float, hi: float, rounds: int = 90) -> float:
    """Golden-section search."""
    a, b = hi - _GOLDEN * (hi - lo), lo + _GOLDEN * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - _GOLDEN * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + _GOLDEN * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def reml(n: np.ndarray, k: np.ndarray, mean: np.ndarray, css: np.ndarray, ssw: float) -> tuple[float, float, float, bool]:
    """within sd, between sd, its 95 % profile upper bound, singular; from groups summed by size.

    n: size; k, mean, css: number of groups of that size, the mean of their
    means and the sum of squares of these; ssw: all squares within groups. With
    w = n / (1 + ratio n), the restricted likelihood is smallest in
    (N - 1) ln rss + sum ln(1 + ratio n) + ln sum w. Ratios are searched from 0
    without an upper end. The bound is where the deviance, with the within sd
    fitted anew, has risen by CHI2_95 (by the restricted likelihood).
    """
    total, groups = float((n * k).sum()), k

    def parts(ratio: float) -> tuple[float, float]:
        w = n / (1 + ratio * n)
        sw = (groups * w).sum()
        mu = (groups * w * mean).sum() / sw
        return ssw + (w * (css + groups * (mean - mu) ** 2)).sum(), (groups * np.log1p(ratio * n)).sum() + np.log(sw)

    def crit(ratio: float) -> float:
        rss, rest = parts(ratio)
        return (total - 1) * np.log(max(rss, 1e-300)) + rest

    best, at = crit(0.0), None
    step = -24.0
    while step < 700:  # logarithms of ratios; on until the criterion has long been rising
        c = crit(math.exp(step))
        if c < best:
            best, at = c, step
        elif step > (at if at is not None else 0.0) + 12:
            break
        step += 0.5
    ratio = 0.0 if at is None else math.exp(_minimum(lambda u: crit(math.exp(u)), at - 0.5, at + 0.5))
    within = math.sqrt(parts(ratio)[0] / (total - 1))
    between = within * math.sqrt(ratio)

    def deviance(sd: float) -> float:
        def of(log_var: float) -> float:
            rss, rest = parts(sd * sd / math.exp(log_var))
            return (total - 1) * log_var + rest + rss / math.exp(log_var)

        middle = 2 * math.log(within)
        return of(_minimum(of, middle - 6, middle + 6, 60))

    limit = deviance(between) + CHI2_95
    lo, hi = between, max(between, within) * 1.5
    while deviance(hi) < limit and hi < 1e6 * within:
        lo, hi = hi, hi * 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if deviance(mid) < limit else (lo, mid)
    return within, between, hi, ratio == 0.0


def variance_components(rows: DataFrame, group: str, value: str, least_rows: int = 5, least_groups: int = 3) -> DataFrame:
    """n_obs, n_groups, within_sd, between_sd, between_hi and singular of a random-intercept model by restricted likelihood.

    Groups below least_rows do not count; fewer than least_groups groups, or no
    spread within them, give nulls. The likelihood needs the group table only
    through sums by group size, of which there are few; they are one row's arrays.
    """
    g = group_table(rows, group, value).where(F.col("n") >= least_rows)
    by_size = g.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.avg("m").alias("mean"), (F.var_pop("m") * F.count(F.lit(1))).alias("css"), F.sum("ssw").alias("ssw"))
    one = by_size.agg(F.sum("k").alias("n_groups"), F.sum(F.col("n") * F.col("k")).alias("n_obs"), F.sum("ssw").alias("ssw"), *[F.collect_list(F.col(c).cast("double")).alias(c) for c in ("n", "k", "mean", "css")])

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in x.itertuples(index=False):
            ok = r.n_groups >= least_groups and r.ssw > 0
            out.append(reml(*(np.asarray(v, float) for v in (r.n, r.k, r.mean, r.css)), r.ssw) if ok else (None, None, None, None))
        return pd.DataFrame(out, columns=["within_sd", "between_sd", "between_hi", "singular"])

    columns = F.struct(F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("ssw", F.lit(0.0)).alias("ssw"), "n", "k", "mean", "css")
    one = one.withColumn("f", F.pandas_udf(fit, "within_sd double, between_sd double, between_hi double, singular boolean")(columns))
    return one.select(F.coalesce("n_obs", F.lit(0)).alias("n_obs"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), "f.*")


def classification_agreement(rows: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Percent agreement, Cohen's kappa and Gwet's AC1 of two binary classes on complete pairs."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    q = (F.col("pa") + F.col("pb")) / 2
    pg = 2 * q * (1 - q)
    chance = lambda p: F.when(p < 1, (F.col("po") - p) / (1 - p))
    return s.select(*by, "n", F.col("po").alias("agreement"), chance(pe).alias("kappa"), chance(pg).alias("ac1"))


def two_predictor_slopes(rows: DataFrame, y: str, x1: str, x2: str, by: tuple[str, ...]) -> DataFrame:
    """Least squares of y on two predictors per group, from covariances."""
    c = lambda p, q: F.covar_samp(p, q)
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp(x1).alias("v1"), F.var_samp(x2).alias("v2"), c(x1, x2).alias("c12"), c(x1, y).alias("c1y"), c(x2, y).alias("c2y")
    )
    det = F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12")
    return s.where("n >= 4").select(
        *by, "n", F.try_divide(F.col("c1y") * F.col("v2") - F.col("c2y") * F.col("c12"), det).alias("b1"), F.try_divide(F.col("c2y") * F.col("v1") - F.col("c1y") * F.col("c12"), det).alias("b2")
    )


def _numbered(rows: DataFrame, digest: str) -> DataFrame:
    """rows with `_k`, their place from 0 in the order of a column of hex digests: the place within each first three digits, and where these begin."""
    x = rows.withColumn("_part", F.substring(digest, 1, 3)).withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(digest)))
    starts = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows
    starts = starts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return x.join(F.broadcast(starts), "_part").withColumn("_k", F.col("_start") + F.col("_place") - 1).drop("_part", "_place", "_start")


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, replicates: int = 200, low: float = 0.025) -> DataFrame:
    """lower, mean, replicates: the mean of all rows, and the low quantile of means over replicates that draw as many whole clusters as there are,
    with replacement.

    Draw j of replicate r takes cluster number md5("r:j") mod n, clusters being
    numbered in the order of md5(cluster), so every run draws the same. Draws
    are counted per replicate and cluster before they meet the clusters' sums,
    which alone are joined. A replicate without any value is left out; without
    clusters there is one row of nulls. Rows without a cluster are no cluster.
    """
    digits = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 13), 16, 10).cast("bigint")
    g = rows.where(F.col(cluster).isNotNull()).groupBy(F.md5(F.col(cluster).cast("string").cast("binary")).alias("_c")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    g = _numbered(g, "_c")
    clusters = g.count()
    draws = rows.sparkSession.range(clusters * replicates).select(F.floor(F.col("id") / max(1, clusters)).alias("rep"), (F.col("id") % max(1, clusters)).alias("draw"))
    taken = digits(F.concat_ws(":", F.col("rep").cast("string"), F.col("draw").cast("string"))) % max(1, clusters)
    counts = draws.groupBy("rep", taken.alias("_k")).agg(F.count(F.lit(1)).alias("w"))
    means = counts.join(g, "_k").groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("mean"))
    mean = g.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(low)).alias("lower"), F.count("mean").alias("replicates")).crossJoin(F.broadcast(mean)).select("lower", "mean", "replicates")
