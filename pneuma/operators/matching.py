"""Matching of two devices' onsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, along


def candidate_pairs(a: DataFrame, b: DataFrame, tol: float, by: tuple[str, ...] = REC) -> DataFrame:
    """Pairs of onsets at most tol apart, by an equi-join on buckets of that width."""
    bucket = F.floor(F.col("t_s") / tol)
    left = a.select(*by, F.col("idx").alias("a_idx"), F.col("t_s").alias("a_t"), bucket.alias("_b"))
    right = b.select(*by, F.col("idx").alias("b_idx"), F.col("t_s").alias("b_t"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    return left.join(right, [*by, "_b"]).where(F.abs(F.col("a_t") - F.col("b_t")) <= tol).drop("_b")


def match_onsets(a: DataFrame, b: DataFrame, tol: float, batch: int = 512, by: tuple[str, ...] = REC) -> DataFrame:
    """One-to-one matches, nearest first, ties by b then a.

    Pairs that are nearest to each other on both sides are matched by window
    functions. What is left of the others falls into islands, as onsets farther
    than tol from every neighbour part the timeline; islands are decided by a
    helper, many at a time.
    """
    pairs = candidate_pairs(a, b, tol, by).withColumn("_d", F.abs(F.col("a_t") - F.col("b_t")))
    first = lambda side: F.row_number().over(Window.partitionBy(*by, f"{side}_idx").orderBy("_d", "b_idx", "a_idx")) == 1
    pairs = pairs.withColumn("_a", first("a")).withColumn("_b", first("b")).withColumn("_sure", F.col("_a") & F.col("_b"))
    taken = lambda side: F.max("_sure").over(Window.partitionBy(*by, f"{side}_idx"))
    pairs = pairs.withColumn("_ta", taken("a")).withColumn("_tb", taken("b"))
    sure = pairs.where("_sure").select(*by, "a_idx", "a_t", "b_idx", "b_t")
    left = pairs.where("not _ta and not _tb").select(*by, "a_idx", "a_t", "b_idx", "b_t", "_d")
    # A new island begins where no earlier pair reaches.
    lo, hi = F.least("a_t", "b_t"), F.greatest("a_t", "b_t")
    w = Window.partitionBy(*by).orderBy("_lo", "_hi", "a_idx", "b_idx")
    left = left.withColumns({"_lo": lo, "_hi": hi})
    left = left.withColumn("_new", F.coalesce(F.col("_lo") > F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    left = left.withColumn("_batch", F.floor(F.sum("_new").over(w) / batch)).drop("_new", "_lo", "_hi")

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_d", "b_idx", "a_idx"])
        seen_a, seen_b, keep = set(), set(), []
        for i, x, y in zip(rows.index, rows["a_idx"], rows["b_idx"], strict=True):
            if x not in seen_a and y not in seen_b:
                seen_a.add(x)
                seen_b.add(y)
                keep.append(i)
        return rows.loc[keep, [*by, "a_idx", "a_t", "b_idx", "b_t"]]

    return sure.unionByName(left.groupBy(*by, "_batch").applyInPandas(decide, left.select(*by, "a_idx", "a_t", "b_idx", "b_t").schema))


def matched_durations(matches: DataFrame, a: DataFrame, b: DataFrame, lo_ms: float, hi_ms: float) -> DataFrame:
    """Durations whose two ends are matched and follow each other in both sequences, both plausible; diff a - b in ms."""
    rank = lambda d, n: d.select(*REC, F.col("idx").alias(f"{n}_idx"), F.row_number().over(along("t_s")).alias(f"{n}_k"))
    m = matches.join(rank(a, "a"), [*REC, "a_idx"]).join(rank(b, "b"), [*REC, "b_idx"])
    w = along("a_k")
    m = m.withColumns({"next": (F.col("a_k") - F.lag("a_k").over(w) == 1) & (F.col("b_k") - F.lag("b_k").over(w) == 1), "a_ms": 1000 * (F.col("a_t") - F.lag("a_t").over(w)), "b_ms": 1000 * (F.col("b_t") - F.lag("b_t").over(w))})
    m = m.where(F.col("next") & F.col("a_ms").between(lo_ms, hi_ms) & F.col("b_ms").between(lo_ms, hi_ms))
    return m.select(*REC, "a_idx", "b_idx", "a_ms", "b_ms", (F.col("a_ms") - F.col("b_ms")).alias("diff_ms"))


def detection_score(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Precision, recall and F1 of a's onsets, with b as the truth."""
    n = lambda d, c: d.groupBy(*REC).agg(F.count(F.lit(1)).alias(c))
    x = n(a, "n_a").join(n(b, "n_b"), list(REC), "full").join(n(matches, "n_m"), list(REC), "left").fillna(0)
    ratio = lambda p, q: F.try_divide(F.col(p).cast("double"), q)
    x = x.withColumns({"precision": ratio("n_m", F.col("n_a")), "recall": ratio("n_m", F.col("n_b"))})
    return x.withColumn("f1", F.try_divide(2.0 * F.col("n_m"), F.col("n_a") + F.col("n_b")))


def onset_timing(matches: DataFrame) -> DataFrame:
    d = 1000 * (F.col("a_t") - F.col("b_t"))
    return matches.groupBy(*REC).agg(F.count(F.lit(1)).alias("n"), F.median(d).alias("median_ms"), (F.percentile(d, F.lit(0.75)) - F.percentile(d, F.lit(0.25))).alias("iqr_ms"))
