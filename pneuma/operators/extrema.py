"""Peaks and troughs of sampled signals."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, along, run_ids
from .timebase import fill_gaps


def _plateaus(samples: DataFrame) -> DataFrame:
    """recording_id, idx, value and the values before and after of every run of equal values; idx is its middle, the left one of two."""
    runs = run_ids(samples, "value").groupBy(*REC, "run").agg(F.first("value").alias("value"), F.min("idx").alias("start"), F.count(F.lit(1)).alias("n"))
    w = along("run")
    middle = (F.col("start") + F.floor((F.col("n") - 1) / 2)).cast("bigint")
    return runs.select(*REC, middle.alias("idx"), "value", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"))


def local_maxima(samples: DataFrame) -> DataFrame:
    """recording_id, idx, value of every plateau above both neighbours: its middle, the left one of two."""
    return _plateaus(samples).where((F.col("value") > F.col("before")) & (F.col("value") > F.col("after"))).select(*REC, "idx", "value")


def turning_points(samples: DataFrame) -> DataFrame:
    """recording_id, idx, value, kind: plateaus above both neighbours as peaks, plateaus below both as troughs."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    kind = F.when((v > before) & (v > after), "peak").when((v < before) & (v < after), "trough")
    return _plateaus(samples).select(*REC, "idx", "value", kind.alias("kind")).where("kind is not null")


def enforce_alternation(extrema: DataFrame, rule: str = "extreme", by: tuple[str, ...] = REC) -> DataFrame:
    """One event of each run of the same kind.

    extreme: the highest peak or lowest trough, the first of ties. nearest: the
    one closest to the next event of the other kind, and the last of the last
    run. In a run without any value the middle event stays.
    """
    runs = run_ids(extrema, "kind", "idx", by)
    w = Window.partitionBy(*by, "run")
    if rule == "extreme":
        height = F.when(F.col("kind") == "peak", F.col("value")).otherwise(-F.col("value"))
        place = F.row_number().over(w.orderBy("idx"))
        runs = runs.withColumns({"_h": height, "_n": F.count(F.lit(1)).over(w), "_k": F.count("value").over(w), "_p": place})
        middle = F.when(F.col("_k") == 0, F.abs(F.col("_p") - F.floor((F.col("_n") + 1) / 2)))
        order = w.orderBy(middle.asc_nulls_last(), F.col("_h").desc_nulls_last(), "idx")
    else:
        last = runs.groupBy(*by, "run").agg(F.min("idx").alias("first"))
        nxt = last.select(*by, (F.col("run") - 1).alias("run"), F.col("first").alias("next"))
        runs = runs.join(nxt, [*by, "run"], "left")
        order = w.orderBy(F.abs(F.col("idx") - F.col("next")).asc_nulls_first(), F.when(F.col("next").isNull(), -F.col("idx")).otherwise(F.col("idx")))
    return runs.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(extrema.columns)


def extrema_zerocross(samples: DataFrame, amplitude_min: float = 0.3, by: tuple[str, ...] = REC) -> DataFrame:
    """One extremum per half cycle between zero crossings of the centred signal; small swings dropped.

    A half cycle runs from the sample before one crossing to the sample before
    the next, both included. With three extrema or more, one whose smaller
    neighbouring swing is below amplitude_min of the mean swing goes.
    """
    w = along("idx", by)
    x = samples.withColumn("x", F.col("value") - F.avg("value").over(Window.partitionBy(*by)))
    x = x.withColumn("up", F.col("x") >= 0)
    x = x.withColumn("cut", (F.lead("up").over(w) != F.col("up")).cast("int"))
    x = x.withColumn("cuts", F.sum(F.coalesce("cut", F.lit(0))).over(w))
    # A cut sample closes the half cycle before it and opens the next.
    seg = x.withColumn("seg", F.when(F.col("cut") == 1, F.array("cuts", F.col("cuts") - 1)).otherwise(F.array("cuts")))
    seg = seg.select(*by, "idx", "x", "value", "up", "cut", "cuts", F.explode("seg").alias("seg"))
    total = Window.partitionBy(*by)
    seg = seg.withColumn("last", F.max("cuts").over(total)).where((F.col("seg") >= 1) & (F.col("seg") < F.col("last")))
    rises = seg.groupBy(*by, "seg").agg(
        F.min_by("up", "idx").alias("from_up"),
        F.max_by(F.struct("idx", "value", "x"), F.struct("x", -F.col("idx"))).alias("hi"),
        F.min_by(F.struct("idx", "value", "x"), F.struct("x", "idx")).alias("lo"),
    )
    pick = F.when(F.col("from_up"), F.col("lo")).otherwise(F.col("hi"))
    ex = rises.select(*by, "seg", pick["idx"].alias("idx"), pick["value"].alias("value"), pick["x"].alias("x"), F.when(F.col("from_up"), "trough").otherwise("peak").alias("kind"))
    w = along("seg", by)
    ex = ex.withColumns({"back": F.abs(F.col("x") - F.lag("x").over(w)), "ahead": F.abs(F.col("x") - F.lead("x").over(w))})
    ex = ex.withColumns({"mean": F.avg("back").over(total), "n": F.count(F.lit(1)).over(total)})
    return ex.where((F.col("n") < 3) | (F.least("back", "ahead") >= amplitude_min * F.col("mean"))).select(*by, "idx", "value", "kind")


def refine_extrema(extrema: DataFrame, samples: DataFrame, window: int) -> DataFrame:
    """Moves each event to the extreme sample within `window` samples of it: the middle one of ties, the left of two.

    A range join by buckets of the window's width; an event without finite samples near it stays.
    """
    width = 2 * window + 1
    bucket = F.floor(F.col("idx") / width)
    ev = extrema.select(*REC, F.col("idx").alias("at"), "kind", F.explode(F.array(F.floor((F.col("idx") - window) / width), F.floor((F.col("idx") + window) / width))).alias("bucket")).distinct()
    near = ev.join(samples.select(*REC, "idx", "value", bucket.alias("bucket")), [*REC, "bucket"]).where(F.abs(F.col("idx") - F.col("at")) <= window)
    near = near.withColumn("h", F.when(F.col("kind") == "peak", F.col("value")).otherwise(-F.col("value")))
    best = near.withColumn("top", F.max("h").over(Window.partitionBy(*REC, "at", "kind"))).where("h = top")
    ties = best.groupBy(*REC, "at", "kind").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("ties"))
    got = ties.select(*REC, "at", "kind", F.element_at("ties", F.floor((F.size("ties") + 1) / 2).cast("int")).alias("m"))
    return got.select(*REC, "at", "kind", F.col("m.idx").alias("idx"), F.col("m.value").alias("value"))


def collapse_refined(refined: DataFrame) -> DataFrame:
    """Each refined sample once; a sample that became both peak and trough is neither."""
    once = refined.select(*REC, "idx", "kind", "value").dropDuplicates([*REC, "idx", "kind"])
    both = Window.partitionBy(*REC, "idx")
    return once.withColumn("_kinds", F.count(F.lit(1)).over(both)).where("_kinds = 1").drop("_kinds")


def _valleys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the lowest one back to the nearest strictly higher value (or the start), and whether there is a higher one."""
    low, bounded = np.empty(len(x)), np.zeros(len(x), bool)
    stack: list[tuple[float, float]] = []  # height, lowest value since the one below it in the stack
    for i, v in enumerate(x.tolist()):
        least = v
        while stack and stack[-1][0] <= v:
            least = min(least, stack.pop()[1])
        low[i], bounded[i] = least, bool(stack)
        stack.append((v, least))
    return low, bounded


def _both_valleys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    left, right = _valleys(x), _valleys(x[::-1])
    return left[0], left[1], right[0][::-1], right[1][::-1]


def _gaps(x: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The lowest value since the kept one before, itself included."""
    out, at = np.full(len(x), np.nan), np.flatnonzero(kept)
    if len(at):
        out[at] = np.minimum.reduceat(x[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
    return out


_PROMINENT = "recording_id bigint, sign int, idx bigint, value double, prominence double, maximum boolean, left double, right double, gap double"
_PROMINENT_ARROW = pa.schema(
    [("recording_id", pa.int64()), ("sign", pa.int32()), ("idx", pa.int64())] + [(c, pa.float64()) for c in ("value", "prominence")] + [("maximum", pa.bool_())]
    + [(c, pa.float64()) for c in ("left", "right", "gap")]
)


def _lists(column: pa.Array) -> list[dict[str, np.ndarray]]:
    """Each row of an array of structs as arrays of its fields."""
    offsets, flat = column.offsets.to_numpy(), column.values
    fields = {flat.type.field(k).name: flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)}
    return [{c: v[a:b] for c, v in fields.items()} for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _settled(signs: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per range and sign: maxima with their prominence where the range alone bounds it, and, of a recording of several ranges, also the values that
    are the highest so far from either side: other ranges see only them, and the lowest value since the kept one before (gap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for recording, whole, rows in zip(b.column(0), b.column(1).to_pylist(), _lists(b.column(2)), strict=True):
                for sign in signs:
                    x, maximum = sign * rows["value"].astype(float), rows["kind"] == sign
                    low, bounded, ahead, bounded_ahead = _both_valleys(x)
                    kept = np.zeros(len(x), bool) if whole else ~(bounded & bounded_ahead)
                    prominence = np.where(maximum & ~kept, x - np.maximum(low, ahead), np.nan)
                    some = maximum | kept
                    floats = (x, prominence, np.where(bounded, low, np.nan), np.where(bounded_ahead, ahead, np.nan), _gaps(x, kept))
                    value, prominence, left, right, gap = (pa.array(f[some], from_pandas=True) for f in floats)
                    n = int(some.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([recording.as_py()] * n, pa.int64()), pa.array(np.full(n, sign, np.int32)), pa.array(rows["idx"][some]), value, prominence, pa.array(maximum[some]), left, right, gap],
                        schema=_PROMINENT_ARROW,
                    )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prominence of the kept maxima of a recording."""
    for b in batches:
        for recording, sign, rows in zip(b.column(0), b.column(1), _lists(b.column(2)), strict=True):
            x = np.stack([rows["gap"], rows["value"]], axis=1).ravel()
            low, _, ahead, _ = _both_valleys(x)
            left, right = (np.where(np.isnan(mine), found[1::2], mine) for mine, found in ((rows["left"], low), (rows["right"], ahead)))
            top = rows["maximum"].astype(bool)
            n, nothing = int(top.sum()), pa.nulls(int(top.sum()), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([recording.as_py()] * n, pa.int64()), pa.array([sign.as_py()] * n, pa.int32()), pa.array(rows["idx"][top]), pa.array(rows["value"][top]),
                 pa.array((rows["value"] - np.maximum(left, right))[top]), pa.array(top[top]), nothing, nothing, nothing],
                schema=_PROMINENT_ARROW,
            )


def prominences(samples: DataFrame, signs: tuple[int, ...] = (1,), range_samples: int = 1 << 18) -> DataFrame:
    """recording_id, sign, idx, value, prominence: maxima of the signal (sign 1) and of the negated signal (-1, value negated too).

    Only turning points and the two ends go to the helpers: they bound every
    valley. Ranges of a recording are arrays, many to a batch; they settle most
    maxima on their own, all of them where a recording is one range. The values
    that still stand out of their range are merged per recording.
    """
    ends = samples.groupBy(*REC).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    marks = turning_points(samples).select(*REC, "idx", "value", F.when(F.col("kind") == "peak", 1).otherwise(-1).alias("kind"))
    edge = samples.join(ends, list(REC)).where("idx = lo or idx = hi").select(*REC, "idx", "value", F.lit(0).alias("kind"))
    at = lambda c: F.floor(F.col(c) / range_samples)
    both = marks.unionByName(edge).join(ends.select(*REC, (at("lo") == at("hi")).alias("whole")), list(REC))
    rows = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("bigint").alias("idx"), "kind", F.col("value").cast("double").alias("value"))))
    arrays = both.groupBy(*REC, "whole", at("idx").alias("_range")).agg(rows.alias("rows")).select(F.col(REC[0]).cast("bigint").alias(REC[0]), "whole", "rows")
    settled = arrays.mapInArrow(_settled(signs), _PROMINENT)
    open_rows = F.array_sort(F.collect_list(F.struct("idx", "maximum", "value", "left", "right", "gap"))).alias("rows")
    left = settled.where("gap is not null").groupBy(*REC, "sign").agg(open_rows).mapInArrow(_merged, _PROMINENT)
    return settled.where("gap is null and maximum").unionByName(left).select(*REC, "sign", "idx", "value", "prominence")


def peak_prominence(samples: DataFrame, range_samples: int = 1 << 18) -> DataFrame:
    """Maxima with their prominence."""
    return prominences(samples, (1,), range_samples).select(*REC, "idx", "value", "prominence")


def greedy_spacing(events: DataFrame, gap: float, weight: str, by: tuple[str, ...] = REC, at: str = "idx", batch: int = 512) -> DataFrame:
    """Heaviest first, drops events closer than `gap` to one already taken; ties in order.

    Events farther apart than the gap are independent: lone ones stay as they
    are, and islands of close events are decided by a helper, many at a time.
    """
    w = along(at, by)
    far = (F.col(at) - F.lag(at).over(w) >= gap) | F.lag(at).over(w).isNull()
    marked = events.withColumn("_far", far.cast("int"))
    marked = marked.withColumns({"_island": F.sum("_far").over(w), "_lone": (F.col("_far") == 1) & (F.coalesce(F.lead("_far").over(w), F.lit(1)) == 1)}).drop("_far")
    contested = marked.where("not _lone").drop("_lone").withColumn("_batch", F.floor(F.col("_island") / batch))

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_island", at], kind="stable").reset_index(drop=True)
        place, island = rows[at].to_numpy(), rows["_island"].to_numpy()
        taken: dict[int, list] = {}
        keep = []
        for i in rows[weight].sort_values(ascending=False, kind="stable").index:
            mine = taken.setdefault(island[i], [])
            k = bisect.bisect_left(mine, place[i])
            if (k == 0 or place[i] - mine[k - 1] >= gap) and (k == len(mine) or mine[k] - place[i] >= gap):
                mine.insert(k, place[i])
                keep.append(i)
        return rows.loc[sorted(keep)].drop(columns="_batch")

    decided = contested.groupBy(*by, "_batch").applyInPandas(decide, contested.drop("_batch").schema)
    return marked.where("_lone").drop("_lone").unionByName(decided).drop("_island")


def extrema_prominence(samples: DataFrame, min_prominence: float = 0.5, min_distance: float = 1.0) -> DataFrame:
    """Peaks and troughs of enough prominence, spaced at least min_distance samples within their kind."""
    top = prominences(samples, (1, -1)).where(F.col("prominence") >= min_prominence)
    top = greedy_spacing(top, min_distance, "prominence", (*REC, "sign"))
    return top.select(*REC, "idx", (F.col("sign") * F.col("value")).alias("value"), "prominence", F.when(F.col("sign") == 1, "peak").otherwise("trough").alias("kind"))


def first_paced_onset(peaks: DataFrame, min_breath: float, run: int) -> DataFrame:
    """recording_id, t_s of the first peak that begins run - 1 intervals of at least min_breath."""
    w = along("t_s")
    slow = peaks.withColumn("_slow", ((F.lead("t_s").over(w) - F.col("t_s")) >= min_breath).cast("int"))
    ahead = w.rowsBetween(0, run - 2)
    slow = slow.withColumn("_sum", F.sum("_slow").over(ahead))
    return slow.where(F.col("_sum") == run - 1).groupBy(*REC).agg(F.min("t_s").alias("first_onset_s"))


def prominence_distribution(maxima: DataFrame, by: tuple[str, ...] = REC) -> DataFrame:
    q = lambda p: F.percentile("prominence", F.lit(p))
    return maxima.groupBy(*by).agg(F.count(F.lit(1)).alias("n_maxima"), F.min("prominence").alias("p_min"), q(0.25).alias("p_q25"), q(0.5).alias("p_median"), F.max("prominence").alias("p_max"))


def prominence_sweep(maxima: DataFrame, thresholds: list[float], min_distance: float = 1.0) -> DataFrame:
    """Per recording and threshold: maxima kept and dropped by prominence, spaced ones, and the median step between these.

    Prominences are computed once; spacing depends on the threshold.
    """
    grid = maxima.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    each = maxima.crossJoin(F.broadcast(grid))  # a fixed list of thresholds
    kept = (F.col("prominence") >= F.col("threshold")).cast("bigint")
    counts = each.groupBy(*REC, "threshold").agg(F.sum(kept).alias("kept"), F.sum(1 - kept).alias("dropped"))
    by = (*REC, "threshold")
    spaced = greedy_spacing(each.where("prominence >= threshold"), min_distance, "prominence", by)
    spaced = spaced.withColumn("_step", F.col("idx") - F.lag("idx").over(along("idx", by)))
    spaced = spaced.groupBy(*by).agg(F.count(F.lit(1)).alias("spaced"), F.median("_step").alias("median_step"))
    return counts.join(spaced, list(by), "left").fillna(0, ["spaced"])


def detect_breaths(samples: DataFrame, fs: float, method: str = "prominence", min_prominence: float = 0.5, min_distance_s: float = 1.0, amplitude_min: float = 0.3,
                   refine_on: DataFrame | None = None, refine_window_s: float = 0.4, rule: str = "extreme") -> DataFrame:
    """recording_id, idx, value, kind: peaks and troughs found, moved to the extremes of a second signal where one is given, and made to alternate.

    Gaps are bridged first. rule: extreme, nearest, or none.
    """
    x = fill_gaps(samples.select(*REC, "idx", "value")).where("value is not null").drop("filled")
    if method == "prominence":
        found = extrema_prominence(x, min_prominence, max(1.0, round(min_distance_s * fs)))
    elif method == "zerocross":
        found = extrema_zerocross(x, amplitude_min)
    else:
        raise ValueError(f"no such method: {method}")
    found = found.select(*REC, "idx", "value", "kind")
    if refine_on is not None:
        second = fill_gaps(refine_on.select(*REC, "idx", "value")).where("value is not null").drop("filled")
        found = collapse_refined(refine_extrema(found, second, round(refine_window_s * fs))).select(*REC, "idx", "value", "kind")
    return found if rule == "none" else enforce_alternation(found, rule)


def _spaced_times(times: pd.Series, gap: float) -> pd.Series:
    """Of ascending times those more than gap after the one taken before."""
    out = []
    for ts in times:
        taken: list[float] = []
        for t in ts:
            if not taken or t - taken[-1] > gap:
                taken.append(t)
        out.append(taken)
    return pd.Series(out)


def estimate_breath_period(samples: DataFrame, least_s: float = 2.0, most_s: float = 8.0) -> DataFrame:
    """recording_id, n_peaks, period_s: upper median of plausible intervals between peaks of a free stretch; null without any.

    A peak is higher than two samples on each side and above 0.40 of the range,
    and more than 0.6 of the shortest period after the peak before.
    """
    w, every = along(), Window.partitionBy(*REC)
    lo, hi = F.min("value").over(every), F.max("value").over(every)
    x = samples.select(*REC, "idx", "t_s", "value").withColumns({"_u": (F.col("value") - lo) / F.when(hi - lo >= 1e-6, hi - lo), "_n": F.count(F.lit(1)).over(every)})
    top = (F.col("_u") > 0.40) & (F.col("_n") >= 10)
    for k in (1, 2):
        top = top & (F.col("value") > F.lag("value", k).over(w)) & (F.col("value") > F.lead("value", k).over(w))
    peaks = x.withColumn("_top", F.when(top, F.col("t_s"))).groupBy(*REC).agg(F.array_sort(F.collect_list("_top")).alias("t"))
    gap = 0.6 * least_s
    peaks = peaks.withColumn("t", F.pandas_udf(lambda t: _spaced_times(t, gap), "array<double>")("t"))
    steps = F.zip_with(F.slice("t", 2, F.greatest(F.lit(1), F.size("t"))), F.slice("t", 1, F.greatest(F.lit(0), F.size("t") - 1)), lambda b, a: b - a)
    steps = F.array_sort(F.filter(steps, lambda d: (d >= least_s) & (d <= most_s)))
    return peaks.withColumn("d", steps).select(*REC, F.size("t").alias("n_peaks"), F.get("d", F.floor(F.size("d") / 2).cast("int")).alias("period_s"))


def _fires(rows: pd.DataFrame, gap: float) -> pd.Series:
    """Times at which the armed signal rises above the dead zone; it is armed below, and stays so while a crossing comes too early."""
    out = []
    for times, above in zip(rows["t"], rows["above"], strict=True):
        armed, taken = False, []
        for t, up in zip(times, above, strict=True):
            if not up:
                armed = True
            elif armed and (not taken or t - taken[-1] > gap):
                taken.append(t)
                armed = False
        out.append(taken)
    return pd.Series(out)


def live_breath_onsets(samples: DataFrame, dead: float = 0.12, min_sep_s: float = 2.0, by: tuple[str, ...] = REC) -> DataFrame:
    """t_s of upward crossings of the centred signal with hysteresis: armed below -dead of the 5-95 % range, fired above +dead, at least min_sep_s apart.

    Windows of fewer than four samples give none. One array of the samples outside the dead zone for each key.
    """
    every = Window.partitionBy(*by)
    ranked = samples.select(*by, "t_s", "value").withColumns({"_n": F.count("value").over(every), "_r": F.row_number().over(every.orderBy("value")), "_m": F.avg("value").over(every)})
    at = lambda p: F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * F.lit(p)) + 1, F.col("value"))).over(every)
    x = ranked.withColumn("_range", at(0.95) - at(0.05)).where("_n >= 4")
    zone, v = F.when(F.col("_range") > 0, F.col("_range")).otherwise(F.lit(1e-6)) * dead, F.col("value") - F.col("_m")
    x = x.where(F.abs(v) > zone).select(*by, F.struct("t_s", (v > 0).alias("above")).alias("e"))
    g = x.groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("e")).select(*by, F.struct(F.col("e.t_s").alias("t"), F.col("e.above").alias("above")).alias("r"))
    fired = F.pandas_udf(lambda r: _fires(r, min_sep_s), "array<double>")("r")
    return g.select(*by, F.explode(fired).alias("t_s"))
