"""Spectra and filters of uniform recordings: NumPy on chunks of a recording, or on arrays of many segments at once."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, run_ids
from ..functions.medians import window_medians
from ..functions.zoom import waves, zoom
from .timebase import fill_gaps

#: Fixed values of decimation: the largest stage, the largest that is made at all, samples needed for each output sample.
STAGE, LARGEST, SAMPLES_EACH = 13, 40, 30
#: The anti-alias filter: Chebyshev of this order and ripple (dB), cut at this share of the new half rate, run forward and back.
CHEBYSHEV_ORDER, RIPPLE_DB, CUTOFF = 8, 0.05, 0.8


def hann(n: int) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))


def segment_arrays(samples: DataFrame, columns: list[str], segment: Column | int, overlap: float = 0.5, by: tuple[str, ...] = REC) -> DataFrame:
    """the key, seg (length) and an array of each column for all whole segments of a recording.

    segment may use the recording's number of samples, n; it is cut to n and
    made even. A sample is copied to each segment that covers it, so a long
    recording is spread over tasks.
    """
    n = samples.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    seg = F.least(F.col("n"), segment if isinstance(segment, Column) else F.lit(segment)).cast("int")
    x = n.withColumn("seg", seg - seg % 2).where("seg >= 2")
    step, p = F.greatest(F.lit(1), F.round(F.col("seg") * (1 - overlap))), F.col("idx") - 1
    first = F.greatest(F.lit(0), F.ceil((p - F.col("seg") + 1) / step)).cast("bigint")
    last = F.least(F.floor(p / step), F.floor((F.col("n") - F.col("seg")) / step)).cast("bigint")
    x = x.withColumns({"_a": first, "_z": last}).where("_a <= _z").withColumn("_segment", F.explode(F.sequence("_a", "_z")))
    rows = F.array_sort(F.collect_list(F.struct("idx", *[F.col(c).cast("double").alias(c) for c in columns])))
    g = x.groupBy(*by, "_segment", "seg").agg(rows.alias("rows"))
    return g.select(*by, "seg", *[F.col(f"rows.{c}").alias(c) for c in columns])


def _by_length(arrays: pd.Series, fn: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """fn over stacked arrays of equal length, in the order of the rows."""
    out = pd.Series([None] * len(arrays), index=arrays.index, dtype=object)
    for _, some in arrays.groupby(arrays.map(len)):
        for i, row in zip(some.index, fn(np.stack(some.to_list())), strict=True):
            out[i] = row
    return out


def welch_psd(samples: DataFrame, fs: float, segment: Column | int, overlap: float = 0.5, by: tuple[str, ...] = REC) -> DataFrame:
    """One-sided density per recording and bin: demeaned Hann segments (n - 1 denominator), averaged; gaps are bridged first."""

    def density(x: pd.Series) -> pd.Series:
        def of(v: np.ndarray) -> np.ndarray:
            n = v.shape[1]
            w = hann(n)
            power = np.abs(np.fft.rfft((v - v.mean(axis=1, keepdims=True)) * w)) ** 2
            return power[:, : n // 2] * (2.0 / (n * fs * float((w**2).mean())))

        return _by_length(x, of)

    each = segment_arrays(fill_gaps(samples.select(*by, "idx", "value"), by), ["value"], segment, overlap, by)
    each = each.select(*by, "seg", F.posexplode(F.pandas_udf(density, "array<double>")("value")).alias("bin", "power"))
    return each.groupBy(*by, "seg", "bin").agg(F.avg("power").alias("power")).select(*by, "bin", (F.col("bin") * fs / F.col("seg")).alias("freq"), "power")


def band_metrics(psd: DataFrame, band: tuple[float, float], wide: tuple[float, float], rate: tuple[float, float], by: tuple[str, ...] = REC) -> DataFrame:
    """Share of power in a band of a wider one, and the frequency of most power within bounds (the lower of ties)."""
    power = lambda b: F.sum(F.when(F.col("freq").between(*b), F.col("power")))
    inside = F.when(F.col("freq").between(*rate), F.struct(F.round("power", 12), -F.col("freq")))
    return psd.groupBy(*by).agg(F.try_divide(power(band), power(wide)).alias("band_ratio"), F.max_by("freq", inside).alias("dominant_hz"))


def flag_alias_prone(psd: DataFrame, new_fs: float = 25.0, within: float = 1.0, multiples: int = 40, band: tuple[float, float] = (0.05, 1.0), limit_db: float = -57.0) -> DataFrame:
    """Power that decimation to new_fs without a filter would fold into the band (within 1 Hz of its multiples), in dB of the band's power."""
    k = F.round(F.col("freq") / new_fs)
    folds = k.between(1, multiples) & (F.abs(F.col("freq") - k * new_fs) <= within)
    g = psd.groupBy(*REC).agg(F.sum(F.when(folds, F.col("power"))).alias("near"), F.sum(F.when(F.col("freq").between(*band), F.col("power"))).alias("in_band"))
    db = 10 * F.log10(F.try_divide(F.coalesce("near", F.lit(0.0)), F.col("in_band")))
    return g.select(*REC, db.alias("alias_db"), F.coalesce(db > limit_db, F.lit(False)).alias("alias_prone"))


def whole_arrays(samples: DataFrame, columns: list[str], by: tuple[str, ...] = REC) -> DataFrame:
    """Each key's columns as arrays in the order of idx; for keys of bounded length, such as recordings of hours or trials."""
    rows = F.array_sort(F.collect_list(F.struct("idx", *columns)))
    return samples.groupBy(*by).agg(rows.alias("rows")).select(*by, F.col("rows.idx").alias("idx"), *[F.col(f"rows.{c}").alias(c) for c in columns])


def _chunk_arrays(x: DataFrame, chunk: int, by: tuple[str, ...] = REC) -> DataFrame:
    """The key, n, first (place of the first sample, from 0) and value (array) of each chunk of a recording without gaps (rows carry n)."""
    at = F.floor((F.col("idx") - 1) / chunk).alias("chunk")
    g = x.groupBy(*by, "n", at).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("rows"))
    return g.select(*by, "n", "chunk", (F.col("rows")[0]["idx"] - 1).alias("first"), F.col("rows.value").alias("value"))


def _centred(samples: DataFrame) -> DataFrame:
    """Bridged samples less their recording's mean, with n and places counted from 1."""
    every = Window.partitionBy(*REC)
    x = fill_gaps(samples.select(*REC, "idx", "value")).where("value is not null")
    x = x.withColumns({"n": F.count(F.lit(1)).over(every), "_mean": F.avg("value").over(every), "_low": F.min("idx").over(every)})
    return x.select(*REC, (F.col("idx") - F.col("_low") + 1).alias("idx"), (F.col("idx")).alias("at"), "n", (F.col("value") - F.col("_mean")).alias("value"), "_mean")


def bin_bounds(n: np.ndarray | int, fs: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """The first bin at or above low, and one past the last at or below high, of recordings of n samples, as floats compare."""
    n = np.atleast_1d(np.asarray(n, np.int64))
    first, stop = np.ceil(low * n / fs).astype(np.int64), np.floor(high * n / fs).astype(np.int64) + 1
    first = np.where((first - 1) * fs / n >= low, first - 1, np.where(first * fs / n < low, first + 1, first))
    stop = np.where((stop - 1) * fs / n > high, stop - 1, np.where(stop * fs / n <= high, stop + 1, stop))
    return np.maximum(first, 0), np.maximum(np.minimum(stop, n), np.maximum(first, 0))


def band_transform(chunks: DataFrame, fs: float, low: float, high: float) -> DataFrame:
    """recording_id, n, bin, re, im: the whole recording's transform at bins of low to high, summed from what each chunk of _chunk_arrays adds."""

    def part(x: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, first, v in zip(x["n"], x["first"], x["value"], strict=True):
            k, stop = (int(b[0]) for b in bin_bounds(n, fs, low, high))
            z = zoom(np.asarray(v, float), int(n), int(first), k, stop - k) if stop > k else np.zeros(0, complex)
            out.append((k, z.real, z.imag))
        return pd.DataFrame(out, columns=["k", "re", "im"])

    each = chunks.select(*REC, "n", F.pandas_udf(part, "k bigint, re array<double>, im array<double>")(F.struct("n", "first", "value")).alias("s"))
    each = each.select(*REC, "n", "s.k", F.posexplode(F.arrays_zip(F.col("s.re").alias("re"), F.col("s.im").alias("im"))).alias("m", "v"))
    return each.groupBy(*REC, "n", (F.col("k") + F.col("m")).alias("bin")).agg(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"))


def dominant_rate(samples: DataFrame, fs: float, low: float = 0.1, high: float = 0.5, chunk_s: float = 300.0) -> DataFrame:
    """Breaths a minute at the largest value of the raw periodogram of the whole recording (the lower of ties).

    Each chunk's share of the transform is taken at the band's bins alone and
    summed over the chunks; recordings too short for a bin in the band have NaN.
    """
    x = _centred(samples)
    power = band_transform(_chunk_arrays(x, max(1, round(chunk_s * fs))), fs, low, high).withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    best = power.groupBy(*REC).agg(F.max_by(F.col("bin") * fs / F.col("n") * 60, F.struct(F.round("power", 9), -F.col("bin"))).alias("rate_bpm"))
    return x.select(*REC).distinct().join(best, list(REC), "left").select(*REC, F.coalesce("rate_bpm", F.lit(float("nan"))).alias("rate_bpm"))


@functools.lru_cache(4)
def _above(n: int, fs: float, corner: float) -> np.ndarray:
    """The smooth step over the bins of n samples."""
    return _step(np.fft.rfftfreq(n, 1 / fs), corner)


def _step(freq: np.ndarray, corner: float) -> np.ndarray:
    """0 below the corner, then a smooth rise (from 1e-12) to 1 above five times it."""
    return np.array([0.5 * math.erfc(-(f / corner - 3) * 2.5) if f >= corner else 0.0 for f in freq.tolist()])


def _twice(freq: np.ndarray) -> np.ndarray:
    return -1.0 / np.maximum(2 * np.pi * freq, 1e-12) ** 2


def double_integrate(samples: DataFrame, fs: float, corner: float = 0.05, chunk_s: float = 300.0) -> DataFrame:
    """Displacement from acceleration: each frequency of the whole (circular) recording at or above the corner divided by -(2 pi f)^2, the others dropped.

    The response is cut in two: a smooth one, whose memory is a few periods of
    the corner, runs over chunks with a halo of eight periods; what is left
    lies between the corner and five times it, and is summed from the chunks'
    shares of the few bins there. The recording's ends meet, as in a transform
    of the whole, whose result this equals to some 1e-8 of the signal's size. A
    corner that is not positive is an error; recordings
    without any value have no rows.
    """
    if corner <= 0:
        raise ValueError("the corner is not positive")
    halo = math.ceil(8 / corner * fs)
    chunk = max(round(chunk_s * fs), 2 * halo)
    x = _centred(samples)

    # The few bins between the corner and five times it, a row for each recording.
    bins = band_transform(_chunk_arrays(x, chunk), fs, corner, min(5 * corner, fs / 2)).groupBy(*REC).agg(F.array_sort(F.collect_list(F.struct("bin", "re", "im"))).alias("bins"))

    # Chunks with their halo, over the recording's ends; a recording of hardly more than one chunk is one.
    chunks, p = F.greatest(F.lit(1), F.floor((F.col("n") - 2 * halo) / chunk)), F.col("idx") - 1
    own = F.least(F.floor(p / chunk), chunks - 1)
    first, stop = lambda c: c * chunk, lambda c: F.when(c == chunks - 1, F.col("n")).otherwise((c + 1) * chunk)
    around = F.filter(
        F.array_distinct(F.transform(F.array(own - 1, own, own + 1), lambda c: F.pmod(c, chunks))),
        lambda c: (c == own) | (F.pmod(first(c) - p, F.col("n")) <= halo) | (F.pmod(p - stop(c), F.col("n")) < halo),
    )
    near = x.withColumns({"chunk": F.explode(around), "_own": own, "_p": p, "_k": chunks})
    offset = F.when(F.col("_k") == 1, F.col("_p")).otherwise(F.pmod(F.col("_p") - F.col("chunk") * chunk + halo, F.col("n")))
    rows = F.array_sort(F.collect_list(F.struct(offset.alias("o"), (F.col("chunk") == F.col("_own")).alias("own"), "at", "value")))
    pieces = near.groupBy(*REC, "n", "chunk").agg(F.max("_k").alias("k"), rows.alias("rows")).join(bins, list(REC), "left")

    def integrate(t: pd.DataFrame) -> pd.Series:
        out = []
        for n, at, k, v, bin_, re, im in zip(*(t[c] for c in ("n", "chunk", "k", "v", "bin", "re", "im")), strict=True):
            n, v = int(n), np.asarray(v, float)
            y = np.fft.irfft(np.fft.rfft(v) * _twice(np.fft.rfftfreq(len(v), 1 / fs)) * _above(len(v), fs, corner), len(v)) if len(v) > 1 else np.zeros(len(v))
            if bin_ is not None and len(bin_):
                f = np.asarray(bin_, np.int64) * fs / n
                begin = 0 if k == 1 else int(at) * chunk - halo
                y = y + waves((np.asarray(re, float) + 1j * np.asarray(im, float)) * _twice(f) * (1 - _step(f, corner)), n, int(bin_[0]), begin % n, len(v))
            out.append(y)
        return pd.Series(out, dtype=object)

    packed = F.struct("n", "chunk", "k", F.col("rows.value").alias("v"), F.col("bins.bin").alias("bin"), F.col("bins.re").alias("re"), F.col("bins.im").alias("im"))
    done = pieces.select(*REC, F.explode(F.arrays_zip(F.col("rows.own").alias("own"), F.col("rows.at").alias("at"), F.pandas_udf(integrate, "array<double>")(packed).alias("value"))).alias("r"))
    return done.where("r.own").select(*REC, F.col("r.at").alias("idx"), F.col("r.value").alias("value"))


def with_halo(samples: DataFrame, chunk: int, halo: int, last: Column | None = None) -> DataFrame:
    """Rows of each chunk of `chunk` samples and of `halo` samples on both sides; own marks a chunk's samples. Chunks behind `last` are part of it."""
    p = F.col("idx") - 1
    of = lambda x: F.floor(x / chunk) if last is None else F.least(F.floor(x / chunk), last)
    at = of(p)
    near = F.sequence(F.greatest(F.lit(0), of(p - halo)).cast("bigint"), of(p + halo).cast("bigint"))
    return samples.withColumn("chunk", F.explode(near)).withColumn("own", F.col("chunk") == at)


def gain(freq: np.ndarray, fs: float, low: float | None, high: float | None, order: int = 2) -> np.ndarray:
    """Response of a Butterworth filter run forward and back: 1 / (1 + X^(2 order))."""
    o = np.tan(np.pi * np.minimum(freq, 0.499999 * fs) / fs)
    if low and high:
        a, b = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)
        with np.errstate(divide="ignore"):
            x = (o**2 - a * b) / (o * (b - a))
    elif high:
        x = o / np.tan(np.pi * high / fs)
    else:
        with np.errstate(divide="ignore"):
            x = np.tan(np.pi * low / fs) / o
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.abs(x) ** (2 * order))


def anti_alias_gain(freq: np.ndarray, fs: float, q: int) -> np.ndarray:
    """Response of the Chebyshev low-pass run forward and back: 1 / (1 + ripple * T(x)^2)."""
    x = np.tan(np.pi * np.minimum(freq, 0.499999 * fs) / fs) / np.tan(np.pi * CUTOFF / (2 * q))
    t = np.where(x <= 1, np.cos(CHEBYSHEV_ORDER * np.arccos(np.minimum(x, 1))), np.cosh(CHEBYSHEV_ORDER * np.arccosh(np.maximum(x, 1))))
    return 1.0 / (1.0 + (10 ** (RIPPLE_DB / 10) - 1) * t**2)


def filtered(x: np.ndarray, fs: float, response: Callable[[np.ndarray], np.ndarray], pad: int) -> np.ndarray:
    """One piece filtered without phase, with odd reflection at both ends; missing samples are bridged and put back."""
    gone = ~np.isfinite(x)
    if gone.all() or len(x) < 2:
        return x
    k = np.arange(len(x))
    y = np.interp(k, k[~gone], x[~gone])
    m = min(pad, len(y) - 1)
    y = np.concatenate([2 * y[0] - y[m:0:-1], y, 2 * y[-1] - y[-2 : -m - 2 : -1]])
    freq = np.fft.rfftfreq(len(y), 1 / fs)
    y = np.fft.irfft(np.fft.rfft(y) * response(freq), len(y))[m : m + len(x)]
    y[gone] = np.nan
    return y


def _by_chunks(samples: DataFrame, fs: float, response: Callable[[np.ndarray], np.ndarray], chunk: int, halo: int, pad: int, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Each chunk with its halo is an array of a row, so that a Python call filters many chunks."""
    x = with_halo(samples.select(*REC, "idx", *columns), chunk, halo)
    rows = F.array_sort(F.collect_list(F.struct("idx", "own", *[F.col(c).cast("double").alias(c) for c in columns])))
    arrays = x.groupBy(*REC, "chunk").agg(rows.alias("rows"))

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda a: filtered(np.array(a, float), fs, response, pad))

    zipped = F.arrays_zip(F.col("rows.idx").alias("idx"), F.col("rows.own").alias("own"), *[run(F.col(f"rows.{c}")).alias(c) for c in columns])
    out = arrays.select(*REC, F.explode(zipped).alias("r")).where("r.own").select(*REC, F.col("r.idx").alias("idx"), *[F.col(f"r.{c}").alias(c) for c in columns])
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def zero_phase_filter(samples: DataFrame, fs: float, low: float | None, high: float | None, chunk_s: float = 300.0, pad_s: float = 60.0, order: int = 2, end_pad_s: float | None = None, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Butterworth pass without phase, by chunks with a halo of pad_s, so a long recording is spread over tasks.

    A high edge at or above half the rate is left out; an empty band is an
    error. end_pad_s is the length of the odd reflection, pad_s where not given.
    """
    high = None if high is not None and high >= fs / 2 else high
    if (low or 0) <= 0 and not high or (low and high and low >= high):
        raise ValueError("the band is empty")
    halo = round(pad_s * fs)
    pad = halo if end_pad_s is None else round(end_pad_s * fs)
    return _by_chunks(samples, fs, lambda f: gain(f, fs, low, high, order), round(chunk_s * fs), halo, pad, columns)


def calib_bandpass(samples: DataFrame, fs: float = 25.0, low: float = 0.05, high: float = 1.0, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """The calibration band: order 4, forward and back. The reflection is 60 s, as a shorter one leaves the start-up of so low an edge in the signal."""
    if high >= fs / 2:
        raise ValueError("the band's upper edge is at or above half the rate")
    return zero_phase_filter(samples, fs, low, high, 600.0, 120.0, 4, 60.0, columns)


def calib_lowpass(samples: DataFrame, fs: float = 25.0, high: float = 0.6) -> DataFrame:
    return zero_phase_filter(samples, fs, None, high, 600.0, 60.0, 4, 15.0)


def detrend_highpass(samples: DataFrame, fs: float, cutoff: float = 0.05) -> DataFrame:
    return zero_phase_filter(samples, fs, cutoff, None)


def _primes(q: int) -> list[int]:
    """Prime factors, largest first."""
    out, p = [], 2
    while q > 1:
        while q % p == 0:
            out.append(p)
            q //= p
        p += 1
    return out[::-1]


def smooth_factor_near(q: float, most: int = STAGE, search: float = 0.2) -> int | None:
    """The factor nearest q, within a fifth of it, whose primes are all small; the smaller of ties."""
    near = [k for k in range(max(2, int(q * (1 - search))), int(np.ceil(q * (1 + search))) + 1) if max(_primes(k)) <= most]
    return min(near, key=lambda k: (abs(k - q), k), default=None)


def decimation_plan(q: int, most: int = STAGE, largest: int = LARGEST) -> list[int]:
    """Stages whose product is q: primes, largest first, packed into steps of at most `most`.

    A prime above `most` is a stage of its own; one above `largest` is refused,
    with a nearby factor in the message.
    """
    if q < 1:
        raise ValueError("a decimation factor is a positive integer")
    primes = _primes(q)
    if primes and primes[0] > largest:
        raise ValueError(f"{q} has the prime factor {primes[0]}, too large for one stage; {smooth_factor_near(q, most)} is the nearest factor without")
    stages: list[int] = []
    for f in primes:
        for i, s in enumerate(stages):
            if s * f <= most:
                stages[i] *= f
                break
        else:
            stages.append(f)
    return sorted(stages, reverse=True)


def decimation_plans(factors: DataFrame) -> DataFrame:
    """q, stages, nearby of each distinct factor; stages are null where the factor is refused, nearby then is the factor to take."""

    def plans(q: pd.Series) -> pd.DataFrame:
        refused = [max(_primes(f), default=1) > LARGEST for f in q]
        stages = [None if no else decimation_plan(f) for f, no in zip(q, refused, strict=True)]
        return pd.DataFrame({"stages": stages, "nearby": pd.array([smooth_factor_near(f) if no else None for f, no in zip(q, refused, strict=True)], "Int32")})

    q = factors.select(F.col("q").cast("int").alias("q")).where("q >= 1").distinct()
    return q.withColumn("p", F.pandas_udf(plans, "stages array<int>, nearby int")("q")).select("q", "p.stages", "p.nearby")


def decimation_factor(fs: Column, target: Column, strict: bool = True) -> Column:
    """fs / target, which must be whole within 1e-9: else an error, or null where not strict."""
    q = fs / target
    no = F.raise_error(F.concat(F.lit("not a whole factor: "), q.cast("string"))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(F.abs(q - F.round(q)) <= 1e-9, F.round(q).cast("int")).otherwise(no)


def decimate(samples: DataFrame, fs: float, q: int, chunk_s: float = 300.0) -> DataFrame:
    """Every q-th sample, in exact stages, each behind its own anti-alias low-pass; idx counts anew.

    Recordings need 30 samples for each output sample of the whole factor, and
    only finite ones: others are an error.
    """
    stages = decimation_plan(q)
    if not stages:
        return samples.select(*REC, "idx", "value")
    n = F.count(F.lit(1)).over(Window.partitionBy(*REC))
    short = F.when(n < SAMPLES_EACH * q, F.raise_error(F.lit(f"too few samples to decimate by {q}")).cast("double"))
    odd = F.when(F.coalesce(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(True)), F.raise_error(F.lit("decimation needs finite samples")).cast("double"))
    x, rate = samples.select(*REC, "idx", F.coalesce(short, odd, F.col("value")).alias("value")), fs
    for s in stages:
        x = _by_chunks(x, rate, lambda f, rate=rate, s=s: anti_alias_gain(f, rate, s), round(chunk_s * fs), 100 * s, 100 * s)
        x = x.where((F.col("idx") - 1) % s == 0).withColumn("idx", ((F.col("idx") - 1) / s + 1).cast("bigint"))
        rate /= s
    return x


def downsample(samples: DataFrame, fs: float, target: float) -> tuple[DataFrame, float]:
    """Decimated by the whole factor nearest fs / target, and the rate that gives. Another factor is taken only where a prime is refused."""
    if target <= 0:
        raise ValueError("the target rate is not positive")
    if target >= fs:
        return samples.select(*REC, "idx", "value"), fs
    q = max(1, round(fs / target))
    if max(_primes(q), default=1) > LARGEST:
        q = smooth_factor_near(fs / target) or q
    return decimate(samples, fs, q), fs / q


def running_median(x: np.ndarray, k: int) -> np.ndarray:
    """Medians of all whole windows of k (odd)."""
    start = np.arange(max(0, len(x) - k + 1))
    return window_medians(x, start, start + k) if len(start) else np.zeros(0)


def _odd_window(seconds: float, fs: float) -> int:
    k = max(3, round(seconds * fs))
    return k + 1 - k % 2


def despike(samples: DataFrame, fs: float, threshold: float = 3.0, max_width_s: float = 1.0, window_s: float = 0.3, chunk: int = 7500) -> DataFrame:
    """Samples far from the running median are bridged; spiked marks them. Missing samples stay missing.

    The median runs over bridged gaps, with a line through the inner samples
    beyond either end. The scale is 1.4826 MAD of differences over half a
    window, of the whole recording. Without one, all deviating samples count if
    they are less than 1 %, else the median of the non-zero differences is the
    scale. Runs wider than max_width_s, recordings below five samples, and
    recordings that would be flagged whole are left alone.
    """
    k = _odd_window(window_s, fs)
    halo = (k - 1) // 2 + 3

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx").reset_index(drop=True)
        idx, v, n = rows["idx"].to_numpy(), rows["value"].to_numpy(float), int(rows["n"].iloc[0])
        width = min(k, n - 1 + n % 2)
        h = (width - 1) // 2
        med, d = v.copy(), np.full(len(v), np.nan)
        if n >= 5 and np.isfinite(v).all():
            if h:
                d[h:] = v[h:] - v[:-h]
            wide, skipped = v, 0
            if n >= h + 3:
                if idx[0] == 1:
                    slope = np.median(np.diff(v[1 : h + 2]))
                    wide, skipped = np.concatenate([v[1] + slope * (np.arange(1 - h, 1) - 2), wide]), h
                if idx[-1] == n:
                    slope = np.median(np.diff(v[-h - 2 : -1]))
                    wide = np.concatenate([wide, v[-2] + slope * (np.arange(1, h + 1) + 1)])
            found = running_median(wide, width)
            med[h - skipped : h - skipped + len(found)] = found
        rows["med"], rows["d"] = med, d
        return rows.loc[rows["own"], ["recording_id", "idx", "value", "filled", "n", "med", "d"]]

    every = Window.partitionBy(*REC)
    x = fill_gaps(samples.select(*REC, "idx", "value")).withColumn("n", F.count(F.lit(1)).over(every))
    x = with_halo(x, chunk, halo).groupBy(*REC, "chunk").applyInPandas(run, "recording_id bigint, idx bigint, value double, filled boolean, n bigint, med double, d double")
    x = x.withColumn("d", F.when(~F.isnan("d"), F.col("d"))).withColumn("away", F.when(~F.col("filled"), F.abs(F.col("value") - F.col("med"))))
    x = x.withColumn("_m", F.median("d").over(every))
    x = x.withColumns(
        {
            "_scale": 1.4826 * F.median(F.abs(F.col("d") - F.col("_m"))).over(every),
            "_off": F.count(F.when(F.col("away") > 0, 1)).over(every),
            "_step": F.median(F.when(F.col("d") != 0, F.abs("d"))).over(every),
        }
    )
    few = (F.col("_off") > 0) & (F.col("_off") < 0.01 * F.col("n"))
    limit = F.when(F.col("_scale") > 0, threshold * F.col("_scale")).when(few, F.lit(0.0)).otherwise(threshold * F.col("_step"))
    x = x.withColumn("spiked", F.coalesce((F.col("n") >= 5) & (F.col("away") > limit), F.lit(False)))
    x = run_ids(x, "spiked").withColumn("_w", F.count(F.lit(1)).over(Window.partitionBy(*REC, "run")))
    x = x.withColumn("spiked", F.col("spiked") & (F.col("_w") <= max(1, round(max_width_s * fs))))
    x = x.withColumn("spiked", F.col("spiked") & (F.count(F.when(F.col("spiked"), 1)).over(every) < F.col("n")))
    x = x.withColumns({"_gone": F.col("filled"), "value": F.when(~F.col("spiked") & ~F.col("filled"), F.col("value"))})
    bridged = fill_gaps(x.select(*REC, "idx", "value", "spiked", "_gone"))
    return bridged.select(*REC, "idx", F.when(~F.col("_gone"), F.col("value")).alias("value"), "spiked")


def detrend_median(samples: DataFrame, fs: float, window_s: float = 60.0, chunk_s: float = 300.0) -> DataFrame:
    """The signal less its running median over bridged gaps. Windows shrink towards the ends; the very end is the median of itself,
    its neighbour's median and the line through the next two. A window as long as the recording is an error; missing samples stay missing.

    Chunks last chunk_s or twice the window, whichever is more, so no sample is copied to more than one other chunk.
    """
    k = _odd_window(window_s, fs)
    h = (k - 1) // 2
    chunk = max(round(chunk_s * fs), 2 * k)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx").reset_index(drop=True)
        idx, v, n = rows["idx"].to_numpy(), rows["value"].to_numpy(float), int(rows["n"].iloc[0])
        if k >= n:
            raise ValueError(f"a median window of {k} samples is not shorter than the recording of {n}")
        own = np.flatnonzero(rows["own"])
        reach = np.minimum(h, np.minimum(idx[own] - 1, n - idx[own]))
        base = window_medians(v, own - reach, own + reach + 1)
        for first, step in ((0, 1), (len(own) - 1, -1)):
            if reach[first] == 0:
                base[first] = np.median([v[own[first]], base[first + step], 3 * base[first + step] - 2 * base[first + 2 * step]])
        rows = rows.iloc[own]
        return pd.DataFrame({"recording_id": rows["recording_id"], "idx": rows["idx"], "value": np.where(rows["filled"], np.nan, v[own] - base)})

    x = fill_gaps(samples.select(*REC, "idx", "value")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*REC)))
    # The last chunk is part of the one before where it would be shorter than the window.
    last = F.greatest(F.lit(0), F.floor((F.col("n") - k) / chunk))
    x = with_halo(x, chunk, k, last).groupBy(*REC, "chunk").applyInPandas(run, "recording_id bigint, idx bigint, value double")
    return x.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
