"""Operators that cut long recordings into chunks, against plain computations on whole recordings."""

import math

import numpy as np
import pytest

from pneuma.functions.medians import window_medians
from pneuma.functions.zoom import waves, zoom
from pneuma.operators import calibration, devices, spectrum


def signals(spark, rows, names=("value",)):
    data = [(r, i + 1, *[None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) for v in vs]) for r, cols in rows.items() for i, vs in enumerate(zip(*cols, strict=True))]
    return spark.createDataFrame(data, "recording_id bigint, idx bigint, " + ", ".join(f"{n} double" for n in names))


def series(df, key, column="value"):
    return np.array([np.nan if r[column] is None else r[column] for r in df.where(f"recording_id = {key}").orderBy("idx").collect()])


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 777])
def test_window_medians(n):
    rng = np.random.default_rng(n)
    for x in (rng.random(n), rng.integers(0, 4, n).astype(float), np.zeros(n)):
        start = rng.integers(0, n, 200)
        stop = np.minimum(n, start + 1 + 2 * rng.integers(0, n // 2 + 1, 200))
        keep = (stop - start) % 2 == 1
        assert (window_medians(x, start[keep], stop[keep]) == [np.median(x[a:b]) for a, b in zip(start[keep], stop[keep], strict=True)]).all()


def test_zoom_pieces_add_up_to_the_transform():
    rng = np.random.default_rng(1)
    for n in (1, 2, 37, 1000):
        x = rng.standard_normal(n)
        whole = np.fft.fft(x)
        cuts = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
        lo = int(rng.integers(0, n))
        parts = sum(zoom(x[a:b], n, a, lo, n - lo) for a, b in zip(cuts, cuts[1:], strict=False))
        assert np.allclose(parts, whole[lo:], atol=1e-9)
        half = whole[: n // 2 + 1]
        for first in (0, 5 % n):
            assert np.allclose(waves(half, n, 0, first, n - first), x[first:], atol=1e-9)
            if n > 2:
                assert np.allclose(waves(half[1:], n, 1, first, n - first), x[first:] - x.mean(), atol=1e-9)


@pytest.mark.parametrize("fs, window, n", [(10.0, 4.1, 3001), (10.0, 60.0, 2000), (2.0, 3.0, 40)])
def test_detrend_median_equals_medians_of_shrinking_windows(spark, fs, window, n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.standard_normal(n)).round(2)
    gone = rng.random(n) < 0.05
    gone[[0, -1]] = False
    k = max(3, round(window * fs))
    h = (k + 1 - k % 2 - 1) // 2
    at = np.arange(n)
    full = np.interp(at, at[~gone], x[~gone])
    base = np.array([np.median(full[i - min(h, i, n - 1 - i) : i + min(h, i, n - 1 - i) + 1]) for i in range(n)])
    base[0], base[-1] = np.median([full[0], base[1], 3 * base[1] - 2 * base[2]]), np.median([full[-1], base[-2], 3 * base[-2] - 2 * base[-3]])
    df = signals(spark, {1: [np.where(gone, np.nan, x)], 2: [x]})
    found = spectrum.detrend_median(df, fs, window, chunk_s=20.0)
    assert np.allclose(series(found, 1), np.where(gone, np.nan, full - base), atol=1e-9, equal_nan=True)
    assert len(series(found, 2)) == n
    halo = spectrum.with_halo(df, max(round(20 * fs), 2 * (2 * h + 1)), 2 * h + 1)
    assert halo.count() <= 2 * df.count()


def test_detrend_median_refuses_a_window_as_long_as_the_recording(spark):
    with pytest.raises(Exception, match="not shorter than the recording"):
        spectrum.detrend_median(signals(spark, {1: [np.arange(20.0)]}), 1.0, 20.0).collect()


def plain_lag(a, b, most, least):
    best = None
    for d in range(max(-most, 1 - len(a)), min(most, len(a) - 1) + 1):
        u, v = (a[: len(a) - d], b[d:]) if d >= 0 else (a[-d:], b[: len(b) + d])
        ok = np.isfinite(u) & np.isfinite(v)
        if ok.sum() >= least and np.ptp(u[ok]) > 0 and np.ptp(v[ok]) > 0:
            r = np.corrcoef(u[ok], v[ok])[0, 1]
            if best is None or round(r, 9) > round(best[1], 9):
                best = (d, r)
    return best


def test_lag_search_over_chunks_equals_the_plain_search(spark):
    rng = np.random.default_rng(4)
    rows, want = {}, {}
    for key, (n, shift) in enumerate([(500, 13), (731, -7), (90, 30), (25, 2), (400, 0)]):
        a = np.cumsum(rng.standard_normal(n)) + 1000
        b = np.roll(a, shift) * -3 + rng.standard_normal(n) if key == 1 else np.roll(a, shift) + 0.1 * rng.standard_normal(n) - 4e4
        a[rng.random(n) < 0.1], b[rng.random(n) < 0.1] = np.nan, np.nan
        if key == 4:
            b[:] = 5.0
        rows[key], want[key] = [a, b], plain_lag(a, b, 40, 20)
    df = signals(spark, rows, ("a", "b"))
    # Rows that are missing altogether count as missing samples.
    df = df.where("not (recording_id = 0 and idx between 100 and 130)")
    rows[0][0][99:130] = rows[0][1][99:130] = np.nan
    want[0] = plain_lag(*rows[0], 40, 20)
    for chunk in (1, 7500):  # at least four times the largest shift
        found = {r.recording_id: (r["shift"], r.r) for r in calibration.lag_search(df, 40, chunk=chunk).collect()}
        assert set(found) == {k for k, w in want.items() if w}
        for k, (d, r) in found.items():
            assert d == want[k][0] and abs(r - want[k][1]) < 1e-9


def test_lag_search_ties_go_to_the_smallest_shift(spark):
    a = np.tile([0.0, 1, 0, -1], 60)
    found = calibration.lag_search(signals(spark, {1: [a, a]}, ("a", "b")), 9).collect()
    assert [(r["shift"], round(r.r, 9)) for r in found] == [(-8, 1.0)]
    assert calibration.lag_search(signals(spark, {1: [a[:10], a[:10]]}, ("a", "b")), 3).count() == 0


@pytest.mark.parametrize("n", [64, 65, 5000, 7303])
def test_double_integrate_equals_the_whole_transform(spark, n):
    rng, fs, corner = np.random.default_rng(n), 5.0, 0.05
    x = rng.standard_normal(n) + np.sin(np.arange(n) / 9)
    f = np.fft.rfftfreq(n, 1 / fs)
    want = np.fft.irfft(np.fft.rfft(x) * np.where(f >= corner, -1 / np.maximum(2 * np.pi * f, 1e-9) ** 2, 0), n)
    df = signals(spark, {1: [x], 2: [np.ones(n)]})
    found = spectrum.double_integrate(df, fs, corner, chunk_s=1.0)
    assert np.allclose(series(found, 1), want, atol=1e-7) and np.allclose(series(found, 2), 0, atol=1e-9)
    if n == 5000:
        assert spectrum.double_integrate(df.where("idx > 10"), fs, corner).where("idx = 11").count() == 2
        with pytest.raises(ValueError):
            spectrum.double_integrate(df, fs, 0.0)


@pytest.mark.parametrize("n", [64, 3001])
def test_dominant_rate_equals_the_whole_periodogram(spark, n):
    rng, fs = np.random.default_rng(n), 2.0
    rows = {k: [np.sin(2 * np.pi * (0.12 + 0.03 * k) * np.arange(n) / fs) + rng.standard_normal(n) + 50] for k in range(6)} | {9: [np.arange(3.0)]}
    found = {r.recording_id: r.rate_bpm for r in spectrum.dominant_rate(signals(spark, rows), fs, chunk_s=40.0).collect()}
    assert math.isnan(found.pop(9)) and len(found) == 6
    for k, rate in found.items():
        x, f = rows[k][0], np.fft.fftfreq(n, 1 / fs)
        inside = np.flatnonzero((f >= 0.1) & (f <= 0.5))
        assert abs(rate - 60 * f[inside[(np.abs(np.fft.fft(x - x.mean())) ** 2)[inside].argmax()]]) < 1e-9


def test_coherence_null_does_not_depend_on_blocks(spark):
    rng, segment, surrogates = np.random.default_rng(2), 32, 23
    rows = {k: [rng.standard_normal(n), rng.standard_normal(n)] for k, n in ((1, 200), (2, 331), (7, 20))}
    df = signals(spark, rows, ("a", "b"))
    want = {}
    window = spectrum.hann(segment)
    for key, (a, b) in rows.items():
        found, n = [], len(a)
        for s in range(surrogates if n >= segment else 0):
            turns = devices.random_turns(key, np.array([s]), n // 2 + 1)[0]
            fake = np.fft.irfft(np.abs(np.fft.rfft(b - b.mean())) * np.exp(2j * np.pi * turns), n)
            ab, aa, bb = 0, 0, 0
            for at in range(0, n - segment + 1, segment // 2):
                u, v = (np.fft.rfft((x[at : at + segment] - x[at : at + segment].mean()) * window)[: segment // 2] for x in (a, fake))
                ab, aa, bb = ab + u * np.conj(v), aa + np.abs(u) ** 2, bb + np.abs(v) ** 2
            found.append(np.abs(ab) ** 2 / (aa * bb))
        if found:
            want |= {(key, k): q for k, q in enumerate(np.quantile(found, 0.95, axis=0))}
    for block in (4, 1000):
        got = {(r.recording_id, r.bin): r.null_coherence for r in devices.coherence_null(df, 10.0, segment, surrogates, block=block).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    turns = devices.random_turns(5, np.arange(200), 300).ravel()
    assert 0 <= turns.min() and turns.max() < 1 and abs(turns.mean() - 0.5) < 0.01 and abs(np.corrcoef(turns[:-1], turns[1:])[0, 1]) < 0.02
