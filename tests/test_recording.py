"""Whole recordings through one call."""

import numpy as np
import pytest

from pneuma.operators.breaths import variability
from pneuma.operators.recording import analyse
from pneuma.sources.shared import stored


def breathing(seed, fs=25.0, seconds=240, sign=1.0, noise=0.05):
    rng, parts, durations = np.random.default_rng(seed), [], []
    while sum(durations) < seconds:
        d = rng.uniform(3, 5)
        up, down = int(0.4 * d * fs), int(0.6 * d * fs)
        parts += [np.sin(np.pi * (np.arange(up) / up - 0.5)), -np.sin(np.pi * (np.arange(down) / down - 0.5))]
        durations.append((up + down) / fs)
    x = np.concatenate(parts)
    return sign * (x + 0.002 * np.arange(len(x)) + noise * rng.standard_normal(len(x))), durations


def table(spark, signals):
    return spark.createDataFrame([(k, i + 1, float(v)) for k, x in signals.items() for i, v in enumerate(x)], "recording_id bigint, idx bigint, value double")


def test_recordings_to_features(spark):
    good, durations = breathing(1, 50.0)
    down, _ = breathing(2, 50.0, sign=-1.0)
    df = table(spark, {1: good, 2: down, 3: np.full(3000, 0.5)})
    seen = []
    a = analyse(df, 50.0, 25.0, keep=lambda rows, name: seen.append(name) or stored(rows, name))
    assert a.rate == 25.0 and seen == ["base", "detected", "measured", "extrema", "breaths"]
    f = {r.recording_id: r for r in a.features.collect()}
    assert set(f) == {1, 2, 3} and f[3].n_breaths_total == 0 and f[3].window_coverage_s == 0 and f[3].duration_mean is None
    inner = durations[1:-1]
    assert abs(f[1].n_breaths - len(inner)) <= 2 and f[1].duration_median == pytest.approx(np.median(inner), rel=0.03) and f[1].duty_cycle_mean == pytest.approx(0.4, abs=0.05)
    p = {r.recording_id: r for r in a.polarity.collect()}
    assert not p[1].contradicted and p[2].contradicted and p[2].suggestion == "down"
    q = {r.recording_id: r.quality for r in a.quality.collect()}
    assert q[3] == "unusable" and set(q) == {1, 2, 3}
    turned = analyse(table(spark, {2: down}), 50.0, 25.0, polarity="down", grade=False)
    r = turned.polarity.first()
    assert r.suggestion == "down" and not r.contradicted and turned.quality is None
    assert turned.features.first().duty_cycle_mean == pytest.approx(0.4, abs=0.05)


def test_windows_give_a_row_each(spark):
    x, _ = breathing(3)
    epochs = spark.createDataFrame([(1, 1, 10.0, 70.0), (1, 2, 70.0, 130.0), (1, 3, 900.0, 960.0)], "recording_id bigint, epoch int, start double, end double")
    f = {r.epoch: r for r in analyse(table(spark, {1: x}), 25.0, measure_band=None, epochs=epochs, grade=False).features.collect()}
    assert set(f) == {1, 2, 3} and 12 <= f[1].n_breaths <= 18 and f[3].n_breaths_total == 0 and f[1].coverage_frac > 0.9


def test_variability_leaves_nulls_out_before_differences(spark):
    rows = [(1, i, i / 2, v) for i, v in enumerate([1.0, None, 4.0, 2.0, None, 2.5])] + [(2, 0, 0.0, None), (3, 0, 0.0, 7.0)]
    got = {r.recording_id: r for r in variability(spark.createDataFrame(rows, "recording_id bigint, idx bigint, t_s double, value double"), "value", "idx", "t_s").collect()}
    v = np.array([1.0, 4.0, 2.0, 2.5])
    assert set(got) == {1, 3} and got[1].n == 4 and got[1].v_sd == pytest.approx(v.std(ddof=1)) and got[1].v_rmssd == pytest.approx(np.sqrt(np.mean(np.diff(v) ** 2)))
    assert got[1].v_slope_per_breath == pytest.approx(np.polyfit(range(4), v, 1)[0]) and got[1].v_slope_per_s == pytest.approx(np.polyfit([0, 1, 1.5, 2.5], v, 1)[0])
    assert got[3].v_mean == 7.0 and got[3].v_sd is None and got[3].v_rmssd is None and got[3].v_slope_per_s is None
