"""Models of a calibration, trials with their pacer, and bounds, against plain computations."""

import hashlib
import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pneuma import registry
from pneuma.operators import calibration, cohort, devices, stats, timebase, trials


def test_models_recover_a_planted_direction_and_lag(spark):
    rng, fs, n = np.random.default_rng(1), 25.0, 400
    t = np.arange(n) / fs
    rows = []
    for key, (lag, noise) in enumerate([(8, 0.02), (-6, 0.02), (0, 5.0)]):
        pacer = (1 - np.cos(2 * np.pi * t / 4)) / 2
        moved = (1 - np.cos(2 * np.pi * (t - lag / fs) / 4)) / 2
        w = np.array([0.6, -0.3, 0.75])
        axes = np.outer(moved if key < 2 else 0 * moved, w / np.linalg.norm(w)) + noise * rng.standard_normal((n, 3))
        rows += [(key, i + 1, *map(float, axes[i]), float(pacer[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "recording_id bigint, idx bigint, x double, y double, z double, target double")
    got = {r.recording_id: r for r in calibration.score_models(df, fs).collect()}
    for key, lag in ((0, 8), (1, -6)):
        r = got[key]
        assert r.model in calibration.MODELS and r.r > 0.7 and not r.low_fit and r.n == n and abs(r.lag_ms - 40 * lag) <= 40 and r.lag_r > 0.9
    one, axis = df.where("recording_id = 0"), np.array([0.6, -0.3, 0.75])
    p = calibration.fit_pca(calibration.calib_bandpass(one, fs, columns=("x", "y", "z")).join(one.select("recording_id", "idx", "target"), ["recording_id", "idx"]), "recording_id").first()
    w = np.array([p.wx, p.wy, p.wz])
    assert w @ axis / np.linalg.norm(w) / np.linalg.norm(axis) > 0.99
    assert got[2].low_fit and got[2].margin is not None
    few = calibration.score_models(df.where("idx <= 60 and recording_id = 0"), fs).first()
    assert few.too_few and few.model is None and few.r is None


def test_bootstrap_draws_clusters_as_plain_python_does(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{k}", float(v)) for k in range(23) for v in rng.standard_normal(rng.integers(1, 5)) + k] + [("c1", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "c string, v double")
    sums = {}
    for c, v in rows:
        if c is not None and v is not None:
            s, n = sums.get(c, (0.0, 0))
            sums[c] = (s + v, n + 1)
    order = sorted(sums, key=lambda c: hashlib.md5(c.encode()).hexdigest())
    means = []
    for r in range(50):
        picked = [sums[order[int(hashlib.md5(f"{r}:{j}".encode()).hexdigest()[:13], 16) % 23]] for j in range(23)]
        means.append(sum(s for s, _ in picked) / sum(n for _, n in picked))
    got = stats.cluster_bootstrap(df, "c", "v", 50).first()
    assert abs(got.lower - np.quantile(means, 0.025)) < 1e-9 and got.replicates == 50
    assert abs(got.mean - sum(s for s, _ in sums.values()) / sum(n for _, n in sums.values())) < 1e-9


def test_bootstrap_of_few_clusters_does_not_fail(spark):
    two = spark.createDataFrame([("a", 1.0), ("b", None)], "c string, v double")
    got = stats.cluster_bootstrap(two, "c", "v", 200).first()
    assert (got.lower, got.mean) == (1.0, 1.0) and 100 < got.replicates < 200  # draws of b alone have no value
    for df in (two.limit(0), two.where("c = 'b'")):
        got = stats.cluster_bootstrap(df, "c", "v", 20).collect()
        assert [tuple(r) for r in got] == [(None, None, 0)]


def plain_sync(t, v, start, base, changed, lag, least, every):
    boundary = start + 2 * base
    wave = lambda at, s, p: (1 - np.cos(2 * np.pi * (at - s) / p)) / 2
    two = lambda at: np.where(at <= boundary, wave(at, start, base), wave(at, boundary, changed))
    late, sep = t >= boundary, min(base, changed)
    r = [abs(np.corrcoef(v[m], p[m])[0, 1]) if m.sum() > least else None for m, p in ((~late, wave(t, start, base)), (late, two(t - lag)))]

    def peaks(at, x, gap):
        out = []
        for i in range(1, len(x) - 1):
            if x[i] > x[i - 1] and x[i] > x[i + 1] and (not out or at[i] - out[-1] > gap):
                out.append(at[i])
        return np.array(out)

    mine, due = peaks(t, v, 0.5 * sep), peaks(t[::every], two(t)[::every], 0.7 * sep)
    e = sorted(x for x in (np.abs(mine - p).min() for p in due) if x < 0.75 * sep) if len(mine) else []
    return (*r, e[len(e) // 2] if e else None)


def test_trial_synchrony_equals_the_plain_search(spark):
    rng, fs = np.random.default_rng(3), 10.0
    t = np.arange(2000) / fs
    v = np.sin(2 * np.pi * t / 4.2) + 0.3 * rng.standard_normal(2000)
    windows = [(1, k, 20.0 * k + 0.03, 20.0 * k + 16.5, 4.0, 3.2 + 0.3 * k) for k in range(8)] + [(1, 8, 190.0, 191.0, 4.0, 4.0), (1, 9, 500.0, 516.0, 4.0, 4.0)]
    signal = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v, strict=True)], "recording_id bigint, t_s double, value double")
    df = spark.createDataFrame(windows, "recording_id bigint, trial bigint, start double, end double, base double, changed double")
    got = {r.trial: r for r in calibration.trial_sync(signal, df, 0.3).collect()}
    assert set(got) == set(range(9))
    for _, k, a, z, base, changed in windows[:9]:
        inside = (t >= a) & (t <= z)
        want = plain_sync(t[inside], v[inside], a, base, changed, 0.3, 20, 5)
        for x, y in zip((got[k].r_baseline, got[k].r_condition, got[k].peak_error_s), want, strict=True):
            assert (x is None) == (y is None) and (y is None or abs(x - y) < 1e-9)


def test_local_retry_adds_low_extrema_where_nothing_is_near(spark):
    t = np.arange(0, 40, 0.1)
    v = np.where(t < 20, np.sin(2 * np.pi * t / 4), 0.2 * np.sin(2 * np.pi * t / 4))
    samples = spark.createDataFrame([(1, i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(t, v, strict=True))], "recording_id bigint, idx bigint, t_s double, value double")
    known = [(1, i + 1, "peak" if v[i] > v[i - 1] else "trough") for i in range(1, 399) if (v[i] - v[i - 1]) * (v[i + 1] - v[i]) < 0 and abs(v[i]) > 0.5]
    extrema = spark.createDataFrame(known, "recording_id bigint, idx bigint, kind string")
    windows = spark.createDataFrame([(1, 1, 0.0, 19.9), (1, 2, 20.0, 39.9)], "recording_id bigint, trial bigint, start double, end double")
    got = trials.local_retry(samples, windows, extrema).orderBy("t_s").collect()
    assert {r.trial for r in got} == {2} and all(r.added for r in got)
    assert all(a.kind != b.kind for a, b in zip(got, got[1:], strict=False)) and len(got) >= 7
    assert all(abs(abs(r.value) - 0.2) < 0.01 for r in got[1:-1])
    # What is there stays, and nothing is added within the gap of it.
    some = extrema.union(spark.createDataFrame([(1, 232, "trough")], extrema.schema))
    again = trials.local_retry(samples, windows, some, gap_s=0.5).orderBy("t_s").collect()
    assert [r.t_s for r in again if not r.added] == [pytest.approx(23.1)] and len(again) == len(got)
    assert all(abs(r.t_s - 23.1) >= 0.5 for r in again if r.added)
    assert trials.local_retry(samples, windows, extrema, breaths=2).count() == len(got)  # the first trial still has enough


def test_the_expected_waveform_goes_under_the_first_peak(spark):
    fs = 10.0
    wave = -np.cos(2 * np.pi * np.arange(160) / 40)
    observed = [(1, i, float(np.roll(wave, 7)[i])) for i in range(160)] + [(2, i, 1.0) for i in range(30)] + [(3, i, float(i == 90)) for i in range(100)]
    due = [(k, i, float(wave[i])) for k in (1, 2, 3) for i in range(160)]
    of = lambda rows: spark.createDataFrame(rows, "trial bigint, i bigint, value double")
    peaks = spark.createDataFrame([(1, 2.7), (1, 6.7), (2, -1.0), (2, 50.0)], "trial bigint, t_s double")
    got = {r.trial: r for r in trials.align_first_peak(of(observed), peaks, of(due), fs).collect()}
    assert (round(got[1].lag_s, 9), got[1].n, got[1].far) == (0.7, 153, False) and got[1].r > 0.999
    assert got[2].r is None and got[2].n == 30 and got[2].far  # no peak in the trial: the first of equal samples stands for it
    assert round(got[3].lag_s, 9) == 7.0 and got[3].far


def test_bounds_of_means(spark):
    values = [0.1, 0.4, -0.2, 0.3, 0.15]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 2.0), ("c", 1.0), ("c", 1.0), ("c", 1.0), ("a", None)], "g string, v double")
    half = 2.1318467863266499 * np.std(values, ddof=1) / math.sqrt(5)  # the 0.95 quantile of four degrees of freedom
    low = {r.g: r.lower_bound for r in trials.lower_bound(df, "v", ["g"]).collect()}
    assert abs(low["a"] - (np.mean(values) - half)) < 1e-9 and low["b"] is None and low["c"] is None
    high = {r.g: r.equivalence_bound for r in trials.equivalence_bound(df, "v", ["g"]).collect()}
    assert abs(high["a"] - max(abs(np.mean(values) - half), abs(np.mean(values) + half))) < 1e-9


def test_offsets_by_participant_and_rig(spark):
    rng = np.random.default_rng(5)
    rows = [(r, t, b, 0.1 * r + 0.02 * b + float(rng.normal(0, 0.05))) for r in range(4) for t in range(6) for b in range(1, 5)]
    df = spark.createDataFrame(rows, "recording_id bigint, trial bigint, breath int, offset_s double")
    rigs = spark.createDataFrame([(r, f"rig{r % 2}") for r in range(4)], "recording_id bigint, rig string")
    got = {r.recording_id: r for r in devices.offset_summary(df, rigs).collect()}
    for r in range(4):
        mine = [x for x in rows if x[0] == r]
        each = [[x[3] for x in mine if x[1] == t] for t in range(6)]
        within = np.mean([np.var(e, ddof=1) for e in each])
        assert abs(got[r].slope_s - np.polyfit([x[2] for x in mine], [x[3] for x in mine], 1)[0]) < 1e-9
        assert abs(got[r].breath_var - within) < 1e-9 and abs(got[r].trial_var - max(0, np.var([np.mean(e) for e in each], ddof=1) - within / 4)) < 1e-9
        assert abs(got[r].rig_mean - np.mean([x[3] for x in rows if x[0] % 2 == r % 2])) < 1e-9


def test_band_bias_counts_equal_onsets_as_often_as_they_stand(spark):
    true = spark.createDataFrame([(1, 10.0, 4), (1, 10.0, 4), (1, 20.0, 4), (1, 30.0, 6), (2, 10.0, 4)], "recording_id bigint, t_s double, period int")
    found = spark.createDataFrame([(1, "wide", 10.2), (1, "wide", 9.8), (1, "wide", 20.5), (1, "slow", 10.3), (1, "slow", 31.9), (1, "other", 30.0)], "recording_id bigint, band string, t_s double")
    got = {r.period: r for r in cohort.band_bias_table(true, found, 1.0, "period", "band", ["wide", "slow"]).collect()}
    assert abs(got[4].bias_wide - (-0.2 - 0.2 + 0.5) / 3) < 1e-9 and abs(got[4].bias_slow - 0.3) < 1e-9 and abs(got[4].difference - (got[4].bias_wide - 0.3)) < 1e-9
    assert set(got) == {4}


def test_onsets_of_a_paced_recording(spark):
    """Detection finds each planted trough and peak near where it is, and nothing in a short recording."""
    fs, period = 10.0, 4.0
    t = np.arange(0, 120, 1 / fs)
    v = -np.cos(2 * np.pi * t / period) + 0.02 * np.random.default_rng(6).standard_normal(len(t))
    rows = [(1, i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(t, v, strict=True))] + [(2, i + 1, i / fs, 1.0 * (i % 3)) for i in range(20)]
    got = devices.detect_onsets(spark.createDataFrame(rows, "recording_id bigint, idx bigint, t_s double, value double"), fs).collect()
    assert {r.recording_id for r in got} == {1}
    for kind, first in (("peak", 2.0), ("trough", 4.0)):
        at = np.sort([(r.idx - 1) / fs for r in got if r.kind == kind])
        due = np.arange(first, 116, period)
        assert all(np.abs(at - d).min() <= 0.3 for d in due) and len(at) <= len(due) + 2


def test_condition_boundary_and_its_overshoot(spark):
    r = spark.range(1).select(calibration.condition_boundary(F.lit(1000.0), F.lit(71.25)).alias("b")).first()
    assert r.b == 1000 + 2 * (4000 + 71.25)


def test_windows_of_any_length_find_their_samples(spark):
    rng = np.random.default_rng(8)
    samples = [(r, k + 1, float(t)) for r in (1, 2, 3) for k, t in enumerate(np.sort(np.round(rng.uniform(-300, 7000, 60), 1)))] + [(1, 61, 9e11)]
    spans = [0.0, 5.0, 59.9, 60.0, 60.1, 500.0, 3840.0, 1e5, 1e12]
    windows = [(r, i, samples[7 * i + r][2], samples[7 * i + r][2] + spans[i]) for r in (1, 2) for i in range(len(spans))] + [(2, 90, 10.0, 9.0), (2, 91, None, 9.0), (2, 92, 9.0, None)]
    s, w = spark.createDataFrame(samples, "recording_id bigint, idx bigint, t_s double"), spark.createDataFrame(windows, "recording_id bigint, trial int, start double, end double")
    got = timebase.assign_block(s, w, 60.0)
    assert got.columns == ["recording_id", "idx", "t_s", "trial", "start", "end"]
    due = [(r, i, n) for r, i, t in samples for q, n, a, z in windows if q == r and a is not None and z is not None and a <= t <= z]
    assert sorted((x.recording_id, x.idx, x.trial) for x in got.collect()) == sorted(due) and len(due) > 50


def test_flags_add_up_quality_in_the_order_of_the_orders(spark, tmp_path):
    """Means of one half but for rounding, over files whose later orders come first."""
    values = list(itertools.permutations([42, 75, 55, 6]))
    o = [(89 * (len(values) * i + c) + q, c, i) for c, v in enumerate(values) for i, q in enumerate(v)]
    rows = spark.createDataFrame(o, "o_orderkey bigint, o_custkey bigint, i int")
    for k, part in enumerate(("i >= 2", "i < 2")):
        rows.where(part).drop("i").coalesce(1).sort("o_orderkey").write.parquet(f"{tmp_path}/orders.parquet/part={k}")
    spark.range(len(values) + 1).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*/*.parquet' ORDER BY o_orderkey")
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    due = sorted(duck.execute(registry.oracle_sql()["participant_flags"]).fetchall())
    assert sorted(tuple(r) for r in registry.queries()["participant_flags"](spark, str(tmp_path)).collect()) == due
    low = [(a / 89 + b / 89 + c / 89 + d / 89) / 4 < 0.5 for a, b, c, d in values]
    assert [("low signal quality" in r[1]) for r in due[:-1]] == low and 0 < sum(low) < len(low)
