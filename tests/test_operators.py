"""Operators on small inputs with known answers, and on synthetic breathing with known breaths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pneuma.operators import breaths as B
from pneuma.operators import calibration as K
from pneuma.operators import extrema as X
from pneuma.operators import spectrum as P
from pneuma.operators import stats as A
from pneuma.operators import timebase as T
from pneuma.operators import triggers as G


def samples(spark, *signals, fs=1.0):
    rows = [(r, i + 1, i / fs, None if v is None else float(v)) for r, x in enumerate(signals) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id bigint, idx bigint, t_s double, value double")


def breathing(durations, fs=25.0, duty=0.42, noise=0.0, seed=0):
    """Half a sine up for duty * d, half a sine down for the rest."""
    out = []
    for d in durations:
        up, down = round(duty * d * fs), round((1 - duty) * d * fs)
        out += [-math.cos(math.pi * k / up) for k in range(up)] + [math.cos(math.pi * k / down) for k in range(down)]
    x = np.array(out)
    return x + noise * np.random.default_rng(seed).standard_normal(len(x))


def test_trigger_edges_and_settle_codes(spark):
    code = lambda *runs: [c for c, n in runs for _ in range(n)]
    edges = lambda x, **k: [r["index"] for r in G.trigger_edges(samples(spark, x), **k).orderBy("index").collect()]
    assert edges(code((3, 50), (1, 20), (0, 10), (16, 20))) == [1, 51, 81]
    settle = code((0, 10), (3, 2), (4, 2), (1, 40), (0, 5))
    assert len(edges(settle)) == 3 and edges(settle, min_length=10) == [15]
    assert edges([0] * 16 + [5, None, 5, 5]) == [17]
    assert edges([2.05e-289] * 5 + [240] * 5) == []
    assert edges([]) == []


def test_prominence_equals_brute_force(spark):
    rng = random.Random(1)
    signals = [[0, 5, 2, 8, 0]] + [[rng.randint(0, 6) for _ in range(60)] for _ in range(15)] + [np.cumsum([rng.gauss(0, 1) for _ in range(80)]).tolist() for _ in range(8)]
    table = samples(spark, *signals)
    found = {(r.recording_id, r.idx): r.prominence for r in X.peak_prominence(table).collect()}
    assert found[0, 2] == 3
    # Recordings of many ranges, and troughs by the negated signal, give the same.
    assert found == {(r.recording_id, r.idx): r.prominence for r in X.peak_prominence(table, 7).collect()}
    down = X.peak_prominence(table.withColumn("value", -table.value)).collect()
    both = X.prominences(table, (1, -1), 16).collect()
    assert sorted((r.recording_id, r.idx, r.value, r.prominence) for r in both if r.sign == -1) == sorted(map(tuple, down))
    assert found == {(r.recording_id, r.idx): r.prominence for r in both if r.sign == 1}
    for rec, x in enumerate(signals):
        n = len(x)
        for i in range(n):
            if (rec, i + 1) in found:
                left = max([j for j in range(i) if x[j] > x[i]], default=-1)
                right = min([j for j in range(i + 1, n) if x[j] > x[i]], default=n)
                assert found[rec, i + 1] == pytest.approx(x[i] - max(min(x[left + 1 : i + 1]), min(x[i:right])))


def test_plateaus_and_alternation(spark):
    assert [r.idx for r in X.local_maxima(samples(spark, [0, 1, 1, 1, 1, 0, 2, 2, 3, 3])).collect()] == [3]
    ev = spark.createDataFrame([(0, 1, "peak", 1.0), (0, 2, "peak", 3.0), (0, 3, "peak", 3.0), (0, 5, "trough", None), (0, 6, "trough", None), (0, 7, "trough", None), (0, 9, "peak", 0.0)], "recording_id bigint, idx bigint, kind string, value double")
    assert sorted(r.idx for r in X.enforce_alternation(ev).collect()) == [2, 6, 9]
    assert sorted(r.idx for r in X.enforce_alternation(ev, "nearest").collect()) == [3, 7, 9]


def test_synthetic_breaths_are_found(spark):
    rng = random.Random(3)
    durations = [rng.uniform(3, 5) for _ in range(40)]
    s = samples(spark, breathing(durations), fs=25.0)
    ex = X.enforce_alternation(X.extrema_prominence(s, 0.5, 25))
    table = B.flag_breaths(B.breath_table(ex, s)).orderBy("breath").collect()
    assert len(table) == 38 and all(r.has_peak and r.keep for r in table)
    assert np.median([r.duration for r in table]) == pytest.approx(np.median(durations[1:-1]), rel=0.02)
    assert np.median([r.duty_cycle for r in table]) == pytest.approx(0.42, abs=0.06)
    assert all(a.i_end == b.i_start for a, b in zip(table, table[1:], strict=False))
    verdict = B.polarity_verdict(B.breath_table(ex, s)).first()
    assert verdict.suggestion == "up" and verdict.confident
    assert B.polarity_verdict(B.breath_table(ex, s, "down")).first().suggestion == "down"


def test_filters_keep_the_band_and_chunks_do_not_show(spark):
    fs, n = 25.0, 25 * 1200
    t = np.arange(n) / fs
    slow, fast = np.sin(2 * np.pi * 0.25 * t), 0.5 * np.sin(2 * np.pi * 3.0 * t)
    s = samples(spark, slow + fast + 0.2 * t / 60, fs=fs)
    rows = P.zero_phase_filter(s, fs, 0.05, 0.6, 300.0, 60.0).orderBy("idx").collect()
    out = np.array([r.value for r in rows])
    assert len(out) == n and np.abs(out - slow)[2500:-2500].max() < 0.02
    whole = P.filtered((slow + fast + 0.2 * t / 60), fs, lambda f: P.gain(f, fs, 0.05, 0.6), 1500)
    assert np.abs(out - whole).max() < 0.02
    low = P.decimate(s, fs, 5).orderBy("idx").collect()
    assert len(low) == n // 5 and np.abs(np.array([r.value for r in low]) - (slow + 0.2 * t / 60)[::5])[100:-100].max() < 0.05
    with pytest.raises(ValueError, match="band"):
        P.zero_phase_filter(s, fs, 2.0, 1.0)


def test_decimation_plans():
    for q in (2, 4, 6, 8, 13, 20, 26, 39, 40, 50, 78, 80, 100, 120, 169, 200):
        stages = P.decimation_plan(q)
        assert math.prod(stages) == q and max(stages) <= 13


def test_despike_bridges_short_runs_only(spark):
    x = np.sin(np.arange(400) / 10)
    x[50:53] += 30
    x[200:260] += 30
    rows = P.despike(samples(spark, x), 31, 3.0, 20, chunk=100).orderBy("idx").collect()
    assert [r.idx for r in rows if r.spiked and r.idx < 150] == [51, 52, 53]
    assert abs(rows[51].value - math.sin(5.1)) < 0.2 and len(rows) == 400


def test_legacy_rates_and_gaps(spark):
    r = spark.createDataFrame([(2000.0, 25.0), (2000.0, 100.0)], "fs_native double, fs double")
    assert [(x.q_req, x.q_got) for x in T.legacy_rate_fix(r).orderBy("fs").collect()] == [(80, 78), (20, 13)]
    g = T.fill_gaps(samples(spark, [None, 1, None, None, 4, None], [None, None])).orderBy("recording_id", "idx").collect()
    assert [x.value for x in g] == [1, 1, 2, 3, 4, 4, None, None]


def test_icc_and_kappa_of_perfect_and_constant_pairs(spark):
    same = spark.createDataFrame([(float(i), float(i), True, True) for i in range(5)], "a double, b double, x boolean, y boolean")
    assert A.icc_2_1(same, "a", "b").first().icc == pytest.approx(1.0)
    k = A.classification_agreement(same, "x", "y").first()
    assert k.agreement == 1 and k.kappa is None and k.ac1 == 1
    assert same.agg(A.ccc("a", "b").alias("c")).first().c == pytest.approx(1.0)


def test_t_distribution():
    from pneuma.functions import tdist

    for p, df, t in ((0.975, 10, 2.2281388520), (0.95, 5, 2.0150483733), (0.9, 1, 3.0776835372), (0.995, 120, 2.6174211)):
        assert tdist.quantile(p, df) == pytest.approx(t, abs=1e-6) and tdist.cdf(t, df) == pytest.approx(p, abs=1e-8)
        assert tdist.cdf(-t, df) == pytest.approx(1 - p, abs=1e-8)


def test_pca_fit_and_clarity_equal_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((80, 1)) * [[3.0, -1.0, 2.0]] + 0.1 * rng.standard_normal((80, 3))
    target = x @ [0.5, 0.2, 0.1] + 0.05 * rng.standard_normal(80)
    rows = spark.createDataFrame([(1, i, *map(float, v), float(y)) for i, (v, y) in enumerate(zip(x, target, strict=True))], "participant_id bigint, idx bigint, x double, y double, z double, target double")
    fit = K.fit_pca(rows).first()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    score = (x - x.mean(0)) @ vectors[:, 2]
    slope = (score @ (target - target.mean())) / (score @ score)
    assert [fit.wx, fit.wy, fit.wz] == pytest.approx(list(slope * vectors[:, 2])) and fit.r == pytest.approx(abs(np.corrcoef(score, target)[0, 1]))
    clear = K.axis_clarity(rows, 20).orderBy("idx").collect()
    last = np.linalg.eigvalsh(np.cov(x[-20:].T))
    assert len(clear) == 61 and clear[-1].clarity == pytest.approx(last[-1] / last.sum())


def test_operators_take_empty_recordings(spark):
    s = samples(spark)
    assert X.peak_prominence(s).count() == 0 and X.extrema_zerocross(s).count() == 0
    assert B.summarise_breaths(B.flag_breaths(B.breath_table(X.turning_points(s), s))).count() == 0
    assert T.interp_to_grid(s, T.make_grid(s, 1.0)).count() == 0
    assert G.trigger_events(s, 1.0).count() == 0 and G.rigs_present(s.withColumn("code", F.lit(1))).count() == 0


def test_variance_components_equal_a_dense_likelihood():
    from pneuma.operators.stats import reml

    rng = np.random.default_rng(4)
    groups = [rng.normal(0, 10) + rng.normal(0, 1, n) for n in (5, 6, 8, 5, 12, 7, 9, 6)]
    y, owner = np.concatenate(groups), np.repeat(np.arange(len(groups)), [len(g) for g in groups])

    def deviance(within, between):
        v = np.eye(len(y)) * within**2 + between**2 * (owner[:, None] == owner[None, :])
        inverse = np.linalg.inv(v)
        information = inverse.sum()
        r = y - inverse.sum(axis=0) @ y / information
        return np.linalg.slogdet(v)[1] + np.log(information) + r @ inverse @ r

    sizes = np.array([len(g) for g in groups], float)
    means = np.array([g.mean() for g in groups])
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    within, between, upper, singular = reml(sizes, np.ones(len(sizes)), means, np.zeros(len(sizes)), ssw)
    assert not singular and 0.7 < within < 1.4 and 5 < between < 20 < upper * 2
    best = deviance(within, between)
    for a, b in ((0.99, 1), (1.01, 1), (1, 0.97), (1, 1.03)):
        assert deviance(within * a, between * b) > best
    profile = min(deviance(w, upper) for w in within * np.linspace(0.9, 1.1, 201))
    assert profile - best == pytest.approx(3.8415, abs=0.01)
