"""The live operators against plain loops, and one batch against many."""

import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pneuma import registry
from pneuma.streaming import calibrate as C
from pneuma.streaming import packets as W

SCHEMA = "participant_id bigint, event_id bigint, ts timestamp, x double, y double, z double"


def stream(spark, folder, rows, files=1):
    """Rows (participant, seconds, x, y, z) as a file stream, a file a batch, in the order of time."""
    at = f"{folder}/{uuid.uuid4().hex}"
    for k, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        d = [(int(rows[i][0]), int(i), float(rows[i][1]), *(None if v is None else float(v) for v in rows[i][2:])) for i in part]
        f = spark.createDataFrame(d, "participant_id bigint, event_id bigint, s double, x double, y double, z double")
        f.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint"))).select("participant_id", "event_id", "ts", "x", "y", "z").coalesce(1).write.parquet(f"{at}/{k:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)


def breathing(seconds=40, fs=25.0, noise=0.01, who=1, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * fs)) / fs
    u = -np.cos(2 * np.pi * t / 5) / 2
    axes = np.outer(u, [0.8, 0.5, -0.3]) + noise * rng.standard_normal((len(t), 3))
    return [(who, 1000 + a, *v) for a, v in zip(t, axes, strict=True)]


def test_sections_have_the_response_of_the_analog_filter():
    low = C.butterworth_sections(200.0, None, 0.6)[0]
    k = np.tan(np.pi * 0.6 / 200)
    assert low[0] == pytest.approx(k * k / (1 + np.sqrt(2) * k + k * k), rel=1e-9)
    for order in (2, 4):
        s = C.butterworth_sections(25.0, 0.05, 1.0, order)
        assert len(s) == order
        f = np.array([0.02, 0.05, 0.2, 1.0, 3.0])
        z = np.exp(-2j * np.pi * f / 25)
        h = np.prod([abs((b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)) for b0, b1, b2, a1, a2 in s], axis=0)
        w, a, b = (np.tan(np.pi * x / 25) for x in (f, 0.05, 1.0))
        assert h == pytest.approx(1 / np.sqrt(1 + ((w * w - a * b) / (w * (b - a))) ** (2 * order)), rel=1e-6)
    with pytest.raises(ValueError):
        C.butterworth_sections(25.0, None, 1.0, 3)


def test_causal_filter_carries_its_state_over_batches(spark, tmp_path):
    rows = breathing(8)
    rows[50] = (*rows[50][:2], None, *rows[50][3:])
    rows += [(1, rows[-1][1] + 100, 1.0, 1.0, 1.0)]  # after a gap
    sections = C.butterworth_sections(25.0, 0.05, 1.0)
    got = W.drained(C.stream_causal_filter(stream(spark, tmp_path, rows, 4), sections, ("x", "z"), idle_s=30.0)).orderBy("event_id").collect()
    assert [r["seen"] for r in got] == [*range(1, len(rows)), 1]

    def direct(v):
        for b0, b1, b2, a1, a2 in sections:
            y = []
            for i in range(len(v)):
                back = lambda q, k, i=i: q[i - k] if i >= k else 0.0
                y.append(b0 * v[i] + b1 * back(v, 1) + b2 * back(v, 2) - a1 * back(y, 1) - a2 * back(y, 2))
            v = y
        return v

    for c, k in (("x", 2), ("z", 4)):
        whole = [i for i, r in enumerate(rows[:-1]) if r[k] is not None]
        assert [got[i][c] for i in whole] == pytest.approx(direct([rows[i][k] for i in whole]), abs=1e-9)
        assert got[-1][c] == pytest.approx(direct([1.0])[0])
    assert got[50]["x"] is None and got[50]["z"] is not None


def test_running_axis_is_the_first_eigenvector(spark, tmp_path):
    rows = breathing(40, noise=0.1) + [(2, 1000 + k, 1.0, 1.0, 1.0) for k in range(40)]
    got = W.drained(C.stream_running_axis(stream(spark, tmp_path, rows), "12 seconds", "4 seconds", 12)).where("unix_micros(start) >= 1000000000").collect()
    assert {r["participant_id"] for r in got} == {1, 2}
    for r in got:
        a, z = r["start"].timestamp(), r["end"].timestamp()
        x = np.array([v[2:] for v in rows if v[0] == r["participant_id"] and a <= v[1] < z])
        assert r["n"] == len(x)
        if r["participant_id"] == 2:
            assert r["share"] is None
            continue
        values, vectors = np.linalg.eigh(np.cov(x.T))
        assert r["share"] == pytest.approx(values[-1] / values.sum()) and abs(np.dot(r["axis"], vectors[:, -1])) == pytest.approx(1)


def test_confidence_rises_with_paced_breathing_only(spark, tmp_path):
    noise = [(2, t, *v) for (_, t, *_), v in zip(breathing(), np.random.default_rng(1).standard_normal((1000, 3)), strict=True)]
    rows = sorted(breathing() + noise, key=lambda r: r[1])
    one, many = (W.drained(C.stream_calib_confidence(stream(spark, tmp_path, rows, n))).orderBy("participant_id", "elapsed_s").collect() for n in (1, 5))
    assert one == many
    last = {r["participant_id"]: r for r in one}
    assert last[1]["confidence"] > 0.9 and last[1]["rhythm"] and last[1]["still"] and last[1]["breaths"] in (3, 4)
    assert last[2]["confidence"] < 0.3 and last[2]["clarity"] == 0
    assert not one[0]["ready"] and one[0]["confidence"] == 0


def test_a_quiet_calibration_ends_by_its_timer(spark, tmp_path):
    rows = [(1, 1000, 0.5, 0, 0), (1, 1001, 0.5, 0, 0)] + [(2, 1000 + k, 0.9, 0, 0) for k in range(100)]
    rows = sorted(rows, key=lambda r: r[1])
    p = stream(spark, tmp_path, rows, 3).withColumnRenamed("x", "confidence")
    got = {r["participant_id"]: r for r in W.drained(W.stream_calib_status(p, 20.0, 4, 0.82, 3.0, 60.0)).collect()}
    assert (got[1]["status"], got[1]["event_id"], got[1]["elapsed_s"]) == ("timeout", None, 60.0)
    assert (got[2]["status"], got[2]["elapsed_s"]) == ("ready", 23.0)


@pytest.mark.parametrize("last", [-0.3, 0.7, 1.0])
@pytest.mark.parametrize("name", ["stream_amplitude_range", "stream_pacer_r", "stream_running_axis"])
def test_packets_half_a_second_before_a_window_are_those_of_its_sql(spark, tmp_path, name, last):
    """Packets about the start of each window of two participants; the last packet of all comes so many seconds behind a start."""
    rng, day = np.random.default_rng(9), 86400
    near = [-1.0, -0.500001, -0.5, -0.499999, -0.2, 0.0, 0.3]
    at = [(u, k * 2 * day + d) for u in (1, 2) for k in range(1, 5) for d in (*near[u - 1 :: 2], *rng.uniform(2, 2 * day - 2, 3))] + [(1, 10 * day + last)]
    rows = ", ".join(f"({i}, make_timestamp({1704153600_000000 + round(t * 1e6)}), {u}::BIGINT, 'view', {round(float(rng.uniform(0, 100)), 2)}::DOUBLE, '{{}}')" for i, (u, t) in enumerate(at))
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    duck.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id, event_type, value, props FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    due = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda r: (r[0], r[1])
    got = sorted((tuple(r) for r in got.collect()), key=key)
    assert len(got) == len(due) > 5
    for a, b in zip(got, sorted(due, key=key), strict=True):
        assert a == pytest.approx(b, abs=2e-6)
