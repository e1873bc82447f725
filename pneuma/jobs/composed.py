"""Queries over chains of operators: preprocessing, breaths, calibration of a device, participants' flags."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.islands import REC, rounded
from ..operators import calibration as K
from ..operators import cohort as H
from ..operators import extrema as X
from ..operators import quality as Q
from ..operators import session as N
from ..operators.recording import analyse
from ..sources.tables import SAMPLES_SQL, VECTORS_SQL, event_samples, from_vector, read, vector_samples
from .assembly import _AX, MLR, _axes, calib_packets
from .filters import _chebyshev, band_response, dft_filter_sql
from .recordings import EXTREMA_PROMINENCE_SQL, POLARITY_SQL, SUMMARY_SQL

S = SAMPLES_SQL


def from_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One recording of 25 Hz per vector, from two seconds on."""
    return rounded(from_vector(read(spark, sf, "embeddings"), "vec_id", "embedding", 25.0, 2.0))


FROM_VECTOR = f"WITH {VECTORS_SQL} SELECT recording_id, idx, round(2 + (idx - 1) / 25.0::DOUBLE, 6) AS t_s, round(value, 6) AS value FROM e"


def select_seat_channels(spark: SparkSession, sf: str) -> DataFrame:
    seat = F.when(F.col("c_custkey") % 3 == 0, "LEFT").when(F.col("c_custkey") % 3 == 1, "RIGHT").otherwise("MIDDLE")
    return N.select_seat_channels(read(spark, sf, "customer").select("c_custkey", seat.alias("seat"))).select("c_custkey", "seat", "breath_channel", "heart_channel")


SEATS = """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'LEFT' WHEN 1 THEN 'RIGHT' ELSE 'MIDDLE' END AS seat FROM customer)
SELECT *, CASE seat WHEN 'LEFT' THEN 'Breath 2' WHEN 'RIGHT' THEN 'Breath 1' END AS breath_channel, CASE seat WHEN 'LEFT' THEN 'Heart 2' WHEN 'RIGHT' THEN 'Heart 1' END AS heart_channel FROM c"""


def participant_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, with measures from the numbers of their orders."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("participant_id"), F.col("o_orderkey").alias("k"))
    of = lambda m: (F.col("k") % m) / F.lit(float(m))
    ids = read(spark, sf, "customer").select(F.col("c_custkey").alias("participant_id"))
    f = H.participant_flags(
        ids, o.where("k % 13 = 0").withColumn("r", of(97)), o.withColumn("quality", of(89)), o.withColumn("r", of(83)), o.where("k % 3 = 0").withColumn("residual_sd_ms", (F.col("k") % 130) * 1.0),
        o.withColumn("stop_trial", F.when(F.col("k") % 40 != 0, F.col("k"))), order="k",
    )
    return f.select("participant_id", F.array_join("flags", "; ").alias("flags"), "n_flags", "flagged")


PARTICIPANT_FLAGS = """WITH o AS (SELECT o_custkey AS p, o_orderkey AS k FROM orders),
g AS (SELECT p, max(CASE WHEN k % 13 = 0 THEN (k % 97) / 97.0::DOUBLE END) < 0.4 AS a, avg((k % 89) / 89.0::DOUBLE) < 0.5 AS b, median((k % 83) / 83.0::DOUBLE) < 0.4 AS c,
  max(CASE WHEN k % 3 = 0 THEN k % 130 END) > 100 AS d, count(*) FILTER (k % 40 = 0) > 0 AS e FROM o GROUP BY ALL),
t AS (SELECT c_custkey AS participant_id, list_filter([CASE WHEN a THEN 'low calibration fit' END, CASE WHEN b THEN 'low signal quality' END, CASE WHEN c THEN 'poor pacer adherence' END,
  CASE WHEN d THEN 'large alignment residuals' END, CASE WHEN e THEN 'staircase not converged' END], lambda x: x IS NOT NULL) AS f FROM customer LEFT JOIN g ON p = c_custkey)
SELECT participant_id, array_to_string(f, '; ') AS flags, len(f)::INT AS n_flags, len(f) > 0 AS flagged FROM t"""


def preprocess(spark: SparkSession, sf: str) -> DataFrame:
    """Decimated to 12.5 Hz, band-passed and robustly scaled."""
    x, _ = Q.preprocess(vector_samples(spark, sf), 25.0, 12.5, 0.5, 5.0, spikes=None)
    return rounded(x.select(*REC, "idx", "value"), 5)


PREPROCESS = f"""WITH {VECTORS_SQL}, {dft_filter_sql("e", _chebyshev(2), 25.0, 63, "lo")}, dc AS (SELECT recording_id, (idx - 1) // 2 + 1 AS idx, value FROM lo WHERE idx % 2 = 1),
{dft_filter_sql("dc", band_response("0.5, 5.0", 2), 12.5, 31, "bp", 32)}, m AS (SELECT recording_id, median(value) AS c FROM bp GROUP BY ALL),
s AS (SELECT recording_id, any_value(c) AS c, 1.4826 * median(abs(value - c)) AS s FROM bp JOIN m USING (recording_id) GROUP BY ALL)
SELECT recording_id, idx, round((value - c) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) AS value FROM bp JOIN s USING (recording_id)"""


def provenance_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps noted for each recording."""
    r = event_samples(spark, sf).groupBy(*REC).agg(F.count(F.lit(1)).alias("n"))
    r = Q.provenance_log(r, F.concat(F.lit("read "), F.col("n").cast("string"), F.lit(" samples")))
    r = Q.provenance_log(r, F.when(F.col("n") > 100, "long").otherwise("short"))
    return r.select(*REC, F.array_join("provenance", " > ").alias("provenance"))


PROVENANCE = "SELECT user_id AS recording_id, 'read ' || count(*) || ' samples > ' || CASE WHEN count(*) > 100 THEN 'long' ELSE 'short' END AS provenance FROM events GROUP BY ALL"


def detect_breaths(spark: SparkSession, sf: str) -> DataFrame:
    """Prominent, spaced extrema made to alternate."""
    return rounded(X.detect_breaths(event_samples(spark, sf), 1.0, min_prominence=30.0, min_distance_s=5.0))


DETECT = f"""WITH ep AS ({EXTREMA_PROMINENCE_SQL}), k AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY recording_id ORDER BY idx))::INT AS ch FROM ep))
SELECT recording_id, idx, round(value, 6) AS value, kind FROM k QUALIFY row_number() OVER (PARTITION BY recording_id, run ORDER BY CASE WHEN kind = 'peak' THEN -value ELSE value END, idx) = 1"""


def estimate_breath_period(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as recordings at 5 Hz."""
    return rounded(X.estimate_breath_period(vector_samples(spark, sf, 5.0)))


PERIOD = f"""WITH RECURSIVE {VECTORS_SQL}, u AS (SELECT recording_id, idx, (idx - 1) / 5.0::DOUBLE AS t, value, (value - min(value) OVER v) / (max(value) OVER v - min(value) OVER v) AS u,
  greatest(lag(value) OVER w, lag(value, 2) OVER w) AS b, greatest(lead(value) OVER w, lead(value, 2) OVER w) AS a, idx > 2 AND idx <= count(*) OVER v - 2 AS mid FROM e WINDOW v AS (PARTITION BY recording_id), w AS (PARTITION BY recording_id ORDER BY idx)),
pk AS (SELECT recording_id, t, row_number() OVER (PARTITION BY recording_id ORDER BY t) AS k FROM u WHERE u > 0.4 AND value > a AND value > b AND mid),
st AS (SELECT recording_id, [t] AS ts, 1 AS k FROM pk WHERE k = 1 UNION ALL SELECT st.recording_id, CASE WHEN pk.t - ts[-1] > 1.2 THEN list_append(ts, pk.t) ELSE ts END, pk.k FROM st JOIN pk ON pk.recording_id = st.recording_id AND pk.k = st.k + 1),
fin AS (SELECT recording_id, arg_max(ts, k) AS ts FROM st GROUP BY ALL),
d AS (SELECT recording_id, ts, list_sort(list_filter(list_transform(range(2, len(ts) + 1), lambda i: ts[i] - ts[i - 1]), lambda x: x >= 2 AND x <= 8)) AS d FROM fin)
SELECT r.recording_id, coalesce(len(ts), 0)::INT AS n_peaks, round(d[len(d) // 2 + 1], 6) AS period_s FROM (SELECT DISTINCT recording_id FROM e) r LEFT JOIN d ON d.recording_id = r.recording_id"""


def live_breath_onsets(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as recordings at 5 Hz."""
    return rounded(X.live_breath_onsets(vector_samples(spark, sf, 5.0)))


LIVE = f"""WITH RECURSIVE {VECTORS_SQL}, q AS (SELECT recording_id, avg(value) AS m, list_sort(list(value)) AS v FROM e GROUP BY ALL),
z AS (SELECT recording_id, m, 0.12 * (v[floor((len(v) - 1) * 0.95)::INT + 1] - v[floor((len(v) - 1) * 0.05)::INT + 1]) AS zone FROM q),
o AS (SELECT recording_id, (idx - 1) / 5.0::DOUBLE AS t, value > m AS up, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS k FROM e JOIN z USING (recording_id) WHERE abs(value - m) > zone),
st AS (SELECT recording_id, NOT up AS armed, []::DOUBLE[] AS ts, 1 AS k FROM o WHERE k = 1
  UNION ALL SELECT st.recording_id, CASE WHEN NOT up THEN true WHEN armed AND (len(ts) = 0 OR o.t - ts[-1] > 2) THEN false ELSE armed END,
    CASE WHEN up AND armed AND (len(ts) = 0 OR o.t - ts[-1] > 2) THEN list_append(ts, o.t) ELSE ts END, o.k FROM st JOIN o ON o.recording_id = st.recording_id AND o.k = st.k + 1)
SELECT recording_id, round(unnest(ts), 6) AS t_s FROM (SELECT recording_id, arg_max(ts, k) AS ts FROM st GROUP BY ALL)"""


def calib_window(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of four periods of an hour."""
    w = K.calib_window(K.calib_attempts(calib_packets(spark, sf)), 3600.0)
    return rounded(w.select(*REC, "n_attempts", "window_start_s", "window_end_s", "span_s", "overrun_s", "too_short"), 3)


def calib_overrun(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.calib_overrun(K.calib_attempts(calib_packets(spark, sf)), 3600.0, strict=False), 3)


_CALIB = f"""{S}, p AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (SELECT *, (label IS DISTINCT FROM lag(label) OVER (PARTITION BY recording_id ORDER BY idx))::INT AS ch FROM s WHERE label IN ('click', 'view'))),
r AS (SELECT recording_id, run, any_value(label) AS label, min(t_s) AS a, max(t_s) + 1 AS z FROM p GROUP BY ALL), b AS (SELECT *, lag(label) OVER w AS pl, lag(z) OVER w AS pz FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY run)),
l AS (SELECT *, coalesce((CASE WHEN pl = 'view' THEN pz END + a) / 2, a) AS anchor, count(*) OVER (PARTITION BY recording_id) AS n FROM b WHERE label = 'click' QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY run DESC) = 1)"""
CALIB_WINDOW = f"""WITH {_CALIB} SELECT recording_id, n AS n_attempts, round(anchor, 3) AS window_start_s, round(anchor + 14400.0::DOUBLE, 3) AS window_end_s, round(z - a, 3) AS span_s, round(z - a - 14400.0::DOUBLE, 3) AS overrun_s, z - a < 14400 AS too_short FROM l"""
CALIB_OVERRUN = f"WITH {_CALIB} SELECT recording_id, round(z - a, 3) AS span_s, 14400.0::DOUBLE AS paced_s, round(z - a - 14400.0::DOUBLE, 3) AS overrun_s, n AS n_attempts FROM l WHERE z - a >= 14400"


def realised_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's period with its customer's overshoot."""
    o = read(spark, sf, "orders")
    period = (4000 + F.col("o_orderkey") % 500).cast("double")
    t = o.select(F.col("o_custkey").alias("participant_id"), "o_orderkey", F.lit(0.0).alias("onset_ms"), (17000 + F.col("o_totalprice") / 100).alias("end_ms"), period.alias("period_ms"), F.lit(None).cast("double").alias("hardware_ms"))
    each = K.pacer_overshoot(t).select("participant_id", "delta_ms")
    return rounded(t.join(each, "participant_id", "left").select("o_orderkey", K.realised_change(F.col("period_ms"), F.col("delta_ms")).alias("change")), 8)


REALISED = """WITH d AS (SELECT o_custkey, o_orderkey, 4000.0::DOUBLE + o_orderkey % 500 AS p, (17000 + o_totalprice / 100 - 548 - (8000 + 2 * (4000 + o_orderkey % 500)) - 285) / 4 AS d FROM orders)
SELECT o_orderkey, round((p + median(d) OVER (PARTITION BY o_custkey) - 4000) / 4000, 8) AS change FROM d"""


def device_signal(spark: SparkSession, sf: str) -> DataFrame:
    """The axes read by their own least-squares fit."""
    a = _axes(spark, sf)
    return rounded(K.device_signal(a, K.fit_mlr(a), "participant_id"), 5)


#: Weights as they are, not rounded.
_WEIGHTS = re.sub(r"round\((.+?), 6\) AS", r"(\1) AS", MLR)
DEVICE_SIGNAL = f"""WITH {_AX}, f AS ({_WEIGHTS}) SELECT participant_id, idx, round(bias + wx * x + wy * y + wz * z, 5) AS value FROM ax JOIN f USING (participant_id)"""


def apply_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Weights from the participant's number; every other fit is a smoothed one."""
    a = _axes(spark, sf).withColumnRenamed("participant_id", "recording_id")
    r = F.col("recording_id")
    fits = a.select(*REC).distinct().select(*REC, (r % 7 / 10.0).alias("bias"), (r % 5 - 2.0).alias("wx"), F.lit(0.5).alias("wy"), (r % 3 - 1.0).alias("wz"), (r % 2 == 0).alias("smooth"))
    return rounded(K.apply_calibration(a, fits).select(*REC, "idx", "value"))


#: Filters are linear: the weighted sum of axes is filtered, not the axes.
APPLY = f"""WITH {_AX}, src AS (SELECT participant_id AS recording_id, idx, (participant_id % 5 - 2) * x + 0.5 * y + (participant_id % 3 - 1) * z AS value FROM ax),
{dft_filter_sql("src", band_response("0.05, 1.0", 4), 25.0, 63, "bp")}, rd AS (SELECT recording_id, idx, recording_id % 7 / 10.0::DOUBLE + value AS value FROM bp),
{dft_filter_sql("rd", band_response(", 0.6", 4), 25.0, 63, "lp")}
SELECT recording_id, idx, round(CASE WHEN recording_id % 2 = 0 THEN lp.value ELSE rd.value END, 6) AS value FROM rd JOIN lp USING (recording_id, idx)"""

def analyse_recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of 25 Hz as whole recordings: decimated, band-passed, scaled, their breaths summarised, and the polarity that these suggest."""
    a = analyse(vector_samples(spark, sf), 25.0, 12.5, (0.5, 5.0), None, 0.0, 0.08, spikes=None, grade=False, bounds_s=(0.1, 2.0))
    return rounded(a.features.join(a.polarity.select(*REC, "suggestion", "contradicted"), list(REC), "left"))


_VECTOR_BREATHS = f"""{VECTORS_SQL}, {dft_filter_sql("e", _chebyshev(2), 25.0, 63, "lo")}, dc AS (SELECT recording_id, (idx - 1) // 2 + 1 AS idx, value FROM lo WHERE idx % 2 = 1),
{dft_filter_sql("dc", band_response("0.5, 5.0", 2), 12.5, 31, "bp", 32)}, md AS (SELECT recording_id, median(value) AS c FROM bp GROUP BY ALL),
sd AS (SELECT recording_id, any_value(c) AS c, 1.4826 * median(abs(value - c)) AS s FROM bp JOIN md USING (recording_id) GROUP BY ALL),
s AS (SELECT recording_id, idx, (idx - 1) / 12.5::DOUBLE AS t_s, (value - c) / CASE WHEN sd.s > 0 THEN sd.s ELSE 1 END AS value FROM bp JOIN sd USING (recording_id))"""
_SUMMARY = SUMMARY_SQL.replace(SAMPLES_SQL, _VECTOR_BREATHS).replace("t_end - t_start < 3600 OR t_end - t_start > 86400", "t_end - t_start < 0.1 OR t_end - t_start > 2")
_POLARITY = POLARITY_SQL.replace(SAMPLES_SQL, _VECTOR_BREATHS)
ANALYSE = f"""SELECT f.*, suggestion, coalesce(confident AND suggestion <> 'up', false) AS contradicted FROM ({_SUMMARY}) f LEFT JOIN ({_POLARITY}) p ON p.recording_id = f.recording_id"""

QUERIES = {
    "analyse_recordings": (analyse_recordings, ANALYSE),
    "from_vector": (from_vectors, FROM_VECTOR), "select_seat_channels": (select_seat_channels, SEATS), "participant_flags": (participant_flags, PARTICIPANT_FLAGS), "preprocess": (preprocess, PREPROCESS),
    "provenance_log": (provenance_log, PROVENANCE), "detect_breaths": (detect_breaths, DETECT), "estimate_breath_period": (estimate_breath_period, PERIOD), "live_breath_onsets": (live_breath_onsets, LIVE),
    "calib_window": (calib_window, CALIB_WINDOW), "calib_overrun": (calib_overrun, CALIB_OVERRUN), "realised_rate": (realised_rate, REALISED), "device_signal": (device_signal, DEVICE_SIGNAL),
    "apply_calibration": (apply_calibration, APPLY),
}
