"""Queries over `events` as trigger channels, packets and sampled signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, rounded
from ..operators import clean as C
from ..operators import timebase as T
from ..operators import triggers as G
from ..sources.tables import SAMPLES_SQL, event_samples, read

S = SAMPLES_SQL


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    """A channel of few codes with gaps, so that runs and missing samples occur."""
    v = F.when(F.col("code") % 10 != 9, F.floor(F.col("code") / 40).cast("double"))
    return event_samples(spark, sf).withColumn("value", v)


_C = f"{S}, c AS (SELECT recording_id, idx, t_s, CASE WHEN code % 10 <> 9 THEN (code // 40)::DOUBLE END AS value FROM s)"
_RUNS = f"""{_C}, h AS (SELECT *, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY idx), 0) AS held FROM c),
r AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (
  SELECT *, (idx = 1 OR held <> lag(held) OVER (PARTITION BY recording_id ORDER BY idx))::INT AS ch FROM h)),
tr AS (SELECT recording_id, min(idx) AS index, any_value(held) AS code, count(value) AS length FROM r GROUP BY recording_id, run
  HAVING any_value(held) >= 1 AND any_value(held) < 200 AND count(value) >= 1)"""


def split_nibbles(spark: SparkSession, sf: str) -> DataFrame:
    return G.split_nibbles(event_samples(spark, sf)).select(*REC, "idx", "low", "high")


NIBBLES = f"WITH {S} SELECT recording_id, idx, code & 15 AS low, (code & 240) >> 4 AS high FROM s"


def rigs_present(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.rigs_present(event_samples(spark, sf)))


RIGS = f"""WITH {S}, n AS (SELECT recording_id, 'low' AS rig, code & 15 AS v FROM s UNION SELECT recording_id, 'high', (code & 240) >> 4 FROM s)
SELECT recording_id, rig, count(*) AS n_codes, round(avg((v BETWEEN 1 AND 13)::INT), 6) AS share FROM n WHERE v NOT IN (0, 15)
GROUP BY ALL HAVING count(*) >= 3 AND avg((v BETWEEN 1 AND 13)::INT) >= 0.9"""


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    return G.decode_triggers(event_samples(spark, sf), "high", 25.0)


def decode_triggers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_decoded(spark, sf))


_DEC = f"""{S}, n AS (SELECT recording_id, idx, (code & 240) >> 4 AS v FROM s),
d AS (SELECT recording_id, idx, (idx - 1) / 25.0 AS time_s, v AS code FROM n
  QUALIFY v NOT IN (0, 15) AND NOT coalesce(lag(v NOT IN (0, 15)) OVER (PARTITION BY recording_id ORDER BY idx), false))"""
DECODE = f"WITH {_DEC} SELECT recording_id, idx, round(time_s::DOUBLE, 6) AS time_s, code FROM d"


def drop_pre_session(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.drop_pre_session(_decoded(spark, sf), 6))


DROP = f"""WITH {_DEC}, m AS (SELECT recording_id, max(idx) AS f FROM d WHERE code = 6 GROUP BY ALL)
SELECT d.recording_id, idx, round(time_s::DOUBLE, 6) AS time_s, code FROM d JOIN m ON m.recording_id = d.recording_id AND idx >= f"""


def trigger_runs(spark: SparkSession, sf: str) -> DataFrame:
    return G.trigger_runs(_coded(spark, sf))


def trigger_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.trigger_edges(_coded(spark, sf), min_length=2)


def resolve_idle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.resolve_idle(_coded(spark, sf), 0.4))


_MODE = """mo AS (SELECT recording_id, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL),
md AS (SELECT recording_id, value AS mode, n / sum(n) OVER (PARTITION BY recording_id) AS share FROM mo
  QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, value) = 1)"""
IDLE = f"""WITH {_C}, {_MODE} SELECT recording_id, CASE WHEN share >= 0.4 AND abs(mode) >= 0.5 THEN mode ELSE 0.0 END AS idle, round(share, 6) AS share FROM md"""


def debounce_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.debounce_edges(G.trigger_runs(_coded(spark, sf)), 4)


DEBOUNCE = f"""WITH RECURSIVE {_RUNS},
q AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY length DESC, index) AS rk FROM tr),
st AS (SELECT recording_id, []::BIGINT[] AS taken, 1 AS rk FROM (SELECT DISTINCT recording_id FROM q)
  UNION ALL SELECT st.recording_id, CASE WHEN len(list_filter(st.taken, lambda x: abs(x - q.index) < 4)) = 0 THEN list_append(st.taken, q.index) ELSE st.taken END, st.rk + 1
  FROM st JOIN q ON q.recording_id = st.recording_id AND q.rk = st.rk),
fin AS (SELECT recording_id, arg_max(taken, rk) AS taken FROM st GROUP BY ALL)
SELECT q.recording_id, q.index, q.code, q.length FROM q JOIN fin USING (recording_id) WHERE list_contains(taken, q.index)"""


def trigger_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.trigger_events(_coded(spark, sf), 25.0, [1, 2]))


EVENTS = f"""WITH {_C}, {_MODE}, cc AS (SELECT c.recording_id, idx, value - CASE WHEN share >= 0.5 AND abs(mode) >= 0.5 THEN mode ELSE 0 END AS value FROM c JOIN md USING (recording_id)),
h AS (SELECT *, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY idx), 0) AS held FROM cc),
r AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (SELECT *, (idx = 1 OR held <> lag(held) OVER (PARTITION BY recording_id ORDER BY idx))::INT AS ch FROM h)),
tr AS (SELECT recording_id, min(idx) AS i, any_value(held) AS code FROM r GROUP BY recording_id, run HAVING count(value) >= 1)
SELECT recording_id, round((i - 1) / 25.0, 6)::DOUBLE AS time, code::INT::VARCHAR AS label, code AS value FROM tr WHERE code IN (1, 2)"""


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    return event_samples(spark, sf).select(*REC, "idx", F.col("t_s").alias("time_s"), (F.col("code") % 16).alias("code"))


def trial_start_end_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.start_end_counts(_codes(spark, sf))


COUNTS = f"""WITH {S} SELECT recording_id, count(*) FILTER (code % 16 = 10) AS starts, count(*) FILTER (code % 16 = 12) AS ends,
  count(*) FILTER (code % 16 = 10) = count(*) FILTER (code % 16 = 12) AS agree FROM s GROUP BY ALL"""


def block_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.block_bounds(_codes(spark, sf)))


BLOCKS = f"""WITH {S}, b(block, a, z) AS (VALUES ('block2', 2, 3), ('block3', 4, 5), ('block4', 6, 7), ('block5', 8, 9)),
m AS (SELECT recording_id, block, min(t_s) FILTER (code % 16 = a) AS start, max(t_s) FILTER (code % 16 = z) AS "end" FROM s, b GROUP BY ALL)
SELECT recording_id, block, round(start, 6) AS start, round("end", 6) AS "end" FROM m WHERE start IS NOT NULL AND "end" IS NOT NULL"""


def hardware_durations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.hardware_durations(_codes(spark, sf)))


HARDWARE = f"""WITH {S}, e AS (SELECT *, lead(code % 16) OVER w AS nx, lead(t_s) OVER w AS u FROM s WHERE code % 16 IN (10, 12) WINDOW w AS (PARTITION BY recording_id ORDER BY idx))
SELECT recording_id, idx, round(u - t_s, 6) AS duration_s FROM e WHERE code % 16 = 10 AND nx = 12"""


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    """Packets of a day's samples of a recording."""
    s = event_samples(spark, sf).withColumn("packet_ts", (F.floor(F.col("t_s") / 86400) * 86400000).cast("bigint"))
    return s.withColumn("sample_index", F.row_number().over(Window.partitionBy(*REC, "packet_ts").orderBy("idx")) - 1)


_P = f"{S}, p AS (SELECT *, (floor(t_s / 86400) * 86400000)::BIGINT AS packet_ts FROM s)"


def accel_times(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.accel_times(_packets(spark, sf)).select(*REC, "idx", "n_in_packet", "sample_ms", "bad_index", "odd_packet"), 3)


ACCEL = f"""WITH {_P}, q AS (SELECT *, row_number() OVER (PARTITION BY recording_id, packet_ts ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY recording_id, packet_ts) AS n FROM p)
SELECT recording_id, idx, n AS n_in_packet, round(packet_ts - (n - 1 - i) * (1000.0::DOUBLE / 203.4), 3) AS sample_ms, i >= 36 AS bad_index, n <> 36 AS odd_packet FROM q"""


def packet_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.packet_stats(_packets(spark, sf)))


PACKETS = f"""WITH {_P}, d AS (SELECT recording_id, packet_ts - lag(packet_ts) OVER (PARTITION BY recording_id ORDER BY packet_ts) AS gap FROM (SELECT DISTINCT recording_id, packet_ts FROM p))
SELECT recording_id, count(*) AS n_packets, round(avg(gap), 6) AS mean_ms, round(median(gap), 6)::DOUBLE AS median_ms, round(stddev_samp(gap), 6) AS jitter_ms,
  round(quantile_cont(gap, 0.95), 6)::DOUBLE AS p95_ms, max(gap) AS max_ms FROM d GROUP BY ALL"""


def make_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.make_grid(event_samples(spark, sf), 21600.0))


_G = f"""{S}, b AS (SELECT recording_id, min(t_s) AS lo, max(t_s) AS hi FROM s GROUP BY ALL),
g AS (SELECT recording_id, k::INT AS k, lo + k * 21600.0::DOUBLE AS t_s FROM (SELECT *, unnest(range(0, floor((hi - lo) / 21600)::BIGINT + 1)) AS k FROM b))"""
GRID = f"WITH {_G} SELECT recording_id, k, round(t_s, 6) AS t_s FROM g"


def interp_to_grid(spark: SparkSession, sf: str) -> DataFrame:
    s = event_samples(spark, sf)
    return rounded(T.interp_to_grid(s, T.make_grid(s, 21600.0)))


INTERP = f"""WITH {_G}, l AS (SELECT g.*, s.t_s AS t0, s.value AS v0 FROM g ASOF LEFT JOIN s ON s.recording_id = g.recording_id AND s.t_s <= g.t_s),
r AS (SELECT l.*, s.t_s AS t1, s.value AS v1 FROM l ASOF LEFT JOIN s ON s.recording_id = l.recording_id AND s.t_s >= l.t_s)
SELECT recording_id, k, round(t_s, 6) AS t_s, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t_s THEN v0 ELSE v0 + (t_s - t0) / (t1 - t0) * (v1 - v0) END, 6) AS value FROM r"""


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    return event_samples(spark, sf).withColumn("value", F.when(F.col("code") % 5 != 0, F.col("value")))


_GAPPY = f"{S}, c AS (SELECT recording_id, idx, CASE WHEN code % 5 <> 0 THEN value END AS value FROM s)"


def fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.fill_gaps(_gappy(spark, sf)).select(*REC, "idx", "value", "filled"))


FILL = f"""WITH {_GAPPY}, k AS (SELECT * FROM c WHERE value IS NOT NULL),
l AS (SELECT c.*, k.idx AS i0, k.value AS v0 FROM c ASOF LEFT JOIN k ON k.recording_id = c.recording_id AND k.idx <= c.idx),
r AS (SELECT l.*, k.idx AS i1, k.value AS v1 FROM l ASOF LEFT JOIN k ON k.recording_id = l.recording_id AND k.idx >= l.idx)
SELECT recording_id, idx, round(CASE WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL OR i0 = i1 THEN v0 ELSE v0 + (v1 - v0) * (idx - i0) / (i1 - i0) END, 6) AS value, value IS NULL AS filled FROM r"""


def recording_duration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.recording_duration(event_samples(spark, sf), 25.0))


DURATION = f"WITH {S} SELECT recording_id, count(*) AS n, round(count(*) / 25.0::DOUBLE, 6) AS duration_s, round((max(idx) - 1) / 25.0::DOUBLE, 6) AS last_time_s FROM s GROUP BY ALL"


def slice_recordings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.slice_recordings(event_samples(spark, sf), 86400.0, 864000.0).select(*REC, "idx", "t_s", "value", "t0"))


SLICE = f"""WITH {S} SELECT recording_id, idx, round(t_s, 6) AS t_s, value, round(min(t_s) OVER (PARTITION BY recording_id), 6) AS t0 FROM s WHERE t_s BETWEEN 86400 AND 864000"""


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    s = event_samples(spark, sf)
    return T.align_trials(s.where("label = 'click'"), s.where("label = 'view'"))


def align_trials(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_aligned(spark, sf), 3)


_AL = f"""{S}, tg AS (SELECT recording_id, t_s, row_number() OVER (PARTITION BY recording_id ORDER BY t_s, idx) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM s WHERE label = 'click'),
tl AS (SELECT recording_id, t_s, row_number() OVER (PARTITION BY recording_id ORDER BY t_s, idx) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM s WHERE label = 'view'),
al AS (SELECT tg.recording_id, tg.k::INT AS trial_idx, tg.t_s AS trigger_s, tl.t_s AS trial_s, 1000 * (tl.t_s - tg.t_s) AS offset_ms
  FROM tg JOIN tl ON tl.recording_id = tg.recording_id AND tl.k = tg.k AND tl.n = tg.n)"""
ALIGN = f"WITH {_AL} SELECT recording_id, trial_idx, round(trigger_s, 3) AS trigger_s, round(trial_s, 3) AS trial_s, round(offset_ms, 3) AS offset_ms FROM al"


def fit_clock_drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.fit_clock_drift(_aligned(spark, sf)), 2)


DRIFT = f"""WITH {_AL}, f AS (SELECT recording_id, count(*) AS n_trials, regr_slope(offset_ms, trial_idx) AS b, regr_intercept(offset_ms, trial_idx) AS a FROM al GROUP BY ALL),
r AS (SELECT recording_id, stddev_samp(offset_ms - a - b * trial_idx) AS sd FROM al JOIN f USING (recording_id) GROUP BY ALL)
SELECT recording_id, n_trials, round(b, 2) AS slope_ms, round(a, 2) AS offset0_ms, round(sd, 2) AS residual_sd_ms, round(b * (n_trials - 1), 2) AS drift_ms FROM f JOIN r USING (recording_id)"""


def assign_block(spark: SparkSession, sf: str) -> DataFrame:
    """Windows: one to three days behind each purchase of a recording."""
    s = event_samples(spark, sf)
    w = s.where("label = 'purchase'").select(*REC, F.col("idx").alias("window"), F.col("t_s").alias("start"), (F.col("t_s") + 86400.0 * (1 + F.col("idx") % 3)).alias("end"))
    return T.assign_block(s, w, 259200.0).select(*REC, "idx", "window")


ASSIGN = f"""WITH {S}, w AS (SELECT recording_id, idx AS win, t_s AS a, t_s + 86400.0::DOUBLE * (1 + idx % 3) AS z FROM s WHERE label = 'purchase')
SELECT s.recording_id, s.idx, win AS "window" FROM s JOIN w ON w.recording_id = s.recording_id AND s.t_s BETWEEN a AND z"""


def from_timestamped(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.from_timestamped(event_samples(spark, sf)), 9)


TIMESTAMPED = f"""WITH {S}, d AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY recording_id ORDER BY idx) AS d FROM s)
SELECT recording_id, count(*) AS n, round(median(d), 9) AS step_s, round(1 / median(d), 9) AS fs, round(stddev_samp(d) / median(d), 9) AS jitter, stddev_samp(d) / median(d) > 0.01 AS jittery FROM d GROUP BY ALL"""


def list_channels(spark: SparkSession, sf: str) -> DataFrame:
    s = event_samples(spark, sf).withColumnRenamed("label", "channel").withColumn("units", F.when(F.col("channel") == "error", "count").otherwise("V"))
    return rounded(T.list_channels(s))


CHANNELS = f"""WITH {S}, g AS (SELECT recording_id, label AS channel, CASE WHEN label = 'error' THEN 'count' ELSE 'V' END AS units, count(*) AS n, min(t_s) AS first_s, max(t_s) AS last_s FROM s GROUP BY ALL)
SELECT recording_id, channel, units, n, round(first_s, 6) AS first_s, round(last_s, 6) AS last_s, (row_number() OVER (PARTITION BY recording_id ORDER BY channel))::INT AS index,
round((n - 1) / nullif(last_s - first_s, 0), 6) AS fs FROM g"""


def legacy_rate_fix(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "part").select("p_partkey", F.lit(2000.0).alias("fs_native"), (2000.0 / (F.col("p_size") * 4)).alias("fs"))
    return rounded(T.legacy_rate_fix(r).select("p_partkey", "q_req", "q_got", "fs_fixed"))


LEGACY = """WITH q AS (SELECT p_partkey, p_size * 4 AS q FROM part), g AS (
  SELECT *, CASE WHEN q <= 13 THEN q WHEN q // 13 <= 13 THEN 13 * (q // 13) ELSE 169 * (q // 169) END AS got FROM q)
SELECT p_partkey, q::INT AS q_req, got::INT AS q_got, round(2000.0::DOUBLE / got, 6) AS fs_fixed FROM g"""


def constant_check(spark: SparkSession, sf: str) -> DataFrame:
    return C.constant_check(event_samples(spark, sf))


CONSTANT = f"WITH {S} SELECT recording_id, max(value) - min(value) <= 2.0 ** -52 * greatest(1, abs(min(value)), abs(max(value))) AS constant, min(value) AS lo, max(value) AS hi FROM s GROUP BY ALL"


def clip_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.clip_quantiles(event_samples(spark, sf), 0.05, 0.95).select(*REC, "idx", "value", "clipped"))


CLIP = f"""WITH {S}, q AS (SELECT recording_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM s GROUP BY ALL)
SELECT s.recording_id, idx, round(least(greatest(value, lo), hi), 6) AS value, value < lo OR value > hi AS clipped FROM s JOIN q USING (recording_id)"""


def normalise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.normalise(event_samples(spark, sf)).select(*REC, "idx", "value"))


NORMALISE = f"""WITH {S}, m AS (SELECT recording_id, median(value) AS c, 1.4826 * mad(value) AS sc FROM s GROUP BY ALL)
SELECT s.recording_id, idx, round((value - c) / CASE WHEN sc > 0 THEN sc ELSE 1 END, 6) AS value FROM s JOIN m USING (recording_id)"""


def normalise_z(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.normalise(event_samples(spark, sf), "z").select(*REC, "idx", "value"))


NORMALISE_Z = f"WITH {S} SELECT recording_id, idx, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS value FROM s WINDOW w AS (PARTITION BY recording_id)"


def smooth_ma(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.smooth_ma(event_samples(spark, sf), 5).select(*REC, "idx", "value"))


SMOOTH_MA = f"""WITH {S} SELECT recording_id, idx, round(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w ELSE value END, 6) AS value FROM s
WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""


def smooth_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.smooth_gaussian(event_samples(spark, sf), 1.5).select(*REC, "idx", "value"))


SMOOTH_GAUSS = f"""WITH {S}, k AS (SELECT i, exp(-0.5 * (i / (1.5 / (2 * sqrt(2 * ln(2.0))))) ** 2) AS w FROM (VALUES (-2), (-1), (0), (1), (2)) v(i)),
z AS (SELECT s.recording_id, s.idx, sum(w * o.value) / (SELECT sum(w) FROM k) AS g, count(*) AS n FROM s CROSS JOIN k JOIN s o ON o.recording_id = s.recording_id AND o.idx = s.idx + i GROUP BY ALL)
SELECT s.recording_id, s.idx, round(CASE WHEN n = 5 THEN g ELSE value END, 6) AS value FROM s JOIN z USING (recording_id, idx)"""


def flatline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.flatline(_coded(spark, sf), 2))


FLAT = f"""WITH {_C}, r AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (SELECT *, (idx = 1 OR value IS DISTINCT FROM lag(value) OVER (PARTITION BY recording_id ORDER BY idx))::INT AS ch FROM c)),
u AS (SELECT recording_id, run, count(*) AS n, count(value) AS v FROM r GROUP BY ALL)
SELECT recording_id, round(100.0 * sum(CASE WHEN n >= 2 AND v > 0 THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS flat_pct, count(*) FILTER (n >= 2 AND v > 0) AS n_runs FROM u GROUP BY ALL"""


def saturation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.saturation(event_samples(spark, sf), 0.05))


SATURATION = f"""WITH {S}, b AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM s WINDOW w AS (PARTITION BY recording_id))
SELECT recording_id, round(100 * avg((value <= lo + 0.05 * (hi - lo) OR value >= hi - 0.05 * (hi - lo))::INT), 6) AS saturated_pct FROM b GROUP BY ALL"""


def missing_pct(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.missing_pct(_gappy(spark, sf)))


MISSING = f"WITH {_GAPPY} SELECT recording_id, round(100 * avg((value IS NULL)::INT), 6) AS missing_pct FROM c GROUP BY ALL"

QUERIES = {
    "split_nibbles": (split_nibbles, NIBBLES), "rigs_present": (rigs_present, RIGS), "decode_triggers": (decode_triggers, DECODE),
    "drop_pre_session": (drop_pre_session, DROP), "trigger_runs": (trigger_runs, f"WITH {_RUNS} SELECT recording_id, index, code, length FROM tr"),
    "trigger_edges": (trigger_edges, f"WITH {_RUNS} SELECT recording_id, index FROM tr WHERE length >= 2"), "resolve_idle": (resolve_idle, IDLE),
    "debounce_edges": (debounce_edges, DEBOUNCE), "trigger_events": (trigger_events, EVENTS), "trial_start_end_counts": (trial_start_end_counts, COUNTS),
    "block_bounds": (block_bounds, BLOCKS), "hardware_durations": (hardware_durations, HARDWARE), "accel_times": (accel_times, ACCEL),
    "packet_stats": (packet_stats, PACKETS), "make_grid": (make_grid, GRID), "interp_to_grid": (interp_to_grid, INTERP), "fill_gaps": (fill_gaps, FILL),
    "recording_duration": (recording_duration, DURATION), "slice_recordings": (slice_recordings, SLICE), "align_trials": (align_trials, ALIGN),
    "fit_clock_drift": (fit_clock_drift, DRIFT), "assign_block": (assign_block, ASSIGN), "from_timestamped": (from_timestamped, TIMESTAMPED),
    "list_channels": (list_channels, CHANNELS), "legacy_rate_fix": (legacy_rate_fix, LEGACY), "constant_check": (constant_check, CONSTANT),
    "clip_quantiles": (clip_quantiles, CLIP), "normalise": (normalise, NORMALISE), "normalise_z": (normalise_z, NORMALISE_Z), "smooth_ma": (smooth_ma, SMOOTH_MA),
    "smooth_gaussian": (smooth_gaussian, SMOOTH_GAUSS), "flatline": (flatline, FLAT), "saturation": (saturation, SATURATION), "missing_pct": (missing_pct, MISSING),
}
