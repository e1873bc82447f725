"""Queries over `events` as irregular recordings: extrema, breaths, flags, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.islands import REC, rounded
from ..operators import breaths as B
from ..operators import cohort as H
from ..operators import extrema as X
from ..sources.tables import SAMPLES_SQL, event_samples


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return X.turning_points(event_samples(spark, sf))


def _alternating(spark: SparkSession, sf: str) -> DataFrame:
    return X.enforce_alternation(_turns(spark, sf))


def _breaths(spark: SparkSession, sf: str, polarity: str = "up") -> DataFrame:
    """Durations here are minutes to hours, so the plausible range is wide."""
    return B.breath_table(_alternating(spark, sf), event_samples(spark, sf), polarity, 3600.0, 86400.0)


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return B.flag_breaths(_breaths(spark, sf))


def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return X.local_maxima(event_samples(spark, sf))


TURNS_SQL = f"""{SAMPLES_SQL},
r AS (SELECT *, sum(change) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (
  SELECT *, (idx = 1 OR value IS DISTINCT FROM lag(value) OVER (PARTITION BY recording_id ORDER BY idx))::INT AS change FROM s)),
runs AS (SELECT recording_id, run, any_value(value) AS value, min(idx) AS start, count(*) AS n FROM r GROUP BY ALL),
nb AS (SELECT *, lag(value) OVER w AS before, lead(value) OVER w AS after FROM runs WINDOW w AS (PARTITION BY recording_id ORDER BY run)),
ex AS (SELECT recording_id, start + (n - 1) // 2 AS idx, value, CASE WHEN value > before THEN 'peak' ELSE 'trough' END AS kind
  FROM nb WHERE (value > before AND value > after) OR (value < before AND value < after))"""
LOCAL_MAXIMA_SQL = f"WITH {TURNS_SQL} SELECT recording_id, idx, value FROM ex WHERE kind = 'peak'"

ALT_SQL = f"""{TURNS_SQL},
k AS (SELECT *, sum(change) OVER (PARTITION BY recording_id ORDER BY idx) AS krun FROM (
  SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY recording_id ORDER BY idx))::INT AS change FROM ex)),
alt AS (SELECT recording_id, idx, value, kind FROM k
  QUALIFY row_number() OVER (PARTITION BY recording_id, krun ORDER BY CASE WHEN kind = 'peak' THEN -value ELSE value END, idx) = 1)"""


def enforce_alternation(spark: SparkSession, sf: str) -> DataFrame:
    """On peaks above 10 and troughs below 60, so that runs of one kind occur."""
    return X.enforce_alternation(_turns(spark, sf).where("(kind = 'peak' and value > 40) or (kind = 'trough' and value < 30)"))


def enforce_alternation_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return X.enforce_alternation(_turns(spark, sf).where("(kind = 'peak' and value > 40) or (kind = 'trough' and value < 30)"), "nearest")


_SOME = "(kind = 'peak' AND value > 40) OR (kind = 'trough' AND value < 30)"
_KRUNS = f"""{TURNS_SQL}, f AS (SELECT * FROM ex WHERE {_SOME}),
k AS (SELECT *, sum(change) OVER (PARTITION BY recording_id ORDER BY idx) AS krun FROM (
  SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY recording_id ORDER BY idx))::INT AS change FROM f))"""
ALTERNATION_SQL = f"""WITH {_KRUNS} SELECT recording_id, idx, value, kind FROM k
  QUALIFY row_number() OVER (PARTITION BY recording_id, krun ORDER BY CASE WHEN kind = 'peak' THEN -value ELSE value END, idx) = 1"""
NEAREST_SQL = f"""WITH {_KRUNS}, n AS (SELECT recording_id, krun - 1 AS krun, min(idx) AS nxt FROM k GROUP BY ALL)
SELECT k.recording_id, idx, value, kind FROM k LEFT JOIN n USING (recording_id, krun)
  QUALIFY row_number() OVER (PARTITION BY k.recording_id, krun ORDER BY coalesce(nxt - idx, -idx)) = 1"""

BREATHS_SQL = f"""{ALT_SQL},
a AS (SELECT alt.*, t_s, sum((kind = 'trough')::INT) OVER (PARTITION BY alt.recording_id ORDER BY alt.idx) AS cycle
  FROM alt JOIN s USING (recording_id, idx)),
c AS (SELECT recording_id, cycle AS breath, idx AS i_start, t_s AS t_start, a.value AS v_start, lead(idx) OVER w AS i_end,
  lead(t_s) OVER w AS t_end, lead(a.value) OVER w AS v_end FROM a WHERE kind = 'trough' WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
p AS (SELECT recording_id, cycle AS breath, any_value(idx) AS i_peak, any_value(t_s) AS t_peak, any_value(value) AS v_peak
  FROM a WHERE kind = 'peak' GROUP BY ALL HAVING count(*) = 1),
b AS (SELECT c.recording_id, c.breath, i_start, i_peak, i_end, t_start, t_peak, t_end, t_end - t_start AS duration,
  t_peak - t_start AS inhale_dur, t_end - t_peak AS exhale_dur, (t_peak - t_start) / (t_end - t_start) AS duty_cycle,
  (t_peak - t_start) / (t_end - t_peak) AS ie_ratio, 60 / (t_end - t_start) AS rate_bpm, v_peak - v_start AS amp_inhale,
  v_peak - v_end AS amp_exhale, ((v_peak - v_start) + (v_peak - v_end)) / 2 AS amplitude, v_start AS baseline,
  ((v_peak - v_start) + (v_peak - v_end)) / 2 / (t_end - t_start) AS rvt, (v_peak - v_start) / (t_peak - t_start) AS flow_in,
  (v_peak - v_end) / (t_end - t_peak) AS flow_out, i_peak IS NOT NULL AS has_peak,
  (t_end - t_start < 3600 OR t_end - t_start > 86400) AS implausible
  FROM c LEFT JOIN p USING (recording_id, breath) WHERE i_end IS NOT NULL),
m AS (SELECT recording_id, median(amplitude) AS amp, median(duration) AS med, 1.4826 * mad(duration) AS madd FROM b GROUP BY ALL),
fl AS (SELECT b.*, coalesce(amplitude <= 0, false) AS bad_amplitude, coalesce(amp > 0 AND amplitude < 0.2 * amp, false) AS low_amplitude,
  coalesce(madd > 2.0 ** -26 * greatest(1, abs(med)) AND abs(duration - med) > 5 * madd, false) AS duration_outlier FROM b JOIN m USING (recording_id)),
kp AS (SELECT *, NOT implausible AND NOT bad_amplitude AND NOT low_amplitude AND NOT duration_outlier AS keep FROM fl)"""
_DOUBLES = ["t_start", "t_peak", "t_end", "duration", "inhale_dur", "exhale_dur", "duty_cycle", "ie_ratio", "rate_bpm", "amp_inhale", "amp_exhale", "amplitude", "baseline", "rvt", "flow_in", "flow_out"]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _DOUBLES)


def breath_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_breaths(spark, sf))


BREATH_TABLE_SQL = f"WITH {BREATHS_SQL} SELECT recording_id, breath, i_start, i_peak, i_end, {_ROUNDED}, has_peak, implausible FROM b"


def flag_breaths(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf).select(*REC, "breath", "bad_amplitude", "low_amplitude", "duration_outlier", "keep")


FLAGS_SQL = f"WITH {BREATHS_SQL} SELECT recording_id, breath, bad_amplitude, low_amplitude, duration_outlier, keep FROM kp"


def polarity_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.polarity_verdict(_breaths(spark, sf)))


POLARITY_SQL = f"""WITH {BREATHS_SQL}, d AS (SELECT recording_id, median(duty_cycle) AS u FROM b GROUP BY ALL)
SELECT recording_id, round(u, 6) AS duty_cycle_up, round(1 - u, 6) AS duty_cycle_down,
  CASE WHEN u < 0.5 THEN 'up' WHEN u IS NOT NULL THEN 'down' END AS suggestion, coalesce(abs(u - 0.5) >= 0.05, false) AS confident FROM d"""


def summarise_breaths(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.summarise_breaths(_flagged(spark, sf)))


SUMMARY_SQL = f"""WITH {BREATHS_SQL},
d AS (SELECT *, (duration - lag(duration) OVER w) ** 2 AS d2, row_number() OVER w AS k FROM kp WHERE keep WINDOW w AS (PARTITION BY recording_id ORDER BY breath)),
tot AS (SELECT recording_id, count(*) AS n_breaths_total FROM kp GROUP BY ALL),
f AS (SELECT recording_id, count(*) AS n_breaths, count(*) FILTER (NOT has_peak) AS n_breaths_no_peak, sum(duration) AS window_coverage_s,
  avg(duration) AS duration_mean, median(duration) AS duration_median, stddev_samp(duration) AS duration_sd,
  stddev_samp(duration) / avg(duration) AS duration_cv, sqrt(avg(d2)) AS duration_rmssd,
  CASE WHEN count(*) > 1 THEN regr_slope(duration, k) END AS duration_slope_per_breath,
  CASE WHEN count(*) > 1 THEN regr_slope(duration, t_start) END AS duration_slope_per_s,
  avg(rate_bpm) AS rate_bpm_mean, 60 / avg(duration) AS rate_from_mean_duration, avg(inhale_dur) AS inhale_dur_mean,
  avg(exhale_dur) AS exhale_dur_mean, avg(duty_cycle) AS duty_cycle_mean, median(ie_ratio) AS ie_ratio_median,
  avg(amplitude) AS amplitude_mean, median(amplitude) AS amplitude_median, stddev_samp(amplitude) AS amplitude_sd,
  stddev_samp(amplitude) / abs(avg(amplitude)) AS amplitude_cv,
  CASE WHEN count(*) > 1 THEN regr_slope(amplitude, k) END AS amplitude_slope_per_breath,
  avg(rvt) AS rvt_mean, avg(flow_in) AS flow_in_mean, avg(flow_out) AS flow_out_mean,
  CASE WHEN count(*) > 1 THEN regr_slope(baseline, t_start) END AS baseline_drift FROM d GROUP BY ALL)
SELECT recording_id, n_breaths_total, coalesce(n_breaths, 0) AS n_breaths, coalesce(n_breaths_no_peak, 0) AS n_breaths_no_peak,
  round(coalesce(window_coverage_s, 0), 6) AS window_coverage_s, round(100.0 * (n_breaths_total - coalesce(n_breaths, 0)) / n_breaths_total, 6) AS pct_breaths_rejected,
  {", ".join(f"round({c}, 6) AS {c}" for c in "duration_mean duration_median duration_sd duration_cv duration_rmssd duration_slope_per_breath duration_slope_per_s rate_bpm_mean rate_from_mean_duration inhale_dur_mean exhale_dur_mean duty_cycle_mean ie_ratio_median amplitude_mean amplitude_median amplitude_sd amplitude_cv amplitude_slope_per_breath rvt_mean flow_in_mean flow_out_mean baseline_drift".split())}
FROM tot LEFT JOIN f USING (recording_id)"""


def peak_prominence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.peak_prominence(event_samples(spark, sf)))


#: Nearest strictly higher sample on each side, then the lowest value between: a self-join within recordings of bounded length.
PROMINENCE_SQL = f"""{TURNS_SQL},
pk AS (SELECT recording_id, idx, value FROM ex WHERE kind = 'peak'),
bd AS (SELECT p.recording_id, p.idx, p.value, coalesce(max(q.idx) FILTER (q.idx < p.idx), 0) AS lo, coalesce(min(q.idx) FILTER (q.idx > p.idx), 1000000000) AS hi
  FROM pk p LEFT JOIN s q ON q.recording_id = p.recording_id AND q.value > p.value GROUP BY ALL),
pr AS (SELECT b.recording_id, b.idx, b.value, b.value - greatest(min(s.value) FILTER (s.idx <= b.idx), min(s.value) FILTER (s.idx >= b.idx)) AS prominence
  FROM bd b JOIN s ON s.recording_id = b.recording_id AND s.idx > b.lo AND s.idx < b.hi GROUP BY b.recording_id, b.idx, b.value)"""
PEAK_PROMINENCE_SQL = f"WITH {PROMINENCE_SQL} SELECT recording_id, idx, value, round(prominence, 6) AS prominence FROM pr"


def prominence_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.prominence_distribution(X.peak_prominence(event_samples(spark, sf))))


PROMINENCE_DISTRIBUTION_SQL = f"""WITH {PROMINENCE_SQL} SELECT recording_id, count(*) AS n_maxima, round(min(prominence), 6) AS p_min,
  round(quantile_cont(prominence, 0.25), 6) AS p_q25, round(median(prominence), 6) AS p_median, round(max(prominence), 6) AS p_max FROM pr GROUP BY ALL"""


def prominence_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return X.prominence_sweep(X.peak_prominence(event_samples(spark, sf)), [10.0, 20.0, 40.0, 80.0], 4.0)


#: The heaviest left of each recording and threshold is taken in turn, and its neighbours go.
PROMINENCE_SWEEP_SQL = f"""WITH RECURSIVE {PROMINENCE_SQL},
th AS (SELECT pr.*, threshold::DOUBLE AS threshold FROM pr, (VALUES (10), (20), (40), (80)) g(threshold)),
q AS (SELECT recording_id, threshold, idx, row_number() OVER (PARTITION BY recording_id, threshold ORDER BY prominence DESC, idx) AS rk FROM th WHERE prominence >= threshold),
st AS (SELECT recording_id, threshold, []::BIGINT[] AS taken, 1 AS rk FROM (SELECT DISTINCT recording_id, threshold FROM q)
  UNION ALL SELECT st.recording_id, st.threshold, CASE WHEN len(list_filter(st.taken, lambda x: abs(x - q.idx) < 4)) = 0 THEN list_append(st.taken, q.idx) ELSE st.taken END, st.rk + 1
  FROM st JOIN q ON q.recording_id = st.recording_id AND q.threshold = st.threshold AND q.rk = st.rk),
fin AS (SELECT recording_id, threshold, list_sort(arg_max(taken, rk)) AS taken FROM st GROUP BY ALL),
n AS (SELECT recording_id, threshold, sum((prominence >= threshold)::BIGINT)::BIGINT AS kept, sum((prominence < threshold)::BIGINT)::BIGINT AS dropped FROM th GROUP BY ALL)
SELECT n.*, coalesce(len(taken), 0)::BIGINT AS spaced, list_median(list_transform(range(2, len(taken) + 1), lambda i: taken[i] - taken[i - 1])) AS median_step
FROM n LEFT JOIN fin USING (recording_id, threshold)"""


def min_distance_filter(spark: SparkSession, sf: str) -> DataFrame:
    top = X.peak_prominence(event_samples(spark, sf)).where("prominence >= 20")
    return rounded(X.greedy_spacing(top, 4.0, "prominence"))


#: The heaviest left of each recording is taken in turn, and its neighbours go.
MIN_DISTANCE_SQL = f"""WITH RECURSIVE {PROMINENCE_SQL},
q AS (SELECT recording_id, idx, value, prominence, row_number() OVER (PARTITION BY recording_id ORDER BY prominence DESC, idx) AS rk FROM pr WHERE prominence >= 20),
st AS (SELECT recording_id, []::BIGINT[] AS taken, 1 AS rk FROM (SELECT DISTINCT recording_id FROM q)
  UNION ALL SELECT st.recording_id, CASE WHEN len(list_filter(st.taken, lambda x: abs(x - q.idx) < 4)) = 0 THEN list_append(st.taken, q.idx) ELSE st.taken END, st.rk + 1
  FROM st JOIN q ON q.recording_id = st.recording_id AND q.rk = st.rk),
fin AS (SELECT recording_id, arg_max(taken, rk) AS taken FROM st GROUP BY ALL)
SELECT q.recording_id, q.idx, q.value, round(q.prominence, 6) AS prominence FROM q JOIN fin USING (recording_id) WHERE list_contains(taken, q.idx)"""


def extrema_prominence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.extrema_prominence(event_samples(spark, sf), 30.0, 5.0))


EXTREMA_PROMINENCE_SQL = f"""WITH RECURSIVE {PROMINENCE_SQL},
tr AS (SELECT recording_id, idx, value FROM ex WHERE kind = 'trough'),
bt AS (SELECT p.recording_id, p.idx, p.value, coalesce(max(q.idx) FILTER (q.idx < p.idx), 0) AS lo, coalesce(min(q.idx) FILTER (q.idx > p.idx), 1000000000) AS hi
  FROM tr p LEFT JOIN s q ON q.recording_id = p.recording_id AND q.value < p.value GROUP BY ALL),
pt AS (SELECT b.recording_id, b.idx, b.value, least(max(s.value) FILTER (s.idx <= b.idx), max(s.value) FILTER (s.idx >= b.idx)) - b.value AS prominence
  FROM bt b JOIN s ON s.recording_id = b.recording_id AND s.idx > b.lo AND s.idx < b.hi GROUP BY b.recording_id, b.idx, b.value),
al AS (SELECT *, 'peak' AS kind FROM pr WHERE prominence >= 30 UNION ALL SELECT *, 'trough' FROM pt WHERE prominence >= 30),
q AS (SELECT *, row_number() OVER (PARTITION BY recording_id, kind ORDER BY prominence DESC, idx) AS rk FROM al),
sg AS (SELECT recording_id, kind, []::BIGINT[] AS taken, 1 AS rk FROM (SELECT DISTINCT recording_id, kind FROM q)
  UNION ALL SELECT sg.recording_id, sg.kind, CASE WHEN len(list_filter(sg.taken, lambda x: abs(x - q.idx) < 5)) = 0 THEN list_append(sg.taken, q.idx) ELSE sg.taken END, sg.rk + 1
  FROM sg JOIN q ON q.recording_id = sg.recording_id AND q.kind = sg.kind AND q.rk = sg.rk),
fin AS (SELECT recording_id, kind, arg_max(taken, rk) AS taken FROM sg GROUP BY ALL)
SELECT q.recording_id, q.idx, q.value, round(q.prominence, 6) AS prominence, q.kind FROM q JOIN fin USING (recording_id, kind) WHERE list_contains(taken, q.idx)"""


def extrema_zerocross(spark: SparkSession, sf: str) -> DataFrame:
    return X.extrema_zerocross(event_samples(spark, sf))


ZEROCROSS_SQL = f"""WITH {SAMPLES_SQL}, x AS (SELECT *, value - avg(value) OVER (PARTITION BY recording_id) AS x FROM s),
u AS (SELECT *, x >= 0 AS up, coalesce((lead(x >= 0) OVER w) <> (x >= 0), false) AS cut FROM x WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
cuts AS (SELECT recording_id, idx, up, row_number() OVER w AS seg, lead(idx) OVER w AS nxt FROM u WHERE cut WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
e AS (SELECT c.recording_id, c.seg, CASE WHEN c.up THEN 'trough' ELSE 'peak' END AS kind, u.idx, u.value, u.x FROM cuts c
  JOIN u ON u.recording_id = c.recording_id AND u.idx BETWEEN c.idx AND c.nxt
  QUALIFY row_number() OVER (PARTITION BY c.recording_id, c.seg ORDER BY CASE WHEN c.up THEN u.x ELSE -u.x END, u.idx) = 1),
d AS (SELECT *, abs(x - lag(x) OVER w) AS back, abs(x - lead(x) OVER w) AS ahead, count(*) OVER (PARTITION BY recording_id) AS n FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY seg)),
g AS (SELECT *, avg(back) OVER (PARTITION BY recording_id) AS mean FROM d)
SELECT recording_id, idx, value, kind FROM g WHERE n < 3 OR least(coalesce(back, ahead), coalesce(ahead, back)) >= 0.3 * mean"""


def refine_extrema(spark: SparkSession, sf: str) -> DataFrame:
    return X.refine_extrema(_turns(spark, sf), event_samples(spark, sf), 3)


REFINED_SQL = f"""{TURNS_SQL},
nr AS (SELECT ex.recording_id, ex.idx AS at_idx, ex.kind, s.idx, s.value, CASE WHEN ex.kind = 'peak' THEN s.value ELSE -s.value END AS h
  FROM ex JOIN s ON s.recording_id = ex.recording_id AND s.idx BETWEEN ex.idx - 3 AND ex.idx + 3),
ti AS (SELECT * FROM nr QUALIFY h = max(h) OVER (PARTITION BY recording_id, at_idx, kind)),
rf AS (SELECT recording_id, at_idx, kind, idx, value FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY recording_id, at_idx, kind) AS n FROM ti
  WINDOW w AS (PARTITION BY recording_id, at_idx, kind ORDER BY idx)) WHERE r = (n + 1) // 2)"""
REFINE_SQL = f"WITH {REFINED_SQL} SELECT recording_id, at_idx AS \"at\", kind, idx, value FROM rf"


def collapse_refined(spark: SparkSession, sf: str) -> DataFrame:
    return X.collapse_refined(refine_extrema(spark, sf))


COLLAPSE_SQL = f"WITH {REFINED_SQL} SELECT recording_id, idx, any_value(kind) AS kind, any_value(value) AS value FROM rf GROUP BY recording_id, idx HAVING count(DISTINCT kind) = 1"


def _peaks(spark: SparkSession, sf: str) -> DataFrame:
    return X.local_maxima(event_samples(spark, sf)).join(event_samples(spark, sf).select(*REC, "idx", "t_s"), [*REC, "idx"])


def first_paced_onset(spark: SparkSession, sf: str) -> DataFrame:
    return X.first_paced_onset(_peaks(spark, sf), 20_000.0, 4)


FIRST_PACED_SQL = f"""WITH {TURNS_SQL}, p AS (SELECT recording_id, t_s FROM ex JOIN s USING (recording_id, idx) WHERE kind = 'peak'),
d AS (SELECT *, (lead(t_s) OVER w - t_s >= 20000)::INT AS slow FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY t_s)),
z AS (SELECT *, sum(slow) OVER (PARTITION BY recording_id ORDER BY t_s ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM d)
SELECT recording_id, min(t_s) AS first_onset_s FROM z WHERE k = 3 GROUP BY ALL"""


def peak_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.peak_intervals(_peaks(spark, sf), 20_000.0))


PEAK_INTERVALS_SQL = f"""WITH {TURNS_SQL}, p AS (SELECT recording_id, t_s FROM ex JOIN s USING (recording_id, idx) WHERE kind = 'peak')
SELECT recording_id, (row_number() OVER w)::INT AS peak_num, round(t_s, 6) AS t_s, round(lead(t_s) OVER w - t_s, 6) AS interval_s, lead(t_s) OVER w - t_s >= 20000 AS slow
FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY t_s)"""


def durations_ms(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.durations_ms(_peaks(spark, sf), 3_600_000.0, 86_400_000.0).select(*REC, "t_s", "duration_ms"), 3)


_GAPS = f"""{TURNS_SQL}, p AS (SELECT recording_id, t_s, 1000 * (t_s - lag(t_s) OVER (PARTITION BY recording_id ORDER BY t_s)) AS d
  FROM ex JOIN s USING (recording_id, idx) WHERE kind = 'peak')"""
DURATIONS_SQL = f"WITH {_GAPS} SELECT recording_id, round(t_s, 3) AS t_s, round(d, 3) AS duration_ms FROM p WHERE d BETWEEN 3600000 AND 86400000"


def dropped_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return B.dropped_intervals(_peaks(spark, sf), 3_600_000.0, 86_400_000.0)


DROPPED_SQL = f"WITH {_GAPS} SELECT recording_id, count(*) FILTER (d NOT BETWEEN 3600000 AND 86400000) AS n_dropped, count(d) AS n_intervals FROM p GROUP BY ALL"


def block_variability(spark: SparkSession, sf: str) -> DataFrame:
    b = _breaths(spark, sf).withColumn("block", F.floor(F.col("t_start") / 604800).cast("int"))
    return rounded(B.block_variability(b, ("recording_id", "block")))


BLOCK_VARIABILITY_SQL = f"""WITH {BREATHS_SQL}, w AS (SELECT recording_id, floor(t_start / 604800)::INT AS block, duration,
  (duration - lag(duration) OVER (PARTITION BY recording_id, floor(t_start / 604800) ORDER BY t_start)) ** 2 AS d2 FROM b)
SELECT recording_id, block, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN stddev_samp(duration) / avg(duration) END, 6) AS cv,
  round(CASE WHEN count(*) >= 5 THEN sqrt(avg(d2)) END, 6) AS rmssd, round(CASE WHEN count(*) >= 5 THEN stddev_samp(duration) END, 6) AS sd FROM w GROUP BY ALL"""


def duty_cycle_simple(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.duty_cycle_simple(_alternating(spark, sf)))


DUTY_SQL = f"""WITH {BREATHS_SQL} SELECT recording_id, round(median((i_peak - i_start) / (i_end - i_start)), 6) AS duty_cycle, count(*) AS n
FROM b WHERE i_peak IS NOT NULL GROUP BY ALL"""


def depths_z(spark: SparkSession, sf: str) -> DataFrame:
    onsets = _alternating(spark, sf).where("kind = 'trough'")
    return rounded(B.depths_z(event_samples(spark, sf), onsets))


DEPTHS_SQL = f"""WITH {BREATHS_SQL}, d AS (SELECT b.recording_id, b.breath, count(*) AS n, max(s.value) - min(s.value) AS depth FROM b
  JOIN s ON s.recording_id = b.recording_id AND s.idx BETWEEN b.i_start AND b.i_end GROUP BY ALL HAVING count(*) >= 3)
SELECT recording_id, breath, round(depth, 6) AS depth, round((depth - avg(depth) OVER w) / stddev_samp(depth) OVER w, 6) AS depth_z
FROM d WINDOW w AS (PARTITION BY recording_id)"""


def variability(spark: SparkSession, sf: str) -> DataFrame:
    """Of the sample values of each recording, in order."""
    return rounded(B.variability(event_samples(spark, sf), "value", "idx", "t_s"))


VARIABILITY_SQL = f"""WITH {SAMPLES_SQL}, d AS (SELECT *, (value - lag(value) OVER (PARTITION BY recording_id ORDER BY idx)) ** 2 AS d2 FROM s)
SELECT recording_id, count(value) AS n, round(avg(value), 6) AS v_mean, round(median(value), 6) AS v_median, round(stddev_samp(value), 6) AS v_sd,
  round(stddev_samp(value) / abs(avg(value)), 6) AS v_cv, round(sqrt(avg(d2)), 6) AS v_rmssd, round(regr_slope(value, idx), 6) AS v_slope_per_breath,
  round(regr_slope(value, t_s), 6) AS v_slope_per_s FROM d GROUP BY ALL"""


def cohort_medians(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.cohort_medians(_flagged(spark, sf)), 9)


COHORT_SQL = f"""WITH {BREATHS_SQL}, e AS (SELECT recording_id, median(duration) AS d, median(duty_cycle) AS u FROM kp WHERE keep GROUP BY ALL)
SELECT count(*) AS n, round(median(d), 9) AS duration_s, round(60 / median(d), 9) AS rate_bpm, round(median(u), 9) AS duty_cycle FROM e"""


def dist_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.dist_summary(event_samples(spark, sf), "value", ("label",)))


DIST_SQL = f"""WITH {SAMPLES_SQL} SELECT label, count(value) AS n, round(min(value), 6) AS "min", round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median,
  round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS "max", round(stddev_samp(value), 6) AS sd FROM s GROUP BY ALL"""

QUERIES = {
    "summarise_breaths": (summarise_breaths, SUMMARY_SQL),
    "local_maxima": (local_maxima, LOCAL_MAXIMA_SQL),
    "enforce_alternation": (enforce_alternation, ALTERNATION_SQL),
    "enforce_alternation_nearest": (enforce_alternation_nearest, NEAREST_SQL),
    "breath_table": (breath_table, BREATH_TABLE_SQL),
    "flag_breaths": (flag_breaths, FLAGS_SQL),
    "polarity_verdict": (polarity_verdict, POLARITY_SQL),
    "peak_prominence": (peak_prominence, PEAK_PROMINENCE_SQL),
    "prominence_distribution": (prominence_distribution, PROMINENCE_DISTRIBUTION_SQL),
    "prominence_sweep": (prominence_sweep, PROMINENCE_SWEEP_SQL),
    "min_distance_filter": (min_distance_filter, MIN_DISTANCE_SQL),
    "extrema_prominence": (extrema_prominence, EXTREMA_PROMINENCE_SQL),
    "extrema_zerocross": (extrema_zerocross, ZEROCROSS_SQL),
    "refine_extrema": (refine_extrema, REFINE_SQL),
    "collapse_refined": (collapse_refined, COLLAPSE_SQL),
    "first_paced_onset": (first_paced_onset, FIRST_PACED_SQL),
    "peak_intervals": (peak_intervals, PEAK_INTERVALS_SQL),
    "durations_ms": (durations_ms, DURATIONS_SQL),
    "dropped_intervals": (dropped_intervals, DROPPED_SQL),
    "block_variability": (block_variability, BLOCK_VARIABILITY_SQL),
    "duty_cycle_simple": (duty_cycle_simple, DUTY_SQL),
    "depths_z": (depths_z, DEPTHS_SQL),
    "variability": (variability, VARIABILITY_SQL),
    "cohort_medians": (cohort_medians, COHORT_SQL),
    "dist_summary": (dist_summary, DIST_SQL),
}
