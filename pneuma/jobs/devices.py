"""Queries over two devices, pacers and recordings' codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.islands import REC, rounded
from ..operators import cohort as H
from ..operators import devices as D
from ..operators import session as N
from ..operators import trials as T
from ..sources.tables import SAMPLES_SQL, event_samples, read
from .assembly import _AX, _axes
from .recordings import ALT_SQL, _alternating

S = SAMPLES_SQL


def cross_coherence(spark: SparkSession, sf: str) -> DataFrame:
    p = _axes(spark, sf).select(F.col("participant_id").alias("recording_id"), "idx", F.col("x").alias("a"), F.col("y").alias("b"))
    return rounded(D.cross_coherence(p, 25.0, 32).select(*REC, "bin", "freq", "n", "coherence", F.when(F.col("bin") > 0, F.cos("phase")).alias("cos_phase")), 5)


COHERENCE = f"""WITH {_AX}, sg AS (SELECT participant_id, g, idx - 1 - 16 * g AS i, x, y FROM ax, range(0, 3) t(g) WHERE idx - 1 BETWEEN 16 * g AND 16 * g + 31),
h AS (SELECT participant_id, g, i, (x - avg(x) OVER w) * 0.5 * (1 - cos(2 * pi() * i / 31)) AS a, (y - avg(y) OVER w) * 0.5 * (1 - cos(2 * pi() * i / 31)) AS b FROM sg WINDOW w AS (PARTITION BY participant_id, g)),
ft AS (SELECT participant_id, g, k, sum(a * cos(2 * pi() * k * i / 32)) AS ar, sum(a * sin(2 * pi() * k * i / 32)) AS ai, sum(b * cos(2 * pi() * k * i / 32)) AS br, sum(b * sin(2 * pi() * k * i / 32)) AS bi FROM h, range(0, 16) t(k) GROUP BY ALL),
cs AS (SELECT participant_id, k, count(*) AS n, sum(ar * ar + ai * ai) AS paa, sum(br * br + bi * bi) AS pbb, sum(ar * br + ai * bi) AS re, sum(ar * bi - ai * br) AS im FROM ft GROUP BY ALL)
SELECT participant_id AS recording_id, k::INT AS bin, round(k * 25.0::DOUBLE / 32, 5) AS freq, n, round((re * re + im * im) / (paa * pbb), 5) AS coherence, CASE WHEN k > 0 THEN round(re / sqrt(re * re + im * im), 5) END AS cos_phase FROM cs"""


def _commanded(spark: SparkSession, sf: str) -> DataFrame:
    """Four breaths half a day apart behind each purchase."""
    p = event_samples(spark, sf).where("label = 'purchase'").select(*REC, F.col("idx").alias("trial"), "t_s", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("breath"))
    return p.withColumn("t_s", F.col("t_s") + 43200.0 * F.col("breath"))


_CMD = "cm AS (SELECT recording_id, idx AS trial, k::INT AS breath, t_s + 43200.0::DOUBLE * k AS due FROM s, range(1, 5) r(k) WHERE label = 'purchase')"


def offset_per_breath(spark: SparkSession, sf: str) -> DataFrame:
    on = event_samples(spark, sf).where("label = 'click'")
    return rounded(D.offset_per_breath(on, _commanded(spark, sf), 20000.0))


OFFSET = f"""WITH {S}, {_CMD} SELECT cm.recording_id, trial, breath, round(s.t_s - due, 6) AS offset_s FROM cm JOIN s ON s.recording_id = cm.recording_id AND label = 'click' AND abs(s.t_s - due) <= 20000
QUALIFY row_number() OVER (PARTITION BY cm.recording_id, trial, breath ORDER BY abs(s.t_s - due), s.t_s) = 1"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    p = event_samples(spark, sf).where("label = 'purchase'")
    return p.select(*REC, F.col("idx").alias("trial"), F.col("t_s").alias("start"), (F.col("t_s") + 172800.0).alias("end"), F.lit(40000.0).alias("base"), (F.lit(40000.0) + 100 * F.col("code")).alias("changed"))


_W = "w AS (SELECT recording_id, idx AS trial, t_s AS a, t_s + 172800.0::DOUBLE AS z, 40000.0::DOUBLE + 100 * code AS ch FROM s WHERE label = 'purchase')"


def adherence_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.adherence_corr(event_samples(spark, sf), _windows(spark, sf), 320.0).where("n >= 5"))


ADHERENCE = f"""WITH {S}, {_W}, x AS (SELECT w.recording_id, trial, value, CASE WHEN t_s - 320 <= a + 80000 THEN (1 - cos(2 * pi() * (t_s - 320 - a) / 40000)) / 2 ELSE (1 - cos(2 * pi() * (t_s - 320 - a - 80000) / ch)) / 2 END AS p
  FROM s JOIN w ON w.recording_id = s.recording_id AND t_s - 320 BETWEEN a AND z) SELECT recording_id, trial, count(*) AS n, round(corr(value, p), 6) AS r FROM x GROUP BY ALL HAVING count(*) >= 5"""


def trial_breaths(spark: SparkSession, sf: str) -> DataFrame:
    t = _alternating(spark, sf).where("kind = 'trough'").join(event_samples(spark, sf).select(*REC, "idx", "t_s"), [*REC, "idx"])
    return rounded(D.trial_breaths(t, _windows(spark, sf), 3600.0, 259200.0), 4)


TRIAL_BREATHS = f"""WITH {ALT_SQL}, {_W}, tr AS (SELECT recording_id, t_s FROM alt JOIN s USING (recording_id, idx) WHERE kind = 'trough'),
h AS (SELECT w.recording_id, trial, t_s - lag(t_s) OVER (PARTITION BY w.recording_id, trial ORDER BY t_s) AS gap FROM w JOIN tr ON tr.recording_id = w.recording_id AND t_s BETWEEN a - 3600 AND z + 3600),
g AS (SELECT recording_id, trial, count(*) AS n, count(gap) AS b, avg(gap) AS m FROM h GROUP BY ALL)
SELECT w.recording_id, w.trial, coalesce(n, 0) AS n_troughs, coalesce(b, 0) AS n_breaths, round(m, 4) AS mean_s FROM w LEFT JOIN g ON g.recording_id = w.recording_id AND g.trial = w.trial"""


def match_expected_breaths(spark: SparkSession, sf: str) -> DataFrame:
    """Four expected breaths of half a day from the first detected one of each window."""
    t = _alternating(spark, sf).where("kind = 'trough'").join(event_samples(spark, sf).select(*REC, "idx", "t_s"), [*REC, "idx"])
    w = _windows(spark, sf)
    due = w.select(*REC, "trial", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("breath")).withColumn("offset_s", 43200.0 * (F.col("breath") - 1))
    return rounded(T.match_expected_breaths(t, w, due, 20000.0, 259200.0), 4)


EXPECTED = f"""WITH RECURSIVE {ALT_SQL}, {_W}, tr AS (SELECT recording_id, idx, t_s FROM alt JOIN s USING (recording_id, idx) WHERE kind = 'trough'),
f AS (SELECT w.recording_id * 1000000 + trial AS key, tr.idx, t_s FROM w JOIN tr ON tr.recording_id = w.recording_id AND t_s BETWEEN a AND z),
due AS (SELECT key, k AS idx, fst + 43200.0::DOUBLE * (k - 1) AS t_s FROM (SELECT key, min(t_s) AS fst FROM f GROUP BY ALL), range(1, 5) r(k)),
pr AS (SELECT due.key, due.idx AS a_idx, due.t_s AS a_t, f.idx AS b_idx, f.t_s AS b_t, row_number() OVER (PARTITION BY due.key ORDER BY abs(due.t_s - f.t_s), f.idx, due.idx) AS rk FROM due JOIN f ON f.key = due.key AND abs(due.t_s - f.t_s) <= 20000),
st AS (SELECT key, []::BIGINT[] AS ua, []::BIGINT[] AS ub, []::BIGINT[] AS won, 1 AS rk FROM (SELECT DISTINCT key FROM pr)
  UNION ALL SELECT st.key, CASE WHEN list_contains(ua, a_idx) OR list_contains(ub, b_idx) THEN ua ELSE list_append(ua, a_idx) END, CASE WHEN list_contains(ua, a_idx) OR list_contains(ub, b_idx) THEN ub ELSE list_append(ub, b_idx) END,
    CASE WHEN list_contains(ua, a_idx) OR list_contains(ub, b_idx) THEN won ELSE list_append(won, st.rk) END, st.rk + 1 FROM st JOIN pr ON pr.key = st.key AND pr.rk = st.rk),
fin AS (SELECT key, arg_max(won, rk) AS won FROM st GROUP BY ALL),
m AS (SELECT pr.key, count(*) AS n, avg(abs(a_t - b_t)) AS e, avg(b_t - a_t) AS b FROM pr JOIN fin ON fin.key = pr.key AND list_contains(won, rk) GROUP BY pr.key)
SELECT d.key // 1000000 AS recording_id, d.key % 1000000 AS trial, coalesce(n, 0) AS n_matched, 4 - coalesce(n, 0) AS n_missing, round(e, 4) AS mae_s, round(b, 4) AS bias_s FROM (SELECT DISTINCT key FROM due) d LEFT JOIN m ON m.key = d.key"""


def recording_qc_code(spark: SparkSession, sf: str) -> DataFrame:
    """Sides and triggers of a recording from the counts of its labels' codes."""
    f = event_samples(spark, sf).groupBy(*REC).agg(
        F.count_if((F.col("label") == "click") & (F.col("code") > 90)).alias("left_files"),
        F.count_if((F.col("label") == "view") & (F.col("code") > 95)).alias("right_files"), F.count_if(F.col("code") == 7).alias("starts"), F.lit(2).alias("expected"),
    )
    return D.recording_qc_code(f)


QC_CODE = f"""WITH {S}, f AS (SELECT recording_id, count(*) FILTER (label = 'click' AND code > 90) AS left_files, count(*) FILTER (label = 'view' AND code > 95) AS right_files, count(*) FILTER (code = 7) AS starts, 2 AS expected FROM s GROUP BY ALL),
c AS (SELECT *, CASE WHEN left_files > 0 AND right_files > 0 THEN 99 WHEN left_files + right_files > 1 THEN 98 WHEN left_files + right_files = 0 OR starts = 0 THEN 0 WHEN starts = 2 THEN 2 WHEN starts = 1 THEN 1 ELSE 3 END AS code FROM f)
SELECT *, code <> 2 AS abnormal FROM c"""


def lag_confound(spark: SparkSession, sf: str) -> DataFrame:
    """Expected correlation for the lag (code, in ms) at each sample's own period, and the realised proportion of change."""
    period = 4000 + 10 * F.col("value")
    return rounded(event_samples(spark, sf).select(*REC, "idx", D.lag_confound(F.col("code") * 1.0, period).alias("expected_r"), ((period + 285.0 / 4 - 4000) / 4000).alias("realised_change")), 8)


CONFOUND = f"WITH {S} SELECT recording_id, idx, round(cos(2 * pi() * code / (4000 + 10 * value)), 8) AS expected_r, round((10 * value + 71.25::DOUBLE) / 4000, 8) AS realised_change FROM s"


def trial_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows within a run (a customer): its onset as resolved from two sources, a lag of 0.2 s, and the trial's own bounds."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("start_s"), (F.col("o_totalprice") / 1000 + 17.0).alias("stop_s"))
    runs = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("double").alias("manual_s"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("trigger_s"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("estimate_s"), F.lit(False).alias("excluded"))
    return rounded(N.trial_windows(o, N.resolve_run_onset(runs), ["o_custkey"]).select("o_custkey", "o_orderkey", "start", "end"))


TRIAL_WINDOWS = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS onset FROM customer)
SELECT o_custkey, o_orderkey, round(onset + 0.2::DOUBLE + o_totalprice / 1000, 6) AS start, round(onset + 0.2::DOUBLE + o_totalprice / 1000 + 17, 6) AS "end" FROM orders LEFT JOIN c ON c_custkey = o_custkey"""


def confidence_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Over the trials of one block."""
    o = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return rounded(H.confidence_mean(o, "o_custkey", "o_totalprice"), 4)


CONFIDENCE = "SELECT o_custkey, round(avg(o_totalprice), 4) AS confidence, count(*) AS n, round(CASE WHEN count(*) > 1 THEN stddev_samp(o_totalprice) / sqrt(count(*)) END, 4) AS se FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL"

QUERIES = {
    "cross_coherence": (cross_coherence, COHERENCE), "offset_per_breath": (offset_per_breath, OFFSET), "adherence_corr": (adherence_corr, ADHERENCE),
    "trial_breaths": (trial_breaths, TRIAL_BREATHS), "match_expected_breaths": (match_expected_breaths, EXPECTED), "recording_qc_code": (recording_qc_code, QC_CODE), "lag_confound": (lag_confound, CONFOUND), "trial_windows": (trial_windows, TRIAL_WINDOWS),
    "confidence_mean": (confidence_mean, CONFIDENCE),
}
