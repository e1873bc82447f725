"""Queries over the models of a calibration, trials with their pacer, bounds of means, and offsets of breaths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.islands import REC, rounded
from ..operators import calibration as K
from ..operators import cohort as H
from ..operators import devices as D
from ..operators import trials as T
from ..sources.tables import SAMPLES_SQL, event_samples, read, vector_samples
from .assembly import _AX, _axes
from .behaviour import _R, _rated, tost_p
from .cohort import cluster_bootstrap
from .composed import _WEIGHTS
from .devices import _CMD, _W, _commanded, _windows
from .filters import band_response, dft_filter_sql
from .recordings import ALT_SQL, _alternating

S = SAMPLES_SQL

# ---- the models of a calibration


def _models(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of four vectors as three axes and a pacer at 25 Hz."""
    return K.score_models(_axes(spark, sf).withColumnRenamed("participant_id", "recording_id"), band=(0.5, 5.0), least=50, most_lag_s=0.32)


def score_models(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_models(spark, sf).drop("too_few"), 5)


def _axis_sql(axis: str) -> str:
    return f"s{axis} AS (SELECT participant_id AS recording_id, idx, {axis} AS value FROM ax), {dft_filter_sql('s' + axis, band_response('0.5, 5.0', 4), 25.0, 63, 'f' + axis)}"


#: The principal axis comes from squaring the covariance matrix again and again, which leaves the projection on it.
_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
_SQUARE = ", ".join(
    f"({' + '.join('{}*{}'.format(*(''.join(sorted(a + k)), ''.join(sorted(k + b)))) for k in 'xyz')}) / t AS {a}{b}" for a, b in _PAIRS
)
_MODELS = f"""{_AX}, {", ".join(_axis_sql(c) for c in "xyz")},
axb AS (SELECT ax.participant_id, ax.idx, fx.value AS x, fy.value AS y, fz.value AS z, target FROM ax JOIN fx ON fx.recording_id = participant_id AND fx.idx = ax.idx JOIN fy ON fy.recording_id = participant_id AND fy.idx = ax.idx JOIN fz ON fz.recording_id = participant_id AND fz.idx = ax.idx),
mlr AS ({_WEIGHTS.replace(f"WITH {_AX}, ", "WITH ").replace("FROM ax ", "FROM axb ")}),
cv AS (SELECT participant_id, {", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in _PAIRS)}, {", ".join(f"covar_samp({c}, target) AS c{c}, avg({c}) AS m{c}" for c in "xyz")}, avg(target) AS mt FROM axb GROUP BY ALL),
pw AS (SELECT participant_id, {", ".join(f"{p} / (xx + yy + zz) AS {p}" for p in _PAIRS)}, 0 AS k FROM cv
  UNION ALL SELECT participant_id, {_SQUARE}, k + 1 FROM (SELECT *, xx*xx + yy*yy + zz*zz + 2 * (xy*xy + xz*xz + yz*yz) AS t FROM pw WHERE k < 40)),
pj AS (SELECT cv.participant_id, pw.xx * cv.cx + pw.xy * cv.cy + pw.xz * cv.cz AS px, pw.xy * cv.cx + pw.yy * cv.cy + pw.yz * cv.cz AS py, pw.xz * cv.cx + pw.yz * cv.cy + pw.zz * cv.cz AS pz,
  pw.xx * cv.xx + pw.yy * cv.yy + pw.zz * cv.zz + 2 * (pw.xy * cv.xy + pw.xz * cv.xz + pw.yz * cv.yz) AS top, mx, my, mz, mt FROM cv JOIN pw ON pw.participant_id = cv.participant_id AND pw.k = 40),
pca AS (SELECT participant_id, px / top AS wx, py / top AS wy, pz / top AS wz, mt - (px * mx + py * my + pz * mz) / top AS bias FROM pj),
rd AS (SELECT m.participant_id AS recording_id, idx, bias + wx * x + wy * y + wz * z AS value FROM axb JOIN mlr m ON m.participant_id = axb.participant_id),
{dft_filter_sql("rd", band_response(", 0.6", 4), 25.0, 63, "lo")},
pr AS (SELECT recording_id AS participant_id, idx, 'mlr-wide' AS model, 0 AS place, value FROM rd UNION ALL SELECT recording_id, idx, 'mlr-wide-lp', 1, value FROM lo
  UNION ALL SELECT m.participant_id, idx, 'pca-wide', 2, bias + wx * x + wy * y + wz * z FROM axb JOIN pca m ON m.participant_id = axb.participant_id),
rr AS (SELECT pr.participant_id, model, any_value(place) AS place, count(*) AS n, corr(value, target) AS r FROM pr JOIN ax ON ax.participant_id = pr.participant_id AND ax.idx = pr.idx GROUP BY ALL),
tp AS (SELECT *, r - lead(r) OVER w AS margin FROM rr WINDOW w AS (PARTITION BY participant_id ORDER BY round(r, 9) DESC, place) QUALIFY row_number() OVER w = 1),
ft AS (SELECT 'mlr-wide' AS kind, participant_id, bias, wx, wy, wz FROM mlr UNION ALL SELECT 'pca-wide', participant_id, bias, wx, wy, wz FROM pca),
ch AS (SELECT pr.participant_id, pr.idx, target AS a, value AS b FROM pr JOIN tp ON tp.participant_id = pr.participant_id AND tp.model = pr.model JOIN ax ON ax.participant_id = pr.participant_id AND ax.idx = pr.idx),
lg AS (SELECT p.participant_id, d, corr(p.a, q.b) AS r FROM ch p CROSS JOIN range(-8, 9) t(d) JOIN ch q ON q.participant_id = p.participant_id AND q.idx = p.idx + d GROUP BY ALL HAVING count(*) >= 20),
lb AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY round(r, 9) DESC, d) = 1),
sm AS (SELECT tp.participant_id AS recording_id, tp.n, tp.model, tp.r, margin, tp.r < 0.4 AS low_fit, bias, wx, wy, wz, tp.model = 'mlr-wide-lp' AS smooth, d * 40.0::DOUBLE AS lag_ms, lb.r AS lag_r
  FROM tp JOIN ft ON ft.participant_id = tp.participant_id AND ft.kind = replace(tp.model, '-lp', '') JOIN lb ON lb.participant_id = tp.participant_id)"""
SCORES = f"""WITH RECURSIVE {_MODELS} SELECT recording_id, n, model, {", ".join(f"round({c}, 5) AS {c}" for c in ("r", "margin"))}, low_fit, {", ".join(f"round({c}, 5) AS {c}" for c in ("bias", "wx", "wy", "wz", "lag_ms", "lag_r"))}, smooth FROM sm"""


def model_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return H.model_frequency(_models(spark, sf))


FREQUENCY = f"WITH RECURSIVE {_MODELS} SELECT model, count(*) AS n, count(*) FILTER (low_fit) AS n_low FROM sm GROUP BY ALL"


def agreement_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' lines as trials of the participants whose calibrations are scored."""
    scores = _models(spark, sf).withColumnRenamed("recording_id", "participant_id")
    return rounded(H.agreement_by_model(_rated(spark, sf), scores, "participant_id", "a", "b"), 5)


BY_MODEL = f"""WITH RECURSIVE {_MODELS}, {_R}, em AS (SELECT participant_id, avg(abs(a - b)) AS mae FROM r GROUP BY ALL)
SELECT model, count(*) AS n, round(avg(sm.r), 5) AS fit, round(avg(margin), 5) AS margin, round(avg(mae), 5) AS mae, round(CASE WHEN count(*) > 1 AND var_pop(margin) > 0 THEN regr_slope(mae, margin) END, 5) AS slope
FROM sm JOIN em ON em.participant_id = sm.recording_id GROUP BY ALL"""


def band_bias_table(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks and errors as two bands' onsets, nearest to each purchase within six hours, by the purchase's tenth code."""
    s = event_samples(spark, sf)
    true = s.where("label = 'purchase'").select(*REC, "t_s", F.floor(F.col("code") / 10).alias("period"))
    found = s.where("label in ('click', 'view')").select(*REC, F.col("label").alias("band"), "t_s")
    return rounded(H.band_bias_table(true, found, 21600.0, "period", "band", ["click", "view"]))


BAND_BIAS = f"""WITH {S}, t AS (SELECT recording_id, idx, t_s, code // 10 AS period FROM s WHERE label = 'purchase'),
m AS (SELECT period, f.label AS band, f.t_s - t.t_s AS d FROM t JOIN s f ON f.recording_id = t.recording_id AND f.label IN ('click', 'view') AND abs(f.t_s - t.t_s) <= 21600
  QUALIFY row_number() OVER (PARTITION BY t.recording_id, t.idx, f.label ORDER BY abs(f.t_s - t.t_s), f.t_s) = 1)
SELECT period, round(avg(d) FILTER (band = 'click'), 6) AS bias_click, round(avg(d) FILTER (band = 'view'), 6) AS bias_view, round(avg(d) FILTER (band = 'click') - avg(d) FILTER (band = 'view'), 6) AS difference FROM m GROUP BY ALL"""

# ---- trials and their pacer


def trial_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases open trials of two days, paced by half a day and then by more, by their code."""
    w = _windows(spark, sf)
    return rounded(K.trial_sync(event_samples(spark, sf), w, 600.0, 2, 2, 172800.0), 5)


_SYNC_PEAKS = """{n} AS (SELECT recording_id, trial, sep, t_s, row_number() OVER (PARTITION BY recording_id, trial ORDER BY t_s) AS k FROM ({source}) WHERE top),
{n}s AS (SELECT recording_id, trial, sep, [t_s] AS ts, 1 AS k FROM {n} WHERE k = 1 UNION ALL SELECT p.recording_id, p.trial, p.sep, CASE WHEN p.t_s - ts[-1] > {share} * p.sep THEN list_append(ts, p.t_s) ELSE ts END, p.k FROM {n}s f JOIN {n} p ON p.recording_id = f.recording_id AND p.trial = f.trial AND p.k = f.k + 1),
{n}k AS (SELECT recording_id, trial, sep, unnest(ts) AS t_s FROM (SELECT recording_id, trial, any_value(sep) AS sep, arg_max(ts, k) AS ts FROM {n}s GROUP BY ALL))"""
_HIGHER = "{c} > lag({c}) OVER w AND {c} > lead({c}) OVER w AS top"
_OVER = "WINDOW w AS (PARTITION BY recording_id, trial ORDER BY t_s, value)"
SYNC = f"""WITH RECURSIVE {S}, {_W}, x AS (SELECT s.recording_id, trial, t_s, value, a, ch, a + 80000 AS boundary, least(40000.0::DOUBLE, ch) AS sep FROM s JOIN w ON w.recording_id = s.recording_id AND t_s BETWEEN a AND z),
y AS (SELECT *, t_s >= boundary AS late, (1 - cos(2 * pi() * (t_s - a) / 40000)) / 2 AS early,
  CASE WHEN t_s - 600 <= boundary THEN (1 - cos(2 * pi() * (t_s - 600 - a) / 40000)) / 2 ELSE (1 - cos(2 * pi() * (t_s - 600 - boundary) / ch)) / 2 END AS lagged,
  CASE WHEN t_s <= boundary THEN (1 - cos(2 * pi() * (t_s - a) / 40000)) / 2 ELSE (1 - cos(2 * pi() * (t_s - boundary) / ch)) / 2 END AS whole FROM x),
g AS (SELECT recording_id, trial, count(*) AS n, CASE WHEN count(*) FILTER (NOT late) > 2 THEN abs(corr(value, early) FILTER (NOT late)) END AS rb, CASE WHEN count(*) FILTER (late) > 2 THEN abs(corr(value, lagged) FILTER (late)) END AS rc FROM y GROUP BY ALL),
th AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY recording_id, trial ORDER BY t_s, value) % 2 = 1),
{_SYNC_PEAKS.format(n="pm", share=0.5, source=f"SELECT *, {_HIGHER.format(c='value')} FROM y {_OVER}")}, {_SYNC_PEAKS.format(n="pd", share=0.7, source=f"SELECT *, {_HIGHER.format(c='whole')} FROM th {_OVER}")},
er AS (SELECT d.recording_id, d.trial, d.t_s, any_value(d.sep) AS sep, min(abs(m.t_s - d.t_s)) AS e FROM pdk d JOIN pmk m ON m.recording_id = d.recording_id AND m.trial = d.trial GROUP BY ALL),
me AS (SELECT recording_id, trial, list(e ORDER BY e) AS es FROM er WHERE e < 0.75 * sep GROUP BY ALL)
SELECT g.recording_id, g.trial, n, round(rb, 5) AS r_baseline, round(rc, 5) AS r_condition, round(es[len(es) // 2 + 1], 5) AS peak_error_s FROM g LEFT JOIN me ON me.recording_id = g.recording_id AND me.trial = g.trial"""


def local_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Trials of two days with fewer than three breaths; what is found must be an hour from what is there."""
    return rounded(T.local_retry(event_samples(spark, sf), _windows(spark, sf), _alternating(spark, sf), 3, 0.5, 3600.0, 172800.0))


RETRY = f"""WITH {ALT_SQL}, {_W}, x AS (SELECT w.recording_id * 1000000 + trial AS key, idx, t_s, value FROM s JOIN w ON w.recording_id = s.recording_id AND t_s BETWEEN a AND z),
ins AS (SELECT x.*, kind FROM x JOIN alt ON alt.recording_id = key // 1000000 AND alt.idx = x.idx),
few AS (SELECT w.recording_id * 1000000 + trial AS key FROM w LEFT JOIN ins ON ins.key = w.recording_id * 1000000 + trial GROUP BY ALL HAVING count(*) FILTER (kind = 'trough') - 1 < 3),
xc AS (SELECT key, idx, t_s, value, value - avg(value) OVER (PARTITION BY key) AS x FROM x WHERE key IN (SELECT key FROM few)),
u AS (SELECT *, x >= 0 AS up, coalesce((lead(x >= 0) OVER w) <> (x >= 0), false) AS cut FROM xc WINDOW w AS (PARTITION BY key ORDER BY idx)),
cuts AS (SELECT key, idx, up, row_number() OVER w AS seg, lead(idx) OVER w AS nxt FROM u WHERE cut WINDOW w AS (PARTITION BY key ORDER BY idx)),
e AS (SELECT c.key, c.seg, CASE WHEN c.up THEN 'trough' ELSE 'peak' END AS kind, u.idx, u.t_s, u.value, u.x FROM cuts c JOIN u ON u.key = c.key AND u.idx BETWEEN c.idx AND c.nxt
  QUALIFY row_number() OVER (PARTITION BY c.key, c.seg ORDER BY CASE WHEN c.up THEN u.x ELSE -u.x END, u.idx) = 1),
d AS (SELECT *, abs(x - lag(x) OVER w) AS back, abs(x - lead(x) OVER w) AS ahead, count(*) OVER (PARTITION BY key) AS n FROM e WINDOW w AS (PARTITION BY key ORDER BY seg)),
lo AS (SELECT key, idx, t_s, value, kind FROM (SELECT *, avg(back) OVER (PARTITION BY key) AS mean FROM d) WHERE n < 3 OR least(coalesce(back, ahead), coalesce(ahead, back)) >= 0.5 * mean),
al AS (SELECT key, idx, t_s, value, kind, false AS added FROM ins WHERE key IN (SELECT key FROM few)
  UNION ALL SELECT *, true FROM lo WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.key = lo.key AND abs(ins.t_s - lo.t_s) < 3600)),
kr AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY idx) AS run FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY key ORDER BY idx))::INT AS ch FROM al))
SELECT key // 1000000 AS recording_id, key % 1000000 AS trial, idx, round(t_s, 6) AS t_s, round(value, 6) AS value, kind, added FROM kr QUALIFY row_number() OVER (PARTITION BY key, run ORDER BY CASE WHEN kind = 'peak' THEN -value ELSE value END, idx) = 1"""


def align_first_peak(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as trials at 8 Hz; peaks stand above 0.1 and both neighbours; the expected wave has breaths of two seconds."""
    x = vector_samples(spark, sf, 8.0).select(F.col("recording_id").alias("trial"), (F.col("idx") - 1).cast("bigint").alias("i"), "value")
    w = F.lag("value").over(K.Window.partitionBy("trial").orderBy("i")), F.lead("value").over(K.Window.partitionBy("trial").orderBy("i"))
    peaks = x.withColumn("_top", (F.col("value") > w[0]) & (F.col("value") > w[1]) & (F.col("value") > 0.1)).where("_top").select("trial", (F.col("i") / 8.0).alias("t_s"))
    due = x.select("trial", "i", (-F.cos(F.col("i") * (6.283185307179586 / 16))).alias("value"))
    return rounded(T.align_first_peak(x, peaks, due, 8.0, 2.0))


ALIGN = """WITH x AS (SELECT vec_id AS trial, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
t AS (SELECT *, v > lag(v) OVER w AND v > lead(v) OVER w AND v > 0.1 AS top FROM x WINDOW w AS (PARTITION BY trial ORDER BY i)),
p AS (SELECT trial, coalesce(min(i) FILTER (top), arg_max(i, v)) - 8 AS shift FROM t GROUP BY ALL),
b AS (SELECT p.trial, count(*) AS n, corr(v, -cos((i - shift) * 2 * pi() / 16)) AS r FROM p JOIN x ON x.trial = p.trial WHERE i - shift BETWEEN 0 AND 63 GROUP BY ALL)
SELECT p.trial, round(shift / 8.0::DOUBLE, 6) AS lag_s, n, round(r, 6) AS r, abs(shift / 8.0::DOUBLE) > 1 AS far FROM p JOIN b ON b.trial = p.trial"""


def offset_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of clicks from commanded breaths; the recording's number gives its rig."""
    s = event_samples(spark, sf)
    offsets = D.offset_per_breath(s.where("label = 'click'"), _commanded(spark, sf), 20000.0)
    return rounded(D.offset_summary(offsets, s.select(*REC, (F.col("recording_id") % 3).alias("rig")).distinct()), 4)


OFFSET_SUMMARY = f"""WITH {S}, {_CMD}, o AS (SELECT cm.recording_id, trial, breath, s.t_s - due AS o FROM cm JOIN s ON s.recording_id = cm.recording_id AND label = 'click' AND abs(s.t_s - due) <= 20000
QUALIFY row_number() OVER (PARTITION BY cm.recording_id, trial, breath ORDER BY abs(s.t_s - due), s.t_s) = 1),
t AS (SELECT recording_id, trial, count(*) AS n, avg(o) AS m, var_samp(o) AS v FROM o GROUP BY ALL),
p AS (SELECT recording_id, avg(v) AS bv, greatest(0, var_samp(m) - avg(v / n)) AS tv FROM t GROUP BY ALL),
l AS (SELECT recording_id, count(*) AS n, avg(o) AS m, CASE WHEN count(*) > 1 AND var_pop(breath) > 0 THEN regr_slope(o, breath) END AS sl FROM o GROUP BY ALL),
r AS (SELECT recording_id % 3 AS rig, avg(o) AS rm FROM o GROUP BY ALL)
SELECT l.recording_id, n, round(m, 4) AS mean_s, round(sl, 4) AS slope_s, round(bv, 4) AS breath_var, round(coalesce(tv, 0), 4) AS trial_var, rig, round(rm, 4) AS rig_mean FROM l JOIN p ON p.recording_id = l.recording_id JOIN r ON r.rig = l.recording_id % 3"""

# ---- bounds of means


def _nation_means(spark: SparkSession, sf: str) -> DataFrame:
    means = _rated(spark, sf).groupBy("participant_id").agg(F.avg(F.col("a") - F.col("b")).alias("d"))
    return means.join(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("participant_id"), "s_nationkey"), "participant_id")


def lower_bound(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.lower_bound(_nation_means(spark, sf), "d", ["s_nationkey"]))


def equivalence_bound(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.equivalence_bound(_nation_means(spark, sf), "d", ["s_nationkey"]))


def t_cdf_sql(t: str, nu: str) -> str:
    """Student's distribution by Simpson's rule over the angle whose tangent is t / sqrt(nu)."""
    top = f"atan(abs({t}) / sqrt({nu}))"
    weights = f"list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * cos(i * {top} / 400) ** ({nu} - 1)))"
    return f"(0.5 + sign({t}) * exp(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2)) / sqrt(pi()) * {weights} * {top} / 1200)"


_BOUNDS = f"""{_R}, m AS (SELECT participant_id, avg(a - b) AS d FROM r GROUP BY ALL), g AS (SELECT s_nationkey, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM m JOIN supplier ON s_suppkey = participant_id GROUP BY ALL),
q AS (SELECT DISTINCT (n - 1)::DOUBLE AS nu, 0.0::DOUBLE AS lo, 50.0::DOUBLE AS hi, 0 AS k FROM g WHERE n >= 3
  UNION ALL SELECT nu, CASE WHEN {t_cdf_sql("(lo + hi) / 2", "nu")} < 0.95 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {t_cdf_sql("(lo + hi) / 2", "nu")} < 0.95 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM q WHERE k < 60),
b AS (SELECT g.*, CASE WHEN n >= 3 AND sd > 0 THEN hi * sd / sqrt(n) END AS half FROM g LEFT JOIN q ON nu = n - 1 AND k = 60)"""
LOWER = f"WITH RECURSIVE {_BOUNDS} SELECT s_nationkey, n, round(mean, 6) AS mean, round(mean - half, 6) AS lower_bound FROM b"
EQUIVALENCE = f"WITH RECURSIVE {_BOUNDS} SELECT s_nationkey, n, round(mean, 6) AS mean, round(greatest(abs(mean - half), abs(mean + half)), 6) AS equivalence_bound FROM b"
TOST_P = f"""WITH RECURSIVE {_BOUNDS}, t AS (SELECT *, (n - 1)::DOUBLE AS nu, (mean + 1) / (sd / sqrt(n)) AS tl, (mean - 1) / (sd / sqrt(n)) AS tu FROM b WHERE half IS NOT NULL)
SELECT s_nationkey, n, round(greatest(1 - {t_cdf_sql("tl", "nu")}, {t_cdf_sql("tu", "nu")}), 6) AS p, round(mean - half, 6) AS lower_bound, round(greatest(abs(mean - half), abs(mean + half)), 6) AS equivalence_bound FROM t"""

#: Draws and numbers of clusters by the same digests, in SQL.
BOOTSTRAP = f"""WITH {_R}, g AS (SELECT *, row_number() OVER (ORDER BY md5(participant_id::VARCHAR)) - 1 AS k FROM (SELECT participant_id, sum(a - b) AS s, count(a - b) AS n FROM r GROUP BY ALL)), c AS (SELECT count(*) AS c FROM g),
d AS (SELECT i // c AS rep, ('0x' || substr(md5((i // c)::VARCHAR || ':' || (i % c)::VARCHAR), 1, 13))::BIGINT % c AS k FROM c, range(0, 200 * (SELECT c FROM c)) t(i)),
m AS (SELECT rep, sum(s) / sum(n) AS mean FROM d JOIN g ON g.k = d.k GROUP BY ALL)
SELECT round(quantile_cont(mean, 0.025), 6) AS lower, (SELECT round(sum(s) / sum(n), 6) FROM g) AS mean, count(*) AS replicates FROM m"""

QUERIES = {
    "score_models": (score_models, SCORES), "model_frequency": (model_frequency, FREQUENCY), "agreement_by_model": (agreement_by_model, BY_MODEL), "band_bias_table": (band_bias_table, BAND_BIAS),
    "trial_sync": (trial_sync, SYNC), "local_retry": (local_retry, RETRY), "align_first_peak": (align_first_peak, ALIGN), "offset_summary": (offset_summary, OFFSET_SUMMARY),
    "lower_bound": (lower_bound, LOWER), "equivalence_bound": (equivalence_bound, EQUIVALENCE), "tost_p": (tost_p, TOST_P), "cluster_bootstrap": (cluster_bootstrap, BOOTSTRAP),
}
