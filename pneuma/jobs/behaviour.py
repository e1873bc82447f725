"""Queries over trials, quality verdicts and participant statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.islands import REC, rounded
from ..operators import clean as C
from ..operators import cohort as H
from ..operators import quality as Q
from ..operators import session as N
from ..operators import trials as T
from ..sources.tables import VECTORS_SQL, event_samples, read, vector_samples
from .cohort import _R, _rated
from .filters import band_response, dft_filter_sql


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("trial"), F.when(F.col("o_orderpriority") < "3", "High").otherwise("Low").alias("salience"), ((F.col("o_orderkey") % 5 - 2) / 10.0).alias("delta"), F.col("o_orderstatus").alias("status"))


_T = "tr AS (SELECT o_orderkey AS trial, CASE WHEN o_orderpriority < '3' THEN 'High' ELSE 'Low' END AS salience, (o_orderkey % 5 - 2) / 10.0::DOUBLE AS delta, o_orderstatus AS status FROM orders)"


def expected_durations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.expected_durations(_trials(spark, sf)).select("trial", "breath", "duration_s"))


_ED = f"""{_T}, ed AS (SELECT trial, k::INT AS breath, 4 * CASE WHEN delta = 0 THEN 1 WHEN salience = 'Low' THEN (1 + delta) ** ((k - 1) / 3.0::DOUBLE) WHEN k > 2 THEN 1 + delta ELSE 1 END AS d FROM tr, range(1, 5) r(k))"""
DURATIONS = f"WITH {_ED} SELECT trial, breath, round(d, 6) AS duration_s FROM ed"


def expected_waveform(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.expected_waveform(T.expected_durations(_trials(spark, sf)), "trial", 8))


WAVEFORM = f"""WITH {_ED}, st AS (SELECT *, sum(d) OVER (PARTITION BY trial ORDER BY breath) - d AS s FROM ed)
SELECT trial, breath, k::INT AS k, round(s + k / 8.0::DOUBLE * d, 6) AS t_s, round(-cos(2 * pi() * k / 8), 6) AS value FROM st, range(0, 9) r(k) WHERE k < 8 OR breath = 4"""


def _breaths(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("breath"), F.col("l_quantity").alias("duration"))


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return T.wide_breaths(_breaths(spark, sf), "trial")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return T.direction_correct(_trials(spark, sf).join(_wide(spark, sf), "trial", "left"), F.col("delta"))


def trial_qc_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every trial once, with its breaths side by side and why something is missing."""
    return rounded(T.trial_qc_table(_trials(spark, sf), _breaths(spark, sf)))


_JD = f"""{_T}, wb AS (SELECT l_orderkey AS trial, avg(l_quantity) FILTER (l_linenumber = 1) AS b1, avg(l_quantity) FILTER (l_linenumber = 2) AS b2, avg(l_quantity) FILTER (l_linenumber = 3) AS b3, avg(l_quantity) FILTER (l_linenumber = 4) AS b4 FROM lineitem GROUP BY ALL),
mv AS (SELECT tr.*, b1, b2, b3, b4, coalesce((b3 + b4) / 2, b3, b4) - coalesce((b1 + b2) / 2, b1, b2) AS move FROM tr LEFT JOIN wb USING (trial)),
jd AS (SELECT *, CASE WHEN delta <> 0 THEN sign(move) = sign(delta) END AS correct, ((b1 IS NULL) <> (b2 IS NULL)) OR ((b3 IS NULL) <> (b4 IS NULL)) AS single FROM mv)"""
QC_TABLE = f"""WITH {_JD} SELECT trial, salience, delta, status, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3, 6) AS b3, round(b4, 6) AS b4, round(move, 6) AS move, correct, single,
concat_ws('; ', CASE WHEN b1 IS NULL THEN 'no breath 1' END, CASE WHEN b2 IS NULL THEN 'no breath 2' END, CASE WHEN b3 IS NULL THEN 'no breath 3' END, CASE WHEN b4 IS NULL THEN 'no breath 4' END, CASE WHEN delta = 0 THEN 'no change' END) AS qc_note FROM jd"""


def direction_correct(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_judged(spark, sf).groupBy("salience").agg(F.count("correct").alias("n"), F.avg(F.col("correct").cast("double")).alias("share"), F.count_if("single").alias("n_single")))


DIRECTION = f"WITH {_JD} SELECT salience, count(correct) AS n, round(avg(correct::INT), 6) AS share, count(*) FILTER (single) AS n_single FROM jd GROUP BY ALL"


def qc_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.qc_summary(_judged(spark, sf), ["salience", "status"]))


QC_SUMMARY = f"""WITH {_JD} SELECT salience, status, count(*) AS n_trials, count(correct) AS n_scored, round(100 * avg(correct::INT), 6) AS pct_correct, round(median(move), 6) AS median_move,
round(CASE WHEN count(b4 - b1) >= 3 THEN corr(delta, b4 - b1) END, 6) AS r_all, round(CASE WHEN count(b4 - b1) FILTER (delta <> 0) >= 3 THEN corr(delta, b4 - b1) FILTER (delta <> 0) END, 6) AS r_changed,
round(stddev_samp(b4 - b1) FILTER (delta = 0), 6) AS no_change_sd FROM jd GROUP BY ALL"""


def good_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Participants with most trials complete: counts by status side by side."""
    o = read(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("trial"))
    return rounded(T.good_subset(o.join(_judged(spark, sf), "trial"), "o_custkey", "status", ["F", "O", "P"], 40.0))


GOOD = f"""WITH {_JD}, g AS (SELECT o_custkey, 100 * avg((b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AND b4 IS NOT NULL)::INT) AS p, median(move) AS m, count(*) FILTER (status = 'F') AS n_f, count(*) FILTER (status = 'O') AS n_o, count(*) FILTER (status = 'P') AS n_p
FROM orders JOIN jd ON trial = o_orderkey GROUP BY ALL) SELECT o_custkey, round(p, 6) AS pct_complete, round(m, 6) AS median_move, n_f, n_o, n_p FROM g WHERE p >= 40"""


def adherence_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Sign of the slope over a trial's breaths against the sign of its change."""
    li = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trial")).agg(F.when(F.count(F.lit(1)) > 1, F.regr_slope("l_quantity", F.col("l_linenumber").cast("double"))).alias("slope"))
    j = _trials(spark, sf).join(li, "trial").select("trial", T.adherence_direction(F.round("slope", 9), F.col("delta")).alias("adherence"))
    return j.groupBy("adherence").agg(F.count(F.lit(1)).alias("n"))


ADHERENCE = f"""WITH {_T}, s AS (SELECT l_orderkey AS trial, CASE WHEN count(*) > 1 THEN round(regr_slope(l_quantity, l_linenumber), 9) END AS slope FROM lineitem GROUP BY ALL)
SELECT CASE WHEN delta <> 0 AND slope IS NOT NULL AND NOT isnan(slope) THEN (sign(slope) * sign(delta))::INT END AS adherence, count(*) AS n FROM tr JOIN s USING (trial) GROUP BY ALL"""


#: At one sample a second: band, breathing band, and thresholds that suit the vectors' spread.
_QUALITY = {"target_fs": None, "low": 0.05, "high": 0.25, "resp_band": 0.15, "dom_lo": 0.05, "thresholds": {"iqr_unusable": 0.05, "iqr_degraded": 0.09, "freq_lo": 0.06, "freq_hi": 0.14, "band_ratio_min": 0.5, "saturation_pct": 4.0}}


def quality(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as recordings of 64 s at one sample a second, ten seconds trimmed at both ends."""
    return rounded(Q.quality(vector_samples(spark, sf, 1.0), 1.0, 10.0, **_QUALITY))


def _spectrum_sql(source: str, seg: int, by: str = "recording_id") -> str:
    """bm({by}, br, dom) of the first seg samples (i from 0) of each key."""
    return f"""hn AS (SELECT {by}, i, (value - avg(value) OVER (PARTITION BY {by})) * 0.5 * (1 - cos(2 * pi() * i / {seg - 1})) AS v FROM {source} WHERE i < {seg}),
ft AS (SELECT {by}, k * 1.0::DOUBLE / {seg} AS f, sum(v * cos(2 * pi() * ((k * i) % {seg}) / {seg})) ** 2 + sum(v * sin(2 * pi() * ((k * i) % {seg}) / {seg})) ** 2 AS p FROM hn, range(0, {seg // 2}) t(k) GROUP BY {by}, k),
bm AS (SELECT {by}, sum(p) FILTER (f BETWEEN 0.05 AND 0.15) / sum(p) FILTER (f BETWEEN 0.05 AND 0.25) AS br, arg_max(f, p) FILTER (f BETWEEN 0.05 AND 0.15) AS dom FROM ft GROUP BY ALL)"""


QUALITY = f"""WITH {VECTORS_SQL}, ra AS (SELECT recording_id, idx - 10 AS idx, value FROM e WHERE idx BETWEEN 11 AND 55),
{dft_filter_sql("ra", band_response("0.05, 0.25", 2), 1.0, 44, "fl", 45)},
fi AS (SELECT recording_id, idx - 1 AS i, value FROM fl), {_spectrum_sql("fi", 44)},
nb AS (SELECT *, round(value, 6) IN (lag(round(value, 6)) OVER w, lead(round(value, 6)) OVER w) AS same, min(value) OVER v AS lo, max(value) OVER v AS hi FROM ra WINDOW w AS (PARTITION BY recording_id ORDER BY idx), v AS (PARTITION BY recording_id)),
rw AS (SELECT recording_id, 100.0 * avg(coalesce(same, false)::INT) AS flat, 100.0 * avg((value <= lo + 0.001 * (hi - lo) OR value >= hi - 0.001 * (hi - lo))::INT) AS sat FROM nb GROUP BY ALL),
iq AS (SELECT recording_id, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM fl GROUP BY ALL),
al AS (SELECT *, list_filter([CASE WHEN iqr < 0.09 THEN 'low spread' END, CASE WHEN dom < 0.06 OR dom > 0.14 THEN 'frequency' END, CASE WHEN flat > 10 THEN 'flatline' END, CASE WHEN sat > 4 THEN 'saturated' END,
  CASE WHEN br < 0.5 THEN 'band ratio' END, CASE WHEN iqr < 0.05 THEN 'no spread' END], lambda x: x IS NOT NULL) AS t FROM iq JOIN rw USING (recording_id) JOIN bm USING (recording_id))
SELECT recording_id, CASE WHEN iqr < 0.05 THEN 'unusable' WHEN len(t) > 0 THEN 'degraded' ELSE 'good' END AS quality, round(iqr, 6) AS filtered_iqr, round(br, 6) AS band_ratio, round(dom, 6) AS dominant_hz,
round(60 * dom, 6) AS dominant_rate_bpm, round(flat, 6) AS flat_pct, round(sat, 6) AS saturated_pct, 0.0::DOUBLE AS na_pct, 64.0::DOUBLE AS duration_s, 45.0::DOUBLE AS usable_s, array_to_string(t, '; ') AS flags FROM al"""


def quality_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The same recordings in segments of 32 s."""
    return rounded(Q.quality_segments(vector_samples(spark, sf, 1.0), 1.0, 32.0, stub_s=5.0, **_QUALITY))


SEGMENTS = f"""WITH {VECTORS_SQL}, {dft_filter_sql("e", band_response("0.05, 0.25", 2), 1.0, 60)},
fi AS (SELECT recording_id, (idx - 1) // 32 AS segment, (idx - 1) % 32 AS i, value FROM fl), {_spectrum_sql("fi", 32, "recording_id, segment")},
nb AS (SELECT recording_id, (idx - 1) // 32 AS segment, round(value, 6) IN (lag(round(value, 6)) OVER w, lead(round(value, 6)) OVER w) AS same FROM e WINDOW w AS (PARTITION BY recording_id, (idx - 1) // 32 ORDER BY idx)),
rw AS (SELECT recording_id, segment, 100.0 * avg(coalesce(same, false)::INT) AS flat FROM nb GROUP BY ALL),
iq AS (SELECT recording_id, segment, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM fi GROUP BY ALL)
SELECT recording_id, segment, segment * 32.0::DOUBLE AS start_s, segment * 32.0::DOUBLE + 31 AS end_s, round(iqr, 6) AS filtered_iqr, round(dom, 6) AS dominant_hz, round(flat, 6) AS flat_pct, 0.0::DOUBLE AS na_pct,
NOT (iqr < 0.09 OR dom < 0.06 OR dom > 0.14 OR flat > 10) AS usable FROM iq JOIN rw USING (recording_id, segment) JOIN bm USING (recording_id, segment)"""


def vacant_channel_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Channels of a recording with next to no spread."""
    return rounded(C.vacant_channel_guard(event_samples(spark, sf).withColumnRenamed("label", "channel"), 15.0))


VACANT = "SELECT user_id AS recording_id, event_type AS channel, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM events GROUP BY ALL HAVING stddev_samp(value) < 15 OR count(*) < 2"


def tost(spark: SparkSession, sf: str) -> DataFrame:
    """Participants' mean differences against a margin of 1, per nation of the supplier."""
    means = _rated(spark, sf).groupBy("participant_id").agg(F.avg(F.col("a") - F.col("b")).alias("d"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("participant_id"), "s_nationkey")
    return rounded(T.t_bounds(means.join(s, "participant_id"), "d", 1.0, ["s_nationkey"]))


TOST = f"""WITH {_R}, m AS (SELECT participant_id, avg(a - b) AS d FROM r GROUP BY ALL), g AS (SELECT s_nationkey, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM m JOIN supplier ON s_suppkey = participant_id GROUP BY ALL)
SELECT s_nationkey, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN n >= 3 AND sd > 0 THEN (mean + 1) / (sd / sqrt(n)) END, 6) AS t_lower, round(CASE WHEN n >= 3 AND sd > 0 THEN (mean - 1) / (sd / sqrt(n)) END, 6) AS t_upper FROM g"""


def tost_p(spark: SparkSession, sf: str) -> DataFrame:
    """As tost, with p (the larger of the two one-sided ones), the lower 95 % bound and the larger absolute 90 % limit of the mean."""
    means = _rated(spark, sf).groupBy("participant_id").agg(F.avg(F.col("a") - F.col("b")).alias("d"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("participant_id"), "s_nationkey")
    t = T.with_p(T.t_bounds(means.join(s, "participant_id"), "d", 1.0, ["s_nationkey"])).where("t_lower is not null")
    return rounded(t.select("s_nationkey", "n", "p", "lower_bound", "equivalence_bound"))


def alertness_slopes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.alertness_slopes(_rated(spark, sf), "participant_id", "quality", "a", "b"))


ALERTNESS = f"WITH {_R} SELECT participant_id, round(regr_slope(a, quality), 6) AS slope_a, round(regr_slope(b, quality), 6) AS slope_b, round(regr_slope(a, quality) - regr_slope(b, quality), 6) AS difference FROM r GROUP BY ALL"


def agreement_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement statistics per model (return flag) and the slope of the error on the discount."""
    li = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("x"), (F.col("l_quantity") - F.col("l_tax") * 100).alias("b"))
    return rounded(li.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.regr_slope(F.col("a") - F.col("b"), F.col("x")).alias("slope")))


BY_MODEL = "SELECT l_returnflag AS model, count(*) AS n, round(avg(abs(l_tax * 100)), 6) AS mae, round(regr_slope(l_tax * 100, l_discount), 6) AS slope FROM lineitem GROUP BY ALL"


def dependent_corr_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.dependent_corr_contrast(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"), 5)


CONTRAST = """WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r12, corr(l_quantity, l_discount) AS r13, corr(l_extendedprice, l_discount) AS r23 FROM lineitem)
SELECT n, round(r12, 5) AS r12, round(r13, 5) AS r13, round(r23, 5) AS r23, round((r12 - r13) * sqrt((n - 1) * (1 + r23) / (2 * (n - 1) / (n - 3) * (1 - r12 ** 2 - r13 ** 2 - r23 ** 2 + 2 * r12 * r13 * r23) + ((r12 + r13) / 2) ** 2 * (1 - r23) ** 3)), 5) AS t FROM c"""


def questionnaire_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of a participant's score (balance) with the mean and spread of their trials."""
    t = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"))
    return rounded(H.questionnaire_corr(read(spark, sf, "customer"), t, "c_custkey", "c_acctbal", ["mean", "sd"]))


QUESTIONNAIRE = "WITH t AS (SELECT o_custkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY ALL) SELECT count(*) AS n, round(corr(c_acctbal, m), 6) AS r_mean, round(corr(c_acctbal, s), 6) AS r_sd FROM customer JOIN t ON o_custkey = c_custkey"


def band_bias_table(spark: SparkSession, sf: str) -> DataFrame:
    """Mean error by period (line number) and band (line status) side by side, with the difference."""
    li = read(spark, sf, "lineitem").withColumn("e", F.col("l_tax") - F.col("l_discount"))
    p = li.groupBy("l_linenumber").pivot("l_linestatus", ["F", "O"]).agg(F.avg("e"))
    return rounded(p.select("l_linenumber", F.col("F").alias("bias_f"), F.col("O").alias("bias_o"), (F.col("F") - F.col("O")).alias("difference")))


BAND_BIAS = "SELECT l_linenumber, round(avg(l_tax - l_discount) FILTER (l_linestatus = 'F'), 6) AS bias_f, round(avg(l_tax - l_discount) FILTER (l_linestatus = 'O'), 6) AS bias_o, round(avg(l_tax - l_discount) FILTER (l_linestatus = 'F') - avg(l_tax - l_discount) FILTER (l_linestatus = 'O'), 6) AS difference FROM lineitem GROUP BY ALL"


def attach_condition(spark: SparkSession, sf: str) -> DataFrame:
    """Each order with its customer's first condition (segment) and the current one, swapped in the second session."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") < "H", "A").otherwise("B").alias("first"))
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", (1 + F.col("o_orderkey") % 2).alias("session"))
    return N.attach_condition(o, c, "o_custkey", "session", ("A", "B"))


ATTACH = """WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment < 'H' THEN 'A' ELSE 'B' END AS first FROM customer) SELECT o_orderkey, o_custkey, 1 + o_orderkey % 2 AS session, first,
CASE WHEN o_orderkey % 2 = 0 THEN first WHEN first = 'A' THEN 'B' WHEN first = 'B' THEN 'A' END AS condition FROM orders LEFT JOIN c ON c_custkey = o_custkey"""

QUERIES = {
    "expected_durations": (expected_durations, DURATIONS), "expected_waveform": (expected_waveform, WAVEFORM), "trial_qc_table": (trial_qc_table, QC_TABLE), "direction_correct": (direction_correct, DIRECTION),
    "qc_summary": (qc_summary, QC_SUMMARY), "good_subset": (good_subset, GOOD), "adherence_direction": (adherence_direction, ADHERENCE), "quality": (quality, QUALITY), "quality_segments": (quality_segments, SEGMENTS),
    "vacant_channel_guard": (vacant_channel_guard, VACANT), "tost": (tost, TOST), "alertness_slopes": (alertness_slopes, ALERTNESS), "agreement_by_flag": (agreement_by_model, BY_MODEL),
    "dependent_corr_contrast": (dependent_corr_contrast, CONTRAST), "questionnaire_corr": (questionnaire_corr, QUESTIONNAIRE), "bias_by_status": (band_bias_table, BAND_BIAS), "attach_condition": (attach_condition, ATTACH),
}
