"""Queries over windows, devices, agreement and staircases on the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.islands import REC, rounded
from ..operators import cohort as H
from ..operators import epochs as E
from ..operators import matching as M
from ..operators import staircase as Q
from ..operators import stats as A
from ..operators import trials as T
from ..sources.tables import SAMPLES_SQL, event_samples, read
from .recordings import BREATHS_SQL, _breaths, _flagged

S = SAMPLES_SQL
TOL = 20_000.0


def _epochs(spark: SparkSession, sf: str) -> DataFrame:
    """One to three days behind each purchase."""
    w = event_samples(spark, sf).where("label = 'purchase'")
    w = w.select(*REC, F.col("idx").alias("at"), F.col("t_s").alias("onset"), (F.col("t_s") + 86400.0 * (1 + F.col("idx") % 3)).alias("offset"))
    return E.make_epochs(w, 3600.0)


_EP = """ep AS (SELECT recording_id, idx AS at_idx, row_number() OVER (PARTITION BY recording_id ORDER BY t_s, idx)::INT AS epoch, t_s + 3600.0::DOUBLE AS start,
  t_s + 86400.0::DOUBLE * (1 + idx % 3) + 3600.0::DOUBLE AS stop FROM s WHERE label = 'purchase')"""


def make_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_epochs(spark, sf).select(*REC, "epoch", "start", "end", "bad"))


MAKE_EPOCHS = f'WITH {S}, {_EP} SELECT recording_id, epoch, round(start, 6) AS start, round(stop, 6) AS "end", false AS bad FROM ep'


def _assigned(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    return E.epoch_breaths(_breaths(spark, sf), _epochs(spark, sf), rule).select(*REC, "breath", "epoch")


def epoch_breaths_start(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, "start")


def epoch_breaths_contained(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, "contained")


def epoch_breaths_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, "overlap")


_EB = f"WITH {BREATHS_SQL}, {_EP}"
EB_START = f"{_EB} SELECT b.recording_id, breath, min(epoch) AS epoch FROM b LEFT JOIN ep ON ep.recording_id = b.recording_id AND t_start BETWEEN start AND stop GROUP BY ALL"
EB_CONTAINED = f"{_EB} SELECT b.recording_id, breath, min(epoch) AS epoch FROM b LEFT JOIN ep ON ep.recording_id = b.recording_id AND t_start >= start AND t_end <= stop GROUP BY ALL"
EB_OVERLAP = f"{_EB} SELECT b.recording_id, breath, epoch FROM b JOIN ep ON ep.recording_id = b.recording_id AND t_end >= start AND t_start <= stop"


def epoch_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.epoch_features(_flagged(spark, sf), _epochs(spark, sf)))


EPOCH_FEATURES = f"""{_EB}, fst AS (SELECT kp.*, min(epoch) AS epoch FROM kp JOIN ep ON ep.recording_id = kp.recording_id AND t_start BETWEEN start AND stop GROUP BY ALL),
f AS (SELECT fst.recording_id, fst.epoch, count(*) AS nt, count(*) FILTER (keep) AS n, sum(greatest(0, least(t_end, stop) - greatest(t_start, start))) FILTER (keep) AS cov,
  avg(duration) FILTER (keep) AS dm FROM fst JOIN ep ON ep.recording_id = fst.recording_id AND ep.epoch = fst.epoch GROUP BY ALL),
pt AS (SELECT kp.recording_id, epoch, count(*) AS np FROM kp JOIN ep ON ep.recording_id = kp.recording_id AND t_end >= start AND t_start <= stop AND NOT (t_start >= start AND t_end <= stop) GROUP BY ALL)
SELECT ep.recording_id, ep.epoch, round(start, 6) AS start, round(stop, 6) AS "end", coalesce(nt, 0) AS n_breaths_total, coalesce(n, 0) AS n_breaths, coalesce(np, 0) AS n_breaths_partial,
  round(least(1, coalesce(cov, 0) / (stop - start)), 6) AS coverage_frac, round(coalesce(cov, 0), 6) AS window_coverage_s, round(dm, 6) AS duration_mean
FROM ep LEFT JOIN f ON f.recording_id = ep.recording_id AND f.epoch = ep.epoch LEFT JOIN pt ON pt.recording_id = ep.recording_id AND pt.epoch = ep.epoch"""


def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of windows with enough covered time and two breaths or more, per recording."""
    return rounded(H.quality_gate(E.epoch_features(_flagged(spark, sf), _epochs(spark, sf))))


GATE = f"""WITH e AS ({EPOCH_FEATURES}) SELECT recording_id, count(*) AS n_windows, count(*) FILTER (coverage_frac >= 0.7 AND n_breaths >= 2) AS n_usable,
round(avg((coverage_frac >= 0.7 AND n_breaths >= 2)::INT), 6) AS usable_rate FROM e GROUP BY ALL"""


def rate_series_constant(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.rate_series(_breaths(spark, sf), 21600.0, "amplitude"))


def rate_series_linear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.rate_series(_breaths(spark, sf), 21600.0, "amplitude", "linear"))


_RG = """rb AS (SELECT recording_id, min(t_start) AS lo, max(t_end) AS hi FROM b GROUP BY ALL),
g AS (SELECT recording_id, k::INT AS k, lo + k * 21600.0::DOUBLE AS t_s FROM (SELECT *, unnest(range(0, floor((hi - lo) / 21600)::BIGINT + 1)) AS k FROM rb))"""
RATE_CONSTANT = f"""WITH {BREATHS_SQL}, {_RG} SELECT g.recording_id, k, round(g.t_s, 6) AS t_s, round(amplitude, 6) AS value FROM g ASOF LEFT JOIN b ON b.recording_id = g.recording_id AND b.t_start <= g.t_s"""
RATE_LINEAR = f"""WITH {BREATHS_SQL}, {_RG}, an AS (SELECT recording_id, (t_start + t_end) / 2 AS at_s, amplitude AS v FROM b WHERE amplitude IS NOT NULL),
l AS (SELECT g.*, an.at_s AS t0, an.v AS v0 FROM g ASOF LEFT JOIN an ON an.recording_id = g.recording_id AND an.at_s <= g.t_s),
rr AS (SELECT l.*, an.at_s AS t1, an.v AS v1 FROM l ASOF LEFT JOIN an ON an.recording_id = l.recording_id AND an.at_s >= l.t_s)
SELECT recording_id, k, round(t_s, 6) AS t_s, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t_s THEN v0 ELSE v0 + (t_s - t0) / (t1 - t0) * (v1 - v0) END, 6) AS value FROM rr"""


def _devices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = event_samples(spark, sf)
    return s.where("label = 'click'"), s.where("label = 'view'")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return M.match_onsets(*_devices(spark, sf), TOL)


def match_onsets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_matches(spark, sf))


_MATCH = f"""{S}, a AS (SELECT * FROM s WHERE label = 'click'), v AS (SELECT * FROM s WHERE label = 'view'),
pr AS (SELECT a.recording_id, a.idx AS a_idx, a.t_s AS a_t, v.idx AS b_idx, v.t_s AS b_t,
  row_number() OVER (PARTITION BY a.recording_id ORDER BY abs(a.t_s - v.t_s), v.idx, a.idx) AS rk
  FROM a JOIN v ON v.recording_id = a.recording_id AND abs(a.t_s - v.t_s) <= {TOL}),
st AS (SELECT recording_id, []::BIGINT[] AS used, []::BIGINT[] AS won, 1 AS rk FROM (SELECT DISTINCT recording_id FROM pr)
  UNION ALL SELECT st.recording_id,
    CASE WHEN list_contains(used, a_idx) OR list_contains(used, b_idx) THEN used ELSE list_append(list_append(used, a_idx), b_idx) END,
    CASE WHEN list_contains(used, a_idx) OR list_contains(used, b_idx) THEN won ELSE list_append(won, st.rk) END, st.rk + 1
  FROM st JOIN pr ON pr.recording_id = st.recording_id AND pr.rk = st.rk),
fin AS (SELECT recording_id, arg_max(won, rk) AS won FROM st GROUP BY ALL),
m AS (SELECT pr.* FROM pr JOIN fin ON fin.recording_id = pr.recording_id AND list_contains(won, rk))"""
MATCH = f"WITH RECURSIVE {_MATCH} SELECT recording_id, a_idx, round(a_t, 6) AS a_t, b_idx, round(b_t, 6) AS b_t FROM m"


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return M.matched_durations(_matches(spark, sf), *_devices(spark, sf), 3_600_000.0, 1e9)


def matched_durations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_matched(spark, sf), 3)


_MD = f"""{_MATCH}, ra AS (SELECT recording_id, idx AS a_idx, row_number() OVER (PARTITION BY recording_id ORDER BY t_s) AS a_k FROM a),
rv AS (SELECT recording_id, idx AS b_idx, row_number() OVER (PARTITION BY recording_id ORDER BY t_s) AS b_k FROM v),
mm AS (SELECT m.*, a_k, b_k FROM m JOIN ra ON ra.recording_id = m.recording_id AND ra.a_idx = m.a_idx JOIN rv ON rv.recording_id = m.recording_id AND rv.b_idx = m.b_idx),
dd AS (SELECT *, a_k - lag(a_k) OVER w = 1 AND b_k - lag(b_k) OVER w = 1 AS nx, 1000 * (a_t - lag(a_t) OVER w) AS a_ms, 1000 * (b_t - lag(b_t) OVER w) AS b_ms FROM mm WINDOW w AS (PARTITION BY recording_id ORDER BY a_k)),
md AS (SELECT recording_id, a_idx, b_idx, a_ms, b_ms, a_ms - b_ms AS diff_ms FROM dd WHERE nx AND a_ms BETWEEN 3600000 AND 1000000000 AND b_ms BETWEEN 3600000 AND 1000000000)"""
MATCHED = f"WITH RECURSIVE {_MD} SELECT recording_id, a_idx, b_idx, round(a_ms, 3) AS a_ms, round(b_ms, 3) AS b_ms, round(diff_ms, 3) AS diff_ms FROM md"


def participant_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and sd of matched differences per block (half of the recording by the onset's number) of five pairs or more."""
    return rounded(H.participant_extract(_matched(spark, sf).withColumn("block", F.floor(F.col("a_idx") / 60))), 3)


EXTRACT = f"""WITH RECURSIVE {_MD}, b AS (SELECT recording_id, a_idx // 60 AS block, count(*) AS n, avg(diff_ms) AS m, stddev_samp(diff_ms) AS sd FROM md GROUP BY ALL)
SELECT recording_id, count(*) FILTER (n >= 5) AS n_blocks, sum(n)::BIGINT AS n_pairs, round(avg(m) FILTER (n >= 5), 3) AS mean_ms, round(avg(sd) FILTER (n >= 5), 3) AS sd_ms FROM b GROUP BY ALL"""


def detection_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.detection_score(_matches(spark, sf), *_devices(spark, sf)))


SCORE = f"""WITH RECURSIVE {_MATCH}, na AS (SELECT recording_id, count(*) AS n_a FROM a GROUP BY ALL), nb AS (SELECT recording_id, count(*) AS n_b FROM v GROUP BY ALL), nm AS (SELECT recording_id, count(*) AS n_m FROM m GROUP BY ALL),
x AS (SELECT recording_id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_m, 0) AS n_m FROM na FULL JOIN nb USING (recording_id) LEFT JOIN nm USING (recording_id))
SELECT *, round(n_m / nullif(n_a, 0), 6) AS precision, round(n_m / nullif(n_b, 0), 6) AS recall, round(2 * n_m / nullif(n_a + n_b, 0), 6) AS f1 FROM x"""


def onset_timing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.onset_timing(_matches(spark, sf)), 3)


TIMING = f"""WITH RECURSIVE {_MATCH} SELECT recording_id, count(*) AS n, round(median(1000 * (a_t - b_t)), 3) AS median_ms,
round(quantile_cont(1000 * (a_t - b_t), 0.75) - quantile_cont(1000 * (a_t - b_t), 0.25), 3) AS iqr_ms FROM m GROUP BY ALL"""


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of measures per line: device a, device b, a participant (supplier), a block."""
    li = read(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("participant_id"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_quantity") + (F.col("l_discount") - 0.05) * 100 + F.col("l_suppkey") % 7).alias("b"),
        F.col("l_returnflag").alias("block"), (F.col("l_quantity") > 25).alias("up_a"), ((F.col("l_quantity") + (F.col("l_discount") - 0.05) * 100) > 25).alias("up_b"),
        F.col("l_tax").alias("quality"), (F.col("l_linenumber") * 1.0).alias("elapsed"),
    )


_R = """r AS (SELECT l_suppkey AS participant_id, l_orderkey, l_linenumber, l_quantity AS a, l_quantity + (l_discount - 0.05::DOUBLE) * 100 + l_suppkey % 7 AS b, l_returnflag AS block,
  l_quantity > 25 AS up_a, l_quantity + (l_discount - 0.05::DOUBLE) * 100 > 25 AS up_b, l_tax AS quality, l_linenumber::DOUBLE AS elapsed FROM lineitem)"""


def ccc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_rated(spark, sf).groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), A.ccc("a", "b").alias("ccc")))


CCC = f"WITH {_R} SELECT participant_id, count(*) AS n, round(2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2), 6) AS ccc FROM r GROUP BY ALL"


def icc_2_1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.icc_2_1(_rated(spark, sf), "a", "b", ("participant_id",)))


ICC = f"""WITH {_R}, ln AS (SELECT *, row_number() OVER () AS id FROM r), lg AS (SELECT participant_id, id, a AS x, 'a' AS rater FROM ln UNION ALL SELECT participant_id, id, b, 'b' FROM ln),
gm AS (SELECT participant_id, avg(x) AS g FROM lg GROUP BY ALL), sm AS (SELECT participant_id, id, avg(x) AS m FROM lg GROUP BY ALL), rm AS (SELECT participant_id, rater, avg(x) AS m FROM lg GROUP BY ALL),
ms AS (SELECT gm.participant_id, (SELECT count(*) FROM sm WHERE sm.participant_id = gm.participant_id) AS n,
  (SELECT 2 * sum((m - g) ** 2) FROM sm WHERE sm.participant_id = gm.participant_id) AS ssr, (SELECT sum((m - g) ** 2) FROM rm WHERE rm.participant_id = gm.participant_id) AS ssc,
  (SELECT sum((x - g) ** 2) FROM lg WHERE lg.participant_id = gm.participant_id) AS sst FROM gm),
q AS (SELECT participant_id, n, ssr / (n - 1) AS r, ssc * n AS c, (sst - ssr - ssc * n) / (n - 1) AS e FROM ms)
SELECT participant_id, n, round((r - e) / (r + e + 2 * (c - e) / n), 6) AS icc FROM q"""


def bland_altman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.bland_altman(_rated(spark, sf).withColumn("d", F.col("a") - F.col("b")), "participant_id", "d"))


_GT = f"""{_R}, gt AS (SELECT participant_id, count(*) AS n, avg(a - b) AS m, sum((a - b) ** 2) - count(*) * avg(a - b) ** 2 AS ssw FROM r GROUP BY ALL)"""
BLAND = f"""WITH {_GT}, t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS bias, sum(ssw) AS ssw, sum(n * n) AS n2, sum(n * m * m) AS nmm FROM gt),
u AS (SELECT *, ssw / (nn - k) AS msw, (nmm - nn * bias * bias) / (k - 1) AS msb, (nn - n2 / nn) / (k - 1) AS n0 FROM t)
SELECT k AS n_groups, round(bias, 6) AS bias, round(bias - 1.96::DOUBLE * sqrt(greatest(0, (msb - msw) / n0) + msw), 6) AS lower, round(bias + 1.96::DOUBLE * sqrt(greatest(0, (msb - msw) / n0) + msw), 6) AS upper, round(sqrt(msw), 6) AS within_sd FROM u"""


def between_sd_moment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.between_sd_moment(_rated(spark, sf).withColumn("d", F.col("a") - F.col("b")), "participant_id", "d"))


BETWEEN = f"""WITH {_R}, g AS (SELECT participant_id, count(*) AS n, avg(a - b) AS m, var_samp(a - b) AS v FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT count(*) AS n_groups, round(sqrt(greatest(0, var_samp(m) - avg(v / n))), 6) AS between_sd FROM g"""


def variance_components(spark: SparkSession, sf: str) -> DataFrame:
    """All but the profile bound, which a test compares with a dense likelihood."""
    found = A.variance_components(_rated(spark, sf).withColumn("d", F.col("a") - F.col("b")), "participant_id", "d")
    return rounded(found.drop("between_hi"), 3)


#: Restricted likelihood by its fixed point: with w = n / (1 + ratio n), the score in the ratio is zero where sum w^2 (m - mu)^2 * (N - 1) / rss equals
#: sum w - sum w^2 / sum w. Bisection over the logarithm of the ratio, not the search of the Spark query.
VARIANCE = f"""WITH RECURSIVE {_GT}, gk AS (SELECT * FROM gt WHERE n >= 5),
cell AS (SELECT n, count(*) AS k, avg(m) AS m, coalesce(var_pop(m), 0) * count(*) AS css, sum(ssw) AS ssw FROM gk GROUP BY n),
one AS (SELECT array_agg({{'n': n::DOUBLE, 'k': k, 'm': m, 'c': css}}) AS c, sum(n * k)::BIGINT AS n_obs, sum(k)::BIGINT AS n_groups, sum(ssw) AS ssw FROM cell),
bi AS (SELECT -24.0::DOUBLE AS lo, 24.0::DOUBLE AS hi, 0 AS i
  UNION ALL SELECT CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, i + 1 FROM (
    SELECT lo, hi, i, mid, list_sum(list_transform(c, lambda x: (x.n / (1 + exp(mid) * x.n)) ** 2 * (x.c + x.k * (x.m - mu) ** 2))) * (n_obs - 1) /
      (ssw + list_sum(list_transform(c, lambda x: x.n / (1 + exp(mid) * x.n) * (x.c + x.k * (x.m - mu) ** 2)))) >
      sw - list_sum(list_transform(c, lambda x: x.k * (x.n / (1 + exp(mid) * x.n)) ** 2)) / sw AS up
    FROM (SELECT *, list_sum(list_transform(c, lambda x: x.k * x.n / (1 + exp(mid) * x.n) * x.m)) / sw AS mu FROM (
      SELECT *, list_sum(list_transform(c, lambda x: x.k * x.n / (1 + exp(mid) * x.n))) AS sw FROM (SELECT lo, hi, i, (lo + hi) / 2 AS mid FROM bi WHERE i < 60), one)))),
ra AS (SELECT CASE WHEN hi < -23.9 THEN 0 ELSE exp((lo + hi) / 2) END AS ratio FROM bi WHERE i = 60),
w AS (SELECT ratio, sum(k * n / (1 + ratio * n) * m) / sum(k * n / (1 + ratio * n)) AS mu FROM ra, cell GROUP BY ratio),
v AS (SELECT ratio, (sum(ssw) + sum(n / (1 + ratio * n) * (css + k * (m - mu) ** 2))) / (sum(n * k) - 1) AS v2 FROM w, cell GROUP BY ratio)
SELECT n_obs, n_groups, round(sqrt(v2), 3) AS within_sd, round(sqrt(v2 * ratio), 3) AS between_sd, ratio = 0 AS singular FROM v, one"""


def classification_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.classification_agreement(_rated(spark, sf), "up_a", "up_b", ("participant_id",)))


_CA = f"""{_R}, c AS (SELECT participant_id, count(*) AS n, avg((up_a = up_b)::INT) AS po, avg(up_a::INT) AS pa, avg(up_b::INT) AS pb FROM r GROUP BY ALL),
d AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe, (pa + pb) * (1 - (pa + pb) / 2) AS pg FROM c)"""
AGREEMENT = f"""WITH {_CA} SELECT participant_id, n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN pg < 1 THEN (po - pg) / (1 - pg) END, 6) AS ac1 FROM d"""


def by_block_and_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.by_block_and_pooled(_rated(spark, sf), "a", "b"))


POOLED = f"""WITH {_R} SELECT block, grouping(block)::INT AS pooled, count(*) AS n, round(avg(a - b), 6) AS bias, round(avg(abs(a - b)), 6) AS mae,
round(2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2), 6) AS ccc FROM r GROUP BY ROLLUP (block)"""


def pacer_error(spark: SparkSession, sf: str) -> DataFrame:
    """Against a commanded value of 25."""
    return rounded(H.pacer_error(_rated(spark, sf), "participant_id", "a", "b", F.lit(25.0)))


PACER_ERROR = f"""WITH {_R} SELECT participant_id, round(avg(a - 25), 6) AS bias_a, round(avg(abs(a - 25)), 6) AS mae_a, round(avg(b - 25), 6) AS bias_b, round(avg(abs(b - 25)), 6) AS mae_b,
round(avg(abs(a - 25)) - avg(abs(b - 25)), 6) AS mae_difference FROM r GROUP BY ALL"""


def coefficient_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Slopes on elapsed time; their differences go on into t bounds over all participants."""
    d = H.coefficient_difference(_rated(spark, sf), "participant_id", "elapsed", "a", "b")
    t = T.t_bounds(d.withColumn("all", F.lit(1)), "difference", 0.5, ["all"]).select("t_lower", "t_upper")
    return rounded(d.crossJoin(F.broadcast(t)))  # one row


COEFFICIENT = f"""WITH {_R}, d AS (SELECT participant_id, count(*) AS n, regr_slope(a, elapsed) AS sa, regr_slope(b, elapsed) AS sb FROM r GROUP BY ALL HAVING count(*) >= 4),
t AS (SELECT avg(sa - sb) AS m, stddev_samp(sa - sb) / sqrt(count(sa - sb)) AS se FROM d)
SELECT participant_id, n, round(sa, 6) AS slope_a, round(sb, 6) AS slope_b, round(sa - sb, 6) AS difference, round((m + 0.5) / se, 6) AS t_lower, round((m - 0.5) / se, 6) AS t_upper FROM d, t"""


def rate_slopes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.rate_slopes(_rated(spark, sf), "participant_id", F.col("a") - F.col("b"), "a"))


RATE_SLOPES = f"WITH {_R} SELECT participant_id, count(*) AS n, round(regr_slope(a - b, a), 6) AS slope FROM r GROUP BY ALL HAVING count(*) >= 4"


def quality_moderation(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of three lines up to each."""
    return rounded(H.quality_moderation(_rated(spark, sf), "participant_id", "elapsed", "quality", "a", "b", 1.0))


MODERATION = f"""WITH {_R}, w AS (SELECT participant_id, elapsed AS t, avg(abs(a - b)) OVER v AS e, avg(quality) OVER v AS q FROM r WINDOW v AS (PARTITION BY participant_id ORDER BY elapsed RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)),
z AS (SELECT participant_id, t, e, (q - avg(q) OVER p) / nullif(stddev_samp(q) OVER p, 0) AS z FROM w WINDOW p AS (PARTITION BY participant_id)),
c AS (SELECT participant_id, count(*) AS n, var_samp(z) AS v1, var_samp(t) AS v2, covar_samp(z, t) AS c12, covar_samp(z, e) AS c1y, covar_samp(t, e) AS c2y FROM z GROUP BY ALL HAVING count(*) >= 4)
SELECT participant_id, n, round((c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12), 6) AS b1, round((c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12), 6) AS b2 FROM c"""


def pre_post_change(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement and variation in block R less those in block A."""
    return rounded(H.pre_post_change(_rated(spark, sf), "participant_id", "block", "A", "R", "a", "b"))


PRE_POST = f"""WITH {_R}, g AS (SELECT participant_id, block, avg(abs(a - b)) AS mae, 2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2) AS ccc, stddev_samp(a) / avg(a) AS cv_a, stddev_samp(b) / avg(b) AS cv_b FROM r WHERE block IN ('A', 'R') GROUP BY ALL),
p AS (SELECT * FROM g WHERE block = 'A'), q AS (SELECT * FROM g WHERE block = 'R')
SELECT participant_id, {", ".join(f"round(p.{m}, 6) AS {m}_pre, round(q.{m}, 6) AS {m}_post, round(q.{m} - p.{m}, 6) AS {m}_change" for m in ("mae", "ccc", "cv_a", "cv_b"))} FROM p FULL JOIN q USING (participant_id)"""


def device_missingness(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a class from one device only: device a saw returned lines, device b open ones."""
    li = read(spark, sf, "lineitem")
    side = lambda c: li.where(c).groupBy("l_orderkey").agg(F.lit(True).alias("class"), F.count(F.lit(1)).alias("n_breaths"))
    return rounded(H.device_missingness(side("l_returnflag = 'R'"), side("l_linestatus = 'O'"), "l_orderkey"))


MISSINGNESS = """WITH a AS (SELECT l_orderkey, count(*) AS n_a FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_orderkey, count(*) AS n_b FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (n_b IS NULL) AS only_a, count(*) FILTER (n_a IS NULL) AS only_b, count(*) FILTER (n_a = 1 OR n_b = 1) AS single,
round(avg((n_a IS NULL OR n_b IS NULL)::INT), 6) AS missing_rate, round(avg(coalesce(n_a = 1 OR n_b = 1, false)::INT), 6) AS single_rate FROM a FULL JOIN b USING (l_orderkey)"""


def bias_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Biases of 0 to 12 on device b, classes above 25; without the lower bound and the first failing bias, which need the t distribution."""
    return rounded(H.bias_sweep(_rated(spark, sf), "participant_id", "a", "b", 25.0, list(range(0, 13, 2))).drop("lower_bound", "first_failing"))


SWEEP = f"""WITH {_R}, x AS (SELECT bias::DOUBLE AS bias, a > 25 AS up_a, b + bias > 25 AS up_b FROM r, range(0, 13, 2) t(bias)),
c AS (SELECT bias, count(*) AS n, avg((up_a = up_b)::INT) AS po, avg(up_a::INT) AS pa, avg(up_b::INT) AS pb FROM x GROUP BY ALL), d AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe, (pa + pb) * (1 - (pa + pb) / 2) AS pg FROM c)
SELECT bias, n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN pg < 1 THEN (po - pg) / (1 - pg) END, 6) AS ac1 FROM d"""


def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.cluster_bootstrap(_rated(spark, sf).withColumn("d", F.col("a") - F.col("b")), "participant_id", "d"))


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("participant_id"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "faster").otherwise("slower").alias("staircase"),
        F.col("o_orderkey").alias("trial"), F.log10(F.lit(0.1) + F.col("o_totalprice") / 300000).alias("intensity"), (F.col("o_orderstatus") != "F").alias("correct"), (F.col("o_orderpriority") == "5-LOW").alias("catch"),
    )


_T = """tr AS (SELECT o_custkey AS participant_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'faster' ELSE 'slower' END AS staircase, o_orderkey AS trial,
  log10(0.1::DOUBLE + o_totalprice / 300000) AS s, o_orderstatus <> 'F' AS ok FROM orders WHERE o_orderpriority <> '5-LOW'),
lv AS (SELECT i::INT AS level, log10(0.1::DOUBLE) + i * (log10(2.0::DOUBLE) - log10(0.1::DOUBLE)) / 45 AS t FROM range(46) r(i)),
ll AS (SELECT *, 0.98::DOUBLE * (0.5 + 0.5 * (1 - exp(-(10.0::DOUBLE ** (3.5 * (s - t)))))) + 0.01 AS hit FROM tr, lv),
lg AS (SELECT *, ln(CASE WHEN ok THEN hit ELSE (1 - hit) / 2 END) AS l, -0.5 * ((t - log10(0.5::DOUBLE)) / 0.25) ** 2 AS prior FROM ll)"""


def staircase_posterior(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.staircase_posterior(_trials(spark, sf)))


POSTERIOR = f"""WITH {_T}, p AS (SELECT participant_id, staircase, level, t, any_value(prior) + sum(l) AS logp FROM lg GROUP BY participant_id, staircase, level, t),
e AS (SELECT *, exp(logp - max(logp) OVER (PARTITION BY participant_id, staircase)) AS e FROM p)
SELECT participant_id, staircase, level, round(t, 6) AS threshold, round(e / sum(e) OVER (PARTITION BY participant_id, staircase), 6) AS p FROM e"""


def staircase_trace(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.staircase_trace(_trials(spark, sf)), 5)


_TRACE = f"""{_T}, c AS (SELECT *, prior + sum(l) OVER (PARTITION BY participant_id, staircase, level ORDER BY trial) AS logp FROM lg),
e AS (SELECT *, exp(logp - max(logp) OVER (PARTITION BY participant_id, staircase, trial)) AS p FROM c),
m AS (SELECT participant_id, staircase, trial, sum(p * t) / sum(p) AS mean, sum(p * t * t) / sum(p) AS m2 FROM e GROUP BY ALL),
z AS (SELECT participant_id, staircase, trial, mean, sqrt(greatest(0, m2 - mean * mean)) AS sd FROM m)"""
TRACE = f"WITH {_TRACE} SELECT participant_id, staircase, trial, round(mean, 5) AS mean, round(sd, 5) AS sd FROM z"


def staircase_stop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.staircase_stop(_trials(spark, sf)), 5)


STOP = f"""WITH {_TRACE}, k AS (SELECT *, row_number() OVER (PARTITION BY participant_id, staircase ORDER BY trial) AS k FROM z)
SELECT participant_id, staircase, count(*) AS n_trials, min(trial) FILTER ((sd < 0.1 AND k >= 10) OR k >= 60) AS stop_trial, round(arg_max(sd, trial), 5) AS last_sd FROM k GROUP BY ALL"""


def threshold_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.threshold_table(_trials(spark, sf), ["faster", "slower"]), 5)


THRESHOLDS = f"""WITH {_TRACE}, l AS (SELECT participant_id, staircase, arg_max(mean, trial) AS mean, arg_max(sd, trial) AS sd FROM z GROUP BY ALL)
SELECT participant_id, round(max(10.0 ** mean) FILTER (staircase = 'faster'), 5) AS t_faster, round(max(sd) FILTER (staircase = 'faster'), 5) AS sd_faster,
round(max(10.0 ** mean) FILTER (staircase = 'slower'), 5) AS t_slower, round(max(sd) FILTER (staircase = 'slower'), 5) AS sd_slower, round(avg(10.0 ** mean), 5) AS t_mean FROM l GROUP BY ALL"""

QUERIES = {
    "make_epochs": (make_epochs, MAKE_EPOCHS), "epoch_breaths_start": (epoch_breaths_start, EB_START), "epoch_breaths_contained": (epoch_breaths_contained, EB_CONTAINED),
    "epoch_breaths_overlap": (epoch_breaths_overlap, EB_OVERLAP), "epoch_features": (epoch_features, EPOCH_FEATURES), "quality_gate": (quality_gate, GATE),
    "rate_series_constant": (rate_series_constant, RATE_CONSTANT), "rate_series_linear": (rate_series_linear, RATE_LINEAR), "match_onsets": (match_onsets, MATCH),
    "matched_durations": (matched_durations, MATCHED), "participant_extract": (participant_extract, EXTRACT), "detection_score": (detection_score, SCORE), "onset_timing": (onset_timing, TIMING),
    "ccc": (ccc, CCC), "icc_2_1": (icc_2_1, ICC), "bland_altman": (bland_altman, BLAND), "between_sd_moment": (between_sd_moment, BETWEEN), "variance_components": (variance_components, VARIANCE),
    "classification_agreement": (classification_agreement, AGREEMENT), "by_block_and_pooled": (by_block_and_pooled, POOLED), "pacer_error": (pacer_error, PACER_ERROR),
    "coefficient_difference": (coefficient_difference, COEFFICIENT), "rate_slopes": (rate_slopes, RATE_SLOPES), "quality_moderation": (quality_moderation, MODERATION),
    "pre_post_change": (pre_post_change, PRE_POST), "device_missingness": (device_missingness, MISSINGNESS), "bias_sweep": (bias_sweep, SWEEP),
    "staircase_posterior": (staircase_posterior, POSTERIOR), "staircase_trace": (staircase_trace, TRACE), "staircase_stop": (staircase_stop, STOP), "threshold_table": (threshold_table, THRESHOLDS),
}
