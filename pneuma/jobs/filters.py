"""Queries over filters, decimation, despiking and spectra; their SQL spells out the discrete Fourier transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.islands import REC, rounded
from ..operators import devices as D
from ..operators import spectrum as P
from ..operators import timebase as T
from ..sources.tables import SAMPLES_SQL, VECTORS_SQL, event_samples, read, vector_samples
from .assembly import _AX, _PSD, _axes
from .signals import _G, _GAPPY, _gappy

N = 64


def band_response(edges: str, order: int, f: str = "f") -> str:
    """Gain of the Butterworth pass at frequency f of rate fs; edges: low, high or both, as in `0.5, 5.0`, `, 5.0` or `0.5,`."""
    low, high = (e.strip() for e in edges.split(","))
    o = f"tan(pi() * least({f}, 0.499999::DOUBLE * fs) / fs)"
    t = lambda e: f"tan(pi() * {e} / fs)"
    if low and high:
        x = f"({o} ** 2 - {t(low)} * {t(high)}) / nullif({o} * ({t(high)} - {t(low)}), 0)"
    else:
        x = f"{o} / {t(high)}" if high else f"{t(low)} / nullif({o}, 0)"
    return f"coalesce(1 / (1 + abs({x}) ** {2 * order}), 0)"


def _chebyshev(q: int) -> str:
    x = f"(tan(pi() * least(f, 0.499999::DOUBLE * fs) / fs) / tan(pi() * 0.8 / {2 * q}))"
    return f"1 / (1 + (10.0::DOUBLE ** 0.005 - 1) * (CASE WHEN {x} <= 1 THEN cos(8 * acos(least(1, {x}))) ELSE cosh(8 * acosh(greatest(1, {x}))) END) ** 2)"


def dft_filter_sql(source: str, gain: str, fs: float, pad: int = N - 1, name: str = "fl", n: int = N) -> str:
    """Common tables that end in {name}(recording_id, idx, value): source (recording_id, idx, value; n samples each) with odd reflection,
    transformed, times the gain, and back."""
    m = n + 2 * pad
    return f"""{name}_n AS (SELECT recording_id, array_agg(value ORDER BY idx) AS v FROM {source} GROUP BY ALL HAVING count(*) = {n}),
{name}_x AS (SELECT recording_id, j, CASE WHEN j < {pad} THEN 2 * v[1] - v[{pad} - j + 1] WHEN j < {pad + n} THEN v[j - {pad} + 1] ELSE 2 * v[{n}] - v[{2 * n - 1} - (j - {pad})] END AS x FROM {name}_n, range(0, {m}) t(j)),
{name}_f AS (SELECT recording_id, k, sum(x * cos(2 * pi() * ((k * j) % {m}) / {m})) AS re, -sum(x * sin(2 * pi() * ((k * j) % {m}) / {m})) AS im FROM {name}_x, range(0, {m // 2 + 1}) t(k) GROUP BY ALL),
{name}_g AS (SELECT recording_id, k, re * g AS re, im * g AS im FROM (SELECT *, ({gain}) * CASE WHEN k = 0 OR 2 * k = {m} THEN 1 ELSE 2 END / {m} AS g FROM (SELECT *, k * fs / {m} AS f FROM (SELECT *, {fs}::DOUBLE AS fs FROM {name}_f)))),
{name} AS (SELECT recording_id, i AS idx, sum(re * cos(2 * pi() * ((k * (i - 1 + {pad})) % {m}) / {m}) - im * sin(2 * pi() * ((k * (i - 1 + {pad})) % {m}) / {m})) AS value FROM {name}_g, range(1, {n + 1}) t(i) GROUP BY ALL)"""


def _filter_oracle(gain: str, digits: int = 6) -> str:
    return f"WITH {VECTORS_SQL}, {dft_filter_sql('e', gain, 25.0)} SELECT recording_id, idx, round(value, {digits}) AS value FROM fl"


def zero_phase_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.zero_phase_filter(vector_samples(spark, sf), 25.0, 0.5, 5.0))


def calib_bandpass(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.calib_bandpass(vector_samples(spark, sf), 25.0, 0.5, 5.0))


def calib_lowpass(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.calib_lowpass(vector_samples(spark, sf), 25.0, 3.0))


def detrend_highpass(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.detrend_highpass(vector_samples(spark, sf), 25.0, 1.0))


def decimate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.decimate(vector_samples(spark, sf), 25.0, 2))


def downsample(spark: SparkSession, sf: str) -> DataFrame:
    """Towards 13 Hz, with the rate reached."""
    x, fs = P.downsample(vector_samples(spark, sf), 25.0, 13.0)
    return rounded(x.withColumn("fs", F.lit(fs)))


_DECIMATED = f"WITH {VECTORS_SQL}, {dft_filter_sql('e', _chebyshev(2), 25.0)} SELECT recording_id, (idx - 1) // 2 + 1 AS idx, round(value, 6) AS value"
DECIMATE = f"{_DECIMATED} FROM fl WHERE idx % 2 = 1"
DOWNSAMPLE = f"{_DECIMATED}, 12.5::DOUBLE AS fs FROM fl WHERE idx % 2 = 1"


def decimation_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Stages of each factor that occurs, or a nearby factor where it is refused."""
    p = P.decimation_plans(read(spark, sf, "part").select(F.col("p_size").alias("q")))
    return p.select("q", F.array_join(F.transform("stages", lambda s: s.cast("string")), " x ").alias("stages"), F.aggregate("stages", F.lit(1), lambda a, s: a * s).alias("product"), "nearby")


DECIMATION_PLAN = """WITH RECURSIVE n AS (SELECT range::INT AS q FROM range(1, 62)),
pf AS (SELECT q, q AS rest, 2 AS p, []::INT[] AS ps FROM n
  UNION ALL SELECT q, CASE WHEN rest % p = 0 THEN rest // p ELSE rest END, CASE WHEN rest % p = 0 THEN p ELSE p + 1 END, CASE WHEN rest % p = 0 THEN list_append(ps, p) ELSE ps END FROM pf WHERE rest > 1),
pr AS (SELECT q, list_reverse_sort(ps) AS ps FROM pf WHERE rest = 1),
st AS (SELECT q, ps, 1 AS i, []::INT[] AS s FROM pr
  UNION ALL SELECT q, ps, i + 1, CASE WHEN list_position(list_transform(s, lambda x: x * ps[i] <= 13), true) > 0
    THEN list_concat(list_concat(s[1 : list_position(list_transform(s, lambda x: x * ps[i] <= 13), true)::INT - 1], [s[list_position(list_transform(s, lambda x: x * ps[i] <= 13), true)] * ps[i]]), s[list_position(list_transform(s, lambda x: x * ps[i] <= 13), true)::INT + 1 :])
    ELSE list_append(s, ps[i]) END FROM st WHERE i <= len(ps)),
fin AS (SELECT q, ps, list_reverse_sort(s) AS s, coalesce(ps[1], 1) > 40 AS refused FROM st WHERE i = len(ps) + 1)
SELECT q, CASE WHEN NOT refused THEN array_to_string(s, ' x ') END AS stages, CASE WHEN NOT refused THEN q END AS product,
  CASE WHEN refused THEN (SELECT arg_min(o.q, abs(o.q - fin.q) + o.q / 1000.0) FROM fin o WHERE coalesce(o.ps[1], 1) <= 13 AND o.q >= 2 AND o.q BETWEEN floor(fin.q * 0.8) AND ceil(fin.q * 1.2)) END AS nearby
FROM fin WHERE q IN (SELECT p_size FROM part)"""


def decimation_factor(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", P.decimation_factor(F.lit(1000.0), F.col("p_size").cast("double"), False).alias("q"))


FACTOR = "SELECT p_partkey, CASE WHEN 1000 % p_size = 0 THEN (1000 // p_size)::INT END AS q FROM part"


def despike(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of five samples, on recordings with gaps."""
    return rounded(P.despike(_gappy(spark, sf), 10.0, 1.0, 0.3, 0.5))


#: Gaps bridged as in fill_gaps; s5 holds the two made samples at either end too.
_BRIDGED = f"""{_GAPPY}, kn AS (SELECT * FROM c WHERE value IS NOT NULL),
lf AS (SELECT c.*, kn.idx AS i0, kn.value AS v0 FROM c ASOF LEFT JOIN kn ON kn.recording_id = c.recording_id AND kn.idx <= c.idx),
rt AS (SELECT lf.*, kn.idx AS i1, kn.value AS v1 FROM lf ASOF LEFT JOIN kn ON kn.recording_id = lf.recording_id AND kn.idx >= lf.idx),
br AS (SELECT recording_id, idx, value IS NULL AS filled, CASE WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL OR i0 = i1 THEN v0 ELSE v0 + (v1 - v0) * (idx - i0) / (i1 - i0) END AS v, count(*) OVER (PARTITION BY recording_id) AS n FROM rt)"""
DESPIKE = f"""WITH {_BRIDGED}, df AS (SELECT *, v - lag(v) OVER w AS d1, v - lag(v, 2) OVER w AS d FROM br WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
sl AS (SELECT recording_id, max(n) AS n, median(d1) FILTER (idx BETWEEN 3 AND 4) AS sh, median(d1) FILTER (idx BETWEEN n - 2 AND n - 1) AS st, max(v) FILTER (idx = 2) AS v2, max(v) FILTER (idx = n - 1) AS vl, median(d) AS md FROM df GROUP BY ALL),
ex AS (SELECT recording_id, idx, v FROM br UNION ALL SELECT recording_id, j, v2 + sh * (j - 2) FROM sl, (VALUES (-1), (0)) t(j) UNION ALL SELECT recording_id, n + j, vl + st * (j + 1) FROM sl, (VALUES (1), (2)) t(j)),
me AS (SELECT recording_id, idx, median(v) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med FROM ex),
sc AS (SELECT df.recording_id, 1.4826 * median(abs(d - md)) AS sc FROM df JOIN sl USING (recording_id) GROUP BY ALL),
fg AS (SELECT df.*, coalesce(NOT filled AND abs(v - med) > sc, false) AS bad FROM df JOIN me USING (recording_id, idx) JOIN sc USING (recording_id)),
rn AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (SELECT *, (bad IS DISTINCT FROM lag(bad) OVER (PARTITION BY recording_id ORDER BY idx))::INT AS ch FROM fg)),
sp AS (SELECT *, bad AND count(*) OVER (PARTITION BY recording_id, run) <= 3 AS spiked FROM rn),
ok AS (SELECT recording_id, idx, v FROM sp WHERE NOT spiked AND NOT filled),
l2 AS (SELECT sp.*, ok.idx AS i0, ok.v AS v0 FROM sp ASOF LEFT JOIN ok ON ok.recording_id = sp.recording_id AND ok.idx <= sp.idx),
r2 AS (SELECT l2.*, ok.idx AS i1, ok.v AS v1 FROM l2 ASOF LEFT JOIN ok ON ok.recording_id = l2.recording_id AND ok.idx >= l2.idx)
SELECT recording_id, idx, round(CASE WHEN filled THEN NULL WHEN NOT spiked THEN v WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (idx - i0) / (i1 - i0) END, 6) AS value, spiked FROM r2"""


def detrend_median(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of nine samples, on recordings with gaps."""
    return rounded(P.detrend_median(_gappy(spark, sf), 10.0, 0.9))


DETREND_MEDIAN = f"""WITH {_BRIDGED}, md AS (SELECT *, median(v) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN least(4, idx - 1, n - idx) PRECEDING AND least(4, idx - 1, n - idx) FOLLOWING) AS m FROM br),
nb AS (SELECT *, lead(m) OVER w AS a1, lead(m, 2) OVER w AS a2, lag(m) OVER w AS b1, lag(m, 2) OVER w AS b2 FROM md WINDOW w AS (PARTITION BY recording_id ORDER BY idx))
SELECT recording_id, idx, round(CASE WHEN NOT filled THEN v - CASE WHEN idx = 1 THEN list_median([v, a1, 3 * a1 - 2 * a2]) WHEN idx = n THEN list_median([v, b1, 3 * b1 - 2 * b2]) ELSE m END END, 6) AS value FROM nb"""


def dominant_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.dominant_rate(vector_samples(spark, sf), 25.0, 1.0, 9.0))


DOMINANT = f"""WITH {VECTORS_SQL}, ce AS (SELECT recording_id, idx, value - avg(value) OVER (PARTITION BY recording_id) AS x FROM e),
ft AS (SELECT recording_id, k, sum(x * cos(2 * pi() * k * (idx - 1) / 64)) ** 2 + sum(x * sin(2 * pi() * k * (idx - 1) / 64)) ** 2 AS p FROM ce, range(0, 33) t(k) WHERE k * 25.0 / 64 BETWEEN 1 AND 9 GROUP BY ALL)
SELECT recording_id, round(arg_max(k, round(p, 9) - k * 1e-13) * 25.0::DOUBLE / 64 * 60, 6) AS rate_bpm FROM ft GROUP BY ALL"""


def double_integrate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.double_integrate(vector_samples(spark, sf), 25.0, 0.5))


DOUBLE_INTEGRATE = f"WITH {VECTORS_SQL}, {dft_filter_sql('e', 'CASE WHEN f >= 0.5 THEN -1 / (2 * pi() * f) ** 2 ELSE 0 END', 25.0, 0)} SELECT recording_id, idx, round(value, 6) AS value FROM fl"


def flag_alias_prone(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as signals of 400 Hz on the way to 25 Hz."""
    return rounded(P.flag_alias_prone(P.welch_psd(vector_samples(spark, sf), 400.0, 32), 25.0, 1.0, 40, (10.0, 20.0), 9.0))


ALIAS = f"""WITH {_PSD}, g AS (SELECT recording_id, sum(power) FILTER (bin % 2 = 0 AND bin > 0) AS near, sum(power) FILTER (bin = 1) AS band FROM psd GROUP BY ALL)
SELECT recording_id, round(10 * log10(near / band), 6) AS alias_db, 10 * log10(near / band) > 9 AS alias_prone FROM g"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _axes(spark, sf).select(F.col("participant_id").alias("recording_id"), "idx", F.col("x").alias("a"), F.col("y").alias("b"))


def coherence_null(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.coherence_null(_pairs(spark, sf), 25.0, 16, 200))


COHERENCE_NULL = f"""WITH {_AX}, h AS (SELECT i, 0.5 * (1 - cos(2 * pi() * i / 15)) AS w FROM range(0, 16) t(i)),
sp AS (SELECT participant_id, k, sqrt(sum(yc * cos(2 * pi() * k * (idx - 1) / 64)) ** 2 + sum(yc * sin(2 * pi() * k * (idx - 1) / 64)) ** 2) AS size
  FROM (SELECT *, y - avg(y) OVER (PARTITION BY participant_id) AS yc FROM ax), range(0, 33) t(k) GROUP BY ALL),
x0 AS (SELECT participant_id, s, k, size, ((participant_id::UBIGINT * 2654435761) % 4294967296 + (s::UBIGINT * 2246822519) % 4294967296 + (k::UBIGINT * 3266489917) % 4294967296) % 4294967296 AS x FROM sp, range(0, 200) t(s)),
x1 AS (SELECT * REPLACE ((xor(x, x >> 16) * 2146121005) % 4294967296 AS x) FROM x0),
x2 AS (SELECT * REPLACE ((xor(x, x >> 15) * 2221713035) % 4294967296 AS x) FROM x1),
ph AS (SELECT participant_id, s, k, size * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64 AS amp, 2 * pi() * xor(x, x >> 16) / 4294967296.0::DOUBLE AS phi FROM x2),
fk AS (SELECT participant_id, s, i, sum(amp * cos(2 * pi() * k * i / 64 + phi)) AS v FROM ph, range(0, 64) t(i) GROUP BY ALL),
al AS (SELECT participant_id, s, i, v FROM fk UNION ALL SELECT participant_id, -1, idx - 1, x FROM ax),
sg AS (SELECT participant_id, s, g, i - 8 * g AS i, v - avg(v) OVER (PARTITION BY participant_id, s, g) AS v FROM al, range(0, 7) t(g) WHERE i BETWEEN 8 * g AND 8 * g + 15),
ft AS (SELECT participant_id, s, g, bin, sum(v * w * cos(2 * pi() * bin * i / 16)) AS re, -sum(v * w * sin(2 * pi() * bin * i / 16)) AS im FROM sg JOIN h USING (i), range(0, 8) t(bin) GROUP BY ALL),
co AS (SELECT b.participant_id, b.s, b.bin, (sum(a.re * b.re + a.im * b.im) ** 2 + sum(a.im * b.re - a.re * b.im) ** 2) / (sum(a.re ** 2 + a.im ** 2) * sum(b.re ** 2 + b.im ** 2)) AS c
  FROM ft a JOIN ft b ON a.participant_id = b.participant_id AND a.g = b.g AND a.bin = b.bin AND a.s = -1 AND b.s >= 0 GROUP BY ALL)
SELECT participant_id AS recording_id, bin, round(quantile_cont(c, 0.95), 6) AS null_coherence, round(bin * 25.0::DOUBLE / 16, 6) AS freq FROM co GROUP BY ALL"""


def cycle_shape_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of sixteen samples of the first two axes."""
    ax = _pairs(spark, sf).withColumn("t_s", (F.col("idx") - 1) / F.lit(25.0))
    cycles = ax.where("idx % 16 = 1").select(*REC, F.floor(F.col("idx") / 16).alias("breath"), F.col("t_s").alias("t_start"), (F.col("t_s") + 0.6).alias("t_end"))
    return rounded(D.cycle_shape_corr(ax.withColumn("value", F.col("a")), ax.withColumn("value", F.col("b")), cycles, 8))


CYCLE = f"""WITH {_AX}, g AS (SELECT DISTINCT participant_id, c, i, c * 16 + i * 15 / 8.0::DOUBLE AS p FROM ax, range(0, 4) t(c), range(0, 8) u(i)),
v AS (SELECT g.*, a.x + (p - floor(p)) * (b.x - a.x) AS va, a.y + (p - floor(p)) * (b.y - a.y) AS vb FROM g JOIN ax a ON a.participant_id = g.participant_id AND a.idx = floor(p) + 1 JOIN ax b ON b.participant_id = g.participant_id AND b.idx = least(64, floor(p) + 2))
SELECT participant_id AS recording_id, c AS breath, round(corr(va, vb), 6) AS r FROM v GROUP BY ALL"""


def sample_time(spark: SparkSession, sf: str) -> DataFrame:
    """Time of each sample at 25 Hz from the recording's own start."""
    s = event_samples(spark, sf)
    return rounded(T.sample_time(s.select(*REC, "idx", "code"), 25.0, F.col("code") / 10).select(*REC, "idx", "t_s"))


SAMPLE_TIME = f"WITH {SAMPLES_SQL} SELECT recording_id, idx, round(code / 10.0::DOUBLE + (idx - 1) / 25.0::DOUBLE, 6) AS t_s FROM s"


def project_to_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Sample numbers at one in six hours with an offset of two hours, on the first device's grid."""
    s = event_samples(spark, sf)
    drift = s.select(*REC).distinct().withColumn("offset0_ms", F.lit(7_200_000.0))
    return rounded(T.project_to_grid(s, drift, T.make_grid(s, 21600.0), 1 / 21600.0))


PROJECT = f"""WITH {_G}, q AS (SELECT recording_id, 7200 + (idx - 1) * 21600.0::DOUBLE AS t_s, value FROM s),
l AS (SELECT g.*, q.t_s AS t0, q.value AS v0 FROM g ASOF LEFT JOIN q ON q.recording_id = g.recording_id AND q.t_s <= g.t_s),
r AS (SELECT l.*, q.t_s AS t1, q.value AS v1 FROM l ASOF LEFT JOIN q ON q.recording_id = l.recording_id AND q.t_s >= l.t_s)
SELECT recording_id, k, round(t_s, 6) AS t_s, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t_s THEN v0 ELSE v0 + (t_s - t0) / (t1 - t0) * (v1 - v0) END, 6) AS value FROM r"""

QUERIES = {
    "zero_phase_filter": (zero_phase_filter, _filter_oracle(band_response("0.5, 5.0", 2))), "calib_bandpass": (calib_bandpass, _filter_oracle(band_response("0.5, 5.0", 4))),
    "calib_lowpass": (calib_lowpass, _filter_oracle(band_response(", 3.0", 4))), "detrend_highpass": (detrend_highpass, _filter_oracle(band_response("1.0,", 2))),
    "decimate": (decimate, DECIMATE), "downsample": (downsample, DOWNSAMPLE), "decimation_plan": (decimation_plan, DECIMATION_PLAN), "decimation_factor": (decimation_factor, FACTOR),
    "despike": (despike, DESPIKE), "detrend_median": (detrend_median, DETREND_MEDIAN), "dominant_rate": (dominant_rate, DOMINANT), "double_integrate": (double_integrate, DOUBLE_INTEGRATE),
    "flag_alias_prone": (flag_alias_prone, ALIAS), "coherence_null": (coherence_null, COHERENCE_NULL), "cycle_shape_corr": (cycle_shape_corr, CYCLE), "sample_time": (sample_time, SAMPLE_TIME),
    "project_to_grid": (project_to_grid, PROJECT),
}
