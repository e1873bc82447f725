"""Queries that write a table with the library's sinks and read it back, and readers of tables and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.islands import REC, rounded
from ..operators import calibration as K
from ..operators import devices as D
from ..sources import csv, sinks
from ..sources.shared import shared_folder
from ..sources.tables import SAMPLES_SQL, VECTORS_SQL, event_samples, vector_samples
from ..streaming.packets import packet_stream
from .assembly import _AX, _axes
from .filters import band_response, dft_filter_sql
from .recordings import BREATH_TABLE_SQL, EXTREMA_PROMINENCE_SQL, SUMMARY_SQL, breath_table, summarise_breaths
from .trialwise import _PAIRS, _SQUARE

S = SAMPLES_SQL


def write_breaths(spark: SparkSession, sf: str) -> DataFrame:
    """The breath table from files of ranges of recordings."""
    rows, path = breath_table(spark, sf), shared_folder(spark, "breaths")
    sinks.write_breaths(rows, path)
    return sinks.read_back(spark, path, rows)


def write_features(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = summarise_breaths(spark, sf), shared_folder(spark, "features")
    sinks.write_features(rows, path)
    return sinks.read_back(spark, path, rows)


def write_report_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two sheets, and from each of them, read back, its rows and total."""
    s = event_samples(spark, sf)
    sheets = {"trials": s.where("label = 'purchase'").select(*REC, "idx", "value"), "summary": s.groupBy(*REC).agg(F.count(F.lit(1)).alias("idx"), F.avg("value").alias("value"))}
    paths = sinks.write_report_tables(sheets, shared_folder(spark, "report"))
    back = [sinks.read_back(spark, p, sheet).select(F.lit(name).alias("sheet"), F.col("idx").cast("bigint").alias("idx"), "value") for p, (name, sheet) in zip(paths, sheets.items(), strict=True)]
    return rounded(back[0].unionByName(back[1]).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("total"), F.avg("value").alias("mean")), 4)


REPORT_TABLES = f"""WITH {S}, t AS (SELECT 'trials' AS sheet, idx, value FROM s WHERE label = 'purchase' UNION ALL SELECT 'summary', count(*), avg(value) FROM s GROUP BY recording_id)
SELECT sheet, count(*) AS n, sum(idx)::BIGINT AS total, round(avg(value), 4) AS mean FROM t GROUP BY ALL"""


def append_stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Packets appended by two runs from one checkpoint: the second finds nothing new."""
    folder = shared_folder(spark, "appended")
    stream = packet_stream(spark, sf)
    for _ in range(2):
        sinks.append_stream_rows(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return sinks.read_back(spark, f"{folder}/rows", stream).select("participant_id", "event_id", F.unix_micros("ts").alias("us"), "label", "value")


APPENDED = "SELECT user_id AS participant_id, event_id, epoch_us(ts) AS us, event_type AS label, value FROM events"


def read_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables by their schemas, one of them with a column that its file lacks."""
    t = csv.read_tables(spark, {"orders": (f"{sf}/orders.parquet", "o_orderkey bigint, o_custkey bigint"), "customer": (f"{sf}/customer.parquet", "c_custkey bigint, c_mktsegment string, c_session int")})
    c = t["customer"].groupBy("c_custkey", "c_mktsegment").agg(F.count("c_session").alias("sessions"))
    return t["orders"].join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("sessions").alias("sessions"))


TABLES = "SELECT c_mktsegment, count(*) AS n, 0::BIGINT AS sessions FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def read_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as channels; recordings of an odd number have a second one whose name holds `view` too, and so no whole channel."""
    s = event_samples(spark, sf).withColumn("fs", F.lit(25.0))
    s = s.withColumn("channel", F.when((F.col("label") == "click") & (F.col("recording_id") % 2 == 1), "Review Right").otherwise(F.initcap("label")))
    return csv.read_channels(s, "VIEW", strict=False).select(*REC, "idx", "channel")


CHANNELS = f"WITH {S} SELECT recording_id, idx, 'View' AS channel FROM s WHERE label = 'view' AND (recording_id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM s q WHERE q.recording_id = s.recording_id AND q.label = 'click'))"


def condition_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """Each sample as a trial's start, its code as the participant's overshoot."""
    return rounded(event_samples(spark, sf).select(*REC, "idx", K.condition_boundary(1000 * F.col("t_s"), F.col("code") * 1.0).alias("boundary_ms")), 3)


BOUNDARY = f"WITH {S} SELECT recording_id, idx, round(1000 * t_s + 2 * (4000 + code), 3) AS boundary_ms FROM s"

# ---- by eigenvectors and filters spelt out


def fit_pca(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.fit_pca(_axes(spark, sf)), 5)


#: The covariance matrix squared again and again is the projection on its first axis.
PCA = f"""WITH RECURSIVE {_AX}, cv AS (SELECT participant_id, count(*) AS n, {", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in _PAIRS)}, {", ".join(f"covar_samp({c}, target) AS c{c}, avg({c}) AS m{c}" for c in "xyz")}, avg(target) AS mt, var_samp(target) AS tt FROM ax GROUP BY ALL),
pw AS (SELECT participant_id, {", ".join(f"{p} / (xx + yy + zz) AS {p}" for p in _PAIRS)}, 0 AS k FROM cv
  UNION ALL SELECT participant_id, {_SQUARE}, k + 1 FROM (SELECT *, xx*xx + yy*yy + zz*zz + 2 * (xy*xy + xz*xz + yz*yz) AS t FROM pw WHERE k < 40)),
pj AS (SELECT cv.*, pw.xx * cv.cx + pw.xy * cv.cy + pw.xz * cv.cz AS px, pw.xy * cv.cx + pw.yy * cv.cy + pw.yz * cv.cz AS py, pw.xz * cv.cx + pw.yz * cv.cy + pw.zz * cv.cz AS pz,
  pw.xx * cv.xx + pw.yy * cv.yy + pw.zz * cv.zz + 2 * (pw.xy * cv.xy + pw.xz * cv.xz + pw.yz * cv.yz) AS top FROM cv JOIN pw ON pw.participant_id = cv.participant_id AND pw.k = 40)
SELECT participant_id, n, round(px / top, 5) AS wx, round(py / top, 5) AS wy, round(pz / top, 5) AS wz, round(mt - (px * mx + py * my + pz * mz) / top, 5) AS bias, round(sqrt(px * cx + py * cy + pz * cz) / sqrt(top * tt), 5) AS r FROM pj"""


def axis_clarity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.axis_clarity(_axes(spark, sf), 16))


#: The largest root of the covariance's characteristic polynomial, in closed form.
CLARITY = f"""WITH {_AX}, c AS (SELECT participant_id, idx, count(*) OVER w AS n, {", ".join(f"covar_pop({a}, {b}) OVER w AS {a}{b}" for a, b in _PAIRS)} FROM ax WINDOW w AS (PARTITION BY participant_id ORDER BY idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c WHERE n = 16), p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM q),
d AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3) AS d FROM p)
SELECT participant_id, idx, round((q + 2 * p * cos(acos(greatest(-1, least(1, d))) / 3)) / (3 * q), 6) AS clarity FROM d"""


def detect_onsets(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as recordings at 10 Hz."""
    return rounded(D.detect_onsets(vector_samples(spark, sf, 10.0), 10.0), 5)


def _scaled_sql(source: str, name: str) -> str:
    return f"""{name}_m AS (SELECT recording_id, median(value) AS c FROM {source} GROUP BY ALL),
{name}_d AS (SELECT recording_id, any_value(c) AS c, 1.4826 * median(abs(value - c)) AS d FROM {source} JOIN {name}_m USING (recording_id) GROUP BY ALL),
{name} AS (SELECT recording_id, idx, (value - c) / CASE WHEN d > 0 THEN d ELSE 1 END AS value FROM {source} JOIN {name}_d USING (recording_id))"""


_COARSE = f"{VECTORS_SQL}, {dft_filter_sql('e', band_response('0.05, 0.6', 2), 10.0, 63, 'co')}, {_scaled_sql('co', 's')}"
_FOUND = EXTREMA_PROMINENCE_SQL.replace(S, _COARSE).replace("prominence >= 30", "prominence >= 0.4").replace("abs(x - q.idx) < 5)", "abs(x - q.idx) < 10)")
ONSETS = f"""WITH RECURSIVE ep AS ({_FOUND}), {VECTORS_SQL}, {dft_filter_sql('e', band_response('0.05, 2.0', 2), 10.0, 63, 'fi')}, {_scaled_sql('fi', 'fs')},
nr AS (SELECT ep.recording_id, ep.idx AS at_idx, ep.kind, fs.idx, fs.value, CASE WHEN ep.kind = 'peak' THEN fs.value ELSE -fs.value END AS h FROM ep JOIN fs ON fs.recording_id = ep.recording_id AND fs.idx BETWEEN ep.idx - 5 AND ep.idx + 5),
rf AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY recording_id, at_idx, kind ORDER BY h DESC) = 1)
SELECT recording_id, idx, any_value(kind) AS kind, round(any_value(value), 5) AS value FROM rf GROUP BY recording_id, idx HAVING count(DISTINCT kind) = 1"""

QUERIES = {
    "write_breaths": (write_breaths, BREATH_TABLE_SQL), "write_features": (write_features, SUMMARY_SQL), "write_report_tables": (write_report_tables, REPORT_TABLES), "append_stream_rows": (append_stream_rows, APPENDED),
    "read_tables": (read_tables, TABLES), "read_channels": (read_channels, CHANNELS), "condition_boundary": (condition_boundary, BOUNDARY),
    "fit_pca": (fit_pca, PCA), "axis_clarity": (axis_clarity, CLARITY), "detect_onsets": (detect_onsets, ONSETS),
}
