"""Readers of logs and tables, and where results go."""

import pytest
from pyspark.sql import functions as F

from pneuma.sources import csv, sinks
from pneuma.streaming import packets as W


def write(folder, name, header, rows):
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


ACCEL = "phase,trial,packet_timestamp,sample_index,x,y,z,pacer_radius"


def test_accelerometer_and_heart_rate_logs(spark, tmp_path):
    write(tmp_path, "p01_session1_accel.csv", ACCEL, ["breathe,0,1000,0,0.1,-0.2,9.8,0.5", "breathe,,1177,35,1,2,3,"])
    write(tmp_path, "p02_session1_hr.csv", "phase,trial,timestamp,heart_rate", ["rest,1,1000,61.5", "rest,2,2000,"])
    a = csv.read_accel(spark, str(tmp_path / "*_accel.csv")).orderBy("packet_timestamp").collect()
    assert [(r.participant_id, r.phase, r.trial, r.sample_index, r.z, r.pacer_radius) for r in a] == [("p01", "breathe", 0, 0, 9.8, 0.5), ("p01", "breathe", None, 35, 3.0, None)]
    h = csv.read_hr(spark, str(tmp_path / "*_hr.csv")).orderBy("timestamp").collect()
    assert [(r.participant_id, r.timestamp, r.heart_rate) for r in h] == [("p02", 1000, 61.5), ("p02", 2000, None)]


def test_a_log_must_name_one_participant_and_fit(spark, tmp_path):
    row = ["breathe,0,1000,0,0.1,-0.2,9.8,0.5"]
    for sub, files, why in (
        ("two", ("p01_session1_accel.csv", "p01_session2_accel.csv"), "several files of participant p01"),
        ("none", ("log.csv",), "no participant in the name"),
    ):
        folder = tmp_path / sub
        folder.mkdir()
        for f in files:
            write(folder, f, ACCEL, row)
        with pytest.raises(Exception, match=why):
            csv.read_accel(spark, str(folder)).select("participant_id").collect()
    folder = tmp_path / "bad"
    folder.mkdir()
    write(folder, "p01_session1_accel.csv", ACCEL, ["breathe,0,soon,0,0.1,-0.2,9.8,0.5"])
    with pytest.raises(Exception, match="(?i)malformed"):
        csv.read_accel(spark, str(folder)).collect()


def test_trial_and_staircase_logs(spark, tmp_path):
    write(tmp_path, "p07_session1_trials.csv", "phase,trial,condition,base_period_s,change_period_s,start_ms,end_ms,peak_error_ms", ["phase2,3,faster,4,3.2,100.5,16500,"])
    write(tmp_path, "p07_session1_quest.csv", "trial,direction,delta_ratio,response,correct,confidence,arousal,posterior_mean_log,posterior_sd", ["3,faster,0.2,faster,true,80,40,-1.5,0.3"])
    t = csv.read_trial_logs(spark, str(tmp_path / "*_trials.csv")).first()
    assert (t.participant_id, t.trial, t.condition, t.change_period_s, t.start_ms, t.peak_error_ms) == ("p07", 3, "faster", 3.2, 100.5, None)
    q = csv.read_trial_logs(spark, str(tmp_path / "*_quest.csv"), "quest").first()
    assert (q.participant_id, q.direction, q.correct, q.posterior_mean_log) == ("p07", "faster", True, -1.5)


def test_tables_by_schema_from_parquet_and_csv(spark, tmp_path):
    spark.range(3).withColumn("other", F.lit("x")).write.parquet(str(tmp_path / "a.parquet"))
    write(tmp_path, "b.csv", "id,score,note", ["1,0.5,hello", "2,,"])
    t = csv.read_tables(spark, {"a": (str(tmp_path / "a.parquet"), "id bigint, missing double"), "b": (str(tmp_path / "b.csv"), "id bigint, score double, note string")})
    assert sorted((r.id, r.missing) for r in t["a"].collect()) == [(0, None), (1, None), (2, None)]
    assert sorted((r.id, r.score, r.note) for r in t["b"].collect()) == [(1, 0.5, "hello"), (2, None, None)]


def breaths(spark, recordings=40, each=25):
    x = spark.range(recordings * each).select((F.col("id") % recordings).alias("recording_id"), F.floor(F.col("id") / recordings).alias("breath"))
    return x.withColumn("duration", F.col("recording_id") + F.col("breath") / 100.0).repartition(7)


def rows_scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_breaths_lie_in_files_of_ranges_that_a_filter_skips(spark, tmp_path):
    table, path = breaths(spark), str(tmp_path / "breaths")
    sinks.write_breaths(table, path, files=8)
    back = sinks.read_back(spark, path, table)
    assert sorted(back.collect()) == sorted(table.collect())
    files = back.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("recording_id").alias("low"), F.max("recording_id").alias("high")).orderBy("low").collect()
    assert len(files) >= 6 and all(a.high <= b.low for a, b in zip(files, files[1:], strict=False))
    # Row groups whose statistics exclude the recording are not read.
    assert 25 <= rows_scanned(back.where("recording_id = 17")) <= 2 * 1000 / 8 + 25 < back.count()
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_breaths(table, path)
    sinks.write_breaths(table.limit(5), path, mode="overwrite")
    assert sinks.read_back(spark, path, table).count() == 5


def test_features_and_report_tables(spark, tmp_path):
    features = spark.createDataFrame([(2, 1, 0.5), (1, 2, None), (1, 1, 1.5)], "recording_id bigint, epoch int, rate double")
    sinks.write_features(features, str(tmp_path / "features"), "csv")
    back = spark.read.schema(features.schema).option("header", True).csv(str(tmp_path / "features"))
    assert sorted(back.collect(), key=str) == sorted(features.collect(), key=str)
    sheets = {"trials": features, "good subset": features.where("rate > 1"), "nothing": features.limit(0)}
    paths = sinks.write_report_tables(sheets, str(tmp_path / "report/"))
    assert [p.rsplit("/", 1)[1] for p in paths] == list(sheets)
    for p, (_, sheet) in zip(paths, sheets.items(), strict=True):
        assert sorted(spark.read.schema(sheet.schema).parquet(p).collect(), key=str) == sorted(sheet.collect(), key=str)
    with pytest.raises(ValueError):
        sinks.write_report_tables({"a/b": features}, str(tmp_path))


SCHEMA = "participant_id bigint, event_id bigint, ts timestamp, value double"


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, name, rows):
    """One file of (participant, event, seconds, value)."""
    df = spark.createDataFrame(rows, "participant_id bigint, event_id bigint, s double, value double")
    df = df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint"))).select("participant_id", "event_id", "ts", "value")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/_{name}")
    part = next((folder / f"_{name}").glob("part-*.parquet"))
    part.rename(folder / f"{name}.parquet")


def test_appended_rows_come_once_over_restarts(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    for k in range(3):
        put(spark, folder, f"a{k}", [(1, 10 * k + i, 10.0 * k + i, 0.5) for i in range(5)])
    got = lambda: sorted(r.event_id for r in spark.read.schema(SCHEMA).parquet(out).collect())
    sinks.append_stream_rows(source(spark, str(folder)), out, state).awaitTermination()
    assert got() == [10 * k + i for k in range(3) for i in range(5)]
    sinks.append_stream_rows(source(spark, str(folder)), out, state).awaitTermination()  # nothing is new
    assert len(got()) == 15
    put(spark, folder, "b", [(2, 100 + i, 50.0 + i, 0.5) for i in range(5)])
    # A run that ends in the middle: the batch was planned and its files were written, but it was not committed.
    broken = source(spark, str(folder)).withColumn("value", F.when(F.col("event_id") == 103, F.raise_error(F.lit("cut")).cast("double")).otherwise(F.col("value")))
    query = sinks.append_stream_rows(broken, out, state)
    with pytest.raises(Exception, match="cut"):
        query.awaitTermination()
    assert len(got()) == 15
    sinks.append_stream_rows(source(spark, str(folder)), out, state).awaitTermination()
    assert got() == sorted([10 * k + i for k in range(3) for i in range(5)] + [100 + i for i in range(5)])


def test_retried_inserts_go_within_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, folder, "a", [(1, 1, 100.0, 0.1), (1, 2, 100.0, 0.1), (2, 3, 100.0, 0.2), (1, 4, 101.0, 0.3)])
    put(spark, folder, "b", [(1, 5, 100.0, 0.1), (1, 6, 105.0, 0.4)])  # a retry in a later batch, within what the watermark remembers
    put(spark, folder, "c", [(1, 7, 300.0, 0.5)])
    put(spark, folder, "d", [(1, 8, 101.0, 0.3), (1, 9, 300.0, 0.5), (2, 10, 299.5, 0.6)])  # a retry long behind it goes as a late row
    got = W.drained(W.stream_dedupe(source(spark, str(folder)), memory="10 seconds")).collect()
    assert sorted((r.participant_id, r.ts.timestamp(), r.value) for r in got) == [(1, 100.0, 0.1), (1, 101.0, 0.3), (1, 105.0, 0.4), (1, 300.0, 0.5), (2, 100.0, 0.2), (2, 299.5, 0.6)]


def test_one_pole_starts_anew_after_a_quiet_time(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, folder, "a", [(1, 1, 100.0, 1.0), (1, 2, 101.0, 2.0)])
    put(spark, folder, "b", [(1, 3, 102.0, 4.0), (1, 4, 200.0, 5.0), (1, 5, 201.0, 6.0)])
    put(spark, folder, "c", [(2, 6, 400.0, 7.0)])
    put(spark, folder, "d", [(1, 7, 401.0, 8.0)])
    got = {r.event_id: (r.seen, round(r.filtered, 9)) for r in W.drained(W.stream_one_pole(source(spark, str(folder)), 0.5, idle_s=60.0)).collect()}
    assert got == {1: (1, 1.0), 2: (2, 1.5), 3: (3, 2.75), 4: (1, 5.0), 5: (2, 5.5), 6: (1, 7.0), 7: (1, 8.0)}
