import pytest

from pneuma.sources import csv


def write(folder, name, header, rows):
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


def test_logs_take_the_participant_from_the_file(spark, tmp_path):
    header = "phase,trial,packet_timestamp,sample_index,x,y,z,pacer_radius"
    write(tmp_path, "p01_session1_accel.csv", header, ["baseline,0,1000,0,0.1,0.2,0.3,", "phase2,1,1177,35,1,2,3,"])
    write(tmp_path, "p02_session1_accel.csv", header, ["baseline,0,1000,0,0.1,0.2,0.3,"])
    write(tmp_path, "p02_session2_accel.csv", header, ["baseline,0,1000,0,0.1,0.2,0.3,"])
    rows = csv.read_log(spark, str(tmp_path / "*_accel.csv"), "accel")
    assert sorted((r.participant_id, r.packet_timestamp) for r in rows.collect()) == [("p01", 1000), ("p01", 1177), ("p02", 1000), ("p02", 1000)]
    assert {r.participant_id: r.ok for r in csv.one_file_each(rows).collect()} == {"p01": True, "p02": False}


def test_channels_are_found_by_part_of_their_name(spark):
    rows = [(0, "RSP Left", 2000.0, 1.0), (0, "RSP Right", 2000.0, 2.0), (0, "ECG", 1000.0, 3.0)]
    samples = spark.createDataFrame(rows, "recording_id bigint, channel string, fs double, value double")
    assert [r.value for r in csv.read_channels(samples, "rsp r").collect()] == [2.0]
    with pytest.raises(Exception, match="not one channel"):
        csv.read_channels(samples, "RSP").collect()
    assert csv.read_channels(samples, "RSP", strict=False).collect() == csv.read_channels(samples, "EDA").collect() == []
