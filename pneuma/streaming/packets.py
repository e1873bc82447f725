"""Live packet operators on Structured Streaming, event time from the packets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.islands import correlation
from ..operators.calibration import pacer_radius
from ..sources.shared import shared_folder

DELAY = "1 second"


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a file stream: participant_id, event_id, ts, label, value."""
    path = f"{sf_dir}/events.parquet*"  # a file or a folder of files
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return rows.select(F.col("user_id").alias("participant_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"), "value")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the data there is now, by a file sink and checkpoint in the shared folder."""
    spark = stream.sparkSession
    at = shared_folder(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def to_nearest_second(packets: DataFrame, slide_s: int) -> DataFrame:
    """Packets half a second or less before a window's start (every slide_s seconds) are that window's: their ts becomes its start.

    So windows hold their packets by times in whole seconds; all other times stay, and with them what the watermark has passed.
    """
    later = F.unix_micros("ts") + 500_000
    return packets.withColumn("ts", F.greatest("ts", F.timestamp_micros(later - F.pmod(later, F.lit(slide_s * 1_000_000)))))


def stream_phase_rate(packets: DataFrame, width: str = "1 day") -> DataFrame:
    """Tumbling counts and means per label."""
    g = packets.withWatermark("ts", DELAY).groupBy(F.window("ts", width), "label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "label", "n", "mean")


def stream_rolling_r(packets: DataFrame, width: str = "2 days", slide: str = "1 day", least: int = 10, reference: Column | None = None) -> DataFrame:
    """Correlation of value and a reference (time, or what the pacer showed) in sliding windows with enough points, per participant."""
    t = F.unix_micros("ts") / 1e6 if reference is None else reference
    g = packets.withWatermark("ts", DELAY).groupBy(F.window("ts", width, slide), "participant_id").agg(F.count(F.lit(1)).alias("n"), correlation("value", t).alias("r"))
    return g.where(F.col("n") >= least).select(F.col("window.start").alias("start"), "participant_id", "n", "r")


def lagged_pacer(start_s: float, period_s: float, lag_s: float = 0.0) -> Column:
    """What a pacer that began at start_s showed lag_s before the packet, from 0 (exhaled) to 1 (inhaled)."""
    return pacer_radius(F.unix_micros("ts") / 1e6 - lag_s, F.lit(start_s), F.lit(period_s))


def stream_amplitude_range(packets: DataFrame, width: str = "4 days", slide: str = "2 days", least: int = 5, span: float = 0.05) -> DataFrame:
    """5th and 95th percentile by index floor((n - 1) p) in sliding windows; passes where there are enough points and spread."""
    g = packets.withWatermark("ts", DELAY).groupBy(F.window("ts", width, slide), "participant_id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    at = lambda p: F.get("v", F.floor((F.size("v") - 1) * p).cast("int"))
    g = g.select(F.col("window.start").alias("start"), "participant_id", F.size("v").alias("n"), at(0.05).alias("low"), at(0.95).alias("high"))
    return g.withColumn("ready", (F.col("n") >= least) & (F.col("high") - F.col("low") >= span))


def stream_trial_sessions(packets: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Packets of a participant without a longer gap form a session."""
    g = packets.withWatermark("ts", DELAY).groupBy(F.session_window("ts", gap), "participant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "participant_id", "n", "total")


def stream_dedupe(packets: DataFrame, key: tuple[str, ...] = ("participant_id", "ts"), memory: str = DELAY) -> DataFrame:
    """Repeated inserts of one row go while the watermark remembers it: the same participant and onset, whatever else the retry carries.

    A repeat that comes more than `memory` of event time behind the newest row seen is a late row, and goes as such.
    Keys without an onset (null) are no rows of a stream in event time, and go.
    """
    return packets.where("ts is not null").withWatermark("ts", memory).dropDuplicatesWithinWatermark(list(key))


def stream_clamped_breath(packets: DataFrame, scale: float) -> DataFrame:
    return packets.withColumn("breath", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / scale)))


def stream_one_pole(packets: DataFrame, alpha: float = 0.2, idle_s: float = 3600.0) -> DataFrame:
    """One-pole low-pass, carried per participant from batch to batch; late packets are dropped.

    The state is the last output, its time and the number of packets seen; a
    quiet time of more than idle_s ends it, and what follows starts anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        y, last, seen = state.get if state.exists else (float("nan"), None, 0)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        rows = rows if last is None else rows[rows["us"] >= last]
        out, counts = np.empty(len(rows)), np.empty(len(rows), int)
        for i, (t, x) in enumerate(zip(rows["us"].tolist(), rows["value"].to_numpy(float), strict=True)):
            if last is None or t - last > idle_s * 1e6:
                y, seen = float("nan"), 0
            y, last, seen = x if np.isnan(y) else y + alpha * (x - y), t, seen + 1
            out[i], counts[i] = y, seen
        if last is not None:
            state.update((float(y), int(last), int(seen)))
            state.setTimeoutTimestamp(max(int(last // 1000 + idle_s * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"participant_id": key[0], "event_id": rows["event_id"], "seen": counts, "filtered": out})

    timed = packets.where("ts is not null").withWatermark("ts", DELAY)
    keyed = timed.select("participant_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "value").groupBy("participant_id")
    return keyed.applyInPandasWithState(
        step, "participant_id bigint, event_id bigint, seen bigint, filtered double", "y double, us bigint, seen bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_calib_status(packets: DataFrame, least_s: float, breaths: int, confidence: float, hold_s: float, timeout_s: float, forget_s: float = 86400.0) -> DataFrame:
    """One row per participant whose calibration ends: ready once enough time and breaths have passed and the confidence has
    held for hold_s, or timeout. packets: participant_id, event_id, ts, confidence, and breaths (number seen so far; without
    this column each packet counts as one).

    A timer in event time ends the calibration of a participant that stays quiet (event_id null). The state is the start,
    packets seen, since when the confidence holds, and whether it is over; one that is over is kept for forget_s from
    its start, so that it isn't begun again, and then goes.
    """
    counted = "breaths" in packets.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["participant_id", "event_id", "status", "elapsed_s"]
        start, seen, since, over = state.get if state.exists else (-1, 0, -1, False)
        forgotten = lambda: max(int(start // 1000 + max(forget_s, timeout_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1)
        if state.hasTimedOut:
            if over:
                state.remove()
                return
            state.update((start, seen, since, True))
            state.setTimeoutTimestamp(forgotten())
            yield pd.DataFrame([(key[0], None, "timeout", timeout_s)], columns=names).astype({"event_id": "Int64"})
            return
        out = []
        for r in pd.concat(list(batches)).sort_values(["us", "event_id"]).itertuples():
            if over:
                break
            start, seen = (r.us if start < 0 else start), (r.breaths if counted else seen + 1)
            elapsed = (r.us - start) / 1e6
            good = elapsed >= least_s and seen >= breaths and r.confidence >= confidence
            since = (r.us if since < 0 else since) if good else -1
            if good and (r.us - since) / 1e6 >= hold_s:
                out.append((key[0], r.event_id, "ready", elapsed))
                over = True
            elif elapsed >= timeout_s:
                out.append((key[0], r.event_id, "timeout", elapsed))
                over = True
        state.update((int(start), int(seen), int(since), bool(over)))
        state.setTimeoutTimestamp(forgotten() if over else max(int(start // 1000 + timeout_s * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names).astype({"event_id": "Int64"})

    timed = packets.where("ts is not null").withWatermark("ts", DELAY)
    keyed = timed.select("participant_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "confidence", *["breaths"] * counted).groupBy("participant_id")
    return keyed.applyInPandasWithState(
        step, "participant_id bigint, event_id bigint, status string, elapsed_s double", "start bigint, seen bigint, since bigint, over boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
