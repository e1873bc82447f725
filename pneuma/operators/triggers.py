"""Digital trigger channels: nibbles, rigs, runs, edges, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.islands import REC, along, run_ids
from .extrema import greedy_spacing

IDLE_LOW, IDLE_HIGH = 0, 15
EVENT_CODES = (1, 13)


def split_nibbles(samples: DataFrame, value: str = "code") -> DataFrame:
    """low and high nibble of the rounded channel; rows without a finite value go."""
    v = F.round(F.col(value)).cast("int")
    return samples.where(F.col(value).isNotNull()).withColumns({"low": v.bitwiseAND(15), "high": F.shiftright(v.bitwiseAND(240), 4)})


def rigs_present(samples: DataFrame, value: str = "code") -> DataFrame:
    """Rigs whose nibble shows three or more distinct active values, nine tenths of them event codes."""
    n = split_nibbles(samples, value).select(*REC, F.explode(F.create_map(F.lit("low"), F.col("low"), F.lit("high"), F.col("high"))).alias("rig", "v"))
    seen = n.where(~F.col("v").isin(IDLE_LOW, IDLE_HIGH)).distinct()
    share = F.avg(F.col("v").between(*EVENT_CODES).cast("double"))
    return seen.groupBy(*REC, "rig").agg(F.count(F.lit(1)).alias("n_codes"), share.alias("share")).where("n_codes >= 3 and share >= 0.9")


def decode_triggers(samples: DataFrame, rig: str, fs: float, value: str = "code") -> DataFrame:
    """Onsets of activity on the rig's nibble: a step from one code to another is none."""
    code = F.col("low") if rig == "low" else F.col("high")
    n = split_nibbles(samples, value).withColumn("event", code)
    n = n.withColumn("active", ~F.col("event").isin(IDLE_LOW, IDLE_HIGH))
    onset = F.col("active") & ~F.coalesce(F.lag("active").over(along()), F.lit(False))
    return n.withColumn("onset", onset).where("onset").select(*REC, "idx", ((F.col("idx") - 1) / F.lit(fs)).alias("time_s"), F.col("event").alias("code"))


def drop_pre_session(events: DataFrame, start_code: int = 1) -> DataFrame:
    """Events from the last session start on; recordings without one give no rows."""
    last = F.max(F.when(F.col("code") == start_code, F.col("idx"))).over(Window.partitionBy(*REC))
    return events.withColumn("_from", last).where(F.col("idx") >= F.col("_from")).drop("_from")


def trigger_runs(samples: DataFrame, min_length: int = 1, below: float = 200.0, value: str = "value") -> DataFrame:
    """recording_id, index, code, length of runs of one code from 1 to below the limit.

    Missing samples take the code before them (0 at the start) but do not count
    in a run's length.
    """
    w = along()
    held = F.coalesce(F.last(value, True).over(w), F.lit(0).cast("double"))
    x = run_ids(samples.withColumns({"held": held, "there": F.col(value).isNotNull().cast("int")}), "held")
    runs = x.groupBy(*REC, "run").agg(F.min("idx").alias("index"), F.first("held").alias("code"), F.sum("there").alias("length"))
    return runs.where((F.col("code") >= 1) & (F.col("code") < below) & (F.col("length") >= max(1, min_length))).drop("run")


def trigger_edges(samples: DataFrame, **kw) -> DataFrame:
    return trigger_runs(samples, **kw).select(*REC, "index")


def resolve_idle(samples: DataFrame, min_share: float = 0.5, value: str = "value") -> DataFrame:
    """recording_id, idle: the commonest value where it covers min_share of the samples, else 0."""
    n = samples.where(F.col(value).isNotNull()).groupBy(*REC, value).count()
    top = n.groupBy(*REC).agg(F.max_by(value, F.struct("count", -F.col(value))).alias("mode"), (F.max("count") / F.sum("count")).alias("share"))
    idle = F.when((F.col("share") >= min_share) & (F.abs("mode") >= 0.5), F.col("mode")).otherwise(F.lit(0.0))
    return top.select(*REC, idle.alias("idle"), "share")


def debounce_edges(runs: DataFrame, gap: float) -> DataFrame:
    """Longest pulses first, drops others closer than the gap."""
    return greedy_spacing(runs, gap, "length", at="index")


def trigger_events(samples: DataFrame, fs: float, codes: list[int] | None = None, gap: float = 0.0, value: str = "value") -> DataFrame:
    """recording_id, time, label, value: idle level off, runs, optional codes, debounced."""
    idle = resolve_idle(samples, value=value).select(*REC, "idle")
    x = samples.join(idle, list(REC)).withColumn(value, F.col(value) - F.col("idle"))
    runs = trigger_runs(x, value=value)
    if codes:
        runs = runs.where(F.col("code").isin(codes))
    if gap > 0:
        runs = debounce_edges(runs, gap)
    return runs.select(*REC, ((F.col("index") - 1) / F.lit(fs)).alias("time"), F.col("code").cast("int").cast("string").alias("label"), F.col("code").alias("value"))


def start_end_counts(events: DataFrame, start: int = 10, end: int = 12) -> DataFrame:
    n = events.groupBy(*REC).agg(F.count_if(F.col("code") == start).alias("starts"), F.count_if(F.col("code") == end).alias("ends"))
    return n.withColumn("agree", F.col("starts") == F.col("ends"))


#: Start and end code of each block.
BLOCK_CODES = {"block2": (2, 3), "block3": (4, 5), "block4": (6, 7), "block5": (8, 9)}


def block_bounds(events: DataFrame) -> DataFrame:
    """First start and last end of each block that has both; repeats are tolerated."""

    def bound(name: str, codes: tuple[int, int]) -> Column:
        at = lambda c: F.when(F.col("code") == c, F.col("time_s"))
        return F.struct(F.lit(name).alias("block"), F.min(at(codes[0])).alias("start"), F.max(at(codes[1])).alias("end"))

    rows = events.groupBy(*REC).agg(F.array(*[bound(k, v) for k, v in BLOCK_CODES.items()]).alias("b"))
    return rows.select(*REC, F.inline("b")).where("start is not null and end is not null")


def hardware_durations(events: DataFrame, start: int = 10, end: int = 12) -> DataFrame:
    """Time from each trial start to the next event, where that is a trial end (other codes do not count)."""
    w = along()
    e = events.where(F.col("code").isin(start, end)).withColumns({"next": F.lead("code").over(w), "until": F.lead("time_s").over(w)})
    return e.where((F.col("code") == start) & (F.col("next") == end)).select(*REC, "idx", (F.col("until") - F.col("time_s")).alias("duration_s"))
