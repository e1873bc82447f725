"""Session assembly: seats, rigs, trials, windows, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EMPTY_SEAT = "0000"


def parse_seat_filenames(files: DataFrame) -> DataFrame:
    """file, left_id, right_id, error from names such as L12.R34.acq; the letters are optional, 0000 is an empty seat."""
    stem = F.regexp_replace("file", r"\.acq$", "")
    parts = F.split(stem, r"\.", -1)
    left, right = (F.regexp_replace(F.get(parts, F.lit(i)), f"^{side}", "") for i, side in enumerate("LR"))
    bad = (F.size(parts) != 2) | ~F.coalesce(left.rlike("^[0-9]+$") & right.rlike("^[0-9]+$"), F.lit(False))
    seat = lambda c: F.when(~bad & (c != EMPTY_SEAT), c)
    return files.select("file", seat(left).alias("left_id"), seat(right).alias("right_id"), F.when(bad, "name is not two numbered seats").alias("error"))


def build_seat_map(parsed: DataFrame) -> DataFrame:
    """One row per occupied seat; n_files counts the files that hold the participant."""
    rows = parsed.where("error is null").select("file", F.expr("stack(2, 'LEFT', left_id, 'RIGHT', right_id) as (seat, participant_id)"))
    rows = rows.where("participant_id is not null")
    return rows.withColumn("n_files", F.count(F.lit(1)).over(Window.partitionBy("participant_id")))


def resolve_participants(wanted: DataFrame, seats: DataFrame) -> DataFrame:
    """status per wanted id: ok with its seat, missing, or ambiguous."""
    hits = seats.groupBy("participant_id").agg(F.count(F.lit(1)).alias("hits"), F.min("seat").alias("seat"), F.min("file").alias("file"))
    j = wanted.join(hits, "participant_id", "left")
    one = F.col("hits") == 1
    status = F.when(F.col("hits").isNull(), "missing").when(one, "ok").otherwise("ambiguous")
    return j.select("participant_id", status.alias("status"), F.when(one, F.col("seat")).alias("seat"), F.when(one, F.col("file")).alias("file"))


def reconcile_sessions(sessions: DataFrame) -> DataFrame:
    """Recorded codes beat the declared rig; every disagreement is noted; seat and rig stay apart.

    sessions: participant_id, seat, declared, observed (null where the codes fit no rig or two).
    """
    rig = F.coalesce("observed", "declared")
    implied = F.when(rig == "Biopac_Left", "LEFT").when(rig == "Biopac_Right", "RIGHT")
    notes = F.concat_ws(
        "; ",
        F.when(F.col("observed") != F.col("declared"), F.concat_ws(" ", F.lit("declared"), "declared", F.lit("but codes say"), "observed")),
        F.when(implied != F.col("seat"), F.concat_ws(" ", F.lit("seat is"), "seat", F.lit("but rig is"), rig)),
        F.when(F.col("observed").isNull(), F.lit("codes fit no single rig")),
    )
    return sessions.withColumns({"rig": rig, "agrees": notes == "", "notes": F.when(notes != "", notes)})


def dedupe_trials(trials: DataFrame, key: list[str], content: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, with rows dropped and whether they disagreed in content; conflicts are marked, not hidden."""
    w = Window.partitionBy(*key).orderBy(*order, *content)
    every = Window.partitionBy(*key)
    x = trials.withColumn("_c", F.struct(*content))
    x = x.withColumns({"_r": F.row_number().over(w), "n_input": F.count(F.lit(1)).over(every), "conflict": ~F.min("_c").over(every).eqNullSafe(F.max("_c").over(every))})
    return x.where("_r = 1").drop("_r", "_c").withColumn("n_dropped", F.col("n_input") - 1)


def exclude_ids(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def complete_participants(ids: DataFrame, *needed: DataFrame) -> DataFrame:
    """Ids that every needed table has."""
    for table in needed:
        ids = ids.join(table, "participant_id", "left_semi")
    return ids


def resolve_run_onset(runs: DataFrame) -> DataFrame:
    """onset and its source: manual override, trigger, estimate or unavailable; excluded runs have none."""
    onset = F.when(~F.coalesce("excluded", F.lit(False)), F.coalesce("manual_s", "trigger_s", "estimate_s"))
    source = F.when(F.coalesce("excluded", F.lit(False)), "excluded").when(F.col("manual_s").isNotNull(), "manual").when(F.col("trigger_s").isNotNull(), "trigger")
    return runs.withColumns({"onset_s": onset, "source": source.when(F.col("estimate_s").isNotNull(), "estimate").otherwise("unavailable")})


#: The block of each phase.
PHASE_BLOCKS = {"baseline": 2, "phase2": 3, "phase3": 4, "post_baseline": 5}


def phase_to_block(rows: DataFrame) -> DataFrame:
    block = F.when(F.col("phase").startswith("calib_"), 1)
    for phase, number in PHASE_BLOCKS.items():
        block = block.when(F.col("phase") == phase, number)
    return rows.withColumn("block", block)


def affect_coordinates(ratings: DataFrame) -> DataFrame:
    """Valence, arousal and ambivalence of ratings pos, neg (1 to 7), clamped per response."""
    pa, na = (F.col("pos") - 4) / 3, (F.col("neg") - 4) / 3
    p, n = F.greatest(F.lit(0.0), pa), F.greatest(F.lit(0.0), na)
    return ratings.withColumns(
        {"valence": (pa - na) / F.sqrt(F.lit(2.0)), "arousal": (pa + na) / F.sqrt(F.lit(2.0)), "ambivalence": F.greatest(F.lit(0.0), (p + n) / 2 - F.abs(p - n))}
    )


def session_windows(rows: DataFrame, trials: DataFrame) -> DataFrame:
    """Free windows (first to last packet of each phase) and one window per trial that ends after its start."""
    free = rows.groupBy("recording_id", "phase").agg(F.min("t_s").alias("start"), F.max("t_s").alias("end"))
    return free.unionByName(trials.where("end > start").select("recording_id", "phase", "start", "end"))


def collect_flags(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """flags array and its text from named conditions, in order."""
    found = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in flags.items()]))
    return rows.withColumn("flags", F.concat_ws("; ", found))


#: Names of columns that may leave, and patterns that no name may have.
BLOCKED = ("participant", "recording_id", "^id$", "email", "name", "birth", "raw")


def disclosure_guard(table: DataFrame, allowed: list[str], entity: str | None = None, count: str | None = None, least: int = 1) -> DataFrame:
    """column_name, verdict of each column of a result that is about to leave.

    A name must be allowed and match no blocked pattern; a table keyed by
    entities is refused whole, and so is one in which a cell stands for fewer than `least` of them (a count column is named).
    """
    names = table.sparkSession.createDataFrame([(c,) for c in table.columns], "column_name string")
    low = F.lower("column_name")
    blocked = F.lit(False)
    for pattern in BLOCKED:
        blocked = blocked | low.rlike(pattern)
    small = table.agg(F.coalesce(F.min(count) < least, F.lit(False)).alias("_small")) if count else table.sparkSession.range(1).select(F.lit(False).alias("_small"))
    names = names.crossJoin(F.broadcast(small))  # one row
    verdict = F.when(F.lit(entity is not None and entity in table.columns), "refused: rows per entity").when(F.col("_small"), "refused: few entities").when(blocked, "refused: blocked name")
    return names.withColumn("verdict", verdict.when(~F.col("column_name").isin(allowed), "refused: not allowed").otherwise("ok")).drop("_small")


#: The respiration and heart channel of each seat.
SEAT_CHANNELS = (("RIGHT", "Breath 1", "Heart 1"), ("LEFT", "Breath 2", "Heart 2"))


def select_seat_channels(sessions: DataFrame) -> DataFrame:
    """sessions (with seat) with the names of the seat's channels; an unknown seat has none."""
    seats = sessions.sparkSession.createDataFrame(SEAT_CHANNELS, "seat string, breath_channel string, heart_channel string")
    return sessions.join(F.broadcast(seats), "seat", "left")  # two rows


def attach_condition(rows: DataFrame, conditions: DataFrame, by: str, session: str, names: tuple[str, str]) -> DataFrame:
    """rows with the first condition of their id and the current one: the first in session 1, the other one in session 2. Ids without one keep their rows.

    conditions: by, first; repeated rows count once.
    """
    c = conditions.select(by, "first").dropDuplicates([by])
    swapped = F.when(F.col("first") == names[0], names[1]).when(F.col("first") == names[1], names[0])
    return rows.join(c, by, "left").withColumn("condition", F.when(F.col(session) == 1, F.col("first")).when(F.col(session) == 2, swapped))


def trial_windows(trials: DataFrame, onsets: DataFrame, by: list[str], lag_s: float = 0.2) -> DataFrame:
    """trials (by, start_s, stop_s within the run) with absolute start and end: the run's resolved onset plus the lag; trials of runs without one have none."""
    t = trials.join(onsets.select(*by, "onset_s"), by, "left")
    return t.withColumns({"start": F.col("onset_s") + lag_s + F.col("start_s"), "end": F.col("onset_s") + lag_s + F.col("stop_s")})
