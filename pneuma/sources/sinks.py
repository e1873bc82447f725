"""Where results go: breaths and features by recording, report tables by sheet, rows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.islands import REC


def _write(rows: DataFrame, path: str, kind: str, mode: str) -> None:
    writer = rows.write.mode(mode)
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)


def write_breaths(breaths: DataFrame, path: str, kind: str = "parquet", mode: str = "error", files: int | None = None) -> None:
    """Breaths sorted by recording within files of ranges of recordings, so that a reader's filter on recording_id skips files.

    A folder for each recording would be as many files as recordings.
    """
    ranged = breaths.repartitionByRange(files, *REC, "breath") if files else breaths.repartitionByRange(*REC, "breath")
    _write(ranged.sortWithinPartitions(*REC, "breath"), path, kind, mode)


def write_features(features: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """One row per recording or window, in files of ranges of recordings."""
    order = [c for c in (*REC, "epoch") if c in features.columns]
    _write(features.repartitionByRange(*order).sortWithinPartitions(*order), path, kind, mode)


def write_report_tables(sheets: dict[str, DataFrame], folder: str, kind: str = "parquet", mode: str = "error") -> list[str]:
    """Each sheet of a report (trials, summary, good subset, alignment) as a table of its own below the folder; their paths."""
    paths = []
    for name, rows in sheets.items():
        if "/" in name or not name:
            raise ValueError(f"not a name of a sheet: {name!r}")
        paths.append(f"{folder.rstrip('/')}/{name}")
        _write(rows, paths[-1], kind, mode)
    return paths


def append_stream_rows(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends a stream's rows to a Parquet table, each once: all there is now, or, where `every` is given, on at that interval."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)
