"""Documents to packed training sequences: language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of docs. Rows with a null doc_id or null text go through every stage by
the rules of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pneuma.llm.frames import table, written
from pneuma.llm.langid import UNKNOWN, fit, with_language
from pneuma.llm.ngram_join import jaccard_components
from pneuma.llm.packing import pack_documents
from pneuma.llm.pii import redact_documents
from pneuma.llm.tokenize import WORD_BPE, vocabulary_path


#: Rows of long texts that go to a Python worker at once: all stages run in the same executors, whose memory they share.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _by_place(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ... by their place, so that no name clashes, repeats or needs quoting."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without letters) go; `lang` becomes the prediction."""
    _small_batches(spark)
    names, n = docs.columns, len(docs.columns)
    found = _by_place(with_language(docs, fit(docs)))  # the prediction and its score are the last two
    kept = found.where(F.col(f"c{n}") != UNKNOWN).withColumn(f"c{names.index('lang')}", F.col(f"c{n}"))
    return kept.select([f"c{i}" for i in range(n)]).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id stays (null ids last); of rows equal in doc_id and text one.

    A row is known by a 64-bit hash of its doc_id and text, as rows equal in
    both are one. Rows that go, and those that are there more than once, are
    few columns; all others are read once more and kept as they are.
    """
    _small_batches(spark)
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = _by_place(docs).withColumn("row", F.xxhash64(doc_id, text))
    found = written(jaccard_components(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))), "row-components")
    ids = rows.groupBy("row").agg(F.min(doc_id).alias("id"))
    each = found.groupBy(F.col("doc_id").alias("row"), "component_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("first")
    kept = each.join(ids, "row").groupBy("component_id").agg(first)
    # Written, so that its size is known before the texts are joined with it.
    marked = each.join(kept, F.col("row") == F.col("first"), "left").select("row", F.col("first").isNull().alias("goes"), "n")
    marked = written(marked.groupBy("row").agg(F.min("goes").alias("goes"), F.max("n").alias("n")).where("goes or n > 1"), "rows-marked")
    once = rows.join(marked, "row", "left_anti")
    again = rows.join(marked.where("not goes"), "row", "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(again).drop("row").toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to the name of its kind."""
    _small_batches(spark)
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2048 tokens, with its sequence and offset."""
    _small_batches(spark)
    return pack_documents(docs, vocabulary_path(WORD_BPE), 2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Language models, learned contexts and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
