"""Hard negatives by a full sort of each anchor's integer scores, in blocks of anchors against blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .forest import _matrix
from .frames import pick, shared_dir, table, written
from .mtree import _dealt, _loaded, _paths, _stored

#: Rows of a block, anchors of a block, anchors whose scores with a block are held at once.
BLOCK_ROWS, BLOCK_ANCHORS, AT_ONCE = 16_384, 1_024, 64

#: A block: ids, labels and integer vectors, by id.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def labelled_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label and v (floor(256 * x), integers as doubles) of the rows that take part."""
    rows = pick(rows, vec_id="bigint", embedding="array<double>", label="bigint").withColumnRenamed("embedding", "v")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(~odd)
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))


def _with_label(rows: DataFrame) -> DataFrame:
    """Vectors with their label behind, in three components that are small enough for exact doubles."""
    parts = [F.shiftright("label", 44), F.shiftright("label", 22).bitwiseAND(F.lit((1 << 22) - 1)), F.col("label").bitwiseAND(F.lit((1 << 22) - 1))]
    return rows.select("vec_id", F.concat("v", F.array([p.cast("double") for p in parts])).alias("v"))


def _block(ids: np.ndarray, v: np.ndarray) -> Block:
    order = np.lexsort((*v.T[-3:], ids))
    high, middle, low = v[order, -3:].astype(np.int64).T
    return ids[order], (high << 44) + (middle << 22) + low, np.ascontiguousarray(v[order, :-3])


def sorted_scores(anchors: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor: the places of all rows by falling score, ties by id (rows come by id), and their negated scores."""
    scores = -(anchors @ vectors.T).astype(np.int64)
    order = np.argsort(scores, axis=1, kind="stable")  # lexsort by score, then id
    return order, np.take_along_axis(scores, order, axis=1)


def first_positives(block: Block, anchors: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, ids, scores): the first k other rows of the block with the anchor's label."""
    ids, labels, vectors = block
    for lo in range(0, len(anchors[0]), AT_ONCE):
        order, scores = sorted_scores(anchors[2][lo : lo + AT_ONCE], ids, vectors)
        for i in range(len(order)):
            a = lo + i
            at = np.flatnonzero((labels[order[i]] == anchors[1][a]) & (ids[order[i]] != anchors[0][a]))[:k]
            yield a, ids[order[i, at]], -scores[i, at]


def next_negatives(block: Block, anchors: Block, positives: list[np.ndarray], k: int, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, positive, ids, scores): from each positive's upper limit down, the first k rows of other labels not below its lower limit."""
    ids, labels, vectors = block
    for lo in range(0, len(anchors[0]), AT_ONCE):
        order, scores = sorted_scores(anchors[2][lo : lo + AT_ONCE], ids, vectors)
        for i in range(len(order)):
            a = lo + i
            if not len(positives[a]):
                continue
            other = np.flatnonzero(labels[order[i]] != anchors[1][a])
            falling = scores[i, other]  # negated, so it rises
            # low * p <= high * n <= high * p, in integers.
            start = np.searchsorted(falling, -positives[a], "left")
            stop = np.searchsorted(falling, -(-(-low * positives[a] // high)), "right")
            for p, (s, e) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
                if s < e:
                    at = other[s : min(e, s + k)]
                    yield a, p, ids[order[i, at]], -scores[i, at]


def _merged(best: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of two lists, by falling score and id."""
    if best is not None:
        ids, scores = np.append(best[0], ids), np.append(best[1], scores)
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors: vec_id, label, v of labelled_vectors. An anchor's
    positives are its first `positives` other rows (by id) of its label; for
    each, the first `negatives` rows of other labels with low * positive_score
    <= high * negative_score <= high * positive_score come back, ranked from 1.
    Fewer are all returned; an anchor without positives or negatives has no
    row. Ties go to the smaller vec_id. Repeated rows are repeated candidates
    and repeated positives; an anchor repeated whole is one, but the same id
    with another label or vector is an anchor of its own. Vectors of different
    lengths have no score. Components so large that products leave the exact
    range of doubles raise an error.

    Blocks of rows and of anchors are written once. A task takes a block of
    anchors through a share of the blocks of rows, sorting all scores of an
    anchor with a block: first for positives, which are merged over the shares,
    then for the negatives of each positive. Memory is a block of each and
    AT_ONCE anchors' scores, whatever the table's size.
    """
    spark = rows.sparkSession
    rows, anchors = (written(d.select("vec_id", "label", "v"), "labelled") for d in (rows, anchors))
    anchors = anchors.distinct()
    row_blocks = max(1, -(-rows.count() // block_rows))
    anchor_blocks = max(1, -(-anchors.count() // block_anchors))
    folder = shared_dir(spark, "blocks")
    joined = [_dealt(_with_label(d), n) for d, n in ((rows, row_blocks), (anchors, anchor_blocks))]
    _stored(joined[0], f"{folder}/rows", _block)
    asked = _stored(joined[1], f"{folder}/anchors", _block)
    groups = max(1, asked.count())
    shares = max(1, min(row_blocks, -(-2 * spark.sparkContext.defaultParallelism // groups)))
    each = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    tasks = asked.select("dim", "path", each).repartition(groups * shares)

    def over(task: dict, step: Callable[[Block], Iterator[tuple]]) -> Iterator[tuple]:
        for path in _paths(f"{folder}/rows", task["dim"], task["share"], shares):
            yield from step(_loaded(folder, path))

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.to_pylist():
                mine = _loaded(folder, task["path"])
                best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for a, ids, scores in over(task, lambda block: first_positives(block, mine, positives)):  # noqa: B023
                    best[a] = _merged(best.get(a), ids, scores, positives)
                for a, (ids, scores) in best.items():
                    if n := len(ids):
                        yield pa.RecordBatch.from_pydict({"path": [task["path"]] * n, "dim": pa.array([task["dim"]] * n, pa.int32()), "a": pa.array([a] * n, pa.int32()), "id": ids, "score": scores})

    first = tasks.mapInArrow(find_positives, "path string, dim int, a int, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("path", "a").orderBy(F.desc("score"), "id"))
    first = written(first.withColumn("p", place - 1).where(F.col("p") < positives), "positives")
    # One row a block of anchors: `positives` numbers for each of its anchors.
    held = first.groupBy("path", "dim").agg(F.collect_list(F.struct("a", "p", "score")).alias("found"))
    tasks = held.select("path", "dim", "found", each).repartition(groups * shares)

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.to_pylist():
                mine = _loaded(folder, task["path"])
                limits: list[np.ndarray] = [np.zeros(0, np.int64)] * len(mine[0])
                for f in sorted(task["found"], key=lambda f: (f["a"], f["p"])):
                    limits[f["a"]] = np.append(limits[f["a"]], f["score"])
                best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
                for a, p, ids, scores in over(task, lambda block: next_negatives(block, mine, limits, negatives, low, high)):  # noqa: B023
                    best[a, p] = _merged(best.get((a, p)), ids, scores, negatives)
                for (a, p), (ids, scores) in best.items():
                    n = len(ids)
                    yield pa.RecordBatch.from_pydict(
                        {"path": [task["path"]] * n, "a": pa.array([a] * n, pa.int32()), "p": pa.array([p] * n, pa.int32()),
                         "anchor_id": pa.array([int(mine[0][a])] * n, pa.int64()), "negative_id": ids, "negative_score": scores}
                    )

    found = tasks.mapInArrow(find_negatives, "path string, a int, p int, anchor_id bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("path", "a", "p").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = first.select("path", "a", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["path", "a", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_vectors(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
