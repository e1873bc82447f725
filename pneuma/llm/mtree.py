"""Exact top-k by inner product: M-trees searched best-first."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .forest import _matrix
from .frames import filesystem, put_in_place, shared_dir, table, written
from .vectors import usable_vectors

#: Rows of an indexed block, queries of a block, entries of a page.
BLOCK_ROWS, BLOCK_QUERIES, PAGE = 16_384, 4_096, 256
#: Slack of the float bounds, relative to the distances' size: a page is skipped only where it is farther for certain.
SLACK = 1e-9


class MTree:
    """Pages of routing entries (pivot, covering radius, distance to the parent's pivot) over leaf pages.

    Largest inner products become nearest neighbours: every vector gets one
    more component, so that all have the same norm M; a query gets a zero. Then
    d(q, x)^2 = |q|^2 + M^2 - 2 q.x, a metric on which the triangle inequality
    holds.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, seed: int = 3):
        norms = (x * x).sum(axis=1)
        self.norm = float(norms.max()) if len(x) else 0.0
        self.x, self.ids = x, ids
        self.lifted = np.hstack([x, np.sqrt(np.maximum(0.0, self.norm - norms))[:, None]])
        self.rng = np.random.default_rng(seed)
        self.pages: list[tuple] = []
        pivot = self.lifted.mean(axis=0)
        self.root = self._page(np.arange(len(x)), pivot)
        self.pivot = pivot

    def _far(self, at: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.lifted[at] - pivot) ** 2).sum(axis=1))

    def _page(self, at: np.ndarray, parent: np.ndarray) -> int:
        """The number of the page over the rows `at`, below the entry with this pivot."""
        number = len(self.pages)
        self.pages.append(())
        if len(at) <= PAGE:
            self.pages[number] = (True, at, self._far(at, parent))
            return number
        fan = int(min(32, -(-len(at) // (PAGE // 2))))
        chosen = self.lifted[self.rng.choice(at, fan, replace=False)]
        square = (chosen * chosen).sum(axis=1)
        nearest = (square - 2 * self.lifted[at] @ chosen.T).argmin(axis=1)
        groups = [at[nearest == k] for k in range(fan)]
        if max(map(len, groups)) > 0.95 * len(at):  # many equal vectors: cut evenly
            groups = np.array_split(at, fan)
        pivots, radii, children = [], [], []
        for g in groups:
            if len(g):
                pivot = self.lifted[g].mean(axis=0)
                pivots.append(pivot)
                radii.append(self._far(g, pivot).max())
                children.append(self._page(g, pivot))
        pivots = np.array(pivots)
        self.pages[number] = (False, pivots, np.array(radii), np.sqrt(((pivots - parent) ** 2).sum(axis=1)), children)
        return number

    def search(self, q: np.ndarray, own: int, k: int, scores: np.ndarray | None = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k largest inner products with q, ties to smaller ids; the row with id `own` is left out.

        scores and ids, where given, are the best of trees searched before: they compete, and bound this search from its start.
        """
        if scores is None:
            scores, ids = np.zeros(0), np.zeros(0, np.int64)
        if not len(self.x):
            return scores, ids
        lifted = np.append(q, 0.0)
        length = float(q @ q) + self.norm
        slack = SLACK * (1.0 + length**0.5)
        # Nothing farther can be among the k.
        reach = max(0.0, length - 2 * scores[-1]) ** 0.5 if len(scores) == k else np.inf
        queue = [(0.0, self.root, float(np.sqrt(((lifted - self.pivot) ** 2).sum())))]
        while queue:
            bound, number, parent = heapq.heappop(queue)
            if bound > reach + slack:
                break
            page = self.pages[number]
            if page[0]:
                # |d(q, parent) - d(x, parent)| <= d(q, x): rows beyond reach are not computed.
                at = page[1] if reach == np.inf else page[1][np.abs(parent - page[2]) <= reach + slack]
                if not len(at):
                    continue
                s = self.x[at] @ q
                if len(scores) == k:
                    good = s >= scores[-1]
                    at, s = at[good], s[good]
                keep = self.ids[at] != own
                if not keep.any():
                    continue
                scores, ids = np.append(scores, s[keep]), np.append(ids, self.ids[at][keep])
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
                if len(scores) == k:
                    reach = max(0.0, length - 2 * scores[-1]) ** 0.5
            else:
                _, pivots, radii, to_parent, children = page
                near = np.flatnonzero(np.abs(parent - to_parent) - radii <= reach + slack)
                if not len(near):
                    continue
                d = np.sqrt(((pivots[near] - lifted) ** 2).sum(axis=1))
                for child, far, low in zip(near.tolist(), d.tolist(), (d - radii[near]).tolist(), strict=True):
                    if low <= reach + slack:
                        heapq.heappush(queue, (max(0.0, low), children[child], far))
        return scores, ids


def _dealt(d: DataFrame, blocks: int) -> DataFrame:
    """vec_id, v, dim and a block of bounded size."""
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    return d.select("vec_id", "v", F.size("v").alias("dim"), block.alias("block"))


def _stored(blocks: DataFrame, folder: str, make: Callable[[np.ndarray, np.ndarray], object]) -> DataFrame:
    """Writes what make(ids, vectors) gives for each block to a file of the folder, named by dim and block; dim and path of each."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim, block = (k.as_py() for k in key)
        ids, v = t.column("vec_id").to_numpy(), _matrix(t.column("v"))
        if v.size and np.abs(v).max() ** 2 * v.shape[1] >= 2.0**53:
            raise ValueError("components are too large for exact integer products in doubles")
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        path, own = f"{root}/{dim}-{block}", f"{root}/_{dim}-{block}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(own) as sink:
            sink.write(pickle.dumps(make(ids, v), 5))
        put_in_place(fs, own, path)
        return pa.table([pa.array([dim], pa.int32()), pa.array([path])], names=["dim", "path"])

    return written(blocks.groupBy("dim", "block").applyInArrow(run, "dim int, path string"), "stored")


def _loaded(folder: str, path: str):
    with filesystem(folder)[0].open_input_file(path) as source:
        return pickle.loads(source.read())


def _paths(folder: str, dim: int, share: int, shares: int) -> Iterator[str]:
    """Files of a share of the blocks of one dim."""
    fs, root = filesystem(folder)
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        own, _, block = f.base_name.partition("-")
        if own == str(dim) and int(block) % shares == share:
            yield f.path


def top_k(rows: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(64 * x) vectors for each query.

    rows and queries: vec_id, embedding. Vectors that are null or hold null or
    non-finite components, and rows without a vec_id, take no part; vectors of
    different lengths have no product. Ties go to the smaller vec_id; fewer
    than k candidates are all returned. Repeated rows are repeated candidates;
    repeated queries are one. Components beyond 2^26 in size would leave the
    exact range of doubles and raise an error.

    Each block of rows is indexed once, and its tree is written to the shared
    folder. A task takes a block of queries through a share of the trees, one
    after the other: the best found so far bound the next search. Vectors are
    shuffled once, to their blocks.
    """
    spark = rows.sparkSession
    rows, queries = (
        written(
            usable_vectors(d).where("vec_id is not null").select("vec_id", F.transform("v", lambda x: F.floor(x * 64).cast("double")).alias("v")),
            "vectors",
        )
        for d in (rows, queries)
    )
    queries = queries.distinct()
    row_blocks = max(1, -(-rows.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // block_queries))
    folder = shared_dir(spark, "trees")
    _stored(_dealt(rows, row_blocks), f"{folder}/rows", lambda ids, v: MTree(v, ids))
    asked = _stored(_dealt(queries, query_blocks), f"{folder}/queries", lambda ids, v: (ids, v))
    # A block of queries meets all trees in one task, or in several while there are fewer tasks than the cluster takes.
    groups = max(1, asked.count())
    shares = max(1, min(row_blocks, -(-2 * spark.sparkContext.defaultParallelism // groups)))
    tasks = asked.select("dim", "path", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")).repartition(groups * shares)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.to_pylist():
                ids, v = _loaded(folder, task["path"])
                best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
                for path in _paths(f"{folder}/rows", task["dim"], task["share"], shares):
                    tree = _loaded(folder, path)
                    for i, (own, q) in enumerate(zip(ids.tolist(), v, strict=True)):
                        best[i] = tree.search(q, own, k, *best[i])
                found = [len(f) for _, f in best]
                columns = [np.repeat(ids, found), np.concatenate([f for _, f in best]), np.concatenate([s for s, _ in best]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    found = tasks.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 20 = 0"), 20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
