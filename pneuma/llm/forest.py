"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .frames import pick, table, written
from .vectors import usable_vectors

#: The trees are fitted on a bounded sample of distinct vectors; every vector is then indexed. A leaf has SAMPLE_LEAF of them at least.
SAMPLE_VECTORS, SAMPLE_LEAF = 50_000, 16
#: A node of at most this many vectors is a leaf, and of at most this share of a small table's; at least SPILL of a node's vectors go to both sides of its cut.
LEAF_VECTORS, LEAF_SHARE, SPILL = 1024, 0.125, 0.1
#: Cuts tried at a node; the share of its sampled links that a cut may lose; the share of its comparisons that must stay at most.
TRIES, LOSS, GAIN = 6, 0.05, 0.8
#: Sampled vectors of a node, and least links among them, by which a cut is judged.
JUDGES, LEAST_LINKS = 500, 10
#: Trees are added until all sampled links, and this share of made pairs right at the cosine, meet in a leaf; or, from MOST_TREES on, this share of both.
RECALL, LEAST_TREES, MOST_TREES = 0.99, 6, 40
#: Rows of a block of a leaf that is compared by several tasks.
BLOCK = 4096


def cut(x: np.ndarray, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, float, float] | None:
    """The direction, place and margin that leave the fewest comparisons, or None where no cut lessens them enough.

    The margin holds SPILL of the vectors, and more where links of the sample
    would be cut otherwise: inside one dense group no cut is worth its margin.
    """
    some = x if len(x) <= JUDGES else x[rng.choice(len(x), JUDGES, replace=False)]
    i, j = np.nonzero(np.triu(some @ some.T >= cosine, 1))
    best, least = None, GAIN
    for _ in range(TRIES if len(i) >= LEAST_LINKS else 1):
        direction = rng.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        p = x @ direction
        judged = some @ direction
        for share in (0.5, 0.3, 0.7) if len(i) >= LEAST_LINKS else (0.5,):
            at = float(np.quantile(p, share))
            margin = float(np.quantile(np.abs(p - at), SPILL))
            if len(i) >= LEAST_LINKS:
                a, b = judged[i] - at, judged[j] - at
                margin = max(margin, float(np.quantile(np.minimum(-np.minimum(a, b), np.maximum(a, b)), 1 - LOSS, method="higher")) * (1 + 1e-9))
            kept = np.mean(p - at < margin) ** 2 + np.mean(p - at >= -margin) ** 2
            if kept < least:
                best, least = (direction, at, margin), kept
    return best


class Forest:
    """Trees of cuts over unit vectors of one dimension; leaves are numbered through all trees."""

    def __init__(self, sample: np.ndarray, vectors: int, cosine: float = 0.9, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.leaves, self.trees, self.scale, self.cosine = 0, [], vectors / max(1, len(sample)), cosine
        self.most = min(LEAF_VECTORS, max(2 * SAMPLE_LEAF, LEAF_SHARE * vectors))
        probes = self._probes(sample, rng)
        met = [np.zeros(len(a), bool) for a, _ in probes]
        while not self._enough([m.mean() if len(m) else 1.0 for m in met]):
            self.trees.append(self._grow(sample, rng))
            for (a, b), m in zip(probes, met, strict=True):
                m |= self._meet(self.trees[-1], a, b)
            if isinstance(self.trees[-1], int):
                return  # no cut is worth its margin: in one leaf all pairs meet

    def _enough(self, met: list[float]) -> bool:
        links, made = met
        return len(self.trees) >= LEAST_TREES and made >= RECALL and (links == 1 or len(self.trees) >= MOST_TREES and links >= RECALL)

    def _probes(self, sample: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs to measure recall with: links of the sample, and sampled vectors with made ones right at the cosine."""
        some = sample[rng.permutation(len(sample))[:2000]]
        i, j = np.nonzero(np.triu(some @ some.T >= self.cosine, 1))
        drawn = rng.permutation(len(i))[:2000]
        noise = rng.standard_normal(some[:1000].shape)
        noise -= (noise * some[:1000]).sum(axis=1, keepdims=True) * some[:1000]
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        made = self.cosine * some[:1000] + math.sqrt(1 - self.cosine**2) * noise / np.where(length > 0, length, 1)
        return [(some[i[drawn]], some[j[drawn]]), (some[:1000], made)]

    def _meet(self, tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether both vectors of each pair reach one leaf of a tree."""
        met = np.zeros(len(a), bool)
        if len(a):
            (row, leaf), (other, at) = self.homes(a, [tree]), self.homes(b, [tree])
            met[row[np.isin(row * self.leaves + leaf, other * self.leaves + at)]] = True
        return met

    def _grow(self, sample: np.ndarray, rng: np.random.Generator):
        """A tree over the sample, which goes both ways at margins as the vectors will, so its leaves show their sizes."""
        vectors = len(sample) * self.scale
        found = cut(sample, self.cosine, rng) if vectors > self.most and len(sample) >= 2 * SAMPLE_LEAF else None
        if found is None:
            self.leaves += 1
            return self.leaves - 1
        direction, middle, margin = found
        p = sample @ direction - middle
        left, right = self._grow(sample[p < margin], rng), self._grow(sample[p >= -margin], rng)
        return direction, middle, margin, left, right

    def homes(self, x: np.ndarray, trees: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row of x reaches."""
        rows, leaves = [], []
        stack = [(t, np.arange(len(x))) for t in (self.trees if trees is None else trees)]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                rows.append(at)
                leaves.append(np.full(len(at), node))
                continue
            direction, middle, margin, left, right = node
            p = x[at] @ direction - middle
            stack.append((left, at[p < margin]))
            stack.append((right, at[p >= -margin]))
        return np.concatenate(rows), np.concatenate(leaves)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_met(homes: np.ndarray, i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Whether no smaller leaf number holds both rows of a pair (homes: leaf numbers by row, -1 for none)."""
    out = np.empty(len(i), bool)
    for lo in range(0, len(i), 20_000):
        a, b = homes[i[lo : lo + 20_000]], homes[j[lo : lo + 20_000]]
        a = np.where((a >= 0) & (a < leaf), a, -1)
        met = np.zeros(len(a), bool)
        for k in range(a.shape[1]):
            met |= (a[:, k] >= 0) & (b == a[:, k : k + 1]).any(axis=1)
        out[lo : lo + 20_000] = ~met
    return out


def unmet(homes: np.ndarray, i: np.ndarray, j: np.ndarray, links: np.ndarray, leaf: int) -> np.ndarray:
    """The links (rows i by rows j) of which no smaller leaf number holds both rows."""
    if np.count_nonzero(links) <= 20_000:
        at, to = np.nonzero(links)
        new = first_met(homes, i[at], j[to], leaf)
        links = np.zeros_like(links)
        links[at[new], to[new]] = True
        return links
    a, b = homes[i], homes[j]
    common = np.intersect1d(a[(a >= 0) & (a < leaf)], b)
    for lo in range(0, len(common), 256):
        some = common[lo : lo + 256]
        marks = []
        for rows in (a, b):
            mark = np.zeros((len(rows), len(some)), np.float32)
            row, k = np.nonzero(np.isin(rows, some))
            mark[row, np.searchsorted(some, rows[row, k])] = 1
            marks.append(mark)
        links = links & (marks[0] @ marks[1].T < 0.5)
    return links


def spanning(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) that connect the same rows and columns as all of `links`, without the most of a dense group."""
    links, out = links.copy(), []
    count = links.sum(axis=1)
    while count.sum() > 4 * sum(links.shape):
        r = int(count.argmax())
        columns = np.flatnonzero(links[r])
        part = links[:, columns]
        rows = np.flatnonzero(part.any(axis=1))
        out += [(np.full(len(columns), r), columns), (rows, columns[part[rows].argmax(axis=1)])]
        count -= part.sum(axis=1)
        links[:, columns] = False
    out.append(np.nonzero(links))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that pairs connect to each row."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for i, j in pairs:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _homes(whole: pa.RecordBatch, forests: dict[int, Forest]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(dim, rows, row, leaf), sorted by row and leaf, of pieces of a batch of classes."""
    dims = np.diff(whole.column(2).offsets.to_numpy())
    for dim in np.unique(dims).tolist():
        mine = pa.array(np.flatnonzero(dims == dim))
        for lo in range(0, len(mine), 1000):
            b = whole.take(mine[lo : lo + 1000])
            row, leaf = forests[dim].homes(unit(_matrix(b.column(2))))
            order = np.lexsort((leaf, row))
            yield dim, b, row[order], leaf[order]


def _sizes(classes: DataFrame, forests: dict[int, Forest]) -> list[tuple[int, int, int]]:
    """(dim, leaf, vectors) of each leaf."""
    shared = classes.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, _, _, leaf in _homes(whole, shared.value):
                keys, n = np.unique(leaf, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dim)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["dim", "leaf", "n"])

    found = classes.select("rep", "n", "v").mapInArrow(run, "dim bigint, leaf bigint, n bigint")
    # A row a leaf; the sample bounds the leaves.
    return [tuple(r) for r in found.groupBy("dim", "leaf").agg(F.sum("n")).collect()]


#: Blocks of each leaf of more than one, by dim and leaf.
Parts = dict[tuple[int, int], int]


def block_of(reps: np.ndarray, blocks: int) -> np.ndarray:
    return (reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks


def _placed(classes: DataFrame, forests: dict[int, Forest], parts: Parts) -> DataFrame:
    """A row per class, leaf and pair of blocks of it: dim, leaf, low, high, block, rep, n, v and all the class's leaves.

    A leaf of k blocks is k * (k + 1) / 2 pairs; each of its rows goes to the k pairs of its own block, which follows from the row alone.
    """
    shared = classes.sparkSession.sparkContext.broadcast((forests, parts))  # bounded by the sample
    names = ("dim", "leaf", "low", "high", "block")
    schema = pa.schema(
        [(k, pa.int32()) for k in names] + [("rep", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("homes", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, parts = shared.value
        for whole in batches:
            for dim, b, row, leaf in _homes(whole, forests):
                homes = pa.array(np.split(leaf.astype(np.int32), np.flatnonzero(np.diff(row)) + 1), pa.list_(pa.int32()))
                found, inverse = np.unique(leaf, return_inverse=True)
                blocks = np.array([parts.get((dim, k), 1) for k in found.tolist()], np.int64)[inverse]
                mine = block_of(b.column(0).to_numpy()[row], blocks)
                # (row, leaf) once for each block of the leaf.
                each = np.repeat(np.arange(len(row)), blocks)
                other = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                for lo in range(0, len(each), 5000):
                    e, q = each[lo : lo + 5000], other[lo : lo + 5000]
                    p, take = mine[e], pa.array(row[e])
                    ints = (np.full(len(e), dim), leaf[e], np.minimum(p, q), np.maximum(p, q), p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.astype(np.int32)) for c in ints] + [b.column(c).take(take) for c in range(3)] + [homes.take(take)], schema=schema
                    )

    ints = ", ".join(f"{k} int" for k in names)
    return classes.select("rep", "n", "v").mapInArrow(run, f"{ints}, rep bigint, n bigint, v array<double>, homes array<int>")


def _compare(placed: DataFrame, cosine: float) -> DataFrame:
    """Per pair of blocks and class with links: rep, links (vectors linked, each pair counted in its first leaf alone), root.

    All pairs of a leaf are compared, so a pair's first common leaf finds it.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        leaf, low, high = (k.as_py() for k in key[1:])
        reps, n, block = (t.column(c).to_numpy() for c in ("rep", "n", "block"))
        order = np.argsort(reps, kind="stable")
        reps, n, block = reps[order], n[order], block[order]
        x = unit(_matrix(t.column("v")))[order]
        lists = t.column("homes").to_pylist()
        homes = np.full((len(lists), max(map(len, lists))), -1, np.int32)
        for k, at in enumerate(order.tolist()):
            homes[k, : len(lists[at])] = lists[at]
        links, pairs = np.zeros(len(reps), np.int64), []
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for lo in range(0, len(left), 512):
            i, j = left[lo : lo + 512], right[lo:] if low == high else right
            close = x[i] @ x[j].T >= cosine
            if low == high:
                close &= i[:, None] < j
            if not close.any():
                continue
            a, b = spanning(close)
            pairs.append((i[a], j[b]))
            new = unmet(homes, i, j, close, leaf)
            a, b = np.nonzero(new)
            np.add.at(links, i[a], n[j[b]])
            np.add.at(links, j[b], n[i[a]])
        root = roots(len(reps), pairs)
        linked = np.zeros(len(reps), bool)
        for i, j in pairs:
            linked[i] = linked[j] = True
        return pa.table([pa.array(reps[linked]), pa.array(links[linked]), pa.array(reps[root[linked]])], names=["rep", "links", "root"])

    return placed.groupBy("dim", "leaf", "low", "high").applyInArrow(run, "rep bigint, links bigint, root bigint")


def near_duplicates(rows: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Equal vectors are one class, compared once and linked among themselves.
    Vectors that are null, zero, or hold null or non-finite components link
    with nothing, as do rows without a vec_id; vectors of different lengths
    never link. Every reported link is verified in double precision; pairs that
    share no leaf of any tree are missed.
    """
    spark = rows.sparkSession
    vectors = usable_vectors(rows).where(F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0))
    vectors = vectors.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    classes = written(vectors.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    # One row for each length of vectors.
    sizes = {r.dim: r.n for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    forests = {}
    for dim, n in sizes.items():
        share = min(1.0, 1.2 * SAMPLE_VECTORS / n)
        drawn = classes.where((F.size("v") == dim) & (draw <= int(share * (1 << 30)))).select("v").limit(SAMPLE_VECTORS)
        forests[dim] = Forest(unit(_matrix(drawn.toArrow().column(0))), n, cosine)
    parts = {(dim, leaf): -(-n // BLOCK) for dim, leaf, n in _sizes(classes, forests) if n > BLOCK}
    found = written(_compare(_placed(classes, forests, parts), cosine), "leaf-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    names = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    labelled = classes.join(linked, "rep", "left").join(names.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select(
        "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    mine = vectors.join(labelled, "v").select("vec_id", "n_links", F.col("component").alias("component_id"))
    none = pick(rows, vec_id="bigint", embedding="array<double>").where(
        F.col("vec_id").isNull()
        | F.col("embedding").isNull()
        | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        | ~F.exists("embedding", lambda x: x != 0)
    )
    none = none.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.node = v.vec_id
"""
