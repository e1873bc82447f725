"""Document quality by naive Bayes support vectors: n-gram indicators scaled by log-count ratios under a linear hinge loss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import frugal, pick, removed, table, written
from .shingles import word_hashes

#: Indicators are hashed: words and word pairs into the upper half, runs of one to three bytes into the lower, but for PATTERNS at its start.
FEATURES = 1 << 18
#: Which of five words in a row equal the one before.
PATTERNS = 16
_HALF = FEATURES // 2
_ONE, _TWO, _THREE = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 18
#: Bounds of the sample that the classifier is fitted on: labelled rows of a class, and features of all its rows.
SAMPLE_ROWS, SAMPLE_FEATURES = 4_000, 1 << 24
#: Smoothing of the counts, cost of a unit of hinge loss, passes over the sample, share of the fitted weights against their mean size.
SMOOTHING, COST, PASSES, SHARE = 1.0, 1.0, 25, 0.9
#: A score from here on predicts label 1.
THRESHOLD = 0.3


def _slots(h: np.ndarray) -> np.ndarray:
    return (h * _ONE >> np.uint64(64 - 17)).astype(np.int64)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and the last ends; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct features of each whole text.

    Words and word pairs without case, bytes by ones, twos and threes, and runs
    of five words by which of them repeat the word before.
    """
    data, offsets = _bytes_of(texts)
    words, starts = word_hashes(data, offsets)
    first = np.searchsorted(starts, offsets)
    seen = np.zeros(FEATURES, bool)
    for t, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        seen[:] = False
        for at in range(lo, hi, CHUNK):
            b = data[at : min(hi, at + CHUNK + 2)].astype(np.uint64)
            two = b[:-1] << np.uint64(8) | b[1:]
            three = two[:-1] << np.uint64(8) | b[2:]
            for h in (b + np.uint64(1 << 26), two + np.uint64(1 << 25), three):
                seen[_slots(h)] = True
        seen[:PATTERNS] = False
        w = words[first[t] : first[t + 1]]
        for at in range(0, len(w), CHUNK):
            some = w[at : at + CHUNK + 4]
            same = (some[1:] == some[:-1]).astype(np.int64)
            seen[same[:-3] + 2 * same[1:-2] + 4 * same[2:-1] + 8 * same[3:]] = True
            seen[_HALF + _slots(some)] = True
            seen[_HALF + _slots(some[:-1] * _TWO + some[1:] * _THREE)] = True
        yield np.flatnonzero(seen)


class SupportVectors:
    """Weights of the indicators, and the curve from margins to scores.

    An indicator is scaled by the log of the ratio of its smoothed shares in
    class 1 and class 0, and a row of scaled indicators to length 1. A linear
    hinge loss with a penalty on the squared weights is fitted by dual
    coordinate descent; the weights are then drawn towards their mean size.
    """

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, totals: tuple[int, int], seed: int = 5):
        self.ratio, self.weights, self.bias = np.zeros(FEATURES), np.zeros(FEATURES), 0.0
        # Without both classes every text gets the labels' smoothed share.
        self.slope, self.level = 0.0, float(np.log((totals[1] + 1) / (totals[0] + 1)))
        if len(np.unique(labels)) < 2:
            return
        rng = np.random.default_rng(seed)
        aside = rng.permutation(len(rows)) % 4 == 0
        if len(np.unique(labels[aside])) == 2 and len(np.unique(labels[~aside])) == 2:
            # The curve is fitted on rows that these weights have not seen.
            self._fit([r for r, a in zip(rows, aside, strict=True) if not a], labels[~aside], rng)
            mine = labels[aside]
            share = np.array([totals[c] / max(1, np.count_nonzero(mine == c)) for c in (0, 1)])
            self._curve(np.array([self.margin(r) for r, a in zip(rows, aside, strict=True) if a]), mine, share[mine])
        else:
            self.slope = 1.0
        self._fit(rows, labels, rng)

    def _fit(self, rows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
        counts = np.full((2, FEATURES), SMOOTHING)
        for r, y in zip(rows, labels.tolist(), strict=True):
            counts[y, r] += 1
        self.ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        sign = np.where(labels == 1, 1.0, -1.0)
        # Each class weighs the same in the loss.
        most = COST * len(rows) / (2 * np.array([np.count_nonzero(labels == c) for c in (0, 1)]))[labels]
        w, bias, dual = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
        # Scaled rows have length 1, or 0 without any feature that tells the classes apart; they are scaled anew when needed, as all of them
        # together would be twice the size of the sample.
        squares = np.array([1.0 + float(self.ratio[r].any()) for r in rows])
        for _ in range(PASSES):
            moved = 0.0
            for i in rng.permutation(len(rows)).tolist():
                r, y = rows[i], sign[i]
                v = self._scaled(r)
                slope = y * (float(w[r] @ v) + bias) - 1.0
                new = min(max(dual[i] - slope / squares[i], 0.0), most[i])
                if (step := new - dual[i]) != 0.0:
                    dual[i] = new
                    w[r] += step * y * v
                    bias += step * y
                    moved = max(moved, abs(step))
            if moved < 1e-3:
                break
        self.weights = SHARE * w + (1 - SHARE) * np.abs(w).mean() * np.sign(w)
        self.bias = bias

    def _scaled(self, row: np.ndarray) -> np.ndarray:
        v = self.ratio[row]
        length = float(np.sqrt(v @ v))
        return v / length if length else v

    def _curve(self, margins: np.ndarray, labels: np.ndarray, share: np.ndarray) -> None:
        """The logistic curve of the labels over the margins, by Newton steps; each class counts as in the whole table."""
        share = share / share.sum() * len(margins)
        ones, zeros = float((share * labels).sum()), float((share * (1 - labels)).sum())
        target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        a, b = 1.0, float(np.log((ones + 1) / (zeros + 1)))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
            d, h = share * (target - p), share * p * (1 - p)
            system = np.array([[h @ margins**2 + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
            da, db = np.linalg.solve(system, [d @ margins - 1e-6 * a, d.sum()])
            step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
            a, b = a + step * da, b + step * db
            if abs(da) + abs(db) < 1e-9:
                break
        if a > 0:  # else the margins say nothing
            self.slope, self.level = float(a), float(b)

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row] @ self._scaled(row)) + self.bias if len(row) else self.bias

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.level, -500, 500))))


def held_out(doc_id: F.Column) -> F.Column:
    """Documents kept for testing; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, features: int = SAMPLE_FEATURES) -> SupportVectors:
    """A classifier of a bounded sample of the labelled rows that are not held out.

    Labels are 0 or 1 in `quality`; others, and null ids, teach nothing. Of
    each class about `rows` ids are drawn by a hash, and of these, in order of
    their hash, whole texts until they have `features` features. An id with
    both labels teaches both; of rows that share an id the one with the least
    hash teaches. Null texts are empty. The driver holds `features` numbers.
    """
    known = pick(labels, doc_id="bigint", quality="int").where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    totals = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.lit(0.0)
    for y, n in totals.items():
        share = F.when(F.col("quality") == y, min(1.0, (1.2 * rows + 50) / n)).otherwise(share)
    some = known.where(draw < share * (1 << 30)).limit(3 * rows + 200)  # above what is drawn; bounds the broadcast
    texts = pick(docs, doc_id="bigint", text="string").join(F.broadcast(some), "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                b = whole.slice(lo, 100)
                found = list(indicators(b.column(2)))
                packed = pa.array([f.astype("<i4").tobytes() for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(f) for f in found], pa.int64()), packed], names=["doc_id", "quality", "n", "packed"]
                )

    sample = written(texts.mapInArrow(frugal(run), "doc_id bigint, quality int, n bigint, packed binary").withColumn("draw", draw), "labelled")
    taken, left, each = [], features, [rows, rows]
    for r in sample.select("draw", "doc_id", "quality", "n").orderBy("draw", "doc_id", "quality").collect():  # at most 3 * rows + 200
        if r.n <= left and each[r.quality]:
            taken.append((r.doc_id, r.quality))
            left -= r.n
            each[r.quality] -= 1
    held = docs.sparkSession.createDataFrame(taken, "doc_id bigint, quality int")
    found = {(r.doc_id, r.quality): np.frombuffer(r.packed, "<i4") for r in sample.join(F.broadcast(held), ["doc_id", "quality"]).collect()}  # bounded above
    removed(sample)
    taken = [k for k in taken if k in found]
    return SupportVectors([found[k] for k in taken], np.array([y for _, y in taken], int), (totals.get(0, 0), totals.get(1, 0)))


def quality_scores(docs: DataFrame, model: SupportVectors) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row, from its whole text alone.

    Null and empty texts have no feature and get the score of the bias; equal
    texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights and ratios
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(f) for f in indicators(b.column(1))], pa.float64())], schema=schema)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(frugal(run), "doc_id bigint, score double")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
