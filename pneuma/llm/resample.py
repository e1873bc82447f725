"""Importance resampling towards a target: gains of hashed n-gram buckets, through a dictionary of the distinct n-grams."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import frugal, pick, shuffle_partitions, table, written

BUCKETS = 10_000
#: An n-gram with at least this share of all features is looked up in a broadcast dictionary, which so holds at most FREQUENT n-grams.
FREQUENT = 400_000
#: A longer n-gram (in bytes) goes by its SHA-256, so no key is longer than this.
LONG = 64
#: Rows of an Arrow batch that a worker gives back; n-grams whose counts it holds at once.
ROWS, HELD = 20_000, 200_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def features(text: str | None, n: int) -> Iterator[str]:
    """All runs of 1 to n words."""
    found = words(text)
    yield from found
    for k in range(2, n + 1):
        for i in range(len(found) - k + 1):
            yield " ".join(found[i : i + k])


def key(gram: str) -> str:
    """The n-gram, or '#' and the SHA-256 of a long one ('#' is in no n-gram)."""
    if len(gram) <= LONG // 4:
        return gram
    raw = gram.encode()
    return gram if len(raw) <= LONG else "#" + hashlib.sha256(raw).hexdigest()


def crc_of_long(gram: str) -> int | None:
    """CRC-32 of an n-gram that goes by its hash; that of others is taken once, from the dictionary."""
    return None if key(gram) == gram else zlib.crc32(gram.encode())


def _totals(texts: DataFrame, n: int) -> DataFrame:
    """key, crc (of long ones), count: n-grams of the column `text`, counted within each task and then over all."""
    schema = pa.schema([("key", pa.string()), ("crc", pa.int64()), ("count", pa.int64())])

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(map(key, counts), pa.string()), pa.array(map(crc_of_long, counts), pa.int64()), pa.array(counts.values(), pa.int64())], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                counts.update(features(text.as_py(), n))
                if len(counts) > HELD:
                    yield batch(counts)
                    counts = Counter()
        if counts:
            yield batch(counts)

    found = texts.mapInArrow(frugal(run), "key string, crc bigint, count bigint")
    return found.groupBy("key").agg(F.max("crc").alias("crc"), F.sum("count").alias("count"))


def dictionary(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """key, count (in docs), gain: every distinct n-gram of either table, hashed once.

    A bucket holds s of the S features of docs and t of the T of target; its
    gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))).
    """
    both = _totals(docs, n).select("key", "crc", F.col("count").alias("s"), F.lit(0).cast("bigint").alias("t"))
    both = both.unionByName(_totals(target, n).select("key", "crc", F.lit(0).cast("bigint").alias("s"), F.col("count").alias("t")))
    grams = both.groupBy("key").agg(F.max("crc").alias("crc"), F.sum("s").alias("s"), F.sum("t").alias("t"))
    crc = F.coalesce("crc", F.crc32(F.col("key").cast("binary")))
    grams = written(grams.select("key", (crc % buckets).cast("int").alias("bucket"), "s", "t"), "dictionary")
    filled = grams.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    S, T = (float(x or 0) for x in filled.agg(F.sum("s"), F.sum("t")).first())
    ratio = ((F.col("t") + 1).cast("double") * (S + buckets)) / ((F.col("s") + 1).cast("double") * (T + buckets))
    gains = filled.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # a row a bucket
    return grams.join(F.broadcast(gains), "bucket").select("key", F.col("s").alias("count"), "gain")


def weights(docs: DataFrame, gains: DataFrame, n: int = 1) -> DataFrame:
    """doc_id, text_hash, copies, n_words, n_features, weight of each distinct (doc_id, text).

    Frequent n-grams meet their gains in a broadcast dictionary of bounded
    size, and a document's are summed where it is read. The others are counted
    per document and joined with the dictionary; only they are shuffled.
    """
    spark = docs.sparkSession
    total = gains.agg(F.sum("count")).first()[0] or 0
    often = gains.where((F.col("count") >= max(1, -(-total // FREQUENT))) & (F.col("count") > 0)).select("key", "gain")
    shared = spark.sparkContext.broadcast({r.key: r.gain for r in often.collect()})  # at most FREQUENT keys of at most LONG + 1 bytes
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("words", pa.int64()), ("features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = shared.value.get
        rows: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                text_hash = xxhash.xxh3_64_intdigest(text or "") - (1 << 63)
                counts = Counter(features(text, n))
                weight = 0
                for gram, count in counts.items():
                    at = key(gram)
                    if (gain := gain_of(at)) is None:
                        rows.append((doc_id, text_hash, at, count, 0, 0, 0))
                    else:
                        weight += count * gain
                # The document's own row; its key is in no dictionary, and is spread over the tasks.
                rows.append((doc_id, text_hash, f"#{text_hash}", 0, len(words(text)) if n > 1 else counts.total(), counts.total(), weight))
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    counted = docs.mapInArrow(frugal(run), "doc_id bigint, text_hash bigint, key string, n bigint, words bigint, features bigint, weight bigint")
    found = counted.join(gains.select("key", "gain"), "key", "left")
    found = found.groupBy("doc_id", "text_hash").agg(
        F.count_if(F.col("n") == 0).alias("copies"), F.max("words").alias("n_words"), F.max("features").alias("n_features"),
        F.sum(F.col("weight") + F.col("n") * F.coalesce("gain", F.lit(0))).alias("weight"),
    )
    # Repeated rows have added up to a multiple.
    return found.withColumn("weight", F.expr("weight div copies"))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, least: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document.

    Features are runs of 1 to n words of whole texts, A-Z in lower case; weight
    is the sum of their gains (none: 0). Scores add Gumbel noise from a hash of
    the doc_id (a null one hashes as nothing), so that the highest are a sample
    by weight without replacement. Of the N documents with at least `least`
    words, the floor(percent * N / 100) highest scores are drawn and ranked,
    ties to the smaller doc_id, null ids last; the others have a null rank.
    Null and empty texts have no feature. Repeated rows are drawn one by one.
    Rows of one doc_id are told apart by a 64-bit hash of their text.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id="bigint", text="string")
    gains = dictionary(rows.select("text"), pick(target, text="string"), n, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weights(rows, gains, n).withColumn("score", F.col("weight") + noise)
    scored = scored.select("doc_id", "n_words", "n_features", "weight", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("copy")]
    # Ranges of falling score, written, so that they stay what they are; a rank is a range's start and the place in it.
    able = (F.col("n_words") >= least).alias("able")
    ranged = scored.repartitionByRange(shuffle_partitions(spark), able.desc(), *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sizes = sorted((r.part, r.n) for r in ranged.where(able).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
    drawn, starts, start = percent * sum(n for _, n in sizes) // 100, [], 0
    for part, size in sizes:
        starts.append((part, start))
        start += size
    starts = F.broadcast(spark.createDataFrame([s for s in starts if s[1] < drawn], "part int, start bigint"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranged.where(able).join(starts, "part").withColumn("place", place)
    top = ranked.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("bigint"))
    rest = ranged.where(able).join(starts, "part", "left_anti").unionByName(ranged.where(~able)).withColumn("rank", F.lit(None).cast("bigint"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return top.select(names).unionByName(rest.select(names))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH RECURSIVE poly AS (
  SELECT i::UBIGINT AS n, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM poly WHERE k < 8
), tab AS (SELECT list(c ORDER BY n) AS l FROM poly WHERE k = 8),
w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f
  FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark
), g AS (
  SELECT f, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t
  FROM (SELECT f, count(*) AS s, 0 AS t FROM w GROUP BY f UNION ALL SELECT f, 0, count(*) FROM b GROUP BY f) GROUP BY f
), crc AS (
  SELECT f, s, t, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(length(hex(encode(f))) // 2), lambda i: (16 * (strpos('0123456789ABCDEF', substr(hex(encode(f)), (2 * i + 1)::BIGINT, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(encode(f)), (2 * i + 2)::BIGINT, 1)) - 1)::UBIGINT)),
    lambda c, x: xor(c // 256, l[(xor(c % 256, x) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM g, tab
), bucket AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM crc GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM bucket
), doc AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM w JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN doc USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, rank
FROM scored LEFT JOIN (SELECT doc_id, rank FROM ranked WHERE rank <= 10 * n // 100) USING (doc_id)
"""
