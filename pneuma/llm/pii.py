"""Personal data: base patterns, then contexts learned from what they found."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import frugal, pick, table, written
from .shingles import mix, word_hashes

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. A match never starts inside a run of digits, and runs of digits are not given back, so each text is read once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r"[(\[{][Aa][Tt][)\]}]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: A pattern needs this many different seeds, and this share of all that its context stands at known, to be trusted; so does an instance its score.
MIN_SEEDS, CONFIDENCE = 5, 0.8
#: Most digits that an identifier of any kind has.
MOST_DIGITS = 19
#: Bits of the filter by which tasks know which contexts to count (a fixed size; what passes by chance is dropped by a join), and documents counted at once.
FILTER_BITS, COUNT_ROWS = 1 << 22, 250


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each @ the run of local characters before it, not before the last match's end."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in code points, sorted."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


_WORD = re.compile("[^\\x20\\x09-\\x0d]+")
_DOT = re.compile(r"\.|[(\[{]dot[)\]}]", re.IGNORECASE)
_HEX = re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}")
_FOUR = re.compile(r"[0-9]+(?:(?:\.|\[\.\]|-|:|_)[0-9]+){3}")
_NUMBER = re.compile(r"[0-9 ()+./_-]+")


def _could_be(value: str) -> list[int]:
    """Kinds whose shape a value has, more widely than the base patterns take it: other marks for @ and dots, other groupings of digits."""
    digits, kinds = sum("0" <= c <= "9" for c in value), []
    if ("@" in value or _AT.search(value)) and _DOT.search(value):
        kinds.append(0)
    if _FOUR.fullmatch(value) or _HEX.fullmatch(value):
        kinds.append(1)
    if _NUMBER.fullmatch(value):
        if 12 <= digits <= MOST_DIGITS:
            kinds.append(2)
        if 7 <= digits <= 15:
            kinds.append(3)
    return kinds


def _lower(word: str) -> str:
    return word.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str], int]]:
    """(start, end, kind, value, patterns, seed 0/1): base spans, and other values of a fitting shape with what stands around.

    A value is a word (a run without white space, whatever its length) with a
    digit, an @ or another mark for it, less quotes around and stops behind it. Words of
    digits behind it belong to it while it has no more digits than an
    identifier may have. Patterns are the word before, the two words before,
    and the words on both sides.
    """
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    begins = [b for b, _ in words]
    spots = [(s, e, k, 1) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    w, t = 0, 0
    while w < len(words):
        start, stop = words[w]
        w += 1
        piece = text[start:stop]
        if "@" not in piece and not _DIGITS.search(piece) and not _AT.search(piece):
            continue
        while t < len(taken) and taken[t][1] <= start:
            t += 1
        digits = sum("0" <= c <= "9" for c in piece)
        numeric = _NUMBER.fullmatch(piece)
        while numeric and w < len(words) and words[w][0] == stop + 1 and text[stop] == " " and _NUMBER.fullmatch(more := text[words[w][0] : words[w][1]].rstrip(".,;:!?")):
            digits += sum("0" <= c <= "9" for c in more)
            if digits > MOST_DIGITS:
                break
            stop = words[w][1]
            w += 1
        while stop > start and text[stop - 1] in ".,;:!?\"'":
            stop -= 1
        while start < stop and text[start] in "\"'":
            start += 1
        if start < stop and (t == len(taken) or taken[t][0] >= stop):
            spots += [(start, stop, k, 0) for k in _could_be(text[start:stop])]
    out = []
    for start, stop, kind, seed in spots:
        i, j = bisect.bisect_right(begins, start) - 1, bisect.bisect_right(begins, stop - 1)
        one, two, right = (_lower(text[slice(*words[k])]) if 0 <= k < len(words) else "" for k in (i - 1, i - 2, j))
        patterns = [" ".join(p) for p in (("1", one), ("2", two, one), ("r", one, right)) if all(p)]
        out.append((start, stop, kind, re.sub(r"\s", "", text[start:stop]).lower(), patterns, seed))
    return out


def _contexts(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of all contexts that a word follows: one word, two words, words on both sides. words: hashes; text: the text of each."""
    n, one, two, both = len(words), np.uint64(1), np.uint64(2), np.uint64(3)
    keys = []
    if n > 1:
        near = text[1:] == text[:-1]
        keys.append(mix(words[:-1] + one)[near])
    if n > 2:
        whole = text[2:] == text[:-2]
        first, second, third = words[:-2], words[1:-1], words[2:]
        keys += [mix(mix(first + two) + second)[whole], mix(mix(first + both) + third)[whole]]
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _pattern_hashes(patterns: list[str]) -> np.ndarray:
    """The hashes that _contexts has for these patterns."""
    words = [w for p in patterns for w in p.split(" ")[1:]]
    column = pa.array(words, pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(words) + 1] if words else np.zeros(1, np.int64)
    raw = column.buffers()[2] if words else None
    hashes, _ = word_hashes(np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), offsets)
    kinds = np.array([{"1": 1, "2": 2, "r": 3}[p[0]] for p in patterns], np.uint64)
    at = np.cumsum(np.where(kinds == 1, 1, 2)) - np.where(kinds == 1, 1, 2)
    out = mix(hashes[at] + kinds) if len(patterns) else np.zeros(0, np.uint64)
    pair = np.flatnonzero(kinds > 1)
    out[pair] = mix(out[pair] + hashes[at[pair] + 1])
    return out


def context_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, n: how often each wanted context (hash) stands before, or around, anything at all in the whole texts (one column).

    Tasks know the wanted hashes by a filter of a fixed number of bits, and sum before the shuffle.
    """
    spark = texts.sparkSession
    bit = F.pmod("hash", F.lit(FILTER_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(32)).cast("int"))
    words = wanted.groupBy(F.floor(bit / 32).cast("int").alias("at")).agg(F.bit_or(one).alias("bits"))
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.collect():  # at most FILTER_BITS / 32
        bits[r["at"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, COUNT_ROWS):
                column = whole.column(0).slice(lo, COUNT_ROWS).fill_null("").cast(pa.large_string())
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                raw = column.buffers()[2]
                hashes, starts = word_hashes(np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets)
                keys = _contexts(hashes, np.searchsorted(offsets, starts, "right"))
                # As pmod of the signed hash, for a power of two.
                place = keys & np.uint64(FILTER_BITS - 1)
                hit = (shared.value[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
                found, n = np.unique(keys[hit > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return texts.mapInArrow(frugal(run), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).join(wanted, "hash", "left_semi")


_FOUND = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.string()),
            ("patterns", pa.list_(pa.string())), ("seed", pa.int32()), ("hashes", pa.list_(pa.int64())),
        ]
    )
)
_FOUND_SQL = "array<struct<start:bigint,end:bigint,kind:int,value:string,patterns:array<string>,seed:int,hashes:array<bigint>>>"


def _extract(rows: DataFrame, numbered: bool = False) -> DataFrame:
    """row_id, key, found: base spans and candidates of each whole text (rows: key, text).

    row_id is the key of numbered rows; else it is made here and fixed once the result is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = task.partitionId() << 36
        for b in batches:
            found = []
            for text in b.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                some = candidates(text, base) if base or "@" in text or _DIGITS.search(text) or _AT.search(text) else []
                found.append([dict(zip(("start", "end", "kind", "value", "patterns", "seed"), c, strict=True)) for c in some])
            spots = [f for each in found for f in each]
            hashes = iter(_pattern_hashes([p for f in spots for p in f["patterns"]]).view(np.int64).tolist())
            for f in spots:
                f["hashes"] = [next(hashes) for _ in f["patterns"]]
            ids = b.column(0) if numbered else pa.array(range(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([ids, b.column(0), pa.array(found, _FOUND)], names=["row_id", "key", "found"])

    return rows.mapInArrow(frugal(run), f"row_id bigint, key bigint, found {_FOUND_SQL}")


def trusted_instances(edges: DataFrame, min_seeds: int, confidence: float, rounds: int | None, against: DataFrame | None = None) -> DataFrame:
    """(kind, value) of unseen identifiers, from the graph of patterns and instances.

    edges: kind, pattern, value, seed (1 where a base pattern found the value);
    against: kind, pattern, n: how often the pattern's context stands at something else.
    Each round, a pattern's score is the share of its known instances (seeds,
    and those found before) among these and n; unknown values of a fitting
    shape are neither for nor against it. It is taken as 0 below the confidence
    or with fewer than min_seeds known instances. An instance's score is one
    less the product of (1 - score) over its patterns; instances at the
    confidence are found. Rounds go on until none finds a new instance, or as
    many as are asked for.
    """
    edges = edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    # A pattern of fewer instances, or with too much against it, can't be trusted in any round.
    patterns = edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= min_seeds)
    none = F.lit(0).cast("bigint")
    patterns = patterns.join(against, ["kind", "pattern"], "left").withColumn("n", F.coalesce("n", none)) if against is not None else patterns.withColumn("n", none)
    patterns = patterns.where(F.col("all") >= confidence * (F.col("all") + F.col("n")))
    edges = written(edges.join(patterns.select("kind", "pattern", "n"), ["kind", "pattern"]), "pii-edges")
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    turn, before = 0, 0
    while rounds is None or turn < rounds:
        known = F.col("score") >= confidence
        strength = scored.groupBy("kind", "pattern").agg(F.sum(F.when(known, F.col("score"))).alias("sum"), F.count_if(known).alias("known"), F.first("n").alias("n"))
        strength = strength.select("kind", "pattern", "known", (F.col("sum") / (F.col("known") + F.col("n"))).alias("strength"))
        strength = strength.where((F.col("strength") >= confidence) & (F.col("known") >= min_seeds)).drop("known")
        instance = (
            edges.join(strength, ["kind", "pattern"])
            .groupBy("kind", "value")
            .agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("strength"), F.lit(0.999)))))).alias("reached"))
        )
        scored = edges.join(instance, ["kind", "value"], "left").withColumn(
            "score", F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.coalesce("reached", F.lit(0.0)))
        )
        scored = written(scored.select("kind", "pattern", "value", "seed", "n", "score"), "pii-scores")
        # Scores never fall, so an instance once found stays, and as many instances are the same ones.
        found = scored.where((F.col("seed") == 0) & (F.col("score") >= confidence)).select("kind", "value").distinct()
        now = found.count()
        if now <= before:
            break
        turn, before = turn + 1, now
    return scored.where((F.col("seed") == 0) & (F.col("score") >= confidence)).select("kind", "value").distinct()


_SPANS = "array<struct<start:bigint,kind:int,end:bigint,seed:int>>"


def _spans(rows: DataFrame, texts: DataFrame, min_seeds: int, confidence: float, rounds: int | None) -> DataFrame:
    """row_id, key, spans from the written rows of _extract and all texts (one column), in which contexts are counted."""
    spots = rows.select("row_id", F.explode("found").alias("f")).select("row_id", "f.*")
    edges = spots.select("kind", F.explode(F.arrays_zip(F.col("patterns").alias("pattern"), F.col("hashes").alias("hash"))).alias("p"), "value", "seed").select("kind", "p.*", "value", "seed")
    held = edges.groupBy("kind", "pattern", "hash").agg(F.count(F.lit(1)).alias("here"), F.count_distinct("value").alias("values"))
    held = written(held.where(F.col("values") >= min_seeds), "pii-patterns")
    totals = context_counts(texts, held.select("hash").distinct())
    against = held.join(totals, "hash", "left").select("kind", "pattern", F.greatest(F.lit(0).cast("bigint"), F.coalesce("n", F.lit(0)) - F.col("here")).alias("n"))
    unseen = trusted_instances(edges.drop("hash"), min_seeds, confidence, rounds, against)
    extra = (
        spots.where("seed = 0")
        .join(unseen, ["kind", "value"], "left_semi")
        .groupBy("row_id")
        .agg(F.collect_list(F.struct("start", "kind", "end", "seed")).alias("extra"))
    )
    base = F.transform(F.filter("found", lambda f: f["seed"] == 1), lambda f: F.struct(f["start"], f["kind"], f["end"], f["seed"]))
    rows = rows.select("row_id", "key", base.cast(_SPANS).alias("base"))
    both = F.array_sort(F.concat("base", F.coalesce("extra", F.expr(f"cast(array() as {_SPANS})"))))
    return rows.join(extra, "row_id", "left").select("row_id", "key", both.alias("spans"))


def find_personal_data(
    docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int | None = None
) -> DataFrame:
    """doc_id and spans: array of (start, kind, end, seed) sorted by start, then kind; one row per row of docs.

    Base spans (seed 1) are always there. Others (seed 0) are values of a
    fitting shape that contexts learned from all base spans, and from what
    they found in turn, reach with the confidence; whatever else a context
    stands at, in any text, counts against it. Identifiers and words may have
    any length; contexts are counted by 64-bit hashes. Null and empty texts have none.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    found = written(_extract(rows), "pii-found")
    return _spans(found, rows.select("text"), min_seeds, confidence, rounds).select(F.col("key").alias("doc_id"), "spans")


def redact_documents(
    docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int | None = None
) -> DataFrame:
    """All rows and columns of docs, with each span of personal data in `text` replaced by its kind, as [EMAIL].

    Rows are numbered and written first, so rows that repeat a doc_id keep
    their own spans. A null text stays null. n_chars, where there is one, is
    counted anew.
    """
    text = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = written(docs.toDF(*names).withColumn("row_id", F.monotonically_increasing_id()), "pii-rows")
    found = written(_extract(rows.select("row_id", names[text]), True), "pii-found")
    spans = _spans(found, rows.select(F.col(names[text]).cast("string")), min_seeds, confidence, rounds).where(F.size("spans") > 0).select("row_id", "spans")
    body = F.col(names[text])
    changed = F.when(F.col("spans").isNotNull(), redact(body, F.col("spans"))).otherwise(body)
    out = rows.join(spans, "row_id", "left").withColumn(names[text], changed)
    if "n_chars" in docs.columns:
        count = names[docs.columns.index("n_chars")]
        out = out.withColumn(count, F.when(F.col("spans").isNotNull(), F.char_length(names[text]).cast("bigint")).otherwise(F.col(count)))
    return out.select(names).toDF(*docs.columns)


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digests(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    base = F.filter("spans", lambda s: s["seed"] == 1)

    def count(kind: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's name, in one pass; a span that begins inside another is part of it."""

    @F.pandas_udf("string")
    def run(text: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([_redacted(*row) for row in zip(text, starts, ends, kinds, strict=True)], dtype=object)

    return run(text, spans["start"], spans["end"], spans["kind"])


def _redacted(text: str | None, starts: np.ndarray | None, ends: np.ndarray, kinds: np.ndarray) -> str | None:
    if text is None or starts is None:
        return text
    out, at = [], 0
    for start, end, kind in zip(starts, ends, kinds, strict=True):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(table(spark, sf_dir, "documents"))
