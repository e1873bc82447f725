"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import frugal, pick, table

UNKNOWN = "und"
#: The classifier is fitted on a bounded sample: of each language about this many rows, characters of a row (from a hashed
#: place), and symbols. With more languages than TOTAL_SYMBOLS holds each has less, but never less than LEAST_SYMBOLS.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_SYMBOLS = 200, 400, 16_000
TOTAL_SYMBOLS, LEAST_SYMBOLS = 640_000, 4_000
#: Texts are parsed in segments of this many symbols (phrases end there), all segments of a batch side by side.
SEGMENT, SEGMENTS = 256, 8192
#: Symbols of a language besides 0 (any run of non-letters) and the last one (letters its sample lacks).
LETTERS = 62
FLAG = 1 << 30


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; kept in the worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def squeeze(symbols: np.ndarray) -> np.ndarray:
    """Runs of symbol 0 become one."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return symbols[keep]


class SuffixAutomaton:
    """Dense transitions of the automaton of all substrings of a sequence of symbols below `width`.

    `step[state * width + symbol]` is the next state (times width). Where no
    substring goes on, it is the state after the symbol alone, plus FLAG: a
    phrase has ended.
    """

    def __init__(self, symbols: np.ndarray, width: int):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    split = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = split
                        p = link[p]
                    link[q] = link[new] = split
            last = new
        # The last state stands behind a symbol that the sample never has: such a symbol is a phrase of its own.
        unseen = len(nexts)
        step = np.zeros((unseen + 1, width), np.int32)
        for c in range(width):
            step[:, c] = nexts[0].get(c, unseen) * width + FLAG
            step[0, c] -= FLAG  # the start ends no phrase
        for state, out in enumerate(nexts):
            for c, to in out.items():
                step[state, c] = to * width
        self.step = step.ravel()

    def phrases(self, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each row: greedy longest matches. Rows are sorted by falling length."""
        state = np.zeros(len(segments), np.int32)
        ended = np.zeros(len(segments), np.int64)
        alive = np.searchsorted(-lengths, -np.arange(segments.shape[1]), side="left")
        for k in range(segments.shape[1]):
            n = alive[k]
            if not n:
                break
            now = self.step[state[:n] + segments[:n, k]]
            ended[:n] += now >> 30
            state[:n] = now & (FLAG - 1)
        return ended + (lengths > 0)


class Alphabet:
    """Symbols of one language's letters, most frequent first.

    While they are at most LETTERS each has one symbol. Of more letters (a
    syllabary, Chinese) the first have one symbol and the others two: a lead
    and a place. Letters beyond what two symbols can name, and letters the
    sample lacks, are the last symbol, which no sample holds.
    """

    def __init__(self, counts: np.ndarray):
        """counts: how often the sample holds each of the joint letters; 0 and the last are no letters."""
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        leads = 0
        while LETTERS - leads + leads * LETTERS < len(order) and leads < LETTERS:
            leads += 1
        singles = min(LETTERS - leads, len(order))
        self.width = (LETTERS if leads else singles) + 2
        self.first = np.full(len(counts), self.width - 1, np.uint8)
        self.second = np.zeros(len(counts), np.uint8)
        self.first[0] = 0
        self.first[order[:singles]] = 1 + np.arange(singles)
        rest = order[singles : singles + leads * LETTERS]
        self.first[rest] = 1 + singles + np.arange(len(rest)) // LETTERS
        self.second[rest] = 1 + np.arange(len(rest)) % LETTERS
        self.double = len(rest) > 0

    def __call__(self, letters: np.ndarray) -> np.ndarray:
        first = self.first[letters]
        if not self.double:
            return first
        second = self.second[letters]
        both = np.stack([first, second], axis=1).ravel()
        keep = np.ones(len(both), bool)
        keep[1::2] = second > 0
        return both[keep]


def _even_share(lengths: list[int], total: int) -> int:
    """The least length to which pieces may be cut so that `total` is reached, where all together reach it."""
    left, pieces = total, sorted(lengths)
    for k, n in enumerate(pieces):
        share = -(-left // (len(pieces) - k))
        if n >= share:
            return share
        left -= n
    return max(pieces, default=0)


class Model:
    """An alphabet and an automaton of each language; code points are first numbered through all languages together."""

    def __init__(self, samples: dict[str, list[str]], symbols: int = SAMPLE_SYMBOLS):
        symbols = max(min(symbols, LEAST_SYMBOLS), min(symbols, TOTAL_SYMBOLS // max(1, len(samples))))  # memory stays bounded
        is_letter = letters()
        texts = {k: [code_points(t) for t in v] for k, v in sorted(samples.items())}
        known = np.unique(np.concatenate([np.zeros(0, np.uint32), *(c for v in texts.values() for c in v)]))
        self.known = known[is_letter[known]]
        joint = self.joint_table()
        self.names, self.alphabets, self.automata, self.weights = [], [], [], []
        for name, codes in texts.items():
            pieces = [squeeze(np.append(joint[c], 0)) for c in codes]
            share = _even_share([len(p) for p in pieces], symbols)
            sample = squeeze(np.concatenate([np.zeros(1, np.int32), *(p[:share] for p in pieces)]))[:symbols]
            if (sample > 0).any():
                counts = np.bincount(sample, minlength=len(self.known) + 2)
                counts[0] = 0
                alphabet = Alphabet(counts)
                coded = alphabet(sample)
                self.names.append(name)
                self.alphabets.append(alphabet)
                self.automata.append(SuffixAutomaton(coded[coded < alphabet.width - 1], alphabet.width))
                self.weights.append(math.log2(len(coded) + 1))

    def joint_table(self) -> np.ndarray:
        """Number of each code point: 0 for non-letters, the last for letters that no sample holds."""
        table = np.where(letters(), len(self.known) + 1, 0).astype(np.int32)
        table[self.known] = np.arange(1, len(self.known) + 1)
        return table

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a letter of each text (row) under each language (column): phrases * log2(sample size) / length."""
        size = np.maximum(1, [len(s) for s in texts])
        ends = np.cumsum([len(s) for s in texts])
        whole = np.concatenate(texts)
        plain, out = segments(ends), []
        for alphabet, automaton, weight in zip(self.alphabets, self.automata, self.weights, strict=True):
            cut = plain
            if alphabet.double:
                cut = segments(np.concatenate([[0], np.cumsum(1 + (alphabet.second[whole] > 0))])[ends])
            found = parsed(automaton, alphabet(whole), *cut, len(texts))
            out.append(found * weight / size)
        return np.stack(out, axis=1)


def segments(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each piece of SEGMENT symbols of texts that end at `ends`, longest first."""
    n = np.diff(ends, prepend=0)
    parts = -(-n // SEGMENT)
    owner = np.repeat(np.arange(len(n)), parts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(ends - n, parts) + place * SEGMENT
    lengths = np.minimum(SEGMENT, np.repeat(ends, parts) - start)
    order = np.argsort(-lengths, kind="stable")
    return start[order], lengths[order], owner[order]


def parsed(automaton: SuffixAutomaton, symbols: np.ndarray, start: np.ndarray, lengths: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Phrases of each text; a bounded number of segments is laid out at once."""
    out = np.zeros(texts)
    for lo in range(0, len(start), SEGMENTS):
        some = slice(lo, lo + SEGMENTS)
        at = np.minimum(start[some, None] + np.arange(SEGMENT), len(symbols) - 1)
        out += np.bincount(owner[some], automaton.phrases(symbols[at], lengths[some]), texts)
    return out


_tables: dict[int, np.ndarray] = {}


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    key = id(model)
    if key not in _tables:
        _tables.clear()
        _tables[key] = model.joint_table()
    joint = _tables[key]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    symbols = [squeeze(joint[code_points(t)]) if t else np.zeros(0, np.int32) for t in texts]
    known = [i for i, s in enumerate(symbols) if s.any()]
    if not known or not model.names:
        return langs, scores
    bits = model.entropies([symbols[i] for i in known])
    best = bits.argmin(axis=1)
    ranked = np.sort(bits, axis=1)
    score = ranked[:, 1] / (ranked[:, 0] + ranked[:, 1]) if bits.shape[1] > 1 else np.ones(len(known))
    for i, b, s in zip(known, best, score, strict=True):
        langs[i], scores[i] = model.names[b], float(s)
    return langs, scores


def held_out(doc_id: F.Column) -> F.Column:
    """Documents kept for testing; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = ROW_CHARS) -> Model:
    """A model of a bounded sample of the labelled rows that are not held out; every label is learned.

    Counts cover all rows; of each language about `rows` documents are drawn by
    a hash of doc_id, and of each of these `chars` characters from a hashed
    place. Rows without text, label, doc_id or letter teach nothing. The driver
    holds at most about 1.5 * rows * chars characters a language.
    """
    labelled = pick(docs, doc_id="bigint", text="string", lang="string").where(
        "text is not null and lang is not null and doc_id is not null"
    )
    labelled = labelled.where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = labelled.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(1.25 * rows + 50) / F.col("count"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.join(F.broadcast(counts), "lang").where(draw < share)  # one row a language
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.char_length("text") - chars + 1))
    drawn = drawn.select("lang", F.substr("text", place.cast("int"), F.lit(chars)).alias("text"), draw.alias("draw"), "doc_id")
    samples: dict[str, list[str]] = {}
    for r in drawn.orderBy("draw", "doc_id", "text").collect():  # about 1.25 * `rows` a language
        if len(samples.setdefault(r.lang, [])) < rows:
            samples[r.lang].append(r.text)
    return Model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone.

    `und` with score 0 where the text is null or has no letter, or nothing was
    learned; equal phrase counts go to the first language by name. The score is
    the runner-up's share of the two lowest entropies (0.5: undecided).
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                langs, scores = predict(shared.value, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(frugal(run), "doc_id bigint, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score behind its own columns, by the same rules as identify."""
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                langs, scores = predict(shared.value, b.column(text).to_pylist())
                added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*plain.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(frugal(run), schema).toDF(*docs.columns, "lang_pred", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
