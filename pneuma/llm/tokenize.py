"""Token ids of whole texts: a cache over chunks between spaces, and a BPE encoder on a segment tree."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .frames import map_batches, pick, table

WORD_BPE, BYTE_BPE, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Chunks of a generation that a worker keeps, of two generations (results do not depend on it).
CACHE_CHUNKS, CACHE_LIBRARY_CHUNKS = 500_000, 150_000
#: Characters of texts whose distinct chunks the library's encoder takes together, and words of these that it encodes as one text.
STREAM_CHARS, JOINED_WORDS = 4_000_000, 20_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class SegmentTree:
    """Minimum of (rank, position) over adjacent pairs, with point updates.

    `tree[1]` is the leftmost of the lowest ranks as rank * 2**32 + position.
    """

    NONE = 1 << 62

    def __init__(self, ranks: list[int | None]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        leaves = [self.NONE if r is None else (r << 32) | i for i, r in enumerate(ranks)]
        tree = [self.NONE] * self.size + leaves + [self.NONE] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def put(self, i: int, rank: int | None) -> None:
        tree, k = self.tree, self.size + i
        tree[k] = self.NONE if rank is None else (rank << 32) | i
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1


class SegmentTreeBpe:
    """The vocabulary of a tokenizers file: split, byte symbols, merges, word ends, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.bytes = byte_symbols()

    @staticmethod
    def normalise(text: str) -> str:
        # One character at a time: no final sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: always the leftmost pair of the lowest rank, until none is mergeable."""
        symbols = [self.bytes[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        n = len(symbols)
        if n > 1:
            ranks = self.ranks
            tree = SegmentTree([ranks.get(p) for p in zip(symbols, symbols[1:], strict=False)])
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while (best := tree.tree[1]) != SegmentTree.NONE:
                i = best & 0xFFFFFFFF
                j = after[i]
                symbols[i] += symbols[j]
                symbols[j] = ""
                k = after[j]
                after[i] = k
                if j < n - 1:
                    tree.put(j, None)
                if k < n:
                    before[k] = i
                    tree.put(i, ranks.get((symbols[i], symbols[k])))
                else:
                    tree.put(i, None)
                if (h := before[i]) >= 0:
                    tree.put(h, ranks.get((symbols[h], symbols[i])))
        return [self.ids[s] for s in symbols if s]

    def encode_chunk(self, chunk: str) -> list[int]:
        return [i for w in self.split.findall(self.normalise(chunk)) for i in self.merge(w)]


#: Words that are one pre-token, and that no normaliser changes.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


class ChunkCache(dict):
    """chunk -> entry, made on first use. When full, it becomes the older generation, from which chunks in use come back."""

    def __init__(self, make: Callable[[str], object], most: int = CACHE_CHUNKS):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, chunk: str):
        entry = self.older.get(chunk)
        if entry is None:
            entry = self.make(chunk)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[chunk] = entry
        return entry


def _entry(bpe: SegmentTreeBpe, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), " ".join(map(str, ids)), " ".join(bpe.tokens[i] for i in ids)


_encoders: dict[str, tuple[SegmentTreeBpe, ChunkCache, regex.Pattern | None]] = {}


def _encoder(path: str) -> tuple[SegmentTreeBpe, ChunkCache, regex.Pattern | None]:
    """Kept in the worker from task to task."""
    if path not in _encoders:
        bpe = SegmentTreeBpe(path)
        marks = regex.compile("(" + "|".join(map(regex.escape, bpe.special)) + ")") if bpe.special else None

        def make(chunk: str) -> tuple[int, str, str]:
            """A last full stop or comma behind a word is a pre-token of its own, and is not merged with it."""
            if chunk[-1] in ".," and _PLAIN.fullmatch(chunk[:-1]):
                (n, ids, decoded), (m, more, rest) = cache[chunk[:-1]], cache[chunk[-1]]
                return n + m, f"{ids} {more}", f"{decoded} {rest}"
            return _entry(bpe, bpe.encode_chunk(chunk))

        cache = ChunkCache(make)
        _encoders[path] = bpe, cache, marks
    return _encoders[path]


def _entries(path: str, text: str) -> Iterator[tuple[int, str, str]]:
    """Spaces and line ends part pre-tokens and are dropped, so each chunk between them stands alone."""
    bpe, cache, marks = _encoder(path)
    for k, part in enumerate(marks.split(text) if marks and "<" in text else (text,)):
        if k % 2:
            yield _entry(bpe, [bpe.special[part]])
        else:
            if "İ" not in part:  # lower case at once, so that fewer chunks differ
                part = bpe.normalise(part)
            yield from [e for c in part.replace("\n", " ").split(" ") if c and (e := cache[c])[0]]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: ids by repeated lowest-rank merges, then decoded token by token.

    Null and empty texts have no ids. ids are decimal, joined by one space;
    decoded joins the vocabulary's tokens by one space, as decoding without a
    decoder does. Rows repeat if their input repeats.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids, decoded = [], [], []
        for text in batch.column(1).to_pylist():
            found = list(_entries(path, text or ""))
            counts.append(sum(e[0] for e in found))
            ids.append(" ".join([e[1] for e in found]))
            decoded.append(" ".join([e[2] for e in found]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    rows = pick(docs, doc_id="bigint", text="string")
    return map_batches(rows, run, "doc_id bigint, n_tokens bigint, ids string, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode_decode, with digests in place of the two long texts."""

    def digest(parts: list[str]) -> str:
        return hashlib.sha256(" ".join(parts).encode("utf-8")).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids, decoded = [], [], []
        for text in batch.column(1):
            found = list(_entries(path, text.as_py() or ""))
            counts.append(sum([e[0] for e in found]))
            ids.append(digest([e[1] for e in found]))
            decoded.append(digest([e[2] for e in found]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = pick(docs, doc_id="bigint", text="string")
    return map_batches(rows, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary_path(WORD_BPE))


# --- ids by the tokenizers library, for the writers of token files and packed sequences


class LibraryEncoder:
    """Little-endian 32-bit ids of whole texts by the tokenizers library.

    Files that drop white space may be cut at every space and line end, and
    their lower case may be taken at once, so each chunk is encoded once while
    the cache holds it. Texts that hold a special token's string, and files
    that keep white space, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.keeps_space = spec["normalizer"] is None
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.last[[i for t, i in spec["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cache = ChunkCache(self.chunk, CACHE_LIBRARY_CHUNKS)
        self.model = self.library.model
        self.symbols = dict(enumerate(byte_symbols()))

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        """A chunk in lower case that is not in the cache; a last full stop or comma behind a word is a pre-token of its own."""
        if _PLAIN.fullmatch(chunk):
            # One pre-token that no normaliser changes: the library's model may take it as it is.
            word = chunk.encode("utf-8").decode("latin-1").translate(self.symbols)
            ids = [t.id for t in self.model.tokenize(word)]
            return struct.pack(f"<{len(ids)}I", *ids)
        if chunk[-1] in ".," and _PLAIN.fullmatch(chunk[:-1]):
            return self.cache[chunk[:-1]] + self.cache[chunk[-1]]
        return self.whole(chunk)

    def parted(self, text: str) -> str | None:
        """The text as chunks between spaces, or None where it is to be encoded whole."""
        if self.keeps_space or "İ" in text or any([s in text for s in self.special]):
            return None
        # Characters stand for themselves in lower case (no final sigma).
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().replace("\n", " ")

    def __call__(self, text: str) -> bytes:
        if (chunks := self.parted(text)) is None:
            return self.whole(text)
        cache = self.cache
        return b"".join([cache[c] for c in chunks.split(" ") if c])

    def words(self, words: pa.Array) -> pa.Array:
        """The ids of plain words. Many are encoded as one text; a word ends where a token bears the suffix."""
        parts = []
        for lo in range(0, len(words), JOINED_WORDS):
            some = words.slice(lo, JOINED_WORDS).to_pylist()
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                offsets = np.append(0, 4 * ends).astype(np.int64)
                parts.append(pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
            else:
                parts.append(pa.array([self.chunk(w) for w in some], pa.large_binary()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())

    def together(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text: each distinct chunk of all of them is encoded once, and Arrow lays out its ids where it stands."""
        parted = [self.parted(t) for t in texts]
        lists = pc.split_pattern(pa.array([t or "" for t in parted], pa.large_string()), " ")
        chunks = lists.values.dictionary_encode()
        known = chunks.dictionary
        plain = pc.match_substring_regex(known, f"^{_PLAIN.pattern}[.,]?$")
        # A last full stop or comma is a pre-token of its own.
        some = known.filter(plain)
        words = pc.utf8_rtrim(some, ".,").dictionary_encode()
        stop = pc.add(pc.ends_with(some, ".").cast(pa.int8()), pc.multiply(pc.ends_with(some, ",").cast(pa.int8()), pa.scalar(2, pa.int8())))
        stops = pa.array([b"", *(self.cache[c] for c in ".,")], pa.large_binary()).take(stop)
        some = pc.binary_join_element_wise(self.words(words.dictionary).take(words.indices), stops, pa.scalar(b"", pa.large_binary()))
        others = pa.array([self.cache[c] if c else b"" for c in known.filter(pc.invert(plain)).to_pylist()], pa.large_binary())
        place = np.empty(len(known), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        place[is_plain], place[~is_plain] = np.arange(len(some)), len(some) + np.arange(len(others))
        ids = pa.concat_arrays([some, others]).take(pa.array(place[chunks.indices.to_numpy()]))
        _, offsets, content = ids.buffers()
        cuts = np.frombuffer(offsets, np.int64)[lists.offsets.to_numpy()].tolist()
        for text, chunk, a, z in zip(texts, parted, cuts, cuts[1:], strict=False):
            yield self.whole(text) if chunk is None else content.slice(a, z - a).to_pybytes() if z > a else b""

    def stream(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column (null: none)."""
        held, chars = [], 0
        for value in column:
            held.append(value.as_py() or "")
            chars += len(held[-1])
            if chars >= STREAM_CHARS:
                yield from self.together(held)
                held, chars = [], 0
        if held:
            yield from self.together(held)


_libraries: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _libraries:
        _libraries[path] = LibraryEncoder(path)
    return _libraries[path]


class RankEncoder:
    """The same ids as the library's from a byte-level vocabulary's ranks, which is several times faster on texts of many different words.

    Special tokens and the split come from the library's file and its public
    pattern. Texts that the rank encoder gives up on (very long runs of white
    space) go to the library.
    """

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.path = path
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) > 10_000 and _BLANK.search(text):
            return np.frombuffer(library_encoder(self.path)(text), "<u4")
        return self.ranks.encode_to_numpy(text, allowed_special="all")

    def stream(self, column: pa.Array) -> Iterator[bytes]:
        for value in column:
            yield self(value.as_py() or "").astype("<u4").tobytes()


_BLANK = re.compile(r"\s{5000}")
_ranks: dict[str, RankEncoder] = {}


def rank_encoder(path: str, ranks_path: str) -> RankEncoder:
    if path not in _ranks:
        _ranks[path] = RankEncoder(path, ranks_path)
    return _ranks[path]
