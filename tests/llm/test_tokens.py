import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pneuma.llm import packing, tokenfile
from pneuma.llm import tokenize as tok
from pneuma.llm.frames import shared_dir

TEXTS = [
    "", "  ", "a  b", "a   b", " \n ", "It's ΣΑΣ Σ <|endoftext|> İstanbul! é <|startoftext|>x\x1c!\x1d y z 12 3a",
    "a   b \n c\n\n d  \ne ", "日本語 テスト ééÉ", "<|endoftext|><|endoftext|>", " lead", "trail ", "I'LL we'll x's'",
    "\ttab\r\nx", "ǅ ß ﬁ ²½", "x" * 5000, "ab " * 3000, "aaaaabbbbaaaa" * 40,
]


@pytest.mark.parametrize("name", [tok.WORD_BPE])
def test_segment_tree_bpe_equals_library(name):
    path = tok.vocabulary_path(name)
    library = Tokenizer.from_file(path)
    for text in TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        found = list(tok._entries(path, text))
        assert " ".join(e[1] for e in found) == " ".join(map(str, want))
        assert " ".join(e[2] for e in found) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", [tok.WORD_BPE, tok.BYTE_BPE])
def test_cached_chunks_equal_library(name):
    encode = tok.library_encoder(tok.vocabulary_path(name))
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_rank_encoder_equals_library():
    import random

    rng = random.Random(4)
    parts = ["a", "B", "é", "Σ", ".", " ", "\n", ",", "'s", "1", "  ", "\t", "İ", "\x02", "<|endoftext|>", "!", "th", " \n", "日", "\u00a0", "\x1c"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + [" " * 300_000 + "x", "é" * 20_000]
    encode = tok.rank_encoder(tok.vocabulary_path(tok.BYTE_BPE), tok.vocabulary_path(tok.BYTE_RANKS))
    library = tok.library_encoder(tok.vocabulary_path(tok.BYTE_BPE)).library
    for text in texts:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_cached_chunks_equal_library_on_random_texts():
    import random

    rng = random.Random(5)
    parts = ["a", "B", "é", "Σ", ".", " ", "\n", ",", "'s", "1", "  ", "\t", "İ", "\x02", "<|endoftext|>", "!", "th", " \n", "K", "ǅ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    library = Tokenizer.from_file(tok.vocabulary_path(tok.WORD_BPE))
    for text in texts:
        own = " ".join(e[1] for e in tok._entries(tok.vocabulary_path(tok.WORD_BPE), text))
        assert own == " ".join(map(str, library.encode(text, add_special_tokens=False).ids)), text
    for name in (tok.WORD_BPE, tok.BYTE_BPE):
        encode = tok.library_encoder(tok.vocabulary_path(name))
        for text in texts:
            assert np.frombuffer(encode(text), "<u4").tolist() == encode.library.encode(text, add_special_tokens=False).ids, text


def _docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (100, None, "x"), (101, "same", "x"), (101, "same", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, TEXT string")


def test_op5_digests(spark):
    path = tok.vocabulary_path(tok.WORD_BPE)
    library = Tokenizer.from_file(path)
    rows = tok.encode_digests(_docs(spark), path).collect()
    assert len(rows) == len(TEXTS) + 4
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(TEXTS):
            ids = library.encode(TEXTS[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert next(r for r in rows if r.doc_id == 100).n_tokens == 0
    assert tok.encode_decode(_docs(spark).limit(0), path).count() == 0


def test_token_files_round_trip(spark):
    path = tok.vocabulary_path(tok.BYTE_BPE)
    library = tok.library_encoder(path).library
    files = tokenfile.write_token_files(_docs(spark), shared_dir(spark, "t"), lambda: tok.library_encoder(path).stream).collect()
    rows = tokenfile.read_token_files(spark, files).orderBy("start").collect()
    texts = {i: t for i, t in enumerate(TEXTS)} | {None: "no id", 100: "", 101: "same"}
    assert [r.doc_id for r in rows] == [None, *range(len(TEXTS)), 100, 101, 101]
    start = 0
    for r in rows:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.write_token_files(_docs(spark).limit(0), shared_dir(spark, "t"), lambda: None).collect() == []
    assert tokenfile.read_token_files(spark, []).count() == 0


def test_seek_table_reads_one_document_and_checks_sums(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "f.zst")
    import struct

    with open(path, "wb") as sink:
        w = tokenfile.FrameWriter(sink)
        contents = [bytes([i]) * 4 * (i + 1) for i in range(5)]
        for c in contents:
            w.frame(c)
        index = np.arange(5, dtype="<i8").tobytes() + b"\0" * 5 + np.arange(1, 6, dtype="<i8").tobytes()
        w.frame(index)
        w.frame(struct.pack("<I", 1))
        w.close()
    data = open(path, "rb").read()
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(20)[:4] == contents[0]
    local = fs.LocalFileSystem()
    with local.open_input_file(path) as f:
        assert tokenfile.TokenFile(f, len(data)).document(3) == contents[3]
    broken = bytearray(data)
    broken[len(data) - 9 - 12 * 7 + 8] ^= 1
    open(path, "wb").write(broken)
    with local.open_input_file(path) as f, pytest.raises(ValueError, match="checksum"):
        tokenfile.TokenFile(f, len(data)).document(0)


def fewest_bins(lengths, capacity):
    """By dynamic programming over all subsets."""
    n = len(lengths)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)  # bins, fill of the last
    for mask in range(1 << n):
        bins, fill = best[mask]
        for i, x in enumerate(lengths):
            if not mask >> i & 1:
                new = (bins, fill + x) if bins and fill + x <= capacity else (bins + 1, x)
                best[mask | 1 << i] = min(best[mask | 1 << i], new)
    return best[-1][0]


HARD = [49, 41, 34, 33, 29, 26, 26, 22, 20, 19]


def test_bin_completion_finds_the_fewest_bins():
    assert len(packing.best_fit(HARD, 100)) == 4 and fewest_bins(HARD, 100) == 3
    rng = np.random.default_rng(3)
    beaten = 0
    for k in range(60):
        some = rng.integers(5, 60, 11).tolist()
        bins, proven = packing.bin_completion(some, 100, None, 1 + k % 4)
        assert sorted(n for b in bins for n in b) == sorted(some) and max(map(sum, bins)) <= 100
        assert proven and len(bins) == fewest_bins(some, 100)
        beaten += len(bins) < len(packing.best_fit(some, 100))
    assert beaten
    assert packing.bin_completion([], 10) == ([], True)


def test_a_search_that_is_cut_off_says_so():
    rng = np.random.default_rng(4)
    some = rng.integers(180, 450, 120).tolist()
    bins, proven = packing.bin_completion(some, 1000, 50)
    assert not proven and sorted(n for b in bins for n in b) == sorted(some) and len(bins) <= len(packing.best_fit(some, 1000))


def packed_texts(spark, lengths, **options):
    docs = spark.createDataFrame([(i, " ".join(["a"] * (n - 1))) for i, n in enumerate(lengths)], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, tok.vocabulary_path(tok.WORD_BPE), **options).collect()
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in fill.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
    assert sum(r.length for r in rows) == sum(lengths)
    return len(fill)


def test_documents_take_the_fewest_sequences_where_best_fit_loses(spark):
    assert packed_texts(spark, HARD, capacity=100) == 3
    cut = [*HARD, 250, 130]
    assert packed_texts(spark, cut, capacity=100) == 3 + fewest_bins([*HARD, 50, 30], 100)


def test_blocks_leave_no_sequence_each(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 40, 400).tolist()
    assert packed_texts(spark, lengths, capacity=64, block_pieces=30) <= -(-sum(lengths) // 64) + 1


def test_empty_texts_fill_what_long_ones_leave(spark):
    assert packed_texts(spark, [2048, 2047, 1, 2000, 48, *[1] * 2048], capacity=2048) == 4


def test_pack_documents(spark):
    path = tok.vocabulary_path(tok.WORD_BPE)
    rows = packing.pack_documents(_docs(spark), path, 64).collect()
    encode = tok.library_encoder(path)
    texts = {i: t for i, t in enumerate(TEXTS)} | {None: "no id", 100: "", 101: "same"}
    by_sequence = {}
    for r in rows:
        content = encode(texts[r.doc_id]) + b"\0" * 4
        cut = content[4 * r.start : 4 * (r.start + r.length)]
        assert r.start == 64 * r.piece and len(cut) == 4 * r.length and r.ids_crc32 == zlib.crc32(cut)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in rows) == sum(len(encode(texts[d])) // 4 + 1 for d in [*range(len(TEXTS)), None, 100, 101, 101])
    assert packing.pack_documents(_docs(spark).limit(0), path).count() == 0


def test_plain_words_are_encoded_together(monkeypatch):
    """A call for each word that the cache did not hold took most of the time; only stops and other chunks are encoded alone."""
    alone = []
    monkeypatch.setattr(tok.LibraryEncoder, "chunk", lambda self, c, plain=tok.LibraryEncoder.chunk: alone.append(c) or plain(self, c))
    monkeypatch.setattr(tok, "JOINED_WORDS", 7)
    monkeypatch.setattr(tok, "STREAM_CHARS", 300)
    encode = tok.LibraryEncoder(tok.vocabulary_path(tok.WORD_BPE))
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(200)]
    texts = [" ".join(w + rng.choice(["", "", ",", ".", "..", "\n", "$$", " "]) for w in rng.choices([*words, "Σ", "İ", "</s>", "E\u0301", ""], k=20)) for _ in range(60)] + [*TEXTS, None, " ", "."]
    found = list(encode.stream(pa.array(texts)))
    assert found == [encode.whole(t or "") for t in texts]
    assert alone and not [c for c in alone if c.rstrip(".,") in words and c[-2:] != ".."]
