"""Hashed word shingles of whole texts, for all documents of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_PLACES = np.random.default_rng(21).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, CHUNK + 1), base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word (run of bytes other than white space, A-Z as a-z) of the texts in data.

    Works through chunks cut behind white space or at a text's start, so the
    memory needed does not depend on the length of a text.
    """
    hashes, starts_at = [], []
    lo, stop = int(offsets[0]), int(offsets[-1])
    while lo < stop:
        hi = min(lo + CHUNK, stop)
        if hi < stop:
            gaps = np.flatnonzero(_SPACE[data[lo:hi]])
            inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "right")]
            cut = max(lo + int(gaps[-1]) + 1 if len(gaps) else 0, int(inner[-1]) if len(inner) else 0)
            if cut <= lo:  # one word longer than a chunk
                nxt = int(offsets[np.searchsorted(offsets, hi, "right")])
                gaps = np.flatnonzero(_SPACE[data[hi:nxt]])
                cut = hi + int(gaps[0]) + 1 if len(gaps) else nxt
            hi = cut
        piece = data[lo:hi]
        breaks = _SPACE[piece]
        begins = ~breaks
        begins[1:] &= breaks[:-1]
        inner = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "left")] - lo
        begins[inner] = ~breaks[inner]
        breaks[inner] = True
        starts = np.flatnonzero(begins)
        ends = np.append(np.flatnonzero(breaks), hi - lo)
        ends = ends[np.searchsorted(ends, starts, "right")]
        power, inverse = _power_tables(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[piece] * power[: hi - lo], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        hashes.append(mix(h + (ends - starts).astype(np.uint64)))
        starts_at.append(starts + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts_at)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the sorted distinct shingle hashes of each text.

    A text with fewer words than a shingle has its whole sequence as one; one
    without words, or null, has none.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    words, starts = word_hashes(data, offsets)
    first = np.searchsorted(starts, offsets)  # of each text's words
    count = np.diff(first)
    n = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(n)])
    windows = max(0, len(words) - WORDS + 1)
    grams = np.zeros(windows, np.uint64)
    for k in range(WORDS):
        grams += words[k : k + windows] * _PLACES[k]
    grams = mix(grams)
    # A text's windows are those that begin at its words but the last four.
    values = np.empty(int(out[-1]), np.uint64)
    keep = np.zeros(windows, bool)
    delta = np.zeros(windows + 1, np.int64)
    long = count >= WORDS
    np.add.at(delta, first[:-1][long], 1)
    np.add.at(delta, first[1:][long] - WORDS + 1, -1)
    keep = np.cumsum(delta[:-1]) > 0
    place = np.ones(len(values), bool)
    place[out[:-1][(count > 0) & ~long]] = False
    values[place] = grams[keep]
    for t in np.flatnonzero((count > 0) & ~long):
        some = words[first[t] : first[t + 1]]
        values[out[t]] = xxhash.xxh64_intdigest(some.tobytes(), seed=len(some))
    for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[out[:-1][n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], kept[out]


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; empty sets have 0."""
    cuts = offsets.tolist()
    return np.array(
        [xxhash.xxh64_intdigest(values[a:b].tobytes(), seed=7) if b > a else 0 for a, b in zip(cuts, cuts[1:], strict=False)],
        np.uint64,
    )
