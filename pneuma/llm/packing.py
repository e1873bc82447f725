"""Packing of token pieces into sequences: bin completion with best-fit incumbents."""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import pick, table, written
from .tokenize import WORD_BPE, library_encoder, vocabulary_path

#: Pieces that are packed together; blocks bound a task's memory and stay this size at any input size.
BLOCK_PIECES = 4096
#: Steps of a block's search before its incumbent is taken (a parameter: None searches to the end).
SEARCH_NODES = 50_000


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths, largest first, each into the fullest bin that still takes it."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, (n, -1))
        if k == len(rooms):
            bins.append([n])
            room, b = capacity - n, len(bins) - 1
        else:
            room, b = rooms.pop(k)
            bins[b].append(n)
            room -= n
        bisect.insort(rooms, (room, b))
    return bins


def fillings(counts: dict[int, int], lengths: list[int], room: int, least: int, spend: Callable[[], bool]) -> Iterator[list[int]]:
    """All undominated fillings of the room from the lengths left (descending) that reach `least` tokens (the waste bound).

    A filling is dominated, and left out, where a length left fits into the room
    that stays free, or may take the place of one or of all of the filling's
    lengths that are together no longer than it. Lengths are taken in descending
    order, so each multiset is met once. spend() is asked before each step;
    False ends the enumeration.
    """
    taken: list[int] = []
    used: dict[int, int] = {}

    def left(n: int) -> bool:
        return counts.get(n, 0) > used.get(n, 0)

    def first_left(most: int) -> int | None:
        """The largest length left of at most `most`."""
        for k in range(bisect.bisect_left(lengths, -most, key=lambda n: -n), len(lengths)):
            if left(lengths[k]):
                return lengths[k]
        return None

    def dominated(free: int) -> bool:
        whole = sum(taken)
        for n in {*taken, whole} if taken else ():
            better = first_left(n + free)
            if better is not None and better > n:
                return True
        return len(taken) > 1 and left(whole)

    # A frame: next place among lengths, room, whether a length fitted.
    stack = [[0, room, False]]
    while stack:
        at, free, fits = frame = stack[-1]
        k = max(at, bisect.bisect_left(lengths, -free, key=lambda n: -n)) if free else len(lengths)
        while k < len(lengths) and not left(lengths[k]):
            k += 1
        if k < len(lengths):
            if not spend():
                return
            frame[0], frame[2] = k + 1, True
            n = lengths[k]
            taken.append(n)
            used[n] = used.get(n, 0) + 1
            stack.append([k, free - n, False])
            continue
        if not fits and room - free >= least and first_left(free) is None and not dominated(free):
            yield list(taken)
        stack.pop()
        if taken and stack:
            used[taken.pop()] -= 1


def bin_completion(lengths: list[int], capacity: int, nodes: int | None = SEARCH_NODES, width: int = 8) -> tuple[list[list[int]], bool]:
    """Branch and bound over fillings around the largest length left: the bins, and whether they are proven to be the fewest.

    The best-fit solution is the incumbent. A branch may waste at most what is
    left by a solution with one bin less: (bins - 1) * capacity - total. The
    fillings of a bin come fullest first within portions of `width`, and all
    portions are tried. The search ends at the lower bound ceil(total /
    capacity) or when every branch is pruned, and the result is then optimal;
    or after `nodes` steps (None: no end), and the best so far is returned.
    """
    best = best_fit(lengths, capacity)
    total = sum(lengths)
    bound = -(-total // capacity)
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    left = sorted(counts, reverse=True)
    steps = 0

    def spend() -> bool:
        nonlocal steps
        steps += 1
        return nodes is None or steps <= nodes

    def take(content: list[int]) -> None:
        for n in content:
            counts[n] -= 1
            if not counts[n]:
                del left[bisect.bisect_left(left, -n, key=lambda x: -x)]

    def give(content: list[int]) -> None:
        for n in content:
            counts[n] += 1
            if counts[n] == 1:
                left.insert(bisect.bisect_left(left, -n, key=lambda x: -x), n)

    def options(wasted: int) -> Iterator[list[int]]:
        """Bins around the largest length left. What the generator sees of counts and left is as it was when it is resumed."""
        head = left[0]
        allowed = (len(best) - 1) * capacity - total - wasted
        if allowed < 0:
            return
        mine, own = dict(counts), list(left)
        mine[head] -= 1
        if not mine[head]:
            del own[0]
        found = fillings(mine, own, capacity - head, capacity - head - allowed, spend)
        while portion := list(itertools.islice(found, width)):
            for f in sorted(portion, key=lambda f: (-sum(f), len(f))):
                yield [head, *f]

    if len(best) <= bound:
        return best, True
    made: list[list[int]] = []
    stack: list[tuple[Iterator[list[int]], int]] = [(options(0), 0)]
    while stack and len(best) > bound:
        if len(made) == len(stack):  # back from the last option of this level
            give(made.pop())
        found, wasted = stack[-1]
        content = next(found, None) if len(made) + 1 < len(best) else None
        if content is None or not spend():
            stack.pop()
            continue
        take(content)
        made.append(content)
        wasted += capacity - sum(content)
        if not left:
            if len(made) < len(best):
                best = [list(b) for b in made]
        elif wasted <= (len(best) - 1) * capacity - total:
            stack.append((options(wasted), wasted))
    return best, len(best) <= bound or nodes is None or steps <= nodes


def document_pieces(docs: DataFrame, encode: Callable[[], Callable[[pa.Array], Iterator[bytes]]], capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, spread: documents as ids with the end id, cut only where longer than the capacity."""
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([(c, pa.int64() if c != "piece" else pa.int32()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "spread")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, column_ids = 0, encode()
        for b in batches:
            out = []
            for doc_id, content in zip(b.column(0).to_pylist(), column_ids(b.column(1)), strict=True):
                content += end
                for piece, at in enumerate(range(0, len(content), 4 * capacity)):
                    cut = content[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut), seen))
                    seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    rows = pick(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(run, PIECE)


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, spread bigint"


def pack_blocks(pieces: DataFrame, blocks: int, capacity: int, turn: int, search_nodes: int | None = SEARCH_NODES) -> DataFrame:
    """Adds sequence_id, offset and loose (whether the piece is in its block's emptiest sequence).

    Blocks are dealt by a hash that also holds the row's place, so equal rows spread.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        whole = np.flatnonzero(lengths == capacity)
        waiting: dict[int, list[int]] = {}
        for i in np.flatnonzero(lengths < capacity)[::-1]:
            waiting.setdefault(int(lengths[i]), []).append(int(i))
        bins, _ = bin_completion([int(n) for n in lengths[lengths < capacity]], capacity, search_nodes)
        sequence, offset = np.zeros(len(rows), "int64"), np.zeros(len(rows), "int64")
        sequence[whole] = np.arange(len(whole))
        bins.sort(key=sum, reverse=True)
        for s, content in enumerate(bins, len(whole)):
            at = 0
            for n in content:
                i = waiting[n].pop()
                sequence[i], offset[i] = s, at
                at += n
        last = len(whole) + len(bins) - 1
        rows["loose"] = (sequence == last) & (sum(bins[-1]) < capacity if bins else False)
        rows["sequence_id"] = (turn << 56) + (int(key[0]) << 24) + sequence
        rows["offset"] = offset
        return rows.drop(columns="block")

    block = F.pmod(F.xxhash64("doc_id", "piece", "spread", F.lit(turn)), F.lit(blocks)).alias("block")
    return pieces.select("*", block).groupBy("block").applyInPandas(run, f"{PIECE}, loose boolean, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, block_pieces: int = BLOCK_PIECES, search_nodes: int | None = SEARCH_NODES) -> DataFrame:
    """One row per piece with its sequence and offset.

    Null and empty texts are the end id alone. Blocks of about block_pieces
    pieces are packed on their own. Then the emptiest sequences of all blocks
    are packed anew together, in as many rounds as it takes until they are one
    block, so that blocks do not leave a part-filled sequence each. A block
    whose search is not done after search_nodes steps keeps the best packing found.
    """
    names = [c.split()[0] for c in PIECE.split(", ")]
    pieces = written(document_pieces(docs, lambda: library_encoder(path).stream, capacity), "pieces")
    turn, out = 0, None
    while True:
        blocks = max(1, round(pieces.count() / block_pieces))
        packed = pack_blocks(pieces, blocks, capacity, turn, search_nodes)
        if blocks > 1:
            packed = written(packed, "packed")
        kept = packed.where("not loose") if blocks > 1 else packed
        kept = kept.select(*[c for c in names if c != "spread"], "sequence_id", "offset")
        out = kept if out is None else out.unionByName(kept)
        if blocks == 1:
            return out
        pieces, turn = packed.where("loose").select(names), turn + 1


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(WORD_BPE))
