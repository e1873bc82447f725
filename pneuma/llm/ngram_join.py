"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is cut into fragments. Each fragment sees its part
of every set, counts on its own, and the partial counts are summed: first how
often each n-gram occurs (n-grams of one document alone can link nothing), later
the overlap of each candidate pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .frames import frugal, give_back, pick, removed, shuffle_partitions, table, written
from .shingles import fingerprints, shingle_sets

#: n-grams that a fragment holds on average (the number of fragments follows the input), and documents that are cut up at once.
FRAGMENT_GRAMS, SLICE_ROWS = 1 << 19, 1536
#: An n-gram in more than 1 / HEAVY_SHARE of all set elements is heavy, so at most HEAVY_SHARE are; they come last in the order. A task counts n-grams
#: of half that share, and of HEAVY_IN_TASK sets at least; elements after which it forgets those that fall short.
HEAVY_SHARE, HEAVY_IN_TASK, FORGET = 100_000, 12, 400_000
HEAVY_COUNT = np.uint32(0xFFFFFFFF)
#: Pivots of the order, rarest n-grams first, by the number of sets that hold one (a set counts in each slice that holds it): the sets are cut there into
#: fragments when pairs are counted.
PIVOTS = np.array([3, 5, 9, 33, 257, 4097, HEAVY_COUNT], np.uint32)
CUTS = len(PIVOTS) + 1
STAR_ROUNDS = 1
BITMAP_WORDS = 8


def _least(share: int, size: np.ndarray) -> np.ndarray:
    """Smallest overlap that a set of this size can have with a linked one: ceil(share * size / 100)."""
    return -(-share * size // 100)


def _batch(arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) if not isinstance(a, pa.Array) else a for a in arrays], names=names)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(lo, SLICE_ROWS)


class FrequentGrams:
    """The frequent of a stream of n-grams by lossy counting: of each FORGET elements, those counted least are forgotten.

    An n-gram in at least 1 / FORGET of the elements so far is known, its count
    short by that share at most, whatever the slices it came in. The table
    holds FORGET n-grams and those that were more frequent so far.
    """

    def __init__(self):
        self.grams, self.counts, self.missed = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.elements = self.bucket = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct n-grams with their counts."""
        known = np.searchsorted(self.grams, grams)
        same = np.zeros(len(grams), bool)
        inside = known < len(self.grams)
        same[inside] = self.grams[known[inside]] == grams[inside]
        self.counts[known[same]] += counts[same]
        fresh = ~same
        self.elements += int(counts.sum())
        self.grams = np.concatenate([self.grams, grams[fresh]])
        self.counts = np.concatenate([self.counts, counts[fresh]])
        self.missed = np.concatenate([self.missed, np.full(int(fresh.sum()), self.bucket, np.int64)])
        self.bucket = self.elements // FORGET
        keep = self.counts + self.missed > self.bucket
        self.grams, self.counts, self.missed = self.grams[keep], self.counts[keep], self.missed[keep]
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.counts, self.missed = self.grams[order], self.counts[order], self.missed[order]

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """n-grams, and their counts, of half the share of a heavy one."""
        n = self.counts + self.missed
        enough = (n * 2 * HEAVY_SHARE >= self.elements) & (n >= HEAVY_IN_TASK)
        return self.grams[enough], n[enough]


def document_sets(docs: DataFrame) -> DataFrame:
    """Per document (kind 0) doc_id, fingerprint, size; per task (kind 1) n-grams that many of its sets hold, with their number."""

    def rows(kind: int, ids: pa.Array, values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return _batch([np.full(len(n), kind, np.int32), ids, values.view(np.int64), n.astype(np.int64)], ["kind", "doc_id", "value", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = FrequentGrams()
        for b in _slices(batches):
            values, offsets = shingle_sets(b.column(1))
            prints, sizes = fingerprints(values, offsets), np.diff(offsets)
            _, first = np.unique(prints, return_index=True)
            once = np.repeat(np.isin(np.arange(len(sizes)), first), sizes)
            often.add(*np.unique(values[once], return_counts=True))
            yield rows(0, b.column(0), prints, sizes)
        grams, n = often.frequent()
        yield rows(1, pa.nulls(len(n), pa.int64()), grams, n)

    return docs.mapInArrow(frugal(run), "kind int, doc_id bigint, value bigint, n bigint")


def _planes(values: np.ndarray) -> bytes:
    """The values byte by byte, all lowest bytes first: bytes that are nearly always zero stand together, and shuffles compress them away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _gaps(grams: np.ndarray) -> bytes:
    """Ascending n-grams, as the first one and the gaps between them."""
    return _planes(np.diff(grams, prepend=np.uint64(0)))


def _from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of each run of equal keys."""
    cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(keys)], strict=True)) if len(keys) else []


def _fragments_of_sets(docs: DataFrame, fragments: int, heavy: np.ndarray) -> DataFrame:
    """Each slice's sets, once per fingerprint, cut into the fragments of the order: f, slice, owner, grams, sizes (packed).

    A set is known by its slice and its place there, which takes two bytes an
    element however few elements of a set a fragment holds; the slice is a hash
    of its fingerprints. Heavy n-grams go to further fragments, dealt by slice,
    as their count is known. Still further ones, dealt by fingerprint, get the
    fingerprints and sizes of the slice's sets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # at most HEAVY_SHARE values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            values, offsets = shingle_sets(b.column(1))
            prints, sizes = fingerprints(values, offsets), np.diff(offsets)
            known, first = np.unique(prints, return_index=True)
            known, first = known[known != 0], first[known != 0]
            number = int(fingerprints(known, np.array([0, len(known)])).view(np.int64)[0])
            rank = np.full(len(sizes), -1)
            rank[first] = np.arange(len(first))
            owner = np.repeat(rank, sizes)
            values, owner = values[owner >= 0], owner[owner >= 0].astype(np.uint16)  # SLICE_ROWS sets at most
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            common = np.isin(values, shared.value)
            rows = []
            if common.any():
                rows.append((fragments + number % fragments, _planes(owner[common]), _gaps(values[common]), None))
                values, owner = values[~common], owner[~common]
            f = ((values >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
            rows += [(int(f[a]), _planes(owner[a:z]), _gaps(values[a:z]), None) for a, z in _runs(f)]
            dealt = known % np.uint64(fragments)
            order = np.argsort(dealt, kind="stable")
            dealt, known, sizes, owner = dealt[order], known[order], sizes[first][order].astype(np.uint32), order.astype(np.uint16)
            rows += [(2 * fragments + int(dealt[a]), _planes(owner[a:z]), known[a:z].tobytes(), sizes[a:z].tobytes()) for a, z in _runs(dealt)]
            if rows:
                f, owner, grams, sizes = zip(*rows, strict=True)
                binary = [pa.array(x, pa.binary()) for x in (owner, grams, sizes)]
                yield _batch([pa.array(f, pa.int64()), np.full(len(rows), number), *binary], ["f", "slice", "owner", "grams", "sizes"])

    return docs.mapInArrow(frugal(run), "f bigint, slice bigint, owner binary, grams binary, sizes binary")


def _frugal_groups(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    def wrapped(key: tuple, t: pa.Table) -> pa.Table:
        out = run(key, t)
        give_back()
        return out

    return wrapped


def shared_grams(cut: DataFrame, fragments: int) -> DataFrame:
    """Of each fragment, the elements whose n-gram several sets hold, with that number; dealt by slice.

    A set counts once in each different slice that holds it. The first of these
    slices, by number, also gets the set's fingerprint, its size (no other row
    has `sizes`) and, as `count`, the number of slices that hold it: an n-gram
    of a greater count is in another set too.
    """

    def holders(t: pa.Table) -> list[tuple]:
        number, owner, prints, sizes = (t.column(c).to_pylist() for c in ("slice", "owner", "grams", "sizes"))
        number = np.repeat(np.array(number, np.int64), [len(x) // 2 for x in owner])
        owner = np.concatenate([_from_planes(x, np.uint16) for x in owner])
        prints, sizes = np.frombuffer(b"".join(prints), np.uint64), np.frombuffer(b"".join(sizes), np.uint32)
        order = np.lexsort((number, prints))
        bounds = np.array(_runs(prints[order]))
        held, first = np.diff(bounds, axis=1)[:, 0].astype(np.uint32), order[bounds[:, 0]]
        order = np.argsort(number[first], kind="stable")
        held, first = held[order], first[order]
        return [(int(number[first[a]]), *(_planes(x) for x in (owner[first[a:z]], prints[first[a:z]], held[a:z], sizes[first[a:z]]))) for a, z in _runs(number[first])]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        f = key[0].as_py()
        # Slices of the same number hold the same sets, whatever became of the rows that repeat them.
        _, once = np.unique(t.column("slice").to_numpy(), return_index=True)
        t = t.take(pa.array(once))
        if f >= 2 * fragments:
            rows = holders(t)
        elif f >= fragments:
            rows = [(s, o, g, _planes(np.full(len(o) // 2, HEAVY_COUNT)), None) for s, o, g in zip(*(t.column(c).to_pylist() for c in ("slice", "owner", "grams")), strict=True)]
        else:
            number = t.column("slice").to_pylist()
            owner = [_from_planes(x, np.uint16) for x in t.column("owner").to_pylist()]
            row = np.repeat(np.arange(len(number), dtype=np.uint32), [len(x) for x in owner])
            owner, grams = np.concatenate(owner), np.concatenate([_from_gaps(x) for x in t.column("grams").to_pylist()])
            order = np.argsort(grams, kind="stable")
            ordered = grams[order]
            several = np.zeros(len(ordered), bool)
            several[1:] = ordered[1:] == ordered[:-1]
            several[:-1] |= several[1:]
            order, ordered = order[several], ordered[several]
            lengths = np.array([z - a for a, z in _runs(ordered)], np.uint32)
            count = np.repeat(lengths, lengths)
            back = np.argsort(order, kind="stable")  # rows one after the other, n-grams ascending in each
            order, count = order[back], count[back]
            row, owner, grams = row[order], owner[order], grams[order]
            rows = [(number[row[a]], _planes(owner[a:z]), _gaps(grams[a:z]), _planes(count[a:z]), None) for a, z in _runs(row)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=["slice", "owner", "grams", "count", "sizes"])

    # As many tasks as fragments: a few large ones each would be fetched and sorted at once.
    return cut.repartition(fragments, "f").groupBy("f").applyInArrow(_frugal_groups(run), "slice bigint, owner binary, grams binary, count binary, sizes binary")


def linkable_sets(shared: DataFrame, share: int) -> DataFrame:
    """fp, s, bitmap, prefix, cuts of the sets that hold enough shared n-grams to link with any other.

    Each set is taken from the first slice that holds it, and of its n-grams
    those that another set holds too. The order is rarest first, then by hash,
    heavy n-grams last; the prefix is so long that two linked sets share an
    element of their prefixes. bitmap holds the parity of n-grams by hash: two
    sets differ in at least as many elements as their bitmaps in bits. cuts are
    the shared n-grams of each fragment of the order, between two pivots.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        prints, sizes, held = np.zeros(SLICE_ROWS, np.uint64), np.zeros(SLICE_ROWS, np.uint32), np.zeros(SLICE_ROWS, np.uint32)
        owner, grams, count = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for o, g, c, s in zip(*(t.column(c).to_pylist() for c in ("owner", "grams", "count", "sizes")), strict=True):
            o, c = _from_planes(o, np.uint16), _from_planes(c, np.uint32)
            if s is None:
                owner.append(o)
                grams.append(_from_gaps(g))
                count.append(c)
            else:
                prints[o], sizes[o], held[o] = _from_planes(g, np.uint64), _from_planes(s, np.uint32), c
        owner, grams, count = (np.concatenate(x) for x in (owner, grams, count))
        mine = (sizes[owner] > 0) & (count > held[owner])
        owner, grams, count = owner[mine], grams[mine], count[mine]
        order = np.lexsort((grams, owner))
        owner, grams, count = owner[order], grams[order], count[order]
        fps, size, bitmaps, prefixes, parts = [], [], [], [], []
        for a, z in _runs(owner):
            s, k = int(sizes[owner[a]]), z - a
            least = int(_least(share, s))
            if k < least:
                continue
            mine = grams[a:z]
            rare = np.argsort(count[a:z], kind="stable")[: k - least + 1]
            bits = np.bincount((mine % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
            fragment = np.searchsorted(PIVOTS, count[a:z], "right")
            in_order = mine[np.argsort(fragment, kind="stable")]
            edges = np.append(0, np.cumsum(np.bincount(fragment, minlength=CUTS)))
            fps.append(prints[owner[a]])
            size.append(s)
            bitmaps.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            prefixes.append(mine[rare].view(np.int64))
            parts.append([in_order[edges[i] : edges[i + 1]].view(np.int64) for i in range(CUTS)])
        longs = pa.list_(pa.int64())
        return pa.table(
            [
                pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(bitmaps, longs),
                pa.array(prefixes, longs), pa.array(parts, pa.list_(longs)),
            ],
            names=["fp", "s", "bitmap", "prefix", "cuts"],
        )

    return shared.groupBy("slice").applyInArrow(_frugal_groups(run), "fp bigint, s bigint, bitmap array<bigint>, prefix array<bigint>, cuts array<array<bigint>>")


def _sizes_fit(a: str, b: str, share: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * share


def _places_fit(a: str, at: str, b: str, other: str, share: int) -> Column:
    """Whether a common n-gram at these places can be the first of enough: what follows it in either set must reach
    the overlap ceil(share * (a + b) / (100 + share)). It is true for the first common n-gram of every linked pair."""
    needed = F.ceil((F.col(a) + F.col(b)) * share / (100 + share))
    return (F.col(a) - F.col(at) >= needed) & (F.col(b) - F.col(other) >= needed)


def _marks(sets: DataFrame) -> DataFrame:
    """fp, number of shared n-grams and the words of the bitmap."""
    shared = F.aggregate("cuts", F.lit(0), lambda n, c: n + F.size(c)).cast("bigint").alias("k")
    return sets.select("fp", shared, *[F.get("bitmap", F.lit(i)).alias(f"m{i}") for i in range(BITMAP_WORDS)])


def _bitmaps_fit(a: str, ka: str, b: str, kb: str, other: str, share: int) -> Column:
    """Whether two sets can overlap enough: their shared n-grams differ in at least as many elements as their bitmaps in bits."""
    differing = sum((F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"{other}m{i}"))) for i in range(BITMAP_WORDS)), F.lit(0))
    most = F.floor((F.col(ka) + F.col(kb) - differing) / 2)
    return most * 100 >= (F.col(a) + F.col(b) - most) * share


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) with 100 * overlap >= share * union.

    Pairs whose bitmaps differ in too many bits are dropped; of the others the
    overlap in each fragment of the order is counted apart, and the partial
    counts are summed. n-grams of one document alone are in no overlap, so
    shared ones are enough.
    """
    marks = _marks(sets).join(sets.select("fp", "s"), "fp")
    left = marks.withColumnsRenamed({"fp": "a", "s": "sa", "k": "ka"})
    right = marks.withColumnsRenamed({"fp": "b", "s": "sb", "k": "kb"} | {f"m{i}": f"o_m{i}" for i in range(BITMAP_WORDS)})
    both = pairs.join(left, "a").join(right, "b").where(_sizes_fit("sa", "sb", share) & _bitmaps_fit("sa", "ka", "sb", "kb", "o_", share))
    both = both.select("a", "b", "sa", "sb")
    cuts = sets.select("fp", F.posexplode("cuts").alias("cut", "grams")).where(F.size("grams") > 0)
    counted = (
        both.join(cuts.toDF("a", "cut", "ga"), "a")
        .join(cuts.toDF("b", "cut", "gb"), ["b", "cut"])
        .groupBy("a", "b", "sa", "sb")
        .agg(F.sum(F.size(F.array_intersect("ga", "gb"))).alias("overlap"))
    )
    return counted.where(F.col("overlap") * 100 >= (F.col("sa") + F.col("sb") - F.col("overlap")) * share).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, component) with the components that the links (a, b) of their nodes join: only components are joined anew."""
    ends = links.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    least = components(ends).toDF("component", "least")
    return label.join(least, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def set_components(sets: DataFrame, share: int) -> DataFrame:
    """node, component of all linkable sets over their links.

    First each n-gram's sets are compared with one of them only (per class of
    size), which joins large groups of near copies without their pairs. Then
    every pair that shares an element of the prefixes and is not joined yet is
    compared, so no link between components is missed.
    """
    size = F.aggregate("cuts", F.lit(0), lambda n, c: n + F.size(c))
    postings = sets.select("fp", "s", (F.col("s") - size).alias("alone"), F.posexplode("prefix").alias("at", "gram"))
    postings = written(postings.select("fp", "s", (F.col("alone") + F.col("at")).alias("at"), "gram"), "postings")
    label = sets.select(F.col("fp").alias("node"), F.col("fp").alias("component"))
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            label = written(_joined(label, new), "labels")
        at = postings.join(label.withColumnRenamed("node", "fp"), "fp")
        if turn < STAR_ROUNDS:
            tier = F.floor(F.log(F.col("s").cast("double")) / F.log(F.lit(1.1)) + F.lit(0.5 * turn))
            at = at.withColumn("tier", tier)
            head = at.groupBy("gram", "tier").agg(
                F.min_by(F.struct("fp", "s", "component", "at"), F.xxhash64("fp", "gram", F.lit(turn))).alias("head"),
                F.min("component").alias("lo"), F.max("component").alias("hi"),
            )
            head = head.where("lo <> hi").select("gram", "tier", "head")
            pairs = at.join(head, ["gram", "tier"]).where(
                (F.col("component") != F.col("head.component")) & _places_fit("s", "at", "head.s", "head.at", share)
            )
            pairs = pairs.select(*_ordered("fp", "head.fp"))
        else:
            each = at.groupBy("gram", "component").count()
            most = each.groupBy("gram").agg(F.max_by("component", F.struct("count", "component")).alias("most"), F.count(F.lit(1)).alias("kinds"))
            # Only n-grams of several components are left; bitmaps tell most of their pairs apart inside the join.
            live = written(at.join(most.where("kinds > 1"), "gram").join(_marks(sets), "fp"), "live")
            minor = live.where("component <> most").drop("most", "kinds")
            others = live.drop("most", "kinds").select("gram", *[F.col(c).alias(f"o_{c}") for c in minor.columns if c != "gram"])
            pairs = minor.join(others, "gram").where(
                (F.col("component") != F.col("o_component"))
                & _places_fit("s", "at", "o_s", "o_at", share)
                & _bitmaps_fit("s", "k", "o_s", "o_k", "o_", share)
            )
            pairs = pairs.select(*_ordered("fp", "o_fp"))
        new = written(verified(pairs.distinct(), sets, share), "links")
    removed(postings, live)
    return _joined(label, new)


#: Sets of a block of a component, n-grams of a fragment within it, sets of components that are counted together.
BLOCK_SETS, BLOCK_GRAMS, TOGETHER = 1024, 4096, 256


def _linked(grams: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, share: int) -> np.ndarray:
    """Which of the sets `left` are linked with which of `right`. The n-grams in order are cut into fragments, each counts its part of all overlaps."""
    used = np.union1d(left, right)
    owner = np.repeat(used, [len(grams[k]) for k in used])
    order, column = np.unique(np.concatenate([grams[k] for k in used]), return_inverse=True)
    place = np.argsort(column, kind="stable")
    owner, column = owner[place], column[place]
    overlap = np.zeros((len(left), len(right)), np.float32)
    rows = np.empty(len(grams), np.int64)
    rows[used] = np.arange(len(used))
    for lo in range(0, len(order), BLOCK_GRAMS):
        a, z = np.searchsorted(column, [lo, lo + BLOCK_GRAMS])
        part = np.zeros((len(used), min(BLOCK_GRAMS, len(order) - lo)), np.float32)
        part[rows[owner[a:z]], column[a:z] - lo] = 1
        overlap += part[rows[left]] @ part[rows[right]].T
    return 100 * overlap >= share * (sizes[left][:, None] + sizes[right] - overlap)


def set_links(sets: DataFrame, label: DataFrame, copies: DataFrame, share: int) -> DataFrame:
    """fp, links: the documents of other sets that each set is linked with. label: fp, label; copies: fp, n (documents).

    Links never leave a component, so the sets of each are compared with each
    other: small components many at a time, large ones in pairs of blocks that
    several tasks take. Nothing is emitted for a pair.
    """
    several = label.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = label.join(several, "label").join(copies, "fp").join(sets.select("fp", "s", F.flatten("cuts").alias("grams")), "fp")
    blocks = F.ceil(F.col("m") / BLOCK_SETS).cast("int")
    tasks = F.when(F.col("m") > TOGETHER, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), F.lit(4 * shuffle_partitions(sets.sparkSession)))))
    members = members.withColumns({"task": tasks, "large": F.col("m") > TOGETHER, "block": F.pmod(F.xxhash64("fp"), blocks).cast("int"), "blocks": blocks})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = members.select("large", "task", "label", "fp", "s", "n", "grams", "block", other)
    members = members.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        label, fp, s, n, block = (t.column(c).to_numpy() for c in ("label", "fp", "s", "n", "block"))
        offsets, flat = [], []
        for chunk in t.column("grams").chunks:
            offsets += np.diff(chunk.offsets.to_numpy()).tolist()
            flat.append(chunk.flatten().to_numpy())
        grams = np.split(np.concatenate(flat), np.cumsum(offsets)[:-1])
        links = np.zeros(len(fp), np.int64)
        order = np.argsort(label, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            left, right = mine[block[mine] == low], mine[block[mine] == high]
            if not len(left) or not len(right):
                continue
            linked = _linked(grams, s, left, right, share)
            if low == high:
                np.fill_diagonal(linked, False)
            links[left] += linked @ n[right]
            if low != high:
                links[right] += n[left] @ linked
        return pa.table([t.column("fp"), pa.array(links)], names=["fp", "links"])

    found = members.groupBy("large", "task", "low", "high").applyInArrow(_frugal_groups(run), "fp bigint, links bigint")
    return found.groupBy("fp").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, share: int = 80, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: links where 100 * intersection >= share * union; with links, also n_links, the rows linked with it.

    component_id is the smallest doc_id that links reach; documents without
    words, and null texts, link with nothing. Rows that repeat a
    doc_id are linked by their own texts; a row with a null doc_id has the
    component of the documents linked with it, or null. Sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id="bigint", text="string")
    found = written(document_sets(rows), "sets")
    each = found.where("kind = 0").select("doc_id", F.col("value").alias("fp"), F.col("n").alias("n_shingles"))
    total = each.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(shuffle_partitions(spark), -(-total // FRAGMENT_GRAMS))
    heavy = found.where("kind = 1").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") * HEAVY_SHARE >= total)
    heavy = np.sort(np.array([r.value for r in heavy.select("value").collect()], np.int64).view(np.uint64))  # at most HEAVY_SHARE
    cut = _fragments_of_sets(rows, fragments, heavy)
    sets = written(linkable_sets(shared_grams(cut, fragments), share), "linkable")
    label = set_components(sets, share).toDF("fp", "label")
    classes = each.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    counted = []
    if links:
        label = written(label, "labels-of-sets")
        found = set_links(sets, label, classes.select("fp", "n"), share)
        classes = classes.join(found, "fp", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("links", F.lit(0)))
        counted = [F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")]
    classes = classes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = classes.groupBy("label").agg(F.min("first").alias("name"))
    classes = classes.join(names, "label").drop("label", "first", "n", "links")
    out = each.join(classes, "fp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"), *counted)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), links=True)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w
), n AS (SELECT doc_id, len(grams)::BIGINT AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS hits FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * hits >= 80 * (na.n + nb.n - hits)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.seen) AS component_id, (SELECT count(*) FROM e WHERE e.a = n.doc_id) AS n_links FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL
"""
