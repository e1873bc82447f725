"""Each operator against brute force on small tables with nulls, ties, repeats, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pneuma.llm import chat, components, forest, langid, mtree, ngram_join, warc
from pneuma.llm.frames import shared_dir

WORDS = [f"w{i}" for i in range(300)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard_texts(seed):
    rng = random.Random(seed)
    texts = []
    passage = rng.choices(WORDS, k=60)
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.randint(20, 120))
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + rng.choices(WORDS, k=rng.randint(1, 25))) for _ in range(25)]
    texts += ["A b c", "a  B\tc", "", None, " \n ", "one", "One", "é é é é é é"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, seed):
    if seed == 2:  # components in pairs of blocks, overlaps over many fragments
        for name, value in (("BLOCK_SETS", 3), ("BLOCK_GRAMS", 16), ("TOGETHER", 2)):
            monkeypatch.setattr(ngram_join, name, value)
    texts = jaccard_texts(seed)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = groups(len(sets), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("*", F.lit(1).alias("TEXT"))
    found = {r.doc_id: r for r in ngram_join.jaccard_components(docs, links=True).collect()}
    assert [found[i].n_links for i in range(len(sets))] == [sum(i in p for p in links) for i in range(len(sets))]
    assert [found[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert [found[i].component_id for i in range(len(sets))] == want


def test_frequent_grams_are_known_whatever_their_slices():
    rng = np.random.default_rng(8)
    often = ngram_join.FrequentGrams()
    total: dict[int, int] = {}
    for k in range(60):  # one n-gram in 0.7 % of some 30,000 documents, a few of a slice; all others once or twice
        g, n = np.unique(np.append(rng.integers(0, 1 << 62, 30_000).astype(np.uint64), np.repeat(np.array([7, 9], np.uint64), [4, 1])), return_counts=True)
        often.add(g, n)
        assert len(often.grams) < 2 * ngram_join.FORGET + 40_000
        for x in (7, 9):
            total[x] = total.get(x, 0) + int(n[np.searchsorted(g, x)])
    grams, n = often.frequent()
    found = dict(zip(grams.tolist(), n.tolist(), strict=True))
    assert total[7] == 240 and 240 - often.elements // ngram_join.FORGET - 1 <= found[7] <= 240 and 9 in found and len(found) < 10


def test_an_ngram_of_a_few_in_each_slice_is_heavy(spark, monkeypatch):
    """In 0.7 % of the documents, below a dozen of a slice: it is dealt by document, and the components stay right."""
    monkeypatch.setattr(ngram_join, "HEAVY_SHARE", 2_000)
    monkeypatch.setattr(ngram_join, "FORGET", 8_000)
    heavy = []
    monkeypatch.setattr(ngram_join, "_fragments_of_sets", lambda docs, n, found, plain=ngram_join._fragments_of_sets: heavy.append(found) or plain(docs, n, found))
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=8)) + (" common words of seven percent ever" if i % 143 == 0 else "") for i in range(4_000)] + ["a b c d e f g", "a b c d e f g"]
    found = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), links=True)
    rows = {r.doc_id: (r.component_id, r.n_links) for r in found.collect()}
    assert len(heavy[0]) >= 2 and rows[4_000] == rows[4_001] == (4_000, 1) and sum(c != i for i, (c, _) in rows.items()) == 1


def test_jaccard_components_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone"), (3, "A B c d e f")], "doc_id bigint, text string")
    rows = sorted(((str(r.doc_id), r.component_id) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    assert rows == [("1", 1), ("1", 1), ("3", 1), ("None", 1), ("None", None)]
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)] + [(200, 201), (201, 200)]
    rows = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    found = {r.node: r.component for r in rows}
    assert len(rows) == len(found) and all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30)) and found[201] == 200
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars around the smallest node already are written once: no round confirms them."""
    tags = []
    monkeypatch.setattr(components, "written", lambda df, tag, plain=components.written: tags.append(tag) or plain(df, tag))
    edges = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, 21)], "a bigint, b bigint")
    assert sorted(map(tuple, components.components(edges).collect())) == [(i, 1) for i in range(1, 9)] + [(20, 20), (21, 20)]
    assert tags == ["edges"]


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_EDGES", 5)
    monkeypatch.setattr(components, "HUB_SHARE", 20)
    edges = [(50, i) for i in range(60, 160)] + [(i, i + 1) for i in range(0, 30)] + [(30, 50)] + [(500, 400), (500, 401)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {c for i, c in found.items() if i < 200} == {0} and len(found) == 31 + 101 + 3 and found[401] == found[500] == 400


def test_fragments_are_dealt_to_as_many_tasks(spark):
    """One task of a few partitions held many fragments at once."""
    cut = ngram_join._fragments_of_sets(spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string"), 40, np.zeros(0, np.uint64))
    assert ngram_join.shared_grams(cut, 40).rdd.getNumPartitions() == 40


def test_an_element_of_a_fragment_takes_few_bytes(spark):
    """With the set's fingerprint and size in each fragment that holds a part of it, one took more than 12."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.randrange(1 << 30)}" for _ in range(404))) for i in range(300)], "doc_id bigint, text string").coalesce(1)
    rows = ngram_join._fragments_of_sets(docs, 150, np.zeros(0, np.uint64)).collect()
    packed = sum(len(pa.Codec("lz4_raw").compress(b"".join(bytes(x) for x in r if isinstance(x, (bytes, bytearray))))) for r in rows)
    assert packed < 9 * 300 * 400


def test_sets_held_by_several_slices(spark):
    """Copies in other slices, and slices that repeat whole, are one set: they neither link anew nor make an n-gram shared."""
    rng = random.Random(9)
    texts = jaccard_texts(3)[:70]
    assert len(texts) == 70
    texts += [" ".join(rng.choices(WORDS, k=40)) for _ in range(10)]  # linked with their copies only
    texts += texts[:] + rng.sample(texts, 60)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want, degree = groups(len(sets), links), np.bincount(np.array(links).ravel(), minlength=len(sets)).tolist()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    cut = ngram_join._fragments_of_sets
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, 10)
    try:
        assert cut(docs, 4, np.zeros(0, np.uint64)).select("slice").distinct().count() == 14
        found = {r.doc_id: r for r in ngram_join.jaccard_components(docs, links=True).collect()}
        linkable = {r.fp for r in ngram_join.linkable_sets(ngram_join.shared_grams(cut(docs, 4, np.zeros(0, np.uint64)), 4), 80).collect()}
    finally:
        spark.conf.set(size, old)
    assert [(found[i].component_id, found[i].n_links, found[i].n_shingles) for i in range(len(sets))] == [(c, d, len(s)) for c, d, s in zip(want, degree, sets, strict=True)]
    alone = {frozenset(s) for s in sets[70:80]}
    assert len(linkable) <= len({frozenset(s) for s in sets}) - len(alone)


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "<|/|>\n<|+|> \\e \\l [INST] a|b"), (1, 1, "user", ""), (1, 2, "assistant", "<|user|>\nx"), (1, 3, "assistant", None), (1, 3, "assistant", "é|>\n"),
        (2, None, None, "late"), (None, 0, "assistant", "no id"), (3, 0, "we|>ird\\role<", "\\"), (3, 0, "we|>ird\\role<", "\\"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit(0).alias("ROLE"))
    found = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    said = lambda c: sorted([(t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c])
    for c in (1, 2, 3, None):
        assert [tuple(t) for t in found[c].turns] == [(r, x) for _, r, x in said(c)]
        assert found[c].loss_text == "".join(x for _, r, x in said(c) if r == "assistant")
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_warc_ranges_own_each_record_once(spark):
    pages = [(i, f"http://x/{i}", random.Random(i).choice(["same", "", "ü" * 50, f"page {i} " * (i % 40)])) for i in range(60)]
    pages += [(60, None, None), (None, "u", "same"), (61, "a\r\nb", "\x1f\x8b\x08 no member"), (7, "http://x/7", pages[7][2])]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").select("*", F.lit(1).alias("URL"))
    files = warc.write_warc(table, shared_dir(spark, "w")).collect()
    listed = spark.createDataFrame([tuple(f) for f in files], warc.FILES_SCHEMA)
    texts = [(i, t or "") for i, _, t in pages]
    first = {}
    for i, t in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    want = sorted(
        (str(i), len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "response" if i == first.get(t, i) else "revisit", None if i == first.get(t, i) else first[t])
        for i, t in texts
    )
    for split in (64, 1000, 1 << 20):
        rows = warc.read_warc(spark, listed, split).withColumns({"p": warc.page_number("record_id"), "q": warc.page_number("refers_to")}).collect()
        assert sorted((str(r.p), r.payload_bytes, r.payload_digest, r.record_type, r.q) for r in rows) == want
        assert all(bytes(r.payload).decode() == dict(texts)[r.p] for r in rows if r.record_type == "response" and r.p is not None)
    data = b"".join(gzip.decompress(open(f.path.removeprefix("file://"), "rb").read()) for f in files)
    assert data.count(b"WARC/1.1\r\n") == len(pages)
    assert warc.write_warc(table.limit(0), shared_dir(spark, "w")).count() == 0


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(40):
        base = rng.standard_normal(8)
        rows += [(base + 0.25 * rng.standard_normal(8)).tolist() for _ in range(rng.integers(1, 6))]
    rows += [rows[3], rows[3], [2 * x for x in rows[5]], [0.0] * 8, None, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], []]
    return rows


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_forest_equals_brute_force(spark):
    rows = vectors(1)
    table = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, Embedding string")
    ok = [i for i, v in enumerate(rows) if usable(v) and any(v)]
    unit = {i: np.array(rows[i]) / np.linalg.norm(rows[i]) for i in ok}
    links = [(i, j) for i in ok for j in ok if j < i and len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= 0.9]
    want = groups(len(rows), links)
    found = {r.vec_id: r for r in forest.near_duplicates(table).collect()}
    assert [found[i].component_id for i in range(len(rows))] == want
    assert [found[i].n_links for i in range(len(rows))] == [sum(i in p for p in links) for i in range(len(rows))]
    assert all(found[i].kept == (want[i] == i) for i in found)
    assert forest.near_duplicates(table.limit(0)).count() == 0
    extra = table.union(spark.createDataFrame([(None, rows[0], "x")], table.schema))
    assert forest.near_duplicates(extra).where("vec_id is null").first().n_links == 0


def test_forest_recall_with_several_leaves(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((900, 32))
    x = np.vstack([base + 0.12 * rng.standard_normal(base.shape) for _ in range(3)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(axis=1) - 1
    rows = forest.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).orderBy("vec_id").collect()
    got = np.array([r.n_links for r in rows])
    assert (got <= near).all() and got.sum() >= 0.9 * near.sum()


def dense_vectors(n, group, dim, seed):
    """Unit vectors: one group of distinct near copies (cosine about 0.94), pairs of near copies, the rest random."""
    rng = np.random.default_rng(seed)
    center = rng.standard_normal(dim)
    center /= np.linalg.norm(center)
    rest = rng.standard_normal(((n - group) // 2, dim))
    x = np.vstack([center + np.sqrt(0.06 / dim) * rng.standard_normal((group, dim)), rest, rest + 0.25 * rng.standard_normal(rest.shape)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found_vectors(spark, x):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = forest.near_duplicates(table).orderBy("vec_id").collect()
    return np.array([r.n_links for r in rows]), np.array([r.component_id for r in rows])


def test_forest_recall_with_a_dense_group(spark):
    x = dense_vectors(10_000, 3_334, 64, 3)
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    got, component = found_vectors(spark, x)
    assert (got <= near).all() and got.sum() >= 0.99 * near.sum()
    assert len(set(component[:3_334])) == 1


def test_forest_leaves_a_dense_group_whole():
    x = dense_vectors(40_000, 2_000, 64, 4)
    grown = forest.Forest(x[np.random.default_rng(5).permutation(len(x))[:20_000]], len(x))
    assert len(grown.trees) >= 6
    rng = np.random.default_rng(6)
    i, j = rng.integers(0, 2_000, 3_000), rng.integers(0, 2_000, 3_000)
    i, j = i[(x[i] * x[j]).sum(axis=1) >= 0.9], j[(x[i] * x[j]).sum(axis=1) >= 0.9]
    assert np.logical_or.reduce([grown._meet(t, x[i], x[j]) for t in grown.trees]).mean() >= 0.98


def test_forest_counts_the_links_it_unites_when_leaves_are_large(spark, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLE_VECTORS", 40)
    x = dense_vectors(12_000, 0, 64, 7)
    got, component = found_vectors(spark, x)
    assert (got == np.bincount(component, minlength=len(x))[component] - 1).all()


def test_forest_blocks_of_leaves_count_each_link_once(spark, monkeypatch):
    x = dense_vectors(8_000, 400, 32, 8)
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    whole, component = found_vectors(spark, x)
    monkeypatch.setattr(forest, "BLOCK", 100)
    parts = []
    monkeypatch.setattr(forest, "_placed", lambda classes, forests, p, plain=forest._placed: parts.append(p) or plain(classes, forests, p))
    got, again = found_vectors(spark, x)
    assert sum(k > 1 for k in parts[0].values()) > 6
    assert (got == whole).all() and (again == component).all() and (got <= near).all() and got.sum() >= 0.98 * near.sum()


def test_forest_finds_the_links_of_the_given_vectors_by_several_trees(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(axis=1) - 1
    grown = []
    plain = forest.Forest.__init__
    try:
        forest.Forest.__init__ = lambda self, *a, **k: plain(self, *a, **k) or grown.append(self)
        got = np.array([r.n_links for r in forest.near_duplicates(rows).orderBy("vec_id").collect()])
    finally:
        forest.Forest.__init__ = plain
    assert len(grown) == 1 and len(grown[0].trees) >= 6 and grown[0].leaves >= 4 * len(grown[0].trees)
    assert (got <= near).all() and got.sum() >= 0.98 * near.sum()


def test_forest_copies_a_vector_hardly_more_than_its_leaves(spark, monkeypatch):
    """A hundred vectors for each sampled one, with the real bounds on leaves and blocks."""
    monkeypatch.setattr(forest, "SAMPLE_VECTORS", 500)
    copies = []
    monkeypatch.setattr(forest, "_compare", lambda placed, cosine, plain=forest._compare: copies.append(placed.select("dim", "leaf", "low", "high", "rep", F.size("homes").alias("n"))) or plain(placed, cosine))
    x = np.random.default_rng(12).standard_normal((50_000, 16))
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}))
    forest.near_duplicates(table)
    each = copies[0].groupBy("rep").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("leaves"))
    r = each.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("copies") / F.col("leaves")).alias("most"), F.avg("leaves").alias("leaves")).first()
    assert r.n == len(x) and r.leaves >= 6 and r.most < 2


def test_forest_dense_blocks_equal_plain_pairs():
    rng = np.random.default_rng(9)
    for share in (0.02, 0.5, 1.0):
        links = rng.random((300, 200)) < share
        links[100:, :90] = links[:100, 90:] = False
        i, j = forest.spanning(links)
        assert links[i, j].all()
        pairs = np.nonzero(links)
        assert (forest.roots(500, [(i, 300 + j)]) == forest.roots(500, [(pairs[0], 300 + pairs[1])])).all()
        homes = np.sort(rng.integers(-1, 40, (500, 3)), axis=1).astype(np.int32)
        rows, columns = np.arange(300), 300 + np.arange(200)
        new = forest.unmet(homes, rows, columns, links, 20)
        want = forest.first_met(homes, pairs[0], 300 + pairs[1], 20)
        assert (new[pairs] == want).all() and new.sum() == want.sum()


def test_top_k_equals_brute_force(spark):
    rows = vectors(3)
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)] + [(None, rows[0], 0)], "vec_id bigint, embedding array<double>, VEC_ID int")
    found = {}
    for r in mtree.top_k(table, table, 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = [i for i, v in enumerate(rows) if usable(v)]
    q = {i: np.floor(64 * np.array(rows[i], float)).astype(int) for i in ok}
    for i in ok:
        scores = sorted((-int(q[i] @ q[j]), j) for j in ok if j != i and len(q[j]) == len(q[i]))[:5]
        assert sorted(found.get(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert mtree.top_k(table.limit(0), table.limit(0), 5).count() == 0


def test_top_k_over_many_blocks_with_ties_and_repeats(spark):
    rng = np.random.default_rng(14)
    x = np.floor(rng.standard_normal((700, 5)) * 2) / 64
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i].tolist()) for i in range(5)] + [(9_000 + i, [1.0, 2.0]) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = table.where("vec_id % 20 = 0")
    found = {}
    for r in mtree.top_k(table, queries, 7, 64, 9).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    for own, a in q:
        if own % 20 == 0:
            scores = sorted((-int(a @ b), i) for i, b in q if i != own and len(a) == len(b))[:7]
            assert sorted(found[own]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_m_tree_pages_skip_and_keep_ties():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.integers(-20, 20, (1500, 6)), np.tile([3, 1, 4, 1, 5, 9], (700, 1))]).astype(float)
    tree = mtree.MTree(x, np.arange(len(x)))
    assert len(tree.pages) > 5
    for i in (0, 7, 1600, 2199):
        scores, ids = tree.search(x[i], i, 9)
        want = sorted((-(x[i] @ x[j]), j) for j in range(len(x)) if j != i)[:9]
        assert [(-s, j) for s, j in zip(scores, ids, strict=True)] == want


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.op7_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, "the cat sat on the mat and the dog ran", "en", "x") for i in range(8)] + [(10 + i, "der hund und die katze sind in der küche", "de", "x") for i in range(8)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "12 34 !?", "de", "x"), (103, "und der hund", None, "x"), (None, "the dog", "en", "x"), (104, "the cat " * 30_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, Lang string")
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [found[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and found[100].score == 0
    assert found[103].lang_pred == "de" and found[104].lang_pred == "en" and found[None].lang_pred == "en"
    wide = langid.with_language(docs, model)
    assert wide.columns == [*docs.columns, "lang_pred", "score"] and wide.count() == len(rows)
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_suffix_automaton_phrases_equal_brute_force():
    rng = np.random.default_rng(6)
    train = rng.integers(0, 4, 60).astype(np.uint8)
    automaton = langid.SuffixAutomaton(train, 6)
    known = {tuple(train[i:j]) for i in range(60) for j in range(i + 1, 61)}
    text = rng.integers(0, 5, 200).astype(np.uint8)
    want, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and tuple(text[at : at + n + 1]) in known:
            n += 1
        at, want = at + n, want + 1
    rows = np.zeros((2, 256), np.uint8)
    rows[0, :200] = text
    assert automaton.phrases(rows, np.array([200, 0])).tolist() == [want, 0]


def scripts_of_words(seed):
    """Eight languages in eight scripts: random words from 300 of each; Chinese has 1,500 letters."""
    rng = random.Random(seed)
    alphabets = {
        "en": "abcdefghijklmnopqrstuvwxyz", "el": "αβγδεζηθικλμνξοπρστυφχψω", "he": "אבגדהוזחטיכלמנסעפצקרשת", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
        "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 1500))), "hi": "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "ka": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    }
    words = {k: ["".join(rng.choices(a, k=rng.randint(2, 7))) for _ in range(300)] for k, a in alphabets.items()}
    return [(8 * i + j, " ".join(rng.choices(words[k], k=rng.randint(3, 60))), k) for i in range(40) for j, k in enumerate(words)]


def test_languages_of_eight_scripts(spark):
    docs = spark.createDataFrame(scripts_of_words(1), "doc_id bigint, text string, lang string")
    rows = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    right = {k: [r.lang_pred == k for r in rows if r.lang == k] for k in {r.lang for r in rows}}
    assert len(right) == 8 and all(sum(v) >= 0.9 * len(v) for v in right.values()), right


def test_every_language_is_learned(spark):
    rng = random.Random(2)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(12)] for k in range(90)}
    docs = spark.createDataFrame([(90 * i + j, " ".join(rng.choices(w, k=30)), k) for i in range(8) for j, (k, w) in enumerate(words.items())], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert model.names == sorted(words)
    texts = [" ".join(rng.choices(w, k=20)) for w in words.values()]
    assert sum(a == b for a, b in zip(langid.predict(model, texts)[0], words, strict=True)) >= 85


def test_ties_go_to_the_first_language_by_name():
    model = langid.Model({"b": ["one two three"], "a": ["one two three"]})
    assert langid.predict(model, ["one two", "zzz"])[0] == ["a", "a"]


def test_letters_of_two_symbols_are_told_apart():
    counts = np.concatenate([[0], np.arange(500, 0, -1), [0]])
    alphabet = langid.Alphabet(counts)
    coded = alphabet(np.arange(1, 501))
    single = sum(alphabet.second[1:501] == 0)
    assert alphabet.double and len(coded) == 1000 - single and coded.max() < alphabet.width - 1
    assert len({(alphabet.first[k], alphabet.second[k]) for k in range(1, 501)}) == 500
    assert alphabet.first[501] == alphabet.width - 1
