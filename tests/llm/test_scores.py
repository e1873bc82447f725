"""Quality, hard negatives and resampling against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pneuma.llm import negatives, quality, resample

# ---- quality


def brute_indicators(text):
    raw, text = (text or "").encode(), re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    same = tuple(a == b for a, b in zip(words, words[1:], strict=False))
    grams = {("b", raw[i : i + k]) for k in (1, 2, 3) for i in range(len(raw) - k + 1)}
    grams |= {("w", w) for w in words} | {("p", p) for p in zip(words, words[1:], strict=False)}
    return grams, {same[i : i + 4] for i in range(len(same) - 3)}


def test_indicators_are_the_distinct_grams_of_whole_texts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "B", "b", "ché", "###", "x|y"], k=n)) for n in (1, 2, 4, 5, 30, 200)] + ["", None, " ", "x"]
    whole = list(quality.indicators(pa.array(texts)))
    for t, found in zip(texts, whole, strict=True):
        grams, patterns = brute_indicators(t)
        # Hashing may join a few grams, never part one.
        assert len(patterns) + 0.98 * len(grams) - 1 <= len(found) <= len(patterns) + len(grams)
        assert {sum(1 << k for k, x in enumerate(p) if x) for p in patterns} == set(found[found < quality.PATTERNS].tolist())
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, quality.indicators(pa.array(texts)), strict=True))
    assert len(whole[-3]) == len(whole[-4]) == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(np.append(rng.integers(0, 40, 8), 50 + (y if rng.random() < 0.8 else 1 - y))) for y in [0] * 30 + [1] * 50]
    labels = np.array([0] * 30 + [1] * 50)
    model = quality.SupportVectors(rows, labels, (30, 50))
    w = model.weights

    def loss(w, bias):
        m = np.array([w[r] @ model._scaled(r) + bias for r in rows])
        cost = quality.COST * len(rows) / (2 * np.array([30, 50]))[labels]
        return 0.5 * (w @ w + bias**2) + (cost * np.maximum(0, 1 - np.where(labels == 1, 1, -1) * m)).sum()

    at = np.flatnonzero(w)
    plain = np.zeros_like(w)
    size = np.abs(w[at]).sum() / quality.FEATURES  # the drawn weights are share * w + (1 - share) * mean size * sign
    mean = size / (quality.SHARE + (1 - quality.SHARE) * len(at) / quality.FEATURES)
    plain[at] = (w[at] - (1 - quality.SHARE) * mean * np.sign(w[at])) / quality.SHARE
    best = loss(plain, model.bias)
    for _ in range(200):
        other = plain.copy()
        other[at] += rng.normal(0, 0.02, len(at))
        assert loss(other, model.bias + rng.normal(0, 0.02)) >= best - 1e-3 * best
    # Ratios are the logs of the smoothed shares.
    counts = [Counter(g for r, y in zip(rows, labels, strict=True) if y == c for g in r.tolist()) for c in (0, 1)]
    share = [[(c[g] + 1) / (sum(c.values()) + quality.FEATURES) for g in (50, 51)] for c in counts]
    assert np.allclose(model.ratio[50:52], np.log(share[1]) - np.log(share[0]))


def test_quality_on_held_out_documents(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        good = i % 6 != 0
        text = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        docs.append((i, " ".join(text if good else [f"{w}{rng.choice(['###', '%%%'])}" if rng.random() < 0.5 else w for w in text])))
        labels.append((i, int(good), 0))
    docs += [(700, None), (None, ""), (701, "x " * 200_000), (1, docs[1][1])]
    labels += [(700, 1, 0), (None, 0, 0), (2, None, 0), (3, 7, 1)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", F.lit("z").alias("SCORE"), F.lit(1).alias("Doc_Id.x"))
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.quality_scores(docs, model).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([(r.score >= quality.THRESHOLD) == (r.doc_id % 6 != 0) for r in held]) > 0.97
    empty = {r.score for r in rows if r.doc_id in (700, None)}
    assert len(empty) == 1
    # A smaller sample is bounded and still learns; no labels or one class give the labels' share.
    small = quality.quality_scores(docs, quality.fit(docs, labels, rows=60)).collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 6 != 0) for r in small if r.doc_id is not None and r.doc_id < 600]) > 0.9
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, quality.fit(docs, labels, rows=60, features=3_000)).collect())
    for some, share in ((labels.limit(0), 0.5), (labels.where("quality = 1 and doc_id in (1, 7)"), None)):
        scores = {r.score for r in quality.quality_scores(docs.limit(3), quality.fit(docs, some)).collect()}
        assert len(scores) == 1 and (share is None or scores == {share})
    assert quality.quality_scores(docs.limit(0), model).count() == 0


# ---- hard negatives


def brute_negatives(rows, k=5):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, label, v in {(i, lab, tuple(v)) for i, lab, v in rows if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i, lab) for i, lab, w in rows if i != own and len(w) == len(v))
        for p, pid in [(-s, i) for s, i, lab in scored if lab == label][:k]:
            found = [(-s, i) for s, i, lab in scored if lab != label and 80 * p <= -100 * s <= 100 * p][:k]
            out += [(own, pid, r + 1, i, p, s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 1000])
def test_hard_negatives_equal_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(i, [rng.choice([0.5, 0.25, -0.1, rng.random()]) for _ in range(3)], rng.choice([0, 0, 0, 1, 1 << 40, -5])) for i in range(0, 520, 4)]
    rows += [(200, rows[3][1], 0), (204, rows[51][1], rows[51][2]), (900, None, 1), (904, [0.1, None, 0.3], 1), (908, [0.1, float("nan"), 0.3], 0), (None, [0.1] * 3, 0), (912, [0.5] * 3, None)]
    rows += [(1000, [0.5, 0.5], 0), (1004, [0.5, 0.5], 0), (1008, [0.5, 0.4], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint").select("*", F.lit(1).alias("V"), F.lit(2).alias("LABEL"))
    table = negatives.labelled_vectors(df)
    found = negatives.hard_negatives(table, table.where("vec_id % 100 = 0"), block_rows=block, block_anchors=2 if block == 7 else 100)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    none = negatives.labelled_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"))
    assert negatives.hard_negatives(none, none).count() == 0
    one = negatives.labelled_vectors(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id bigint, embedding array<double>, label int"))
    assert negatives.hard_negatives(one, one.where("vec_id = 0")).count() == 0


# ---- resampling


def brute_resample(docs, target, n, least=20, percent=10):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def bucket(g):
        return zlib.crc32(g.encode()) % 10_000

    s, t = (Counter(bucket(g) for x in texts for g in grams(x)[1]) for texts in ([d[1] for d in docs], target))
    S, T = s.total(), t.total()
    out = []
    for doc_id, text in docs:
        w, found = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((len(w), doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        drawn.setdefault(r, []).append(k + 1)
    rows = []
    for r in out:
        rows.append((r[1], *r[2:], drawn[r].pop(0) if drawn.get(r) else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("n, often", [(1, 400_000), (1, 3), (2, 50)])
def test_resample_equals_brute_force(spark, monkeypatch, n, often):
    monkeypatch.setattr(resample, "FREQUENT", often)
    monkeypatch.setattr(resample, "HELD", 50)
    monkeypatch.setattr(resample, "ROWS", 40)
    rng = random.Random(n)
    pool = ["the", "The", "über", "x1", "d-e", "ñ" * 60, "y" * 90, "\U0001f600z"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(pool, weights=[40] * 8 + [1] * 60, k=rng.choice([3, 19, 20, 30, 60])))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "#!?"), (None, docs[3][1]), (7, docs[8][1]), *[(9, docs[9][1])] * 40, (503, "a " * 30_000)]
    target = [" ".join(rng.choices(pool[:40], k=25)) for _ in range(20)] + [None, "only here"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).select("*", F.lit(0).alias("Key"), F.lit(0).alias("TEXT"))
    found = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_resample(docs, target, n)


def test_resample_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = docs.limit(0)
    assert resample.resample(none, docs).count() == 0
    row = resample.resample(docs, none).collect()[0]
    assert row.n_features == 2 and row["rank"] is None and row.weight == 2 * math.floor(1000 * math.log(10_002 / (2 * 10_000)))
