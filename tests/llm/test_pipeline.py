"""The pipeline's stages on a small table against their rules."""

import random
import re
import zlib

import corpus_pipeline as pipeline
from pneuma.llm import langid, tokenize
from pneuma.llm.frames import written


def test_stages(spark, tmp_path):
    base = "the cat sat on the mat and then the dog ran over the hill to find a bone in the garden"
    rows = [(i, f"{base} number {i}" if i > 2 else base, "en", "s", 10) for i in range(6)]
    rows += [(10 + i, f"der hund und die katze nummer {i} sind in der küche und {i} essen brot mit käse heute abend {i}", "de", "s", 10) for i in range(5)]
    rows += [(20, "write to me at a.b@c.de or +1 (456) 555-2186 today, the cat and the dog wait for it", None, "s", 10), (21, None, "en", "s", 0), (22, "123 456", "en", "s", 7), (None, "the dog has no number at all in this garden", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = written(pipeline.language(spark, docs, ""), "t")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {21, 22}
    unique = written(pipeline.near_duplicates(spark, kept, ""), "t")
    assert unique.columns == docs.columns
    ids = {r.doc_id for r in unique.collect()}
    assert {0, 10, 20, None} <= ids and not {1, 2} & ids
    clean = written(pipeline.personal_data(spark, unique, ""), "t")
    texts = {r.doc_id: r for r in clean.collect()}
    assert set(texts) == ids
    assert texts[20].text == "write to me at [EMAIL] or [PHONE] today, the cat and the dog wait for it" and texts[20].n_chars == len(texts[20].text)
    assert texts[0].text == base and not any(re.search("@", r.text) for r in texts.values())
    packed = pipeline.packing(spark, clean, "").collect()
    encode = tokenize.library_encoder(tokenize.vocabulary_path(tokenize.WORD_BPE))
    assert sum(r.length for r in packed) == sum(len(encode(r.text)) // 4 + 1 for r in texts.values())


def test_near_duplicates_go_by_row(spark):
    words = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    rows = [
        (1, words["a"]), (5, words["a"] + " more"), (5, words["b"]),  # one of two texts of a doc_id links to a smaller one
        (7, words["c"]), (7, words["c"] + " more"),  # near copies that share a doc_id
        (9, words["d"]), (None, words["d"] + " more"),  # a near copy without an id
        (None, words["e"]), (None, words["e"]), (10, None), (11, None), (3, words["b"] + " 1 2"), (4, ""), (4, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("text", "doc_id", "'en' as lang")
    kept = pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    seven = [r for r in found if r[0] == 7]
    assert len(seven) == 1
    want = [(1, words["a"]), (9, words["d"]), (None, words["e"]), (10, None), (11, None), (3, words["b"] + " 1 2"), (4, "")]
    assert found == sorted([*want, *seven], key=str)


def test_a_clean_text_stays_when_its_doc_id_repeats(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    docs = spark.createDataFrame([(1, a), (5, a + " more"), (5, b)], "doc_id bigint, text string")
    assert {(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()} == {(1, a), (5, b)}


def test_stages_keep_columns_whatever_their_names(spark):
    a, b = ("the cat sat on the mat and " + " ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(1, a, "en", "x", 1.0, 10, "n", "N", 3), (2, a + " more", "en", "y", 2.0, 20, "m", "M", 4), (3, b + " me@mail.example.com", "en", "z", 3.0, 30, "k", "K", 5), (4, None, "en", "w", 4.0, 40, "j", "J", 6)]
    names = ["doc_id", "text", "lang", "lang_pred", "score", "_row", "a.b", "A.B", "row"]
    docs = spark.createDataFrame(rows, "c0 bigint, c1 string, c2 string, c3 string, c4 double, c5 bigint, c6 string, c7 string, c8 bigint").toDF(*names)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == names, name
        # Written with names by place, as Parquet refuses names that differ by case alone.
        docs = written(docs.toDF(*[f"c{i}" for i in range(9)]), name).toDF(*names)
    found = {r[0]: tuple(r) for r in docs.collect()}
    assert set(found) == {1, 3} and found[1] == rows[0]
    assert found[3] == (3, b + " [EMAIL]", *rows[2][2:])
    assert {r.doc_id for r in pipeline.packing(spark, docs, "").collect()} == {1, 3}


def test_run_equals_brute_force(spark, tmp_path):
    """The whole run on a table of 200 rows against plain rules, but for the language, whose models only tell texts with letters."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=rng.randint(1, 90)))
        rows.append((i, text + (f" mail{i}@host.example.org" if i % 9 == 0 else ""), "en", "s", len(text)))
    for i in range(60):
        w = rows[rng.randrange(120)][1].split()
        w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((200 + i, " ".join(w), "en", "s", 1))
    rows += [(400 + i, t, "en", "s", 0) for i, t in enumerate([None, "", "12 34", "+1 (456) 555-2186 call " * 900])] + [rows[5], rows[6], (None, "no id " + rows[7][1], "en", "s", 1)]
    folder = tmp_path / "data"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{folder}/documents.parquet")
    found = pipeline.run(spark, f"file://{folder}").collect()

    left = sorted({r for r in rows if re.search("[a-z]", r[1] or "")}, key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for r in left:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1].lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    kept = {left[i][0]: left[i][1] for i in range(len(left)) if label[i] == i}
    encode = tokenize.library_encoder(tokenize.vocabulary_path(tokenize.WORD_BPE))
    want = {}
    for i, t in kept.items():
        t = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t)
        t = re.sub(r"\+1 \(456\) 555-2186", "[PHONE]", t)
        want[i] = encode(t) + b"\0\0\0\0"
    pieces = {(r.doc_id, r.piece): r for r in found}
    assert len(pieces) == len(found) and {r.doc_id for r in found} == set(want)
    for i, ids in want.items():
        parts = [ids[at : at + 8192] for at in range(0, len(ids), 8192)]
        assert [(pieces[i, k].start, pieces[i, k].length, pieces[i, k].ids_crc32) for k in range(len(parts))] == [(2048 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)]
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and all(0 < r.length <= 2048 for r in rows)
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "packing"] and langid.UNKNOWN == "und"
