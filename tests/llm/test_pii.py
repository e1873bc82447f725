import re

import pytest

from pneuma.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii._luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    "", "a@b@c.d e.f@g.h.i.", "x@y", "@@a.b@c.de@f.gh", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004", "1.2.3.4",
    "card 4753376719988201 4753 3767 1998 8201 and 4753-3767-1998-8202", "call +1 (456) 555-2186 or +12345", "+1+2+3 456 789 0123 4",
    "1" * 3000, "é 55.63.178.142 ü a.b@c.d", "9" * 40 + ".1.1.1", "a" * 3000 + "@", "1.2.3.", "..@a.b",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_random():
    import random

    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("12 .@-+(a0)9") for _ in range(40))
        assert pii.base_spans(text) == brute(text), text


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"some words here reach me at user{i}@mail.example.com today", "x") for i in range(8)]
    rows += [(100, "some words here reach me at hidden.name(at)mail.example.com today", "x")]
    rows += [(101, "nothing like that stands near hidden2(at)mail.example.com ever", "x"), (102, None, "x"), (None, "", "x"), (103, "chapter 12.", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Text string")
    out = {r.doc_id: r for r in pii.pii_digests(docs).collect()}
    assert len(out) == len(rows)
    text = rows[8][1]
    start = text.index("hidden")
    assert out[100].spans == f"email:{start}:{text.index(' today')}" and out[100].n_email == 0
    assert out[101].spans == "" and out[102].spans == "" and out[103].spans == ""
    assert out[3].n_email == 1
    assert pii.pii_digests(docs.limit(0)).count() == 0
    redacted = pii.find_personal_data(docs).join(docs.toDF("doc_id", "body", "c"), "doc_id")
    shown = {r.doc_id: r.shown for r in redacted.select("doc_id", pii.redact(redacted.body, redacted.spans).alias("shown")).collect()}
    assert shown[100] == "some words here reach me at [EMAIL] today" and shown[103] == "chapter 12."


@pytest.mark.parametrize("mark", ["(AT)", "[At]", "(aT)"])
def test_marks_of_any_case_are_searched(spark, mark):
    rows = [(i, f"some words here reach me at user{i}@mail.example.com today") for i in range(8)]
    rows += [(100, f"reach me at hidden.name{mark}mail.example.com today"), (101, f"\u0130 reach me at other.name{mark}mail.example.com today")]
    out = {r.doc_id: r.spans for r in pii.pii_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, name in ((100, "hidden"), (101, "other")):
        assert out[i] == f"email:{rows[i - 92][1].index(name)}:{rows[i - 92][1].index(' today')}"


def test_found_instances_induce_new_contexts_until_none_is_new(spark):
    edges = [(0, "p0", f"seed{i}", 1) for i in range(12)] + [(0, "p0", "x0", 0)]
    for k in range(1, 7):
        edges += [(0, f"p{k}", f"seed{k}-{i}", 1) for i in range(4)] + [(0, f"p{k}", f"x{k - 1}", 0), (0, f"p{k}", f"x{k}", 0)]
    edges += [(0, "q", f"seed{i}", 1) for i in range(4)] + [(0, "q", "never", 0)]
    edges = spark.createDataFrame(edges, "kind int, pattern string, value string, seed int")
    found = {r.value for r in pii.trusted_instances(edges, 5, 0.8, None).collect()}
    assert found == {f"x{k}" for k in range(7)}
    assert {r.value for r in pii.trusted_instances(edges, 5, 0.8, 2).collect()} == {"x0", "x1"}


def test_whatever_else_a_context_stands_at_counts_against_it(spark):
    rows = [(i, f"call me at user{i}@mail.example.com now") for i in range(8)] + [(100, "call me at hidden(at)mail.example.com now")]
    found = {r.doc_id: r.spans for r in pii.pii_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[100].startswith("email:11:")
    rows += [(200 + i, "they call me at noon") for i in range(40)]
    found = {r.doc_id: r.spans for r in pii.pii_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # "at" and "me at" stand before noon; what stands on both sides still tells.
    assert found[100].startswith("email:11:")
    rows += [(300 + i, "call me at once now") for i in range(40)]
    found = {r.doc_id: r.spans for r in pii.pii_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[100] == ""


def test_context_counts_equal_plain_ones(spark):
    texts = ["a b c a b", "A b  c\n", "", None, "a", "é a b é a b c"]
    patterns = ["1 a", "2 a b", "r a c", "1 é", "2 é a", "r b é"]
    hashes = pii._pattern_hashes(patterns).astype("int64").tolist()
    wanted = spark.createDataFrame([(h,) for h in hashes], "hash bigint")
    n = {r["hash"]: r["n"] for r in pii.context_counts(spark.createDataFrame([(t,) for t in texts], "text string"), wanted).collect()}
    assert [n.get(h, 0) for h in hashes] == [5, 4, 3, 2, 2, 0]


def test_long_identifiers_and_many_spans(spark):
    name = "x" * 5000
    rows = [(i, f"{'w' * 3000} mail: user{i}@a.example.com") for i in range(6)] + [(50, f"{'w' * 3000} mail: {name}(at)a.example.com")]
    rows += [(60, " ".join(f"u{i}@b.example.com" for i in range(4000)))]
    found = {r.doc_id: r for r in pii.pii_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[50].spans == f"email:3007:{3007 + 5000 + 4 + 13}" and found[60].n_email == 4000


def test_unseen_identifiers_in_a_whole_table(spark, sf_dir):
    """Every document gets a line: seeds and unseen identifiers in contexts of their own, and decoys of the same shapes in others."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.pmod(F.col("doc_id"), F.lit(6))
    n = F.col("doc_id").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("contact address: user"), n, F.lit("@mail.example.org end")))
        .when(k == 1, F.concat(F.lit("contact address: hidden"), n, F.lit("(at)mail.example.org end")))
        .when(k == 2, F.concat(F.lit("host ip= 10.0.0."), F.pmod("doc_id", F.lit(256)).cast("string"), F.lit(" up")))
        .when(k == 3, F.concat(F.lit("host ip= 10-20-30-"), n, F.lit(" up")))
        .when(k == 4, F.concat(F.lit("build 10-20-30-"), n, F.lit(" of part 555 01"), n))
        .otherwise(F.concat(F.lit("see note(at)page"), n, F.lit(".end")))
    )
    planted = docs.withColumn("line", line).withColumn("text", F.concat("text", F.lit("\n"), "line")).cache()
    spans = pii.find_personal_data(planted.select("doc_id", "text"))
    got = planted.join(spans, "doc_id").select("doc_id", "text", "line", F.filter("spans", lambda s: s["seed"] == 0).alias("extra")).collect()
    assert len(got) == docs.count()
    hits = wrong = wanted = 0
    for r in got:
        start = len(r.text) - len(r.line)
        value = {1: "hidden", 3: "10-20-30-"}.get(r.doc_id % 6)
        wanted += value is not None
        for s in r.extra:
            good = value is not None and s.start == start + r.line.index(value)
            hits, wrong = hits + good, wrong + (not good)
    assert wanted > 50 and hits >= 0.95 * wanted and wrong <= 0.02 * hits, (wanted, hits, wrong)


def test_query_equals_brute_force_on_the_table(spark, sf_dir):
    import hashlib

    out = {r.doc_id: r for r in pii.op8_pii(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for d in docs:
        base, r = brute(d.text or ""), out[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        parts = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(parts).encode()).hexdigest() and set(parts) <= set(filter(None, r.spans.split(",")))


@pytest.mark.parametrize("value", ["joe@mail[dot]com", "josé@exämple.com", "<anna@löwe.de>", "b{at}c(DOT)de"])
def test_addresses_without_a_digit_are_candidates(spark, value):
    rows = [(i, f"please write soon to user{i}@mail.example.com about it") for i in range(8)] + [(50, f"please write soon to {value} about it"), (51, "prices @ market. and a@b")]
    out = {r.doc_id: r for r in pii.pii_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[50].spans == f"email:21:{21 + len(value)}" and out[50].n_email == 0 and out[51].spans == ""
