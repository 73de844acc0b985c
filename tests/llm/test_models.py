"""Quality classifier, personal data, and the pipeline."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import ringfence.llm.quality as quality
from ringfence.llm.pii import KINDS, Field, base_spans, field_spans, find_pii, fit_field, fit_pii, labelled_words, luhn, uncovered, viterbi, written
from ringfence.llm.quality import fit_ordinal, fit_quality, grade_of, score_quality, select_quality
from ringfence.llm.queries import QUERIES, SQL
from ringfence.session import cut

import sys, os
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus  # noqa: E402


def test_ordinal_fit_recovers_weights_and_order():
    draw = np.random.default_rng(0)
    x = (draw.random((6000, 3)) < 0.4).astype(np.float32)
    score = x @ np.array([2.0, -1.5, 0.0]) + draw.logistic(size=6000)
    grade = np.digitize(score, [-1.0, 0.5, 2.0])
    w, cuts = fit_ordinal(x, grade, 4)
    assert w == pytest.approx([2.0, -1.5, 0.0], abs=0.15) and cuts == pytest.approx([-1.0, 0.5, 2.0], abs=0.15)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = fit_quality(docs, ratings.filter("doc_id % 4 <> 0"))
    out = score_quality(docs, model).join(labels.filter("doc_id % 4 = 0"), "doc_id")
    kept = {(r.quality, r.toxic): (r.kept, r.n) for r in out.groupBy("quality", "toxic").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert kept[1, 0][0] >= 0.97 * kept[1, 0][1]
    assert kept[1, 1][0] <= 0.25 * kept[1, 1][1] and kept[0, 0][0] <= 0.1 * kept[0, 0][1]


def test_fit_holds_little_more_than_its_rows():
    """The features are looked at range by range of their hashes, with the same result as all at once."""
    draw = np.random.default_rng(6)
    n, words = 3000, np.unique(draw.integers(0, 2**64, 40_000, dtype=np.uint64))
    grade = draw.integers(0, 3, n)
    each = [np.unique(np.concatenate([draw.choice(words[3:], 700), words[:3][draw.random(3) < 0.3 * g]])) for g in grade]
    table = pa.RecordBatch.from_arrays([pa.array(draw.permutation(n)), pa.array(grade, pa.int32()), pa.array(draw.integers(1, 4, n)), pa.array([e.tobytes() for e in each], pa.binary())],
                                       ["doc_id", "grade", "weight", "features"])
    tracemalloc.start()
    model = next(iter(quality._fit(3, 8, 6.0, 64)(iter([table.slice(0, 1000), table.slice(1000)]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(e.nbytes for e in each)
    assert np.array_equal(np.frombuffer(model.column(0)[0].as_py(), np.uint64), words[:3])
    names, z = quality._evidence(each, grade, np.ones(n), 8)
    index = {w: i for i, w in enumerate(names.tolist())}
    for w in [*words[:3], *draw.choice(names, 20)]:
        own = grade[[w in e for e in each]]
        assert np.isclose(z[index[int(w)]], abs(own.mean() - grade.mean()) / np.sqrt(grade.var() / len(own)) if len(own) >= 8 else 0)


def test_quality_awkward(spark):
    docs = corpus.frame(spark, corpus.awkward())
    ratings = spark.createDataFrame([(1, 2), (None, 1), (3, None), (99, 0), (3, 1), (3, 1)], "doc_id long, grade int")
    for rows in (ratings, ratings.limit(0)):
        model = fit_quality(docs, rows)
        out = score_quality(docs, model).collect()
        assert len(out) == len(corpus.awkward()) and all(0 <= r.tail_probability <= 1 for r in out)
        kept = select_quality(docs, model, 0.8)
        assert kept.columns == docs.columns and kept.count() == len(out)  # too little to learn from: nothing is rejected
        assert score_quality(docs.limit(0), model).count() == 0


def test_one_id_with_half_of_the_ratings(spark):
    """It weighs by its ratings, but enters the fit once per grade."""
    good, bad = "calm river stone light " * 20, "$$ win cash now %% " * 20
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(400)] + [(7, good)] * 300, "doc_id long, text string")
    ratings = spark.range(400).selectExpr("id as doc_id", "cast(2 * (id % 2) as int) as grade")
    ratings = ratings.unionByName(spark.range(5000).selectExpr("7L as doc_id", "2 as grade"))
    out = score_quality(docs, fit_quality(docs, ratings, sample_rows=380)).dropDuplicates(["doc_id"]).collect()
    assert all(r.kept == (r.doc_id % 2 == 1) for r in out)


# The patterns as the contract writes them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15])


def test_patterns_equal_the_plain_ones():
    draw = np.random.default_rng(7)
    pieces = ["a@b.co", "a@b", "@", ".", "1.2.3.4", "001.02.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111111", " ", "-", "+", "+1 (212) 555-0199", "(", ")", "9",
              "12", "x_y@c-d.e.f@g.h", "é", "00", "\n", "%", "+4", "4242424242424242424", "١٢٣"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces, draw.integers(1, 14)))
        assert base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 200_000, "a" * 300_000 + "@", "a@" * 100_000, "+1" * 100_000, "1 " * 200_000, "0" * 5000 + ".1.1.1", "1.2.3." + "0" * 9000 + "4"):
        base_spans(text)


@pytest.fixture(scope="module")
def field():
    return Field(*fit_field(list(labelled_words())))


def found(field, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return [(KINDS[k], text[a:b]) for a, k, b in field_spans(field, raw, np.array([0, len(raw)])).get(0, [])]


def test_field_on_sentences_not_in_the_table(field):
    assert found(field, "é the desk has (415) 555-2671, ask there") == [("phone", "(415) 555-2671")]
    assert found(field, "numbers 212-555-0143 and 646-555-0188 ring") == [("phone", "212-555-0143"), ("phone", "646-555-0188")]
    assert found(field, "then ask eve.black (at) corp (dot) example (dot) com about it") == [("email", "eve.black (at) corp (dot) example (dot) com")]
    assert found(field, "my card 5500 0000 0000 0005 is new") == [("card", "5500 0000 0000 0005")]
    for clean in ("in 1999 we saw 12 of 30", "on 12/03/2024 at 10:30", "order 4785380592391139 was sent", "token = \"24be64439e3e\" here", "see (also) this [too]", "THE!! 12!! ENDS!!", ""):
        assert found(field, clean) == []


ADJACENT = [  # text, what is added to the base spans
    ("call +1 (212) 555-0199, (415) 555-2671 today", ["phone (415) 555-2671"]),
    ("call (415) 555-2671, +1 (212) 555-0199 today", ["phone (415) 555-2671"]),
    ("é call (212) 555-0143, (415) 555-2671 today", ["phone (212) 555-0143", "phone (415) 555-2671"]),
    ("call (212) 555-0143 (415) 555-2671 (646) 555-0188 today", ["phone (212) 555-0143", "phone (415) 555-2671", "phone (646) 555-0188"]),
    ("lines 212-555-0143; 646-555-0188 ring", ["phone 212-555-0143", "phone 646-555-0188"]),
    ("a@b.co, +1 (212) 555-0199, 646-555-0188, (415) 555-2671 ring", ["phone 646-555-0188", "phone (415) 555-2671"]),
    ("mail eve (at) corp (dot) com, tom (at) host (dot) org now", ["email eve (at) corp (dot) com", "email tom (at) host (dot) org"]),
    ("call +1 (212) 555-0199 today", []),
]


def test_adjacent_entities(spark):
    out = {r.doc_id: r for r in find_pii(corpus.frame(spark, [(i, t, "a") for i, (t, _) in enumerate(ADJACENT)]), fit_pii(spark)).collect()}
    for i, (text, want) in enumerate(ADJACENT):
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in out[i].spans.split(",") if s)]
        base = [(KINDS[k], a, b) for a, k, b in base_spans(text)]
        assert [f"{k} {text[a:b]}" for k, a, b in spans if (k, a, b) not in base] == want, text
        assert out[i].n_added == len(want) and set(base) <= set(spans)


def test_words_beside_a_base_span_stay():
    run = [(0, 4), (5, 9), (10, 14), (15, 19)]
    for base, left in (([], [run]), ([(5, 3, 9)], [run[:1], run[2:]]), ([(0, 3, 6), (12, 2, 13)], [run[3:]]), ([(0, 3, 19), (1, 2, 3)], []), ([(4, 3, 5)], [run])):
        assert uncovered(run, ([a for a, _, _ in base], [max(b for _, _, b in base[:i + 1]) for i in range(len(base))])) == left


def test_viterbi_by_brute_force():
    import itertools

    draw = np.random.default_rng(0)
    emit, trans, lengths = draw.normal(size=(5, 5, 3)), draw.normal(size=(3, 3)), np.array([5, 1, 3, 2, 4])
    got = viterbi(emit, trans, lengths)
    for e, n, labels in zip(emit, lengths, got):
        score = lambda s: sum(e[i, x] for i, x in enumerate(s)) + sum(trans[x, y] for x, y in zip(s, s[1:]))
        assert tuple(labels[:n]) == max(itertools.product(range(3), repeat=int(n)), key=score)


def test_pii_awkward(spark, sf):
    model = fit_pii(spark)
    rows = corpus.awkward()
    out = find_pii(corpus.frame(spark, rows), model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in out) == sorted(
        (d is None, d or 0, hashlib.sha256(written(plain_base(t or "")).encode()).hexdigest()) for d, t, _ in rows)
    assert find_pii(corpus.frame(spark, []), model).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in find_pii(docs, model).collect():
        spans, base = r.spans.split(",") if r.spans else [], written(plain_base(texts[r.doc_id]))
        assert set(base.split(",") if base else []) <= set(spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and len(spans) - r.n_added == r.n_email + r.n_ip + r.n_card + r.n_phone


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf))
        seen.append((before, docs))
        if name != "packing":
            assert docs.columns == names
    quality, exact, near, mixed, packed = seen
    texts = [r.text for r in exact[1].collect()]
    assert len(set(texts)) == len(texts) and set(texts) == {r.text for r in exact[0].collect()}
    rows = [(r.doc_id, r.text) for r in near[0].collect()]
    assert sorted(r.doc_id for r in near[1].collect()) == sorted(d for d, n, c in corpus.near(rows) if d == c)
    assert {r.doc_id for r in mixed[1].collect()} <= {r.doc_id for r in mixed[0].collect()}
    assert {r.doc_id for r in packed[1].collect()} == {r.doc_id for r in packed[0].collect()}


def test_stages_awkward(spark):
    docs = corpus.frame(spark, corpus.awkward())
    for name, stage in corpus_pipeline.STAGES[1:]:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, "")
            assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
    exact = {r.text or "" for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()}
    assert exact == {t or "" for _, t, _ in corpus.awkward()}


def test_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(SQL) <= set(QUERIES)
