"""Quality rules, manifest and collocations against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import CLASHES, WORD, awkward, frame, same
from pyspark.sql import functions as F, types as T

from ringfence.llm import manifest, rules
from ringfence.llm.collocations import collocations, reduced
from ringfence.llm.manifest import fold, merkle_manifest, pack, proof_digest, rank, tampered_manifest, unpack
from ringfence.llm.rules import binomial_tail, fit_cutoffs, quality_rules, text_statistics


def documents(spark, rows):
    """rows of (doc_id, text, source, lang, n_chars), and columns under names used inside."""
    names = [*CLASHES, "grp", "leaf", "slot", "rank", "stratum", "phrase", "f", "path", "level", "held"]
    kinds = [("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("lang", T.StringType()), ("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(c, k) for c, k in kinds] + [T.StructField(c, T.StringType()) for c in names])
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)


def awkward_documents():
    rows = [(d, t, s, [None, "en", "und", "fr"][i % 4], None if t is None else len(t)) for i, (d, t, s) in enumerate(awkward())]
    return rows + [(None, "same", "a", "en", 4), (None, "same", "a", "en", 4), (-5, "minus\n\nminus", "a", "en", 1), (2**62, "far", "a", "en", 3), (-(2**62), "far", None, "en", 3)]


# Rules


def statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    again = {p for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_statistics(spark):
    rows = awkward_documents() + [(50, "a b c a b c a b", None, None, 1), (51, "a a a a\n#\n#\n \na a", None, None, 1), (52, "a b a b a", None, None, 1)]
    got = quality_rules(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int"))
    got = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for d, t, *_ in rows:
        s = statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((d, *s, failed, not failed))
    assert same(got, want)
    assert quality_rules(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


@pytest.mark.parametrize("share", [0.01, 0.3])
def test_binomial_tail(spark, share):
    cases = [(n, k) for n in (1, 7, 50, 400, 5000) for k in (0, 1, 3, 40, 140) if k <= n]
    rows = spark.createDataFrame(cases, "n long, k long").withColumn("p", binomial_tail(F.col("n"), F.col("k"), share)).collect()
    for n, k, p in rows:
        exact = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
        assert p == pytest.approx(exact, rel=1e-9) if k < n * share else p == 1


def labelled(spark, seed, n=4000, noise=0.002):
    """Bad documents have symbols; a few good ones too."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        marks = 30 if bad or r.random() < noise else 0
        text = " ".join(f"w{r.randrange(10**6)}" for _ in range(60)) + " " + "# " * marks
        rows.append((i, text, None, "en" if i % 3 else None, 1))
        labels.append((i, int(not bad)))
    labels += [(0, labels[0][1]), (None, 1), (3, None), (10**9, 0)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_are_certified(spark):
    docs, labels = labelled(spark, 3)
    found = {(x.stratum, x.rule): x for x in fit_cutoffs(text_statistics(docs), labels).collect()}
    assert {k for k, _ in found} == {"en", "und"} and all(x.rejected < 0.01 * x.trials for x in found.values())
    sequences = 2 * len(rules.RULES)
    for x in found.values():
        exact = sum(math.comb(x.trials, i) * 0.01**i * 0.99 ** (x.trials - i) for i in range(x.rejected + 1))
        assert x.p_value == pytest.approx(exact, rel=1e-8) and exact <= 0.05 / sequences
    verdict = quality_rules(docs, labels).join(labels.dropna(), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in verdict}
    assert kept[0] < 0.05 and kept[1] > 0.98


def test_few_labels_certify_nothing(spark):
    docs, labels = labelled(spark, 4, n=200)
    assert fit_cutoffs(text_statistics(docs), labels).count() == 0


def test_noisy_rule_stays_off(spark):
    docs, labels = labelled(spark, 5, noise=0.05)  # good documents have symbols as well
    assert "symbols" not in {x.rule for x in fit_cutoffs(text_statistics(docs), labels).collect()}


# Manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    d, t, s, lang, n = row
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t)])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def sides(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 3 * 3
        out.append((level[a:i], level[i + 1:a + 3]))
        i //= 3
    return out


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        d, t, *_ = r
        cut_ = d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and t is not None
        by[r[2]].append((d is not None, d or 0, leaf(r), leaf((d, t.replace("\n", ""), *r[2:])) if cut_ else leaf(r)))
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: tree([x[2] for x in sorted(by[g])]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for place, g in enumerate(groups):
        for i, (known, d, own, changed) in enumerate(sorted(by[g])):
            path = sides(trees[g], i) + sides(top, place)
            node = changed
            for before, after in path:
                node = digest(*before, node, *after)
            root = top[-1][0]
            out.append((d if known else None, own, trees[g][-1][0], root, digest(*[x for p in path for side in p for x in side]), node, node == root))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_awkward(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SPREAD", 2)  # copies of a row in several blocks
    rows = awkward_documents() + [(9, f"text {i}", "a", "en", 1) for i in range(40)] + [(77, "copy\n", "a", "en", 1)] * 9
    got = tampered_manifest(documents(spark, rows)).select(*MANIFEST).collect()
    assert same(got, plain_manifest(rows)) and any(not r.verified for r in got)
    assert tampered_manifest(documents(spark, [])).count() == 0
    one = tampered_manifest(documents(spark, rows[:1])).collect()
    assert [tuple(r) for r in one] == plain_manifest(rows[:1])


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_manifest_in_several_arrays(spark, depth):
    rows = [(i * i * 7919 % 600_011, f"t{i}", f"s{i % 30 if i > 300 else 0}", None, i) for i in range(900)]
    made = merkle_manifest(documents(spark, rows), depth=depth)
    got = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), fold(F.col("leaf"), F.col("path")), F.lit(True))
    want = [(*r[:5], r[3], True) for r in plain_manifest(rows)]
    assert same(got.collect(), want)


def test_changed_row_is_found(spark):
    rows = [(i, f"a\nb {i}", "s", None, i) for i in range(50)]
    got = {r.doc_id: r.verified for r in tampered_manifest(documents(spark, rows)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 2 == 1 for i in range(50)}


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 60_000, 65_536])
def test_bitmap_ranks(n):
    low = np.sort(np.random.default_rng(n).permutation(65_536)[:n])
    bits, asked = pack(low), np.arange(65_536)
    assert unpack(bits).tolist() == low.tolist()
    assert (rank(bits, asked) == np.searchsorted(low, asked)).all()


def test_dense_bitmaps(spark):
    rows = spark.range(0, 200_000, 1, 7).select(F.lit("g").alias("grp"), (F.col("id") * 3 - 90_000).alias("doc_id"))
    maps = manifest.id_bitmaps(rows.unionByName(rows.filter("doc_id % 1000 = 0")).repartition(5))
    ranks = manifest.rank_ids(maps.cache())
    past = F.col("doc_id") + 90_000
    want = rows.withColumn("want", past / 3 + F.when(past > 0, F.floor((past - 1) / 3000) + 1).otherwise(0))
    assert ranks.count() == 200_000 and ranks.filter("same = 2").count() == 200
    assert ranks.join(want, "doc_id").filter(F.col("rank") != F.col("want")).count() == 0


# Collocations


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for _, t, _, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if any(len(q) > len(p) and m == lang and c >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for (m, q), c in often.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p, a, l, r, n[lang], s) for lang, found in out.items()
            for i, (s, a, p, l, r) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1], x[2].encode()))[:top])]


def prose(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        while len(words) < 60:
            words += ["New York City".split(), ["of", "the"], [f"w{int(r.paretovariate(0.7))}"], ["a,", "B"], ["x\ny"], ["é!"]][r.choice([0, 1, 2, 2, 2, 2, 3, 4, 5])]
        rows.append((i, " ".join(words), None, [None, "und", "en"][i % 3], 1))
    return rows


@pytest.mark.parametrize("bits, pending", [(27, 1 << 21), (9, 300)])
def test_collocations(spark, monkeypatch, bits, pending):
    from ringfence.llm import collocations as module

    # in the second case bit arrays fill up, the second pass has several rounds and tasks hand over early
    monkeypatch.setattr(module, "PENDING", pending)
    monkeypatch.setattr(module, "HELD", pending)
    rows = prose(1, 150) + [(d, t, s, lang, n) for d, t, s, lang, n in awkward_documents() if t is None or len(t) < 20_000]
    got = collocations(documents(spark, rows).repartition(3), least=12, top=9, most_bits=bits, min_bins=2).collect()
    want = plain_collocations(rows, 12, 9)
    assert len(want) > 12 and same(got, want)


def test_collocations_of_nothing(spark):
    assert collocations(documents(spark, [])).count() == 0
    assert collocations(documents(spark, [(1, None, None, None, 0), (2, "few words", None, None, 1)])).count() == 0


def test_first_rows_by_rounds(spark):
    from ringfence.llm.collocations import first_per

    rows = spark.range(3000).select(F.lit("a").alias("lang"), (F.col("id") * 7919 % 3001).alias("score"), F.col("id").cast("string").alias("phrase"))
    got = first_per(rows, "lang", [F.col("score").desc(), F.col("phrase")], 2, "phrase").orderBy("rank").collect()
    assert [(r["rank"], r["score"]) for r in got] == [(1, 3000), (2, 2999)]


def test_summaries_keep_frequent_keys():
    rng = np.random.default_rng(1)
    keys = np.minimum(rng.zipf(1.3, 20_000), 10**6).astype(np.uint64)
    from ringfence.llm.collocations import combined

    least = 150
    capacity = len(keys) // least + 1
    held, counts, off = keys[:0], np.empty(0, np.int64), 0
    for part in np.array_split(keys, 23):
        k, c = combined(part, np.ones(len(part), np.int64))
        held, counts = combined(np.concatenate([held, k]), np.concatenate([counts, c]))
        held, counts, less = reduced(held, counts, capacity)
        off += less
    exact = Counter(keys.tolist())
    bound = dict(zip(held.tolist(), (counts + off).tolist()))
    assert len(held) <= capacity and off < least
    assert all(exact[k] <= bound.get(k, off) for k in exact) and all(k in bound for k, c in exact.items() if c >= least)
