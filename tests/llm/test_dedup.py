"""Near, exact and substring dedup against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import ringfence.llm.ngram_join as ngram_join
from ringfence.llm.automaton import SuffixAutomaton, remove_repeated_words
from ringfence.llm.components import components
from ringfence.llm import exact as exact_module, rows as rows_module
from ringfence.llm.exact import build_directory, build_index, dedup_exact, with_bucket
from ringfence.llm.ngram_join import near_duplicates
from ringfence.llm.segments import Units, cut_segments, half_keys
from ringfence.llm.suffix import multikey_quicksort, remove_repeated_bytes

import sys, os
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus  # noqa: E402


@pytest.fixture(scope="module")
def documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, [(r[0], r[1], r[2]) for r in docs.select("doc_id", "text", "source").collect()]


def similar_rows(seed=4, groups=12):
    """Groups of copies with a growing number of changed words, on both sides of the threshold, and chains."""
    draw, rows, n = random.Random(seed), [], 0
    for g in range(groups):
        words = [f"g{draw.randrange(400)}" for _ in range(draw.choice([6, 40, 120]))]
        for step in range(8):
            rows.append((n, " ".join(words), "s"))
            n += 1
            for _ in range(draw.randrange(1, 4)):
                words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
    return rows


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_near_duplicates_equal_all_pairs(spark, orders):
    rows = similar_rows()
    got = near_duplicates(corpus.frame(spark, rows), orders=orders).select("doc_id", "n_shingles", "component_id").collect()
    assert corpus.same(got, corpus.near(rows))


@pytest.mark.parametrize("block", [1, 3])
def test_near_duplicates_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "PAIRS", 5)
    rows = similar_rows()
    got = near_duplicates(corpus.frame(spark, rows), block=block).select("doc_id", "n_shingles", "component_id").collect()
    assert corpus.same(got, corpus.near(rows))


@pytest.mark.parametrize("block", [4, 60, 10**6])
def test_blocks_of_a_long_list_give_its_pairs(spark, block):
    """One token shared by a large component, small ones and single sets; another by few sets; one by a single component."""
    draw = random.Random(8)
    rows, parts = [], {}
    for token, count in ((5, 200), (6, 7), (7, 90)):
        for i in range(count):
            key = 1000 * token + i
            if i % 2 or token == 7:
                parts[key] = draw.choice([1, 1, 1, 2, 3]) if token != 7 else 4
            rows.append((token, key, draw.choice([40, 50, 90]), draw.randrange(0, 12)))
    join = ngram_join.SetJoin.__new__(ngram_join.SetJoin)
    join.percent, join.block = 75, block
    lists = spark.createDataFrame(rows, ngram_join.LISTS)
    named = spark.createDataFrame(list(parts.items()), "node long, component long")
    got = [tuple(r) for r in join.crossing(lists, named).collect()]
    want = set()
    for token, a, n, p in rows:
        for other, b, m, q in rows:
            least = -(-75 * (n + m) // 175)
            left = min(n - p, m - q)
            if token == other and a < b and parts.get(a, a) != parts.get(b, b) and 100 * min(n, m) >= 75 * max(n, m) and left >= least and min(p, q) + left >= least:
                want.add((a, b))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_near_duplicates_whole_table(documents):
    docs, rows = documents
    assert corpus.same(near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect(), corpus.near(rows))


def test_near_duplicates_awkward(spark):
    rows = corpus.awkward()
    out = near_duplicates(corpus.frame(spark, rows))
    assert corpus.same(out.select("doc_id", "n_shingles", "component_id").collect(), corpus.near(rows))
    assert near_duplicates(corpus.frame(spark, [])).count() == 0


def test_false_hits_and_forgetting_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SEEN", 2)
    rows = similar_rows(9)
    got = near_duplicates(corpus.frame(spark, rows), bits=4).select("doc_id", "n_shingles", "component_id").collect()
    assert corpus.same(got, corpus.near(rows))


def test_unlike_pairs_send_no_whole_set(spark, monkeypatch):
    """Texts below the threshold share prefix tokens; 16 bits of a token tell most of their pairs apart."""
    sent, write = {}, ngram_join.cut

    def counted(df, label="cut"):
        out = write(df, label)
        sent[label] = sent.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "cut", counted)
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(200)]
        for step, places in enumerate(((30, 90, 150), (37, 97, 157), (44, 104, 164), (51, 111, 171))):
            own = list(words)
            for place in places:
                own[place:place + 3] = [f"n{g}{step}{place + i}" for i in range(3)]
            rows.append((4 * g + step, " ".join(own), "s"))
    rows += [(100, "a b c d e f g h", "s"), (101, "a b c d e f g h", "s"), (102, "a b c d e f g h i", "s")]
    got = near_duplicates(corpus.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert corpus.same(got, corpus.near(rows))
    assert sent["short-sets"] > 10 and sent["whole-sets"] == 2


def test_first_bits_have_as_much_in_common():
    draw = np.random.default_rng(2)
    for size in (30, 3000, 100_000):
        tokens = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
        for share in (0.7, 0.85, 0.9, 1.0):
            a, b = tokens[draw.random(len(tokens)) < share], tokens[draw.random(len(tokens)) < share]
            short = [ngram_join._counted(ngram_join.first_bits(x)) for x in (a, b)]
            assert len(short[0]) == len(a) == len(np.unique(short[0]))
            assert len(np.intersect1d(*short)) >= len(np.intersect1d(a, b))
            assert ngram_join.alike(*short, 75) or not ngram_join.alike(a, b, 75)


def test_parities_differ_in_no_more_places_than_sets():
    draw = np.random.default_rng(4)
    for size in (1, 40, 64, 300, 5000):
        tokens = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
        for share in (0.3, 0.8, 0.95, 1.0):
            a, b = tokens[draw.random(len(tokens)) <= share], tokens[draw.random(len(tokens)) <= share]
            if len(a) and len(b):
                x, y = ngram_join.parities(a), ngram_join.parities(b)
                assert len(a) <= 8 * len(x) <= max(64, 2 * len(a)) and ngram_join.unlike(x, y) == ngram_join.unlike(y, x) <= len(np.setxor1d(a, b))
                assert ngram_join.unlike(x, x) == 0


def test_packed_counts_come_back_small():
    counts = np.random.default_rng(5).poisson(0.6, ngram_join.CHUNK).astype(np.int32)
    counts[[0, 77]] = 2**31 - 1, 70_000
    body = ngram_join.packed(counts)
    assert np.array_equal(ngram_join.unpacked(body), counts) and len(body) < counts.nbytes / 8


def test_levels_are_a_byte_for_each_count(spark):
    rows = [(i, " ".join(["again and again it is so"] * 30 + [f"w{i}x{k}" for k in range(40)]), "s") for i in range(60)]
    join = ngram_join.SetJoin(corpus.frame(spark, rows, False))
    counts = np.zeros(1 << ngram_join.SKETCH_BITS)
    import pyarrow as pa
    for _, tokens in ngram_join.sets_of(pa.array([t for _, t, _ in rows]), 5):
        np.add.at(counts, tokens >> np.uint64(64 - ngram_join.SKETCH_BITS), 1)
    want = np.clip(np.floor(np.log2(np.maximum(counts / (2 * counts.mean()), 0.5))) + 1, 0, 31)
    levels = join.levels.value
    assert levels.dtype == np.uint8 and np.array_equal(levels, want) and levels.max() > 5


def test_pairs_ruled_out_by_parities_are_unlike(spark):
    """Of all pairs of sets those that may be similar are left, and few others, before the next order and any text is read."""
    rows = similar_rows(5, 5)
    join = ngram_join.SetJoin(corpus.frame(spark, rows, False))
    key = {r.doc_id: r.set_key for r in join.rows.collect()}
    sets = {key[i]: corpus.shingles(t) for i, t, _ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    left = {tuple(r) for r in join.possible(ngram_join.cut(spark.createDataFrame(pairs, "a long, b long"))).collect()}
    like = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert like and like <= left <= set(pairs) and len(left) < len(like) + len(pairs) / 10


def test_prefix_meets_under_every_order():
    draw = np.random.default_rng(1)
    levels = draw.integers(0, 5, 1 << ngram_join.SKETCH_BITS).astype(np.uint64)
    for _ in range(200):
        n = int(draw.integers(1, 60))
        both = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        a, b = both[draw.random(len(both)) < 0.93], both[draw.random(len(both)) < 0.93]
        common = len(np.intersect1d(a, b))
        if len(a) and len(b) and 100 * common >= 75 * (len(a) + len(b) - common):
            for order in range(3):
                assert len(np.intersect1d(ngram_join.prefix(a, levels, order, 75), ngram_join.prefix(b, levels, order, 75)))


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {x: root(x) for x in parent if any(x in l and l[0] != l[1] for l in links)}
    assert {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


@pytest.mark.parametrize("length, limit, bits", [(400, 100_000, 26), (40, 100_000, 26), (40, 1, 26), (41, 100_000, 5)])
def test_repeated_bytes(documents, length, limit, bits):
    docs, rows = documents
    rows = rows[:80]
    part = docs.filter(docs.doc_id.isin([r[0] for r in rows]))
    assert corpus.same(remove_repeated_bytes(part, length, limit, bits).collect(), corpus.rest_of_bytes(rows, length))


def test_repeated_bytes_awkward(spark):
    rows = [r for r in corpus.awkward() if r[1] is None or len(r[1]) < 40_000]
    assert corpus.same(remove_repeated_bytes(corpus.frame(spark, rows), 40).collect(), corpus.rest_of_bytes(rows, 40))
    assert remove_repeated_bytes(corpus.frame(spark, [])).count() == 0


@pytest.mark.parametrize("limit, bits", [(20_000, 26), (1, 26), (20_000, 5)])
def test_repeated_words(documents, limit, bits):
    docs, rows = documents
    assert corpus.same(remove_repeated_words(docs, 13, limit, bits).collect(), corpus.rest_of_words(rows))


def test_repeated_words_awkward(spark):
    rows = corpus.awkward()
    assert corpus.same(remove_repeated_words(corpus.frame(spark, rows)).collect(), corpus.rest_of_words(rows))
    assert remove_repeated_words(corpus.frame(spark, [])).count() == 0


def test_planted_passage(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(30)) + " " + passage + " " + " ".join(f"e{i}x{k}" for k in range(20)), "s") for i in range(40)]
    got = {r.doc_id: r.n_removed for r in remove_repeated_words(corpus.frame(spark, rows)).collect()}
    assert got == {i: 55 if i else 0 for i in range(40)}


def test_automaton_statistics():
    draw = random.Random(3)
    for _ in range(40):
        texts = [[draw.randrange(3) for _ in range(draw.randrange(1, 30))] for _ in range(4)]
        automaton = SuffixAutomaton()
        for t in texts[:3]:
            automaton.add(t)
        inside = {tuple(t[i:j]) for t in texts[:3] for i in range(len(t)) for j in range(i, len(t) + 1)}
        q = texts[3]
        assert automaton.statistics(q) == [max(k for k in range(e + 2) if tuple(q[e + 1 - k:e + 1]) in inside) for e in range(len(q))]


def test_multikey_quicksort():
    keys = np.random.default_rng(0).integers(0, 3, (3000, 6)).astype(np.uint64)
    assert (keys[multikey_quicksort(keys)] == keys[np.lexsort(keys.T[::-1])]).all()


def exact(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    keep = {t: max((x for x in ds if x is not None), default=None) for t, ds in groups.items()}
    return [(d, keep[t or ""], len(groups[t or ""]), d == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows]


@pytest.mark.parametrize("capacity", [1, 3, 1 << 16])
def test_exact_dedup(spark, documents, capacity):
    for docs, rows in (documents, (corpus.frame(spark, corpus.awkward()), corpus.awkward())):
        assert corpus.same(dedup_exact(docs, capacity).drop("text_key").collect(), exact(rows))
    assert dedup_exact(corpus.frame(spark, [])).count() == 0


@pytest.mark.parametrize("held", [1, 32 << 20])
def test_keys_that_collide_are_chained(spark, monkeypatch, held):
    """Many texts under few keys: only the bytes tell them apart. Links of one text are never two, whatever a task combined."""
    monkeypatch.setattr(exact_module, "HELD_BYTES", held)
    rows = [(i, f"text {i % 40}" if i % 7 else None, (i % 40) % 3 - 1) for i in range(400)] + [(1000, "single", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long").repartition(5)
    docs = docs.selectExpr("doc_id", "coalesce(text, '') text", "key")
    keys = docs.selectExpr("doc_id", "key", "sha2(text, 256) text_sha256", "octet_length(text) n_bytes")
    links = build_index(docs, keys, 2).collect()
    want = {}
    for i, text, key in rows:
        want.setdefault((key, hashlib.sha256((text or "").encode()).hexdigest()), []).append(i)
    assert {(r.key, r.text_sha256): (r.keep_id, r.group_size) for r in links} == {k: (max(v), len(v)) for k, v in want.items()}
    assert len(links) == len(want)
    for key in {r.key for r in links}:
        chain = [r.chain for r in links if r.key == key]
        assert sorted(chain) == list(range(1, len(chain) + 1))


def test_answers_come_from_the_links(spark, monkeypatch):
    """A changed link changes the answers of its rows."""
    index = exact_module.build_index
    monkeypatch.setattr(exact_module, "build_index", lambda *a: index(*a).withColumn("keep_id", F.when(F.col("group_size") > 1, -5).otherwise(F.col("keep_id"))))
    got = {r.doc_id: (r.keep_id, r.kept) for r in dedup_exact(corpus.frame(spark, [(1, "a", "s"), (2, "a", "s"), (3, "b", "s")])).collect()}
    assert got == {1: (-5, False), 2: (-5, False), 3: (3, True)}


@pytest.mark.parametrize("share", [1, 3, 10_000])
def test_hot_groups_meet_by_broadcast(spark, monkeypatch, share):
    monkeypatch.setattr(rows_module, "HOT_SHARE", share)
    rows = spark.range(500).selectExpr("id", "if(id % 2 = 0, 0, id % 9) k")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).filter("k <> 4")
    got = {tuple(r) for r in rows_module.join_groups(rows, groups, ["k"], "n").select("id", "k", "n", "top").collect()}
    assert got == {tuple(r) for r in rows.join(groups, "k").select("id", "k", "n", "top").collect()} and len(got) > 400


def test_directory_splits_only_overfull_buckets(spark):
    slots = spark.range(2000).selectExpr("case when id < 1900 then shiftright(xxhash64(id), 20) else xxhash64(id) end key")
    buckets = build_directory(slots, 50)
    counts = {r[0]: r[1] for r in with_bucket(slots, buckets).groupBy("bucket").count().collect()}
    buckets = [(r.depth, r.prefix) for r in buckets.collect()]
    assert sum(counts.values()) == 2000 and max(counts.values()) <= 50
    depths = {d for d, _ in buckets}
    assert max(depths) > 20 > min(depths) and sum(2.0 ** -d for d, _ in buckets) == 1


def test_segments_whose_keys_agree_in_part(spark):
    """Pairs of different segments of one class with equal low 32 bits of their keys; nothing repeats."""
    head = " ".join(f"word{i}" for i in range(100))[:392]
    rows = [(n, f"{head}{i:08d}", "a") for n, i in enumerate((43497, 96680))]
    assert corpus.same(remove_repeated_bytes(corpus.frame(spark, rows)).collect(), corpus.rest_of_bytes(rows, 400))
    rows = [(n, " ".join(f"w{i}" for i in range(12)) + f" x{i}", "a") for n, i in enumerate((78058, 194788))]
    assert corpus.same(remove_repeated_words(corpus.frame(spark, rows)).collect(), corpus.rest_of_words(rows))


@pytest.mark.parametrize("units", [Units(False, 40, 16, 20), Units(False, 41, 20, 20), Units(False, 3, 1, 1), Units(True, 13, 4, 6)])
def test_segments_that_share_a_window_share_a_half(units):
    rng = random.Random(7)
    common = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(60))
    texts = [common[rng.randrange(60):][:rng.randrange(90)] + " ".join(rng.choice("xyzab") for _ in range(40)) + common[rng.randrange(90):] for _ in range(40)]
    of_window, twice = {}, 0
    for text in texts:
        buf = np.frombuffer(text.encode(), np.uint8)
        h, found = cut_segments(units, buf, np.array([0, len(buf)]))
        if found is None:
            continue
        halves = [{int(k[i]) for k, enough in half_keys(units, h, found) if enough[i]} for i in range(len(found[0]))] if len(found[0]) else []
        for i, (s, n) in enumerate(zip(found[1].tolist(), found[3].tolist())):
            for w in range(n):
                of_window.setdefault(h[s + w:s + w + units.window].tobytes(), []).append((int(found[6][i]), halves[i]))
    for segments in of_window.values():
        for (one, a), (two, b) in zip(segments, segments[1:]):
            if one != two:
                twice += 1
                assert a & b
    assert twice > 20
