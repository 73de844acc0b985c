"""Mixing, packing, chat formatting and search."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfence.llm.chat import chat_digest, format_chats, read_back, whole_examples
from ringfence.llm.mixing import apportion, mix_sources, source_targets, take_mix
from ringfence.llm.packing import encoder, pack, sum_of_squares
from ringfence.llm.topk import best, product, top_k

import sys, os
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus  # noqa: E402


def highest_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportion_equals_highest_quotients(spark, seed):
    draw = np.random.default_rng(seed)
    votes = (draw.pareto(1, 30) * 100 + 1).round(3).tolist() + [0.0]
    rows = [(0, i, v, 70) for i, v in enumerate(votes)] + [(1, i, 5.0, 7) for i in range(4)]
    got = defaultdict(dict)
    for r in apportion(spark.createDataFrame(rows, "g int, i int, v double, s long"), ["g"], "v", "s", ["i"]).collect():
        got[r.g][r.i] = r.quota
    assert [got[0][i] for i in range(len(votes))] == highest_quotients(votes, 70)
    assert [got[1][i] for i in range(4)] == highest_quotients([5.0] * 4, 7) == [2, 2, 2, 1]


def targets(sizes, weights=(5, 2, 1), most=3):
    """Reshares the excess until no target is above its bound."""
    w, total = [weights[i % 3] for i in range(len(sizes))], sum(sizes)
    stopped = set()
    while True:
        left = total - sum(most * sizes[i] for i in stopped)
        open_ = sum(w[i] for i in range(len(sizes)) if i not in stopped)
        share = [most * s if i in stopped else left * w[i] / open_ for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in stopped and share[i] > most * s + 1e-9}
        if not above:
            return share
        stopped |= above


def test_targets(spark):
    draw = np.random.default_rng(5)
    for n in (1, 2, 5, 9, 23):
        sizes = (draw.pareto(0.7, n) * 50 + 1).astype(int).tolist()
        got = source_targets(spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long")).orderBy("sid").collect()
        assert [r.target for r in got] == pytest.approx(targets(sizes))


@pytest.mark.parametrize("block, shard", [(256, 1 << 20), (16, 500), (1, 1 << 20)])
def test_mix_meets_targets(spark, sf, block, shard):
    out = mix_sources(spark.read.parquet(f"{sf}/documents.parquet"), block=block, shard_words=shard)
    rows = out.collect()
    assert sorted(rows) == sorted(mix_sources(spark.read.parquet(f"{sf}/documents.parquet"), block=block, shard_words=shard).collect())
    by = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source, r.target] += r.taken
    assert all(abs(t - got) <= 0.5 + 1e-6 for (_, t), got in by.items())


def test_mix_awkward(spark):
    docs = corpus.frame(spark, corpus.awkward())
    rows = mix_sources(docs).collect()
    sizes = sorted((d is None, d or 0, len(corpus.WORD.findall(t or ""))) for d, t, _ in corpus.awkward())
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in rows) == sizes
    assert all(r.taken <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert set(by) == {"a", "b", "c", "d", "é", None}
    assert all(abs(t - got) <= max(1, 3 * 256) for t, got in by.values())
    assert mix_sources(corpus.frame(spark, [])).count() == 0
    taken = take_mix(docs, mix_sources(docs))
    assert taken.columns == docs.columns
    assert sum(len(corpus.WORD.findall(r.text)) for r in taken.collect()) == sum(r.taken for r in rows)


@pytest.mark.parametrize("seed", [17, 18, 19])
def test_mix_takes_the_drawn_blocks(spark, seed):
    sizes = {1: 1000, 2: 1000, 3: 1003}  # targets 1876.9, 750.8, 375.4
    docs = corpus.frame(spark, [(d, " ".join(f"d{d}w{i}" for i in range(n)), "abc"[d - 1]) for d, n in sizes.items()])
    mixed = mix_sources(docs, block=10, seed=seed)
    kept, rows = {r.doc_id: r for r in mixed.collect()}, take_mix(docs, mixed).collect()
    for d, n in sizes.items():
        pieces = [[int(w.split("w")[1]) for w in r.text.split(" ")] for r in rows if r.doc_id == d]
        whole, parts = [p for p in pieces if len(p) == n], [p for p in pieces if len(p) < n]
        assert all(p == list(range(p[0], p[0] + len(p))) for p in pieces) and all(p[0] % 10 == 0 for p in pieces)
        assert sum(map(len, pieces)) == kept[d].taken and len(whole) == kept[d].taken // n == kept[d].rounds
        assert sorted((p[0], p[0] + len(p)) for p in parts) == [tuple(r) for r in kept[d].runs]
        ends = sorted(p[0] + len(p) for p in parts)
        assert sum(e % 10 > 0 and e < n for e in ends) <= 1  # one block is cut to settle the words
        assert len(parts) > 5 and ends[-1] > 0.8 * n  # blocks from everywhere, not the start of the text
        starts = [p[0] for p in parts]
        assert not set(starts) & set(ends)  # touching blocks are one row
    whole = mix_sources(docs.filter("doc_id = 3"), block=10, seed=seed)
    assert [r.text for r in take_mix(docs.filter("doc_id = 3"), whole).collect()] == [r.text for r in docs.filter("doc_id = 3").collect()]


def test_squares_by_brute_force():
    sizes = np.random.default_rng(2).integers(1, 17, 300)
    where, fill = sum_of_squares(sizes, 16), defaultdict(int)
    for s, w in zip(sizes.tolist(), where.tolist()):
        def squares(change):
            after = dict(fill) | change
            levels = defaultdict(int)
            for v in after.values():
                levels[v] += v < 16
            return sum(n * n for n in levels.values())
        fits = [squares({x: v + s}) for x, v in fill.items() if v + s <= 16] + [squares({"new": s})]
        assert squares({w: fill.get(w, 0) + s}) == min(fits)
        fill[w] += s
        assert fill[w] <= 16


def check_packed(rows, texts, window=2048):
    encode = encoder().encode_ordinary
    left, place = defaultdict(list), defaultdict(list)
    for r in rows:
        left[r.doc_id].append(r)
        place[r.sequence_id].append((r.offset, r.length, r.padded))
    for parts in place.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]
        used = sum(p[1] for p in parts)
        assert used <= window and {p[2] for p in parts} == {used if used & (used - 1) == 0 else window}
    want = defaultdict(list)
    for d, t, *_ in texts:
        ids = np.array([*encode(t or ""), 1], "<u4")
        for a in range(0, len(ids), window):
            part = ids[a:a + window]
            want[d].append((a, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert {d: sorted(x) for d, x in want.items()} == {d: sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in x) for d, x in left.items()}


@pytest.mark.parametrize("items", [50_000, 60])
def test_pack(spark, sf, items):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack(docs, shard_items=items).collect()
    check_packed(rows, docs.select("doc_id", "text").collect())
    used, stored = sum(r.length for r in rows), sum({r.sequence_id: r.padded for r in rows}.values())
    assert used / stored > (0.97 if items > 1000 else 0.8)


def test_pack_awkward(spark):
    check_packed(pack(corpus.frame(spark, corpus.awkward())).collect(), corpus.awkward())
    assert pack(corpus.frame(spark, [])).count() == 0


def test_ids_equal_the_named_tokenizer(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [t for _, t, _ in corpus.awkward() if t] + ["<|endoftext|> a", "it's we'll  \n\n\t x y\u0085z  　", "﻿​ 12٣ ½ ²"]
    draw = np.random.default_rng(0)
    texts += ["".join(map(chr, draw.choice([*range(32, 0x250), 0x2003, 0x3042, 0x1F600, 10, 9, 13], 200))) for _ in range(100)]
    encode = encoder().encode_ordinary
    assert all(encode(t) == other.encode(t, add_special_tokens=False).ids for t in texts)


def test_packed_ids_hold_the_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    named, mark = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = [f"{mark} a", f"a {mark}b", mark, mark * 3, f"x  {mark}  y", f"don{mark}'t", f"{mark[:-1]} {mark}{mark[1:]}", f"{mark[:6]}{mark}", f"é\n{mark}\n\n漢", f"one {mark} two " * 400, "no mark", None]
    left = defaultdict(list)
    for r in pack(corpus.frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect():
        left[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, t in enumerate(texts):
        ids = np.array([*named.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
        assert sorted(left[i]) == want, t


CHATS = "conv_id long, turn long, role string, text string, extra string, formatted string, example string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CHATS)


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "[INST]", "[\\INST]", "\\[INST]\\", "</s></s>", "<\\/s>", "[/INST][/INST", "a\nb", "[", "<", "/s>", "\\\\[", "ça \U0001f600", "[INST]x[/INST]y</s>" * 3]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", None, "sys[INST]tem"] * 4, odd))]
    rows += [(2, 0, "user", "q"), (2, 0, "user", "q"), (None, 1, "assistant", "z"), (None, None, "user", "first"), (3, 5, "user", "only")]
    formatted, examples = format_chats(chats(spark, rows))
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {c: [(r[2] or "", r[3] or "") for r in sorted((x for x in rows if x[0] == c), key=key)] for c in {r[0] for r in rows}}
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in read_back(formatted).collect()} == want
    whole = {r[0]: r[1] for r in formatted.collect()}
    parts = whole_examples(formatted, examples).collect()
    assert len(parts) == sum(r == "assistant" for v in want.values() for r, _ in v)
    for r in parts:
        assert whole[r.conv_id].startswith(r.context + r.reply + "</s>") and r.context.endswith("[INST]assistant[/INST]")
    for r in chat_digest(chats(spark, rows)).collect():
        loss = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()
        assert r.formatted_chars == len(whole[r.conv_id])
    assert chat_digest(chats(spark, [])).count() == 0


def test_loss_is_cut_out_of_the_formatted_text(spark, monkeypatch):
    from ringfence.llm import chat

    rows = chats(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "abc[INST]"), (1, 2, "assistant", "")])
    (right,) = chat_digest(rows).collect()
    assert right.loss_chars == len("abc[INST]") and right.n_examples == 2
    whole = chat.format_chats
    for moved in ({"reply_chars": F.lit(1).cast("long")}, {"context_chars": F.col("context_chars") - 1}):
        monkeypatch.setattr(chat, "format_chats", lambda c, m=moved: (whole(c)[0], whole(c)[1].withColumns(m)))
        assert chat_digest(rows).first().loss_sha256 != right.loss_sha256


def test_many_texts_without_words_in_one_source(spark):
    rows = spark.range(100_000).select("id", F.lit(None).cast("string").alias("text"), F.lit("a").alias("source"))
    rows = rows.unionByName(spark.createDataFrame([(-1, "one two", "a"), (-2, "x y z", "b")], "id long, text string, source string")).withColumnRenamed("id", "doc_id")
    got = mix_sources(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    assert {r.source: (r["size"], r.n) for r in got} == {"a": (2, 100_001), "b": (3, 1)} and sum(r.taken for r in got) == 5


def plain_top(rows, k=10):
    vectors = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
               if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for p, (q, a) in enumerate(vectors):
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(vectors) if n != p and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("shard, tile", [(1 << 15, 128), (7, 2)])
def test_top_k(spark, shard, tile):
    draw = np.random.default_rng(1)
    rows = [(int(i), draw.integers(-2, 3, 5).astype(float).tolist()) for i in range(120)] + [(100, [1.0] * 5), (7, [1.0] * 5), (8, None), (9, []), (10, [1.0, None, 0.0, 0.0, 0.0]),
            (11, [float("nan")] * 5), (200, [float("inf")] * 5), (300, [1.5, 2.0]), (301, [1.0, -0.5]), (None, [1.0] * 5), (400, [3e4] * 5), (401, [4e4] * 5)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, shard string, rank int")
    got = top_k(table, F.col("vec_id") % 100 == 0, shard_rows=shard, tile_rows=tile).collect()
    assert sorted(map(tuple, got)) == sorted(plain_top(rows))
    assert top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_products_are_exact():
    draw = np.random.default_rng(0)
    for size in (1000, 10**6, 2**28):
        a, b = draw.integers(-size, size, (3, 8)), draw.integers(-size, size, (5, 8))
        assert (product(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a])).all()
    assert sorted(best(np.array([[3, 5, 5, 1, 5]]), 2)[0].tolist()) == [1, 2]
